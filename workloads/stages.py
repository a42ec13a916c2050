"""Tables several queries share, built once per session and folder, as a job's stages would be."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_BUILT: dict[tuple, Any] = {}


def stage(spark, folder: str, name: str, build: Callable[[], Any]):
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def built(spark, folder: str, name: str) -> bool:
    return (spark.sparkContext.applicationId, folder, name) in _BUILT


def forget() -> None:
    _BUILT.clear()
