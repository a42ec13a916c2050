"""URL expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: query parameters that identify a listing, per store; sku patterns per store
KEPT_PARAMETERS = {"salcobrand": ("default_sku",)}
SKU_PATTERNS = {"maicao": r"/(CLMC_\d+|\d{5,})\.html"}
# end fixed values


def query_parameter(url: Column, name: str) -> Column:
    raw = F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
    return F.nullif(raw, F.lit(""))


def normalize_url(url: Column, store: Column | None = None,
                  kept: Mapping[str, Sequence[str]] = KEPT_PARAMETERS) -> Column:
    """Fragment and query dropped, except the parameters a store needs to tell listings apart."""
    base = F.regexp_replace(url, r"[?#].*$", "")
    if store is None:
        return base
    result = base
    for name, parameters in kept.items():
        pairs = [F.concat(F.lit(f"{p}="), query_parameter(url, p)) for p in parameters]
        query = F.concat_ws("&", *pairs)
        full = F.when(query != "", F.concat(base, F.lit("?"), query)).otherwise(base)
        result = F.when(store == name, full).otherwise(result)
    return result


def store_sku(store: Column, url: Column) -> Column:
    """The sku a listing URL carries: a path pattern or an identifying parameter, by store."""
    chain = F.lit(None).cast("string")
    for name, pattern in SKU_PATTERNS.items():
        chain = F.when(store == name, F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))).otherwise(chain)
    for name, parameters in KEPT_PARAMETERS.items():
        chain = F.when(store == name, query_parameter(url, parameters[0])).otherwise(chain)
    return chain
