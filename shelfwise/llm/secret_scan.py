"""Secrets in texts, also under nested encodings: a worklist of decoded layers, each scanned anew, spans mapped back to the text.

A layer is a string of bytes and a map of its spans to those of the layer it came from. Rewriting layers replace URL escapes (%41) or Unicode
escapes (backslash u, U, x; numeric character references) in place, so a secret may be part escaped; base64 layers hold what a token
decodes to; unpacked layers what a zlib, gzip, bzip2, xz or zstd stream holds. New layers join the worklist until none is left to unwrap.
A layer whose bytes stand for the same part of the text as those of an earlier one, or are those of a layer around it, is not opened again,
so streams that unpack to themselves end.
"""

from __future__ import annotations

import bisect
import binascii
import bz2
import lzma
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

#: Kinds of secrets in the order in which spans of the same start are listed: pattern, the group that is measured, its least length.
KINDS = {
    "assign": (re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I), 2, 6),
    "access": (re.compile(rb"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(rb"[0-9a-f]+"), 0, 24),
}
#: The same runs, found faster: shorter ones are dropped anyway, and a run can't be cut shorter by its own beginning.
_QUICK = {"access": re.compile(rb"AKIA[A-Z0-9]{16,}"), "hex": re.compile(rb"[0-9a-f]{24,}")}

#: Guards against texts made to unpack without end: bytes of one unpacked layer, of all layers of a text, and number of its layers.
#: Layers beyond them are counted in `unopened`.
LAYER_BYTES, ALL_BYTES, MOST_LAYERS = 32 << 20, 256 << 20, 10_000

URL_ESCAPE = re.compile(rb"%(?:25)*([0-9A-Fa-f]{2})")
UNICODE_ESCAPE = re.compile(rb"\\+u\{([0-9A-Fa-f]{1,6})\}|\\+u([0-9A-Fa-f]{4})(?:\\+u([Dd][C-Fc-f][0-9A-Fa-f]{2}))?|\\+U([0-9A-Fa-f]{8})"
                            rb"|\\+x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
#: Base64 in either alphabet, on one line or wrapped.
BASE64 = (re.compile(rb"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(rb"[A-Za-z0-9_-]{16,}={0,2}"),
          re.compile(rb"(?:[A-Za-z0-9+/]{60,76}\r?\n)+[A-Za-z0-9+/]{1,76}={0,2}"))
_CONTROLS = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]")
_NOT_PLAIN = re.compile(rb"[-_\r\n]")

Span = tuple[int, int]


class Pieces:
    """A rewritten layer: pieces that were replaced, between pieces that stay as they are."""

    def __init__(self) -> None:
        self.at: list[int] = []  # begin of each piece in the layer
        self.begin: list[int] = []  # and of what it stands for
        self.end: list[int] = []
        self.replaced: list[bool] = []

    def add(self, at: int, begin: int, end: int, replaced: bool) -> None:
        self.at.append(at)
        self.begin.append(begin)
        self.end.append(end)
        self.replaced.append(replaced)

    def span(self, start: int, stop: int) -> Span:
        first, last = bisect.bisect_right(self.at, start) - 1, bisect.bisect_right(self.at, stop - 1) - 1
        begin = self.begin[first] + (0 if self.replaced[first] else start - self.at[first])
        end = self.end[last] if self.replaced[last] else self.begin[last] + stop - self.at[last]
        return begin, end

    def holds_decoded(self, start: int, stop: int) -> bool:
        """Whether some byte of the span was decoded; others were scanned in the layer before. Pieces alternate, so two suffice."""
        first, last = bisect.bisect_right(self.at, start) - 1, bisect.bisect_right(self.at, stop - 1) - 1
        return last > first or self.replaced[first]


class Layer:
    """Bytes, the layer they came from, and where in it they stand."""

    def __init__(self, body: bytes, parent: Layer | None = None, place: Callable[[int, int], Span] | None = None, fresh=None) -> None:
        self.body, self.parent, self.place, self.fresh = body, parent, place, fresh

    def origin(self, start: int, stop: int) -> Span:
        """The bytes of the text that a span of this layer comes from."""
        layer = self
        while layer.parent is not None:
            start, stop = layer.place(start, stop)
            layer = layer.parent
        return start, stop

    def around(self) -> Iterator[Layer]:
        layer = self.parent
        while layer is not None:
            yield layer
            layer = layer.parent

    def new(self, start: int, stop: int) -> bool:
        return self.fresh is None or self.fresh(start, stop)


def matches(body: bytes) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the secrets of a layer: leftmost matches that don't overlap, of which those too short are dropped."""
    for kind, (pattern, group, least) in KINDS.items():
        for found in _QUICK.get(kind, pattern).finditer(body):
            if found.end(group) - found.start(group) >= least:
                yield kind, *found.span()


def rewrite(layer: Layer, pattern: re.Pattern, decoded: Callable[[re.Match], bytes | None]) -> Layer | None:
    """The layer with all escapes replaced; None without any."""
    body, pieces, out, at, size = layer.body, Pieces(), [], 0, 0
    for found in pattern.finditer(body):
        new = decoded(found)
        if new is None:
            continue
        start, stop = found.span()
        if start > at:
            out.append(body[at:start])
            pieces.add(size, at, start, False)
            size += start - at
        out.append(new)
        pieces.add(size, start, stop, True)
        size += len(new)
        at = stop
    if not out:
        return None
    if at < len(body):
        out.append(body[at:])
        pieces.add(size, at, len(body), False)
    return Layer(b"".join(out), layer, pieces.span, pieces.holds_decoded)


def _url(found: re.Match) -> bytes:
    return bytes((int(found[1], 16),))


def _unicode(found: re.Match) -> bytes | None:
    """UTF-8 of an escaped code point; \\x stands for a byte; None for half a surrogate pair or no code point."""
    if found[5]:
        return bytes((int(found[5], 16),))
    code = int(found[1] or found[2] or found[4] or found[7] or b"0", 16) if not found[6] else int(found[6])
    if found[3]:
        if not 0xD800 <= code <= 0xDBFF:
            return None
        code = 0x10000 + (code - 0xD800 << 10) + int(found[3], 16) - 0xDC00
    return None if 0xD800 <= code <= 0xDFFF or code > 0x10FFFF else chr(code).encode()


def _bits(begin: int, stays: list[int] | None) -> Callable[[int, int], Span]:
    """Byte i of a decoded token comes from the characters that hold bits 8i to 8i + 8; of a wrapped one, `stays` are the places without breaks."""
    def place(start: int, stop: int) -> Span:
        first, last = start * 8 // 6, -(-stop * 8 // 6) - 1
        return (begin + first, begin + last + 1) if stays is None else (begin + stays[first], begin + stays[last] + 1)

    return place


def base64_layers(layer: Layer) -> Iterator[Layer]:
    """What each token decodes to, if that is a compressed stream or text: valid UTF-8 without control characters."""
    for pattern in BASE64:
        for found in pattern.finditer(layer.body):
            token = found[0]
            if pattern is not BASE64[0] and not _NOT_PLAIN.search(token) or not layer.new(*found.span()):
                continue
            plain = token.rstrip(b"=").replace(b"\r", b"").replace(b"\n", b"").replace(b"-", b"+").replace(b"_", b"/")
            if len(plain) % 4 == 1:
                continue
            body = binascii.a2b_base64(plain + b"=" * (-len(plain) % 4))
            if not packed(body):
                if _CONTROLS.search(body):
                    continue
                try:
                    body.decode()
                except UnicodeDecodeError:
                    continue
            stays = [i for i, c in enumerate(token) if c not in b"\r\n"] if b"\n" in token else None
            yield Layer(body, layer, _bits(found.start(), stays))


def packed(body: bytes) -> str | None:
    """Which compressed stream the bytes begin as."""
    if body[:3] == b"\x1f\x8b\x08":
        return "gzip"
    if body[:3] == b"BZh" and body[4:10] == b"1AY&SY":
        return "bzip2"
    if body[:6] == b"\xfd7zXZ\x00":
        return "xz"
    if body[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd"
    if len(body) > 5 and body[0] & 15 == 8 and body[0] >> 4 <= 7 and (body[0] << 8 | body[1]) % 31 == 0:
        return "zlib"
    return None


def unpack(body: bytes, kind: str, most: int) -> tuple[bytes, bool]:
    """(unpacked bytes, whether more than `most` would come); a broken stream gives what came before the break."""
    out, size = [], 0
    try:
        for part in _unpacked(body, kind):
            out.append(part)
            size += len(part)
            if size > most:
                return b"", True
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
        pass
    return b"".join(out), False


def _unpacked(body: bytes, kind: str, some: int = 1 << 20) -> Iterator[bytes]:
    if kind == "zstd":
        with zstandard.ZstdDecompressor().stream_reader(body) as reader:
            while part := reader.read(some):
                yield part
    elif kind in ("gzip", "zlib"):
        stream = zlib.decompressobj(31 if kind == "gzip" else 15)
        while part := stream.decompress(body, some):
            yield part
            body = stream.unconsumed_tail
    else:
        stream = bz2.BZ2Decompressor() if kind == "bzip2" else lzma.LZMADecompressor()
        while not stream.eof and (part := stream.decompress(body, some)):
            yield part
            body = b""


def children(layer: Layer, most: int) -> tuple[list[Layer], int]:
    """(layers unwrapped from one, number of streams left unopened because they hold more than `most` bytes)."""
    found, unopened = [], 0
    if b"%" in layer.body:
        found.append(rewrite(layer, URL_ESCAPE, _url))
    if b"\\" in layer.body or b"&#" in layer.body:
        found.append(rewrite(layer, UNICODE_ESCAPE, _unicode))
    found.extend(base64_layers(layer))
    kind = packed(layer.body) if layer.parent is not None else None
    if kind:
        body, more = unpack(layer.body, kind, most)
        unopened += more
        if body and not more:
            found.append(Layer(body, layer, lambda start, stop, n=len(layer.body): (0, n)))
    return [f for f in found if f is not None and f.body], unopened


def scan(text: bytes, layer_bytes: int = LAYER_BYTES, all_bytes: int = ALL_BYTES, most_layers: int = MOST_LAYERS) -> tuple[list, list, int, int]:
    """(spans of the text itself, further spans of its decoded layers, layers opened, layers left unopened); spans are (kind, start, end) in bytes."""
    base = list(matches(text))
    known, added = set(base), set()
    seen, waiting = set(), deque([Layer(text)])
    opened = unopened = size = 0
    while waiting:
        layer = waiting.popleft()
        if layer.parent is not None:
            for kind, start, stop in matches(layer.body):
                if layer.new(start, stop):
                    span = (kind, *layer.origin(start, stop))
                    if span not in known:
                        added.add(span)
        found, left = children(layer, layer_bytes)
        unopened += left
        for child in found:
            where = child.origin(0, len(child.body))
            key = (xxhash.xxh128_digest(child.body), *where)
            if key in seen or any(a.body == child.body for a in child.around()):
                continue
            if opened >= most_layers or size + len(child.body) > all_bytes:
                unopened += 1
                continue
            seen.add(key)
            opened, size = opened + 1, size + len(child.body)
            waiting.append(child)
    return base, sorted(added), opened, unopened


_ORDER = {kind: i for i, kind in enumerate(KINDS)}


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def in_code_points(text: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Byte offsets as code-point offsets; spans begin and end with ASCII characters."""
    if text.isascii():
        return spans
    place, at, units = {}, 0, 0
    for offset in sorted({o for _, *both in spans for o in both}):
        units += len(text[at:offset].decode("utf-8", "replace"))
        at, place[offset] = offset, units
    return [(kind, place[start], place[stop]) for kind, start, stop in spans]


SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for whole in batches:
        for batch in words.slices(whole, "text"):
            rows = []
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                base, added, opened, unopened = scan(text or b"")
                lists = [[dict(zip(("kind", "start", "end"), s)) for s in in_order(in_code_points(text or b"", part))] for part in (base, added)]
                rows.append((*lists, opened, unopened))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(columns[0], kind), pa.array(columns[1], kind), *(pa.array(c, pa.int64()) for c in columns[2:])],
                names=["id", "base", "added", "layers", "unopened"])


def find_secrets(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `documents`: the id, base, added, layers, unopened.

    base are the spans of the text itself, added those found in decoded layers that base doesn't have: the part of the text
    that the secret was decoded from. Spans are (kind, start, end) in code points, end exclusive, by start, kind and end. layers counts
    the decoded layers, unopened those beyond the guards of this module. A null or empty text has no spans; null ids stay null;
    repeated rows are scanned each; other columns are ignored, whatever their names; an empty table gives no rows. One scan, no shuffle.
    """
    plain = words.small_batches(documents).select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kinds = f"id {plain.schema['id'].dataType.simpleString()}, base {SPANS}, added {SPANS}, layers long, unopened long"
    return plain.mapInArrow(_scan, kinds).withColumnRenamed("id", id_column)
