"""Text expressions over columns: repair, expand, fold, extract.

Everything is a built-in expression, so it runs in the JVM next to the scan. Patterns are Unicode-aware ((?U)), independent of the JVM's default for word boundaries.
"""

from __future__ import annotations

import functools
import html
import json
import re
import sys
import unicodedata
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed


def rx(pattern: str, ignore_case: bool = False) -> str:
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def replace_all(text: Column, pattern: str, by: str = " ", ignore_case: bool = False) -> Column:
    return F.regexp_replace(text, rx(pattern, ignore_case), by)


def found(text: Column, pattern: str, group: int = 0, ignore_case: bool = True) -> Column:
    """First match of a pattern, or null."""
    return F.nullif(F.regexp_extract(text, rx(pattern, ignore_case), group), F.lit(""))


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.rlike(text, F.lit(rx(pattern, ignore_case)))


def squeeze(text: Column) -> Column:
    """Whitespace runs to one space, ends trimmed."""
    return F.trim(replace_all(text, r"\s+", " "))


def words_array(words) -> Column:
    quoted = ", ".join("'" + w.replace("'", "\\'") + "'" for w in words)
    return F.expr(f"CAST(array({quoted}) AS array<string>)")


# ------------------------------------------------------------- B1: encodings

def _single_bytes() -> dict[str, str]:
    """Characters that cp1252 reads from the bytes 80 to 9F, to the character with that byte's number."""
    read = {n: bytes([n]).decode("cp1252", "ignore") for n in range(0x80, 0xA0)}
    return {char: chr(n) for n, char in read.items() if char}


_WINDOWS = "".join(_single_bytes())
_LATIN = "".join(_single_bytes().values())
_HIGH = f"[\\x{{80}}-\\x{{FF}}{re.escape(_WINDOWS)}]"
SUSPECT = f"{_HIGH}{{2}}|Â"


def _bytes_class(first: int, last: int) -> str:
    """A class of the characters, of either reading, that stand for a range of bytes."""
    also = "".join(c for c, n in _single_bytes().items() if first <= ord(n) <= last)
    return f"[\\x{{{first:X}}}-\\x{{{last:X}}}{re.escape(also)}]"


def _utf8_sequences() -> str:
    """The well-formed multi-byte sequences of UTF-8, as the standard tabulates them."""
    table = [((0xC2, 0xDF), (0x80, 0xBF)), ((0xE0, 0xE0), (0xA0, 0xBF), (0x80, 0xBF)), ((0xE1, 0xEC), (0x80, 0xBF), (0x80, 0xBF)),
             ((0xED, 0xED), (0x80, 0x9F), (0x80, 0xBF)), ((0xEE, 0xEF), (0x80, 0xBF), (0x80, 0xBF)),
             ((0xF0, 0xF0), (0x90, 0xBF), (0x80, 0xBF), (0x80, 0xBF)), ((0xF1, 0xF3), (0x80, 0xBF), (0x80, 0xBF), (0x80, 0xBF)),
             ((0xF4, 0xF4), (0x80, 0x8F), (0x80, 0xBF), (0x80, 0xBF))]
    return "|".join("".join(_bytes_class(*r) for r in row) for row in table)


_SEQUENCES = _utf8_sequences()


def repaired(text: Column) -> Column:
    """UTF-8 that was read byte by byte, read again: sequences within runs of high characters are decoded where they are well-formed.

    A text is cut where high characters begin and end; a run is taken apart into sequences and single characters. A left-over byte that
    stood for an accented capital before a non-letter is a space. White space is squeezed in texts that change.
    """
    pieces = F.split(text, f"(?<={_HIGH})(?!{_HIGH})|(?<!{_HIGH})(?={_HIGH})")
    decoded = lambda t: F.decode(F.encode(F.translate(t, _WINDOWS, _LATIN), "ISO-8859-1"), "UTF-8")
    one = lambda t: F.when(F.char_length(t) > 1, decoded(t)).otherwise(F.translate(t, _LATIN, _WINDOWS))
    run = lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(f"{_SEQUENCES}|(?s:.)"), F.lit(0)), one), "")
    joined = F.array_join(F.transform(pieces, lambda p: F.when(F.rlike(p, F.lit(f"^{_HIGH}{{2}}")), run(p)).otherwise(p)), "")
    changed = F.regexp_replace(joined, r"(?U)Â(?![^\W\d_])", " ")
    return F.when(changed == text, text).otherwise(squeeze(changed))


def repair_encoding(df: DataFrame, *columns: str) -> DataFrame:
    """The columns repaired; texts without a suspicious character are passed on as they are."""
    fix = lambda c: F.when(F.rlike(c, F.lit(SUSPECT)), repaired(c)).otherwise(c)
    return df.withColumns({name: fix(F.col(name)) for name in columns})


# ------------------------------------------------------- B2, B16, B42: words

def expand_abbreviations(text: Column) -> Column:
    """Lower case, store splits, dictionary abbreviations, single spaces. Repair encodings first."""
    text = F.lower(text)
    for pattern, by in fixed.SPLITS + fixed.ABBREVIATIONS:
        text = replace_all(text, pattern, by)
    return squeeze(text)


def expand_set_contents(text: Column) -> Column:
    text = expand_abbreviations(text)
    for pattern, by in fixed.SET_CONTENT:
        text = replace_all(text, pattern, by)
    return squeeze(text)


def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition keeps one ASCII character, what they keep, and those that keep several."""
    source, target, several = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        kept = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(kept) == 1:
            source.append(chr(code))
            target.append(kept)
        elif kept:
            several[chr(code)] = kept
    return "".join(source), "".join(target), several


FOLD_FROM, FOLD_TO, FOLD_SEVERAL = _folds()
_FOLD_SEVERAL = f"[{re.escape(''.join(FOLD_SEVERAL))}]"


def constant_map(entries: dict[str, str]) -> Column:
    """A map known when the query is planned, whatever its size."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def fold(text: Column) -> Column:
    """Accents removed and compatibility characters spelt out (NFKD); what has no ASCII base is deleted, not blanked."""
    known = constant_map(FOLD_SEVERAL)
    spelt = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(known[c], c)), "")
    spelt = F.when(F.rlike(text, F.lit(_FOLD_SEVERAL)), spelt).otherwise(text)
    folded = F.regexp_replace(F.translate(spelt, FOLD_FROM, FOLD_TO), r"[^\x00-\x7F]", "")
    return F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), folded).otherwise(text)  # the wide classes are slow: ASCII texts pass them by


def plain(text: Column) -> Column:
    """The catalog search key: lower case, common accents and apostrophes removed."""
    return F.translate(F.lower(text), fixed.PLAIN_FROM, fixed.PLAIN_TO)


def title_case(text: Column) -> Column:
    """Every letter run capitalised, so hyphens and apostrophes start a new word."""
    parts = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(parts, F.initcap), "")


# ------------------------------------------------------------- B3-B10, B46

def extract_concentration(text: Column) -> Column:
    chain = None
    for pattern, code in fixed.CONCENTRATION_PATTERNS:
        test = matches(text, pattern)
        chain = F.when(test, code) if chain is None else chain.when(test, code)
    return chain


def to_concentration(code: Column) -> Column:
    chain = None
    for name, value in fixed.CONCENTRATION_CODES.items():
        test = F.upper(code) == name
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain


def extract_volume(text: Column) -> Column:
    return found(text, fixed.VOLUME)


def to_volume_ml(text: Column) -> Column:
    """A size text as whole millilitres; unit counts and non-sizes are null."""
    text = F.trim(text)
    number = F.regexp_extract(text, rx(fixed.EXACT_VOLUME, True), 1)
    unit = F.lower(F.regexp_extract(text, rx(fixed.EXACT_VOLUME, True), 2))
    thousands = unit.isin("ml", "cc") & F.rlike(number, F.lit(r"^\d{1,3}\.\d{3}$"))
    written = F.when(thousands, F.regexp_replace(number, r"\.", "")).otherwise(F.regexp_replace(number, ",", "."))
    amount = F.nullif(written, F.lit("")).try_cast("decimal(18,6)")
    litres = ~unit.isin("ml", "cc")
    whole = F.round(F.when(litres, amount * 1000).otherwise(amount), 0).cast("int")
    return F.when(whole > 0, whole)


def to_price(text: Column) -> Column:
    """A price text as whole units; null when absent or unreadable (see bad_price)."""
    digits = F.regexp_extract(F.trim(text), rx(fixed.EXACT_PRICE), 1)
    return F.nullif(F.regexp_replace(digits, r"\.", ""), F.lit("")).try_cast("bigint")


def bad_price(text: Column) -> Column:
    return F.coalesce((text != "") & ~F.rlike(F.trim(text), F.lit(rx(fixed.EXACT_PRICE))), F.lit(False))


def price_text(amount: Column) -> Column:
    """12999 as "$12.999"; blank, zero and negative amounts are null. Halves round to even."""
    value = F.bround(amount.try_cast("double"), 0).cast("bigint")
    return F.when(value > 0, F.concat(F.lit("$"), F.translate(F.format_number(value, 0), ",", ".")))


def declared_gender(terms: Column) -> Column:
    """A store's gender terms (array) as male, female, unisex or null."""
    terms = F.array_sort(F.array_distinct(F.coalesce(terms, F.array().cast("array<string>"))))
    only = F.when(F.size(terms) == 1, F.element_at(terms, 1))
    chain = F.when(F.size(terms) > 1, "unisex")
    for term, value in fixed.DECLARED_GENDER_TERMS.items():
        chain = chain.when(only == term, value)
    return chain


def image_url(text: Column) -> Column:
    text = F.trim(text)
    return F.when(F.startswith(text, F.lit("https://")), text)


def short_code(identity: Column) -> Column:
    return F.substring(F.sha1(identity), 1, 4)


@functools.lru_cache(maxsize=1)
def _odd_numbers() -> dict[str, str]:
    """Numeric references that don't stand for the character of their number."""
    asked = [*range(0xA0), *range(0xFDD0, 0xFDF0), *(p << 16 | n for p in range(17) for n in (0xFFFE, 0xFFFF))]
    return {str(n): html.unescape(f"&#{n};") for n in asked if html.unescape(f"&#{n};") != chr(n)}


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unescape_html(text: Column) -> Column:
    """All character references of HTML, named (with or without semicolon, as browsers read them), decimal and hexadecimal."""
    def number(value: Column, odd: Column) -> Column:
        good = value.between(0, sys.maxunicode) & ~value.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")
        return F.when(good, F.coalesce(odd[value.cast("string")], char)).otherwise(F.lit("\ufffd"))

    def numbered(piece: Column, odd: Column) -> Column:
        """What follows an ampersand and a number sign."""
        decimal, hexadecimal = F.regexp_extract(piece, r"^#([0-9]+);?", 1), F.regexp_extract(piece, r"^#[xX]([0-9a-fA-F]+);?", 1)
        small = F.when(F.char_length(F.ltrim(hexadecimal, F.lit("0"))) <= 8, F.conv(hexadecimal, 16, 10))
        value = F.when(decimal != "", decimal.try_cast("bigint")).otherwise(small.cast("bigint"))
        rest = F.regexp_replace(piece, r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", "")
        return F.when((decimal != "") | (hexadecimal != ""), F.concat(bound(value, lambda v: number(v, odd)), rest))

    def named(piece: Column, names: Column) -> Column:
        """What follows an ampersand: the longest start of it that is a name, and the rest."""
        def longest(name: Column) -> Column:
            whole = F.when(names[name].isNotNull(), F.char_length(name))
            sizes = F.when(F.char_length(name) > 1, F.sequence(F.char_length(name), F.lit(2), F.lit(-1)))
            return F.coalesce(whole, F.get(F.filter(sizes, lambda n: names[F.substring(name, F.lit(1), n)].isNotNull()), F.lit(0)))

        size = bound(F.regexp_extract(piece, r"^[^\t\n\f <&#;]{1,32};?", 0), longest)
        return bound(size, lambda n: F.concat(names[F.substring(piece, F.lit(1), n)], F.substring(piece, n + 1, F.char_length(piece))))

    def whole(known: Column) -> Column:
        read = lambda p: F.coalesce(F.when(F.startswith(p, F.lit("#")), numbered(p, known["odd"])).otherwise(named(p, known["names"])),
                                    F.concat(F.lit("&"), p))
        return F.concat(F.get(known["pieces"], F.lit(0)), F.array_join(F.transform(F.slice(known["pieces"], 2, F.size(known["pieces"])), read), ""))

    def one(t: Column) -> Column:
        known = F.struct(F.split(t, "&").alias("pieces"), constant_map(html5).alias("names"), constant_map(_odd_numbers()).alias("odd"))
        return F.when(F.contains(t, F.lit("&")), bound(known, whole)).otherwise(t)

    return bound(text, one)
