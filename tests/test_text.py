"""Folding and character references against the standard library, over all there is."""

import html
import random
import sys
import unicodedata
from html.entities import html5

from pyspark.sql import functions as F

from shelfwise.functions import text as X


def read(spark, values, function):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["got"] for r in frame.select("i", function(F.col("v")).alias("got")).orderBy("i").collect()]


def test_fold_is_compatibility_decomposition_of_all_characters(spark):
    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    values = ["".join(chars[i:i + 500]) for i in range(0, len(chars), 500)] + ["Chanel № 5 ﬁne Kenzo™ ½", "Ｆｕｌｌ", "", None]
    want = [v and unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode() for v in values]
    assert read(spark, values, X.fold) == want


def test_unescape_html_reads_all_references(spark):
    draw = random.Random(4)
    values = ["&" + n for n in html5] + ["Ni&ntilde;a caf&eacute; &#233;", "&notit; &amp;lt; & &; &#; &#x; &#xe9 &copy=1", "&#0;&#128;&#11;&#55296;&#1114112;",
                                         "&#99999999999999999999;&#xFFFFFFFFFFFFFFFFFF;&#x1F600;", "&&&amp", "", None]
    values += ["".join(draw.choice(["&", "#", "x", "amp", "lt;", "3", "9", ";", " ", "not", "it", "é"]) for _ in range(12)) for _ in range(1000)]
    assert read(spark, values, X.unescape_html) == [v and html.unescape(v) for v in values]


def test_repair_reads_bytes_again(spark):
    """What cp1252 or latin-1 made of UTF-8; broken sequences stay, single bytes read as cp1252 does."""
    whole = ["café ñandú", "“quoted” – dash", "日本語 😀", "Ângel", "plain"]
    broken = [w.encode().decode("latin-1") for w in whole] + [w.encode().decode("cp1252", "ignore") for w in ("café ñandú", "é", "–")]
    values = [*broken, *whole[3:], "Ã", "ÃÃ©Ã", "Â x", "\x93\x94", None]
    want = [*whole, "café ñandú", "é", "–", "Ângel", "plain", "Ã", "ÃéÃ", "x", "“”", None]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r["v"] for r in X.repair_encoding(frame, "v").orderBy("i").collect()]
    assert got == want
    assert "Python" not in X.repair_encoding(frame, "v")._jdf.queryExecution().toString()
