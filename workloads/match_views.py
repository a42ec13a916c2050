"""part as a catalog of listings from six stores, with brand and name spellings that vary by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.fixed import Lexicon
from shelfwise.operators import tokens as T

from .views import table

CODES = {"(M)": "mujer", "(H)": "hombre"}
LEXICON = Lexicon(gender_codes={"store4": CODES, "store5": CODES})
SYLLABLES = {"0": "lo", "1": "mar", "2": "kes", "3": "bru", "4": "vin", "5": "tax", "6": "hol", "7": "quo", "8": "fen", "9": "zip"}

# One text for both engines: only functions Spark and DuckDB share.
_BRAND = "substr(p_brand, 7)"
for _digit, _syllable in SYLLABLES.items():
    _BRAND = f"replace({_BRAND}, '{_digit}', '{_syllable}')"
LISTING_COLUMNS = f"""
  p_partkey AS listing_id, concat('store', CAST(p_partkey % 6 AS {{text}})) AS store,
  CASE WHEN p_partkey % 37 = 0 THEN NULL WHEN p_partkey % 23 = 0 THEN upper({_BRAND}) WHEN p_partkey % 19 = 0 THEN concat({_BRAND}, 'x')
       ELSE {_BRAND} END AS brand,
  concat(p_name, CASE WHEN p_partkey % 17 = 0 THEN substr(p_name, length(p_name), 1) ELSE '' END,
    CASE WHEN p_size % 12 = 0 THEN ' intense' WHEN p_size % 12 = 1 THEN ' Gold' ELSE '' END,
    CASE WHEN p_size % 15 = 0 THEN ' No. 5' ELSE '' END,
    CASE p_type WHEN 'PROMO' THEN ' EDT' WHEN 'ECONOMY' THEN ' edp' WHEN 'SMALL' THEN ' Eau de Parfum' ELSE '' END,
    CASE p_partkey % 13 WHEN 0 THEN ' for Men' WHEN 1 THEN ' women' WHEN 2 THEN ' (M)' WHEN 3 THEN ' (H)' ELSE '' END,
    CASE WHEN p_partkey % 29 = 0 THEN ' Set' ELSE '' END,
    CASE WHEN p_partkey % 5 = 0 THEN ' X' ELSE ' ' END, CAST((p_size % 3 + 1) * 50 AS {{text}}),
    CASE WHEN p_partkey % 5 = 0 THEN 'Ml' ELSE ' ml' END) AS name,
  CASE WHEN p_partkey % 31 <> 0 THEN CAST((p_size % 3 + 1) * 50 AS INT) END AS volume_ml,
  CASE p_type WHEN 'PROMO' THEN 'edt' WHEN 'ECONOMY' THEN 'edp' WHEN 'SMALL' THEN 'edp' END AS concentration,
  concat('https://store', CAST(p_partkey % 6 AS {{text}}), '.example/p/', CAST(p_partkey AS {{text}})) AS listing_url
"""


def match_listings(spark: SparkSession, folder: str) -> DataFrame:
    columns = LISTING_COLUMNS.format(text="STRING")
    return table(spark, folder, "part").selectExpr(*_split(columns), "p_partkey", "p_size", "p_brand", "p_name", "p_type")


def _split(text: str) -> list[str]:
    """Top-level comma split of a select list."""
    parts, depth, quoted, current = [], 0, False, ""
    for char in text:
        if char == "'":
            quoted = not quoted
        if not quoted:
            depth += (char == "(") - (char == ")")
            if char == "," and depth == 0:
                parts.append(current)
                current = ""
                continue
        current += char
    return [*parts, current]


LISTINGS_SQL = f"m AS (SELECT {LISTING_COLUMNS.format(text='VARCHAR')}, p_partkey, p_size, p_brand, p_name, p_type FROM part)"


def with_vectors(spark: SparkSession, folder: str, listings: DataFrame) -> DataFrame:
    """Each listing takes the vector numbered by its key modulo the table's size."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    count = vectors.agg(F.count(F.lit(1))).scalar()
    return listings.withColumn("vec_id", F.pmod("p_partkey", count)).join(vectors, "vec_id").drop("vec_id")


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    return T.tokenize_listings(match_listings(spark, folder), LEXICON)


def token_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return with_vectors(spark, folder, tokens(spark, folder))


LABEL = ("CASE WHEN p_name = other_name AND p_type = other_type THEN 'same' WHEN p_type = other_type "
         "THEN 'same_fragrance_unknown_size' ELSE 'different' END")
LABELS_SQL = f"""
label_pairs AS (
  SELECT least(listing_url, other_url) AS url_a, greatest(listing_url, other_url) AS url_b, {LABEL} AS label, listing_id
  FROM (SELECT *, lead(listing_url) OVER w AS other_url, lead(p_name) OVER w AS other_name, lead(p_type) OVER w AS other_type
        FROM m WINDOW w AS (PARTITION BY p_brand, p_size ORDER BY listing_id)) WHERE other_url IS NOT NULL
)"""


def label_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Reviewed pairs: listings next to each other among those of one brand and size code."""
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand", "p_size").orderBy("listing_id")
    m = match_listings(spark, folder).select(
        "*", F.lead("listing_url").over(w).alias("other_url"), F.lead("p_name").over(w).alias("other_name"),
        F.lead("p_type").over(w).alias("other_type")).where("other_url IS NOT NULL")
    return m.select(F.least("listing_url", "other_url").alias("url_a"), F.greatest("listing_url", "other_url").alias("url_b"),
                    F.expr(LABEL).alias("label"), "listing_id")


# Tokens of m in SQL: the expansions this catalog's names can trigger.
TOKENS_SQL = LISTINGS_SQL + """,
full_text AS (
  SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(concat(coalesce(brand, ''), ' ', name)),
    '\\bx(\\d)', '\\1', 'g'), '([a-z])(\\d)', '\\1 \\2', 'g'), '(\\d)\\s*(ml|m)\\b', '\\1 ml', 'g'), '\\s+', ' ', 'g')) AS expanded,
    lower(coalesce(brand, '')) AS brand_key,
    CASE WHEN brand IS NULL THEN [] ELSE [lower(brand)] END AS brand_words
  FROM m
),
t AS (
  SELECT *, regexp_extract_all(expanded, '[a-z]+') AS words,
    regexp_matches(lower(name), '\\bset\\b') AS is_set,
    replace(replace(expanded, '(m)', CASE WHEN store IN ('store4', 'store5') THEN 'mujer' ELSE '(m)' END),
            '(h)', CASE WHEN store IN ('store4', 'store5') THEN 'hombre' ELSE '(h)' END) AS coded
  FROM full_text
),
t2 AS (
  SELECT *, regexp_extract_all(coded, '[a-z]+') AS coded_words,
    CASE WHEN list_contains(words, 'men') AND NOT list_contains(words, 'women') THEN 'male'
         WHEN list_contains(words, 'women') AND NOT list_contains(words, 'men') THEN 'female' END AS gender
  FROM t
),
t3 AS (
  SELECT *, CASE WHEN gender IS NOT NULL THEN gender WHEN list_contains(coded_words, 'hombre') THEN 'male'
                 WHEN list_contains(coded_words, 'mujer') THEN 'female' END AS coded_gender,
    list_sort(list_distinct(list_filter(words, lambda w: len(w) > 2 AND w NOT IN
      ('men', 'women', 'for', 'set', 'edp', 'edt', 'eau', 'parfum', 'new')))) AS core,
    list_sort(list_distinct(list_filter(words, lambda w: w IN ('intense', 'gold')))) AS exact_variants,
    CASE WHEN is_set THEN [] ELSE list_distinct(regexp_extract_all(regexp_replace(regexp_replace(expanded,
      '\\d+ ml\\b', ' ', 'g'), '\\bno\\s*\\.?\\s*(\\d)', ' \\1', 'g'), '\\b\\d+[a-z]*')) END AS editions
  FROM t2
)"""
