"""The queries opN_<name>, each applying one operator to its whole table, and the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from . import code_search, fill_middle, mixing, near_duplicates, packing, periodic, quality, secret_scan, site_style, token_counts, toxicity, training, url_rules, vector_links

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def judged(scored: DataFrame, held_out, least: float) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= least).cast("int").alias("predicted"))


#: Least score of a good text, and of a toxic one.
GOOD, TOXIC = 0.7, 0.5


def quality_model(documents, labels):
    return quality.train(documents, labels.where(training.fold(F.col("doc_id"), 4) != 2))


@query("op1_quality")
def op1_quality(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = quality_model(documents, table(spark, folder, "labels"))
    return judged(quality.score(documents, model, keep=["doc_id"]), training.fold(F.col("doc_id"), 4) == 2, GOOD)


@query("op2_token_counts")
def op2_token_counts(spark, folder):
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


def toxicity_model(documents, labels):
    return toxicity.train(documents, labels.where(training.fold(F.col("doc_id"), 5) != 0))


@query("op3_toxicity")
def op3_toxicity(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    net = toxicity_model(documents, table(spark, folder, "labels"))
    return judged(toxicity.score(documents, net, keep=["doc_id"]), training.fold(F.col("doc_id"), 5) == 0, TOXIC)


@query("op4_near_vectors")
def op4_near_vectors(spark, folder):
    return vector_links.near_vectors(table(spark, folder, "embeddings"))


@query("op5_nearest_codes", """
WITH coded AS (SELECT vec_id, [CASE WHEN x > 0 THEN 1 ELSE 0 END FOR x IN embedding] AS code FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id AS neighbour_id, list_sum([abs(p[1] - p[2]) FOR p IN list_zip(q.code, r.code)]) AS distance
  FROM coded q JOIN coded r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbour_id, CAST(distance AS INTEGER) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM pairs) WHERE rank <= 10
""")
def op5_nearest_codes(spark, folder):
    """The ten nearest sign codes of every embedding whose id is divisible by 50, among all."""
    return code_search.nearest_codes(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op6_mixing")
def op6_mixing(spark, folder):
    documents = table(spark, folder, "documents")
    sized = cut(documents.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.array("source").alias("sources")))
    mix = mixing.plan_mix(sized, "doc_id", "size", "sources")
    taken = mixing.with_targets(mix.decide(sized, "doc_id", "size", "sources"), mix, "source")
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


@query("op7_packing")
def op7_packing(spark, folder):
    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: The fixed rules of the URL filter: action, host and path.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


@query("op10_url_rules")
def op10_url_rules(spark, folder):
    """Labels of documents reach urls by the document number that ends a url's path; bad is toxic or of low quality."""
    pages, labels = table(spark, folder, "pages"), table(spark, folder, "labels")
    number = F.expr("try_cast(regexp_extract(url, '/([0-9]+)(?:/|[.]html)?(?:[?#].*)?$', 1) AS bigint)")
    bad = labels.select(F.col("doc_id").alias("number"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    labelled = pages.select("url", number.alias("number")).join(bad, "number")
    judged = url_rules.judge(pages, URL_RULES, url_rules.mine(labelled, "url", "bad"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


NEAR_DUPLICATES_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
lowest AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN lowest USING (doc_id)
"""


@query("op8_near_duplicates", NEAR_DUPLICATES_SQL)
def op8_near_duplicates(spark, folder):
    return near_duplicates.near_duplicates(table(spark, folder, "documents"), width=3, percent=85)


@query("op9_main_text")
def op9_main_text(spark, folder):
    return site_style.extract(table(spark, folder, "pages"))


FILL_MIDDLE_SQL = """
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
cuts AS (
  SELECT doc_id, text, n, CAST('0x' || x[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || x[9:16] AS BIGINT) % (n + 1) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || x[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || x[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT doc_id, text, n, form, least(a, b) AS i, greatest(a, b) AS j,
    substring(text, 1, least(a, b)) AS p, substring(text, least(a, b) + 1, greatest(a, b) - least(a, b)) AS m, substring(text, greatest(a, b) + 1) AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM parts
"""


@query("op11_fill_middle", FILL_MIDDLE_SQL)
def op11_fill_middle(spark, folder):
    done = fill_middle.fill_middle(table(spark, folder, "documents"), keep=["doc_id"])
    restored = fill_middle.restore(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored, 256).alias("restored_sha256"))


@query("op12_secrets")
def op12_secrets(spark, folder):
    found = secret_scan.find_secrets(table(spark, folder, "documents"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    rank = F.create_map(*(F.lit(x) for pair in zip(secret_scan.KINDS, range(3)) for x in pair))
    both = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(
        s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return found.select("doc_id", *(count(k) for k in secret_scan.KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(both).alias("spans"), F.size("added").cast("long").alias("n_added"), "layers", "unopened")


def with_planted_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, text): of about a tenth of the ids, chosen by crc32, the words from a drawn place on repeat with a drawn period; a null id is left alone."""
    draw = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = documents.select("doc_id", "text", draw.alias("h"), F.when(draw % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    placed = found.select("doc_id", "text", "w", F.size("w").alias("n"), F.expr("h div 10").alias("g"))
    placed = placed.select("*", (F.col("g") % F.greatest("n", F.lit(1))).cast("int").alias("a"))
    placed = placed.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    repeated = F.expr("array_join(concat(slice(w, 1, a), transform(sequence(a, n - 1), i -> w[a + (i - a) % p])), ' ')")
    return placed.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark, folder):
    found = periodic.periodic_runs(with_planted_repeats(table(spark, folder, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("strongest")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
                        best["period"].alias("period"), F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
