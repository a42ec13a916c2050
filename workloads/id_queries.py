"""Stable ids, redirects and match evaluation over part and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import evaluate as E
from shelfwise.operators import grouping as G
from shelfwise.operators import ids as I
from shelfwise.operators import products as PR
from shelfwise.session import cut, store

from . import match_queries as Q
from . import match_sql as S
from . import match_views as M
from . import views as V
from .registry import query
from .stages import stage

# Before: listings were products by brand, name and type. Now: by brand, name and size.
OLD_SQL = M.LISTINGS_SQL + """,
previous AS (SELECT listing_id, min(listing_id) OVER (PARTITION BY p_brand, p_name, p_type) AS product_id FROM m),
plan AS (SELECT listing_id, concat_ws('|', p_brand, p_name, CAST(p_size % 3 AS VARCHAR)) AS product_key FROM m),
existing AS (SELECT p.product_id, x.product_key, m.p_size AS created_at FROM (SELECT DISTINCT product_id FROM previous) p
             JOIN plan x ON x.listing_id = p.product_id JOIN m ON m.listing_id = p.product_id),
history AS (SELECT l_partkey AS listing_id, count(*) AS readings FROM lineitem GROUP BY 1),
parts AS (SELECT product_id, product_key, count(*) AS listings, sum(coalesce(readings, 0)) AS readings
          FROM plan JOIN previous USING (listing_id) LEFT JOIN history USING (listing_id) GROUP BY 1, 2)"""


def run_tables(spark, folder):
    from pyspark.sql import Window

    m = M.match_listings(spark, folder)
    previous = m.select("listing_id", F.min("listing_id").over(Window.partitionBy("p_brand", "p_name", "p_type")).alias("product_id"))
    plan = m.select("listing_id", F.concat_ws("|", "p_brand", "p_name", (F.col("p_size") % 3).cast("string")).alias("product_key"))
    heads = previous.select("product_id").distinct()
    existing = heads.join(plan.withColumnRenamed("listing_id", "product_id"), "product_id").join(
        m.select(F.col("listing_id").alias("product_id"), F.col("p_size").alias("created_at")), "product_id")
    history = I.reading_counts(V.table(spark, folder, "lineitem").select(F.col("l_partkey").alias("listing_id")))
    return plan, existing, previous, history


def built(spark, folder):
    def build():
        plan, existing, previous, history = (cut(t) for t in run_tables(spark, folder))
        return plan, existing, previous, history, cut(I.assign_ids(plan, existing, previous, history))

    return stage(spark, folder, "ids", build)


@query("id_parts", f"WITH {OLD_SQL} SELECT product_id, product_key, listings, CAST(readings AS BIGINT) AS readings FROM parts")
def id_parts(spark, folder):
    plan, _, previous, history = run_tables(spark, folder)
    return I.old_parts(plan, previous, history)


@query("id_preferences", f"WITH {OLD_SQL}" + """,
r AS (SELECT p.*, coalesce(p.product_key = e.product_key, false) AS is_own,
        max(CASE WHEN p.product_key = e.product_key THEN readings END) OVER w AS own_readings,
        count(*) FILTER (WHERE p.product_key = e.product_key) OVER w > 0 AS has_own
      FROM parts p LEFT JOIN existing e USING (product_id) WINDOW w AS (PARTITION BY p.product_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY product_id, is_own ORDER BY readings DESC, product_key) AS place FROM r)
SELECT product_id, product_key, row_number() OVER (PARTITION BY product_id ORDER BY
   CASE WHEN NOT has_own THEN 0 WHEN NOT is_own AND place = 1 AND readings > own_readings THEN 0 WHEN is_own THEN 1 ELSE 2 END,
   CASE WHEN has_own THEN -readings ELSE -listings END, -readings, product_key) AS choice FROM o""")
def id_preferences(spark, folder):
    from pyspark.sql import Window

    plan, existing, previous, history = run_tables(spark, folder)
    ranked = I.preferences(I.old_parts(plan, previous, history), existing)
    choice = F.row_number().over(Window.partitionBy("product_id").orderBy("preference"))
    return ranked.select("product_id", "product_key", choice.cast("bigint").alias("choice"))


# All keys rank products alike, by seniority, so products choose one after the other; those of another brand and name have no key in common.
ASSIGNED_SQL = OLD_SQL + """,
ranked AS (
  SELECT product_id, product_key, row_number() OVER (PARTITION BY product_id ORDER BY
      CASE WHEN NOT has_own THEN 0 WHEN NOT is_own AND place = 1 AND readings > own_readings THEN 0 WHEN is_own THEN 1 ELSE 2 END,
      CASE WHEN has_own THEN -readings ELSE -listings END, CASE WHEN has_own THEN 0 ELSE -readings END, product_key) AS choice
  FROM (SELECT *, row_number() OVER (PARTITION BY product_id, is_own ORDER BY readings DESC, product_key) AS place FROM (
    SELECT p.*, coalesce(p.product_key = e.product_key, false) AS is_own, max(CASE WHEN p.product_key = e.product_key THEN readings END) OVER w AS own_readings,
      count(*) FILTER (WHERE p.product_key = e.product_key) OVER w > 0 AS has_own
    FROM parts p LEFT JOIN existing e USING (product_id) WINDOW w AS (PARTITION BY p.product_id)))),
wishes AS (SELECT product_id, list(product_key ORDER BY choice) AS keys FROM ranked GROUP BY 1),
seniors AS (
  SELECT p.product_id, concat_ws('|', m.p_brand, m.p_name) AS line, keys, row_number() OVER (PARTITION BY m.p_brand, m.p_name ORDER BY total DESC, e.created_at IS NULL, e.created_at, CAST(p.product_id AS VARCHAR)) AS i
  FROM (SELECT product_id, sum(coalesce(readings, 0)) AS total FROM previous LEFT JOIN history USING (listing_id) GROUP BY 1) p
  JOIN m ON m.listing_id = p.product_id LEFT JOIN existing e ON e.product_id = p.product_id JOIN wishes w ON w.product_id = p.product_id),
chosen AS (
  SELECT line, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS gone, CAST(NULL AS BIGINT) AS product_id, CAST(NULL AS VARCHAR) AS product_key FROM (SELECT DISTINCT line FROM seniors)
  UNION ALL
  SELECT s.line, s.i, CASE WHEN len(free) > 0 THEN list_append(gone, free[1]) ELSE gone END, s.product_id, free[1] FROM (
    SELECT s.*, c.gone, list_filter(s.keys, lambda k: NOT list_contains(c.gone, k)) AS free FROM chosen c JOIN seniors s ON s.line = c.line AND s.i = c.i + 1) s),
held AS (SELECT product_id, product_key FROM chosen WHERE product_key IS NOT NULL),
assigned AS (SELECT k.product_key, h.product_id, CASE WHEN h.product_id IS NULL THEN 'new' ELSE 'kept' END AS how FROM (SELECT DISTINCT product_key FROM plan) k LEFT JOIN held h USING (product_key))"""


@query("assign_ids", f"WITH RECURSIVE {ASSIGNED_SQL} SELECT product_key, product_id, how FROM assigned")
def assign_ids(spark, folder):
    return built(spark, folder)[4]


@query("id_audit", f"WITH RECURSIVE {ASSIGNED_SQL}" + """
SELECT 'fusions' AS counter, count(*) AS value FROM (SELECT product_key FROM parts GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'splits', count(*) FROM (SELECT product_id FROM parts GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'swaps', count(*) FROM assigned WHERE product_id IS NOT NULL AND (product_id, product_key) NOT IN (SELECT (product_id, product_key) FROM parts)
UNION ALL SELECT 'rekeyed', count(*) FROM assigned a LEFT JOIN existing e USING (product_id) WHERE a.product_id IS NOT NULL AND e.product_key IS DISTINCT FROM a.product_key
UNION ALL SELECT 'displaced', count(*) FROM existing e JOIN assigned a ON a.product_key = e.product_key WHERE e.product_id NOT IN (SELECT product_id FROM held)
UNION ALL SELECT 'reused', 0 UNION ALL SELECT 'new', count(*) FROM assigned WHERE how = 'new'""")
def id_audit(spark, folder):
    plan, existing, previous, history, assigned = built(spark, folder)
    return I.id_audit(assigned, I.old_parts(plan, previous, history), existing, I.displaced(assigned, existing))


@query("id_changes", f"WITH {OLD_SQL}, now AS (SELECT listing_id, min(listing_id) OVER (PARTITION BY product_key) AS product_id FROM plan)" + """,
both_maps AS (SELECT b.product_id AS old, n.product_id AS new FROM previous b JOIN now n USING (listing_id))
SELECT 'fusions' AS counter, count(*) AS value FROM (SELECT new FROM both_maps GROUP BY 1 HAVING count(DISTINCT old) > 1)
UNION ALL SELECT 'splits', count(*) FROM (SELECT old FROM both_maps GROUP BY 1 HAVING count(DISTINCT new) > 1)
UNION ALL SELECT 'swaps', count(*) FROM (SELECT DISTINCT product_id FROM previous WHERE product_id IN (SELECT product_id FROM now)
  AND product_id NOT IN (SELECT old FROM both_maps WHERE old = new))""")
def id_changes(spark, folder):
    from pyspark.sql import Window

    plan, _, previous, _ = run_tables(spark, folder)
    now = plan.select("listing_id", F.min("listing_id").over(Window.partitionBy("product_key")).alias("product_id"))
    return I.id_changes(previous, now)


@query("retire_destination", f"WITH {OLD_SQL}" + """,
now AS (SELECT listing_id, min(listing_id) OVER (PARTITION BY product_key) AS product_id FROM plan),
gone AS (SELECT DISTINCT product_id FROM previous WHERE product_id NOT IN (SELECT product_id FROM now)),
votes AS (SELECT p.product_id, n.product_id AS target, count(*) AS c, sum(coalesce(readings, 0)) AS r FROM previous p JOIN gone USING (product_id)
          JOIN now n USING (listing_id) LEFT JOIN history USING (listing_id) WHERE n.product_id <> p.product_id GROUP BY 1, 2)
SELECT g.product_id, t.target AS replaced_by, CASE WHEN t.target IS NULL THEN 'no_listings' ELSE 'merged' END AS reason
FROM gone g LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY c DESC, r DESC, CAST(target AS VARCHAR) DESC) AS rn FROM votes) t
  ON t.product_id = g.product_id AND t.rn = 1""")
def retire_destination(spark, folder):
    from pyspark.sql import Window

    plan, existing, previous, history = run_tables(spark, folder)
    now = plan.select("listing_id", F.min("listing_id").over(Window.partitionBy("product_key")).alias("product_id"))
    products = existing.select("product_id", F.col("product_key").alias("canonical_name"))
    return I.retire(products, previous, now, history).drop("canonical_name")


RETIRED_SQL = """
retired AS (SELECT p_partkey AS product_id, CASE WHEN p_partkey % 97 <> 0 THEN p_partkey // 2 END AS replaced_by FROM part WHERE p_partkey % 3 <> 0),
live AS (SELECT p_partkey AS product_id FROM part WHERE p_partkey % 3 = 0),
chain AS (
  SELECT product_id, replaced_by, 1 AS hops FROM retired
  UNION ALL
  SELECT chain.product_id, r.replaced_by, hops + 1 FROM chain JOIN retired r ON r.product_id = chain.replaced_by WHERE hops < 20),
closure AS (SELECT product_id, arg_max((replaced_by), hops) FILTER (WHERE true) AS target0, max(hops) AS hops FROM chain GROUP BY 1),
final AS (SELECT c.product_id, c.replaced_by AS target FROM chain c JOIN closure k ON k.product_id = c.product_id AND k.hops = c.hops)"""


def retired_tables(spark, folder):
    part = V.table(spark, folder, "part").select(F.col("p_partkey").alias("product_id"))
    retired = part.where("product_id % 3 <> 0").withColumn("replaced_by", F.expr("CASE WHEN product_id % 97 <> 0 THEN product_id DIV 2 END"))
    return part, retired, part.where("product_id % 3 = 0")


@query("redirect_closure", f"WITH RECURSIVE {RETIRED_SQL} SELECT product_id, target, coalesce(target IN (SELECT product_id FROM live), false) AS exists FROM final")
def redirect_closure(spark, folder):
    _, retired, live = retired_tables(spark, folder)
    return I.redirects(retired, live)


@query("retired_outcome", f"WITH RECURSIVE {RETIRED_SQL}" + """
SELECT p_partkey * 2 AS product_id, CASE WHEN p_partkey * 2 IN (SELECT product_id FROM live) THEN 'found'
   WHEN f.product_id IS NULL THEN 'unknown' WHEN target IN (SELECT product_id FROM live) THEN 'replaced' ELSE 'retired' END AS outcome,
   CASE WHEN p_partkey * 2 NOT IN (SELECT product_id FROM live) AND target IN (SELECT product_id FROM live) THEN target END AS new_id
FROM part LEFT JOIN final f ON f.product_id = p_partkey * 2""")
def retired_outcome(spark, folder):
    part, retired, live = retired_tables(spark, folder)
    asked = part.select((F.col("product_id") * 2).alias("product_id"))
    return I.lookup_outcome(asked, live, I.redirects(retired, live))


# ---------------------------------------------------------------- evaluation

# A plain matching to grade in both engines: one group per brand, name, type and size.
EVAL_SQL = M.LISTINGS_SQL + "," + M.LABELS_SQL + """,
members AS (SELECT *, min(listing_id) OVER (PARTITION BY p_brand, p_name, p_type, p_size % 3) AS group_id FROM m),
accepted AS (SELECT group_id AS a, listing_id AS b FROM members WHERE listing_id <> group_id),
decisions AS (
  SELECT prior AS a, listing_id AS b, CASE WHEN p_name = prior_name AND p_type = prior_type THEN 'auto' WHEN p_name = prior_name THEN 'review' ELSE 'veto' END AS kind
  FROM (SELECT *, lag(listing_id) OVER w AS prior, lag(p_name) OVER w AS prior_name, lag(p_type) OVER w AS prior_type
        FROM m WINDOW w AS (PARTITION BY p_brand, p_size % 3 ORDER BY listing_id)) WHERE prior IS NOT NULL),
outcomes AS (
  SELECT l.url_a, l.url_b, l.label, x.store AS sa, y.store AS sb,
    CASE WHEN x.group_id = y.group_id AND x.store <> y.store THEN 'matched' WHEN d.kind IS NULL THEN 'not_a_candidate'
         WHEN d.kind = 'auto' THEN 'auto_but_lost_one_to_one' ELSE d.kind || ':rule' END AS outcome,
    coalesce(l.label = 'same' OR (l.label = 'same_fragrance_unknown_size' AND x.volume_ml = y.volume_ml), false) AS correct
  FROM label_pairs l JOIN members x ON x.listing_url = l.url_a JOIN members y ON y.listing_url = l.url_b
       LEFT JOIN decisions d ON d.a = least(x.listing_id, y.listing_id) AND d.b = greatest(x.listing_id, y.listing_id))"""
REPORT_SQL = EVAL_SQL + """,
pair_counts AS (SELECT least(x.store, y.store) || '-' || greatest(x.store, y.store) AS store_pair, count(*) AS accepted
                FROM members x JOIN members y ON x.group_id = y.group_id AND x.listing_id < y.listing_id AND x.store <> y.store GROUP BY 1),
direct AS (SELECT least(x.store, y.store) || '-' || greatest(x.store, y.store) AS store_pair, count(*) AS direct
           FROM accepted JOIN members x ON x.listing_id = a JOIN members y ON y.listing_id = b WHERE x.store <> y.store GROUP BY 1),
kinds AS (SELECT least(x.store, y.store) || '-' || greatest(x.store, y.store) AS store_pair, count(*) AS candidates,
            count(*) FILTER (WHERE kind = 'auto') AS auto, count(*) FILTER (WHERE kind = 'review') AS review, count(*) FILTER (WHERE kind = 'veto') AS veto
          FROM decisions JOIN members x ON x.listing_id = a JOIN members y ON y.listing_id = b GROUP BY 1),
judged AS (SELECT least(sa, sb) || '-' || greatest(sa, sb) AS store_pair, count(*) AS labelled, count(*) FILTER (WHERE correct) AS correct
           FROM outcomes WHERE outcome = 'matched' GROUP BY 1),
report AS (
SELECT store_pair, coalesce(accepted, 0) AS accepted, coalesce(accepted, 0) - coalesce(direct, 0) AS through_a_chain, coalesce(labelled, 0) AS labelled,
  coalesce(correct, 0) AS correct, coalesce(candidates, 0) AS candidates, coalesce(auto, 0) AS auto, coalesce(review, 0) AS review, coalesce(veto, 0) AS veto
FROM pair_counts FULL JOIN direct USING (store_pair) FULL JOIN judged USING (store_pair) FULL JOIN kinds USING (store_pair))"""


def eval_tables(spark, folder):
    from pyspark.sql import Window

    m = M.match_listings(spark, folder)
    size = (F.col("p_size") % 3).alias("size3")
    m = m.select("*", size)
    members = m.withColumn("group_id", F.min("listing_id").over(Window.partitionBy("p_brand", "p_name", "p_type", "size3")))
    accepted = members.where("listing_id <> group_id").select(F.col("group_id").alias("a"), F.col("listing_id").alias("b"))
    w = Window.partitionBy("p_brand", "size3").orderBy("listing_id")
    prior = m.select("listing_id", "p_name", "p_type", F.lag("listing_id").over(w).alias("a"), F.lag("p_name").over(w).alias("n"),
                     F.lag("p_type").over(w).alias("t")).where("a IS NOT NULL")
    kind = F.when((F.col("p_name") == F.col("n")) & (F.col("p_type") == F.col("t")), "auto").when(
        F.col("p_name") == F.col("n"), "review").otherwise("veto")
    decisions = prior.select("a", F.col("listing_id").alias("b"), kind.alias("kind"), F.lit("rule").alias("reason"))
    labels = M.label_pairs(spark, folder).select("url_a", "url_b", "label", F.lit("labels").alias("source"))
    return labels, members, decisions, accepted


@query("label_outcomes", f"WITH {EVAL_SQL} SELECT url_a, url_b, label, outcome, correct FROM outcomes")
def label_outcomes(spark, folder):
    labels, members, decisions, _ = eval_tables(spark, folder)
    return E.label_outcomes(labels, members, decisions).select("url_a", "url_b", "label", "outcome", "correct")


@query("outcome_counts", f"WITH {EVAL_SQL} SELECT label, CASE WHEN outcome LIKE 'review%' THEN 'review' ELSE outcome END AS outcome, count(*) AS pairs FROM outcomes GROUP BY 1, 2")
def outcome_counts(spark, folder):
    labels, members, decisions, _ = eval_tables(spark, folder)
    return E.outcome_counts(E.label_outcomes(labels, members, decisions))


@query("store_pair_report", f"WITH {REPORT_SQL} SELECT * FROM report")
def store_pair_report(spark, folder):
    labels, members, decisions, accepted = eval_tables(spark, folder)
    return E.store_pair_report(E.label_outcomes(labels, members, decisions), members, decisions, accepted)


@query("match_precision", f"WITH {REPORT_SQL}" + """
SELECT CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(labelled) AS BIGINT) AS labelled, CAST(sum(correct) AS BIGINT) AS correct,
  round(100 * sum(correct) / nullif(sum(labelled), 0), 1) AS precision_percent, CASE WHEN sum(labelled) = sum(accepted) THEN 'exact' ELSE 'estimate' END AS coverage
FROM report""")
def match_precision(spark, folder):
    labels, members, decisions, accepted = eval_tables(spark, folder)
    return E.precision(E.store_pair_report(E.label_outcomes(labels, members, decisions), members, decisions, accepted))


@query("error_lists", f"WITH {EVAL_SQL} SELECT 'wrong_merge' AS list, label AS what, count(*) AS pairs FROM outcomes WHERE outcome = 'matched' AND NOT correct GROUP BY 2 UNION ALL SELECT 'missed_by_veto', outcome, count(*) FROM outcomes WHERE correct AND outcome LIKE 'veto%' GROUP BY 2")
def error_lists(spark, folder):
    labels, members, decisions, _ = eval_tables(spark, folder)
    outcomes = E.label_outcomes(labels, members, decisions)
    wrong = E.wrong_merges(outcomes).groupBy(F.lit("wrong_merge").alias("list"), F.col("label").alias("what")).agg(F.count(F.lit(1)).alias("pairs"))
    missed = E.missed_by_veto(outcomes).groupBy(F.lit("missed_by_veto").alias("list"), F.col("outcome").alias("what")).agg(F.count(F.lit(1)).alias("pairs"))
    return wrong.unionByName(missed)


@query("rules_precision", S.recursive(S.RULED + S.WALK, f""", {M.LABELS_SQL.strip()},
outcomes AS (SELECT coalesce(l.label = 'same' OR (l.label = 'same_fragrance_unknown_size' AND x.volume_ml = y.volume_ml), false) AS correct
  FROM label_pairs l JOIN m x ON x.listing_url = l.url_a JOIN m y ON y.listing_url = l.url_b JOIN grouped g ON g.listing_id = x.listing_id JOIN grouped h ON h.listing_id = y.listing_id
  WHERE g.group_id = h.group_id AND x.store <> y.store),
counted AS (SELECT count(*) AS accepted FROM grouped g JOIN grouped h ON g.group_id = h.group_id AND g.listing_id < h.listing_id JOIN m x ON x.listing_id = g.listing_id
  JOIN m y ON y.listing_id = h.listing_id WHERE x.store <> y.store)
SELECT accepted, (SELECT count(*) FROM outcomes) AS labelled, (SELECT count(*) FILTER (WHERE correct) FROM outcomes) AS correct,
  round(100 * (SELECT count(*) FILTER (WHERE correct) FROM outcomes) / nullif((SELECT count(*) FROM outcomes), 0), 1) AS precision_percent,
  CASE WHEN accepted = (SELECT count(*) FROM outcomes) THEN 'exact' ELSE 'estimate' END AS coverage FROM counted"""))
def rules_precision(spark, folder):
    """The full matcher graded against the labels, decided without them."""
    rows, d = Q.decisions(spark, folder, labelled=False)
    accepted = stage(spark, folder, "accepted_ruled", lambda: store(G.accept_pairs(d, rows), packed=True))
    members = rows.select("listing_id", "store", "listing_url", "volume_ml", "name").join(
        G.group_members(accepted).select("listing_id", "group_id"), "listing_id", "left")
    labels = M.label_pairs(spark, folder).select("url_a", "url_b", "label", F.lit("labels").alias("source"))
    return E.precision(E.store_pair_report(E.label_outcomes(labels, members, d), members, d, accepted))


@query("store_duplicates", S.recursive(S.DECIDED + S.PRODUCTS, """
SELECT group_id, CAST(sum(n) AS BIGINT) AS listings, bool_or(differs) AS inconsistent FROM (
  SELECT p.group_id, p.store, count(*) AS n, bool_or(sig IS NULL) OR coalesce(min(sig) <> max(sig), true) AS differs FROM placed p JOIN sigs s USING (listing_id) GROUP BY 1, 2 HAVING count(*) > 1)
GROUP BY 1"""))
def store_duplicates(spark, folder):
    rows, members = Q.grouped_members(spark, folder)
    return E.store_duplicates(members, G.signature(rows))


@query("same_store_products", S.recursive(S.DECIDED + S.PRODUCTS, """
SELECT product_key, store, name FROM placed WHERE (product_key, store) IN (SELECT (product_key, store) FROM placed WHERE product_key IS NOT NULL GROUP BY product_key, store HAVING count(*) > 1)"""))
def same_store_products(spark, folder):
    rows, members, assigned = Q.resolved_products(spark, folder)
    return E.same_store_products(PR.listing_status(members, assigned), rows)


@query("reassign_listings", f"WITH {OLD_SQL}" + """,
status AS (SELECT listing_id, CASE WHEN listing_id % 5 <> 0 THEN product_key END AS product_key, CASE WHEN listing_id % 5 = 0 THEN 'pending' ELSE 'matched' END AS status FROM plan),
ids AS (SELECT product_key, min(product_id) AS product_id FROM existing WHERE product_id % 3 <> 0 GROUP BY 1),
settled AS (SELECT listing_id, coalesce(i.product_id, p.product_id) AS product_id, status FROM previous p JOIN status USING (listing_id) LEFT JOIN ids i USING (product_key))
SELECT listing_id, CASE WHEN product_id % 7 = 0 THEN product_id + 1 ELSE product_id END AS product_id, status, round(0.1234 + listing_id % 3, 3) AS confidence FROM settled""")
def reassign_listings(spark, folder):
    """Resolved listings take their product's id, pending ones keep theirs, displaced rows are followed."""
    plan, existing, previous, _ = run_tables(spark, folder)
    pending = F.col("listing_id") % 5 == 0
    status = plan.select("listing_id", F.when(~pending, F.col("product_key")).alias("product_key"), F.when(pending, "pending").otherwise("matched").alias("status"),
                         (F.lit(0.1234) + F.col("listing_id") % 3).alias("confidence"))
    ids = existing.where("product_id % 3 <> 0").groupBy("product_key").agg(F.min("product_id").alias("product_id"))
    moved = previous.select("product_id").distinct().where("product_id % 7 = 0").withColumn("holder", F.col("product_id") + 1)
    return I.reassign_listings(previous, status, ids, moved)
