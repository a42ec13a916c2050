"""URL filters: host and path rules by longest match, and rules mined from labelled URLs by FP-growth.

Both kinds are matched through an inverted index: fixed rules by host, mined rules by the first of their tokens.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mined rules hold for at least this share of labelled URLs and are right this often.
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.8
#: A rule set is a model: it must fit every task. More rules than this are refused, ask for more support.
MAX_RULES = 100_000
BAD, GOOD = "label=bad", "label=good"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is no ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty where there is no ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Distinct tokens: labels of the host and their parts, words of the path, names of query fields; no bare numbers."""
    host, path = host_of(url), F.lower(path_of(url))
    query = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1))
    labels = F.split(host, r"\.")
    found = F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("host="), x)),
        F.transform(F.split(host, r"[.\-]"), lambda x: F.concat(F.lit("part="), x)),
        F.transform(F.split(path, r"[^\p{L}\p{N}]+"), lambda x: F.concat(F.lit("path="), x)),
        F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("field="), F.element_at(F.split(x, "="), 1))))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: ~x.rlike(r"=\d*$"))))


def mine(labelled: DataFrame, url: str, bad: str, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens, confidence, support) of rules "these tokens: bad", none of which a rule on fewer tokens makes useless.

    `bad` is a boolean column; rows with a null label are left out, null urls have no tokens. A rule is dropped where a rule on a
    subset of its tokens is at least as confident. No labels, or none bad: no rules.
    """
    tokens = labelled.select(tokens_of(F.col(url)).alias("tokens"), F.col(bad).alias("bad")).where("bad is not null")
    baskets = tokens.select(F.array_append("tokens", F.when(F.col("bad"), F.lit(BAD)).otherwise(F.lit(GOOD))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = (model.associationRules.where((F.element_at("consequent", 1) == BAD) & ~F.array_contains("antecedent", GOOD))
             .select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"))
    rows = found.take(MAX_RULES + 1)
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; raise min_support or min_confidence")
    return labelled.sparkSession.createDataFrame(prune([tuple(r) for r in rows]), "tokens array<string>, confidence double, support double")


def prune(rules: Sequence[tuple[list[str], float, float]]) -> list[tuple[list[str], float, float]]:
    """Rules without a rule on a proper subset of tokens that is at least as confident."""
    kept: dict[frozenset, tuple[list[str], float, float]] = {}
    for tokens, confidence, support in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        smaller = (frozenset(c) for n in range(1, len(tokens)) for c in combinations(tokens, n))
        if not any(s in kept and kept[s][1] >= confidence for s in smaller):
            kept[frozenset(tokens)] = (list(tokens), confidence, support)
    return list(kept.values())


def mined_verdict(tokens: Column, rules: DataFrame) -> Column:
    """True where all tokens of a rule are there. The index maps a token to the rules that it is the first of."""
    index: dict[str, list[list[str]]] = {}
    for row in rules.select("tokens").toLocalIterator():
        if row["tokens"]:
            index.setdefault(row["tokens"][0], []).append(list(row["tokens"]))
    if not index:
        return F.lit(False)
    entries = [x for token, own in sorted(index.items()) for x in (F.lit(token), F.array(*(F.array(*map(F.lit, r)) for r in own)))]
    table = F.create_map(*entries)
    return F.exists(tokens, lambda t: F.exists(F.coalesce(table[t], F.array().cast("array<array<string>>")),
                                               lambda r: F.size(F.array_except(r, tokens)) == 0))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, action) of the longest rule that fits, or null.

    A rule is (action, host + path), its path starting at the first slash; it fits its host and all subdomains where
    the path starts with the rule's. The index maps a host to its rules, longest first; suffixes of the host are looked up.
    """
    index: dict[str, list[tuple[str, str, str]]] = {}
    for action, rule in rules:
        name, slash, rest = rule.partition("/")
        index.setdefault(name, []).append((slash + rest, rule, action))
    if not index:
        return F.lit(None).cast("struct<rule:string,action:string>")
    entry = lambda path_, rule, action: F.struct(
        F.lit(len(rule)).alias("n"), F.lit(path_).alias("path"), F.lit(rule).alias("rule"), F.lit(action).alias("action"))
    table = F.create_map(*(x for name, own in sorted(index.items()) for x in (F.lit(name), F.array(*(entry(*r) for r in own)))))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    near = F.flatten(F.transform(F.filter(suffixes, lambda s: F.map_contains_key(table, s)), lambda s: table[s]))
    fit = F.array_max(F.filter(near, lambda r: F.startswith(path, r["path"])))
    return F.when(fit.isNotNull(), F.struct(fit["rule"].alias("rule"), fit["action"].alias("action")))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], mined: DataFrame, url: str = "url") -> DataFrame:
    """`pages` with host, path, rule (null where no fixed rule fits) and verdict: the rule's, else block where a mined rule fits, else allow.

    A null url or one without :// has an empty host and path and is allowed unless a rule says otherwise. Repeated rows
    are judged each; columns of `pages` with the names of results are replaced. One scan without a shuffle.
    """
    found = rule_for(host_of(F.col(url)), path_of(F.col(url)), rules)
    blocked = mined_verdict(tokens_of(F.col(url)), mined)
    results = {"host": host_of(F.col(url)), "path": path_of(F.col(url)), "rule": found["rule"],
               "verdict": F.coalesce(found["action"], F.when(blocked, F.lit("block")).otherwise(F.lit("allow")))}
    return pages.withColumns(results)
