"""Searches by the table against plain loops."""

from shelfwise.operators import catalog as C


def test_products_of_one_name_are_indexed_and_verified_as_one(spark, monkeypatch):
    """Copies of a name add rows to the result alone, and the tables that grow with the names are never broadcast."""
    kinds = [("Brand#7 red bolt 17 ml", "Brand#7"), ("Brand#1 Red nut 50 ml", "Brand#1"), ("red bolt", "Brand#7"), ("Brand#17 hot ring 1 ml", "Brand#17"), (None, "Brand#7")]
    rows = [(i, *kinds[i % len(kinds)]) for i in range(1000)]
    texts = ["Red bolt", "bolt 7", " RED  1 ", "brand#7 red", "blue", "", "x" * 101]
    sizes, cut = [], C.cut
    monkeypatch.setattr(C, "cut", lambda df: (sizes.append((out := cut(df)).count()), out)[1])
    found = C.search_many(spark.createDataFrame(rows, "product_id int, canonical_name string, brand string"), spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    want = set()
    for text in texts[:5]:
        words = text.lower().split()
        for product, name, brand in rows:
            if name is not None and all(w in f"{name} {brand}".lower() for w in words):
                phrase, folded = " ".join(words), name.lower()
                rank = 0 if folded == phrase else 1 if folded.startswith((phrase, f"{brand.lower()} {phrase}")) else 2
                want.add((text, product, rank))
    got = [(r["text"], r["product_id"], r["text_rank"]) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert max(sizes) < 250
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
