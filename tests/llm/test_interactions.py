"""The audit of filter interactions against a plain count over documents, filter by filter."""

import re
from collections import defaultdict
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from foliospark.llm import interactions, queries

def marks():
    return {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}


def plain(docs, labels, filters="ABCDE"):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        fails.append((s or "", {k for k in filters if f[k]}, i in good and i is not None, i in toxic and i is not None))
    out = []
    for part in {p for p, *_ in fails}:
        rows = [x for x in fails if x[0] == part]
        shapley, steps = defaultdict(int), []
        for order in permutations(filters):
            left = rows
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                redundant = sum(f in x[1] and bool(x[1] & set(order[:k])) for x in rows)
                steps.append((f, ("".join(order), k + 1, len(left), len(gone), redundant, sum(x[1] == {f} for x in rows), sum(x[2] for x in gone), sum(x[3] for x in gone))))
        out += [(part, *s, shapley[f]) for f, s in steps]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_awkward_rows(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (3, 0, 1), (4, 1, 1), (10, 1, None), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    odd = docs.union(docs.where("doc_id in (1, 6, 10)").selectExpr("null", "text", "lang", "source", "n_chars", "weight")).union(docs.selectExpr("doc_id + 50", "text", "lang", "'s2'", "n_chars", "weight"))
    odd = odd.unionByName(spark.createDataFrame([(70, "A b " * 150 + "C", "en", "s1", 0, 0.0), (71, "é#" * 5, "en", "", 0, 0.0)], docs.schema))
    for c in ("id", "part", "d", "mask", "docs", "good", "first", "kept"):
        odd = odd.withColumn(c, F.lit(-1))
    audit = lambda d: interactions.order_steps(interactions.cells(d, interactions.text_rules(F.col("text")), repeats="E", labels=labels, marks=marks()), "ABCDE", ("good", "toxic"))
    want = plain([(r.doc_id, r.text, r.source) for r in odd.collect()], [tuple(r) for r in labels.collect()])
    assert rows(audit(odd)) == want and len(want) == 4 * 600
    assert audit(none.withColumn("x", F.lit(1))).count() == 0


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert rows(queries.op11_filter_audit(spark, sf)) == plain(docs, labels)


def test_walk_meets_every_subset():
    counts = np.random.default_rng(1).integers(0, 9, (3, 64, 2))
    got = interactions.walk(counts)
    for s in range(64):
        assert (got[:, s] == counts[:, [m for m in range(64) if not m & s]].sum(1)).all()


def test_states_and_listed_orders(spark, docs):
    cells = interactions.cells(docs, {"x": F.col("text").contains("token"), "y": F.length("text") > 500})
    got = {(r.part, r.subset): r.docs for r in interactions.subset_states(cells, "xy").collect()}
    text = [(r.source or "", r.text or "") for r in docs.collect()]
    for (part, subset), n in got.items():
        assert n == sum(p == part and not ("x" in subset and "token" in t) and not ("y" in subset and len(t) > 500) for p, t in text)
    assert len(got) == 4 * 4
    one = interactions.order_steps(cells, "xy", orders=["yx"]).collect()
    every = {(r.part, r.filter_order, r.step): r for r in interactions.order_steps(cells, "xy").collect()}
    assert len(one) == 8 and all(r == every[r.part, r.filter_order, r.step] for r in one)
