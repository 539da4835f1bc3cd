"""Vector operators and tool calls against brute force, with null, zero and non-finite vectors."""

import json
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import maxscore, pqdedup, toolcalls


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    x[50:90] = x[50] + rng.normal(size=(40, 16)) * 0.15
    x[100:105] = x[99]
    rows = [(int(i), [float(v) for v in x[i]], 0) for i in range(300)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] + [1.0] * 15, 1), (304, [1.0, 2.0], 1), (299, rows[299][1], 2), (305, [], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def good(rows):
    return [(r.vec_id, np.array(r.embedding, float)) for r in rows if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all()]


@pytest.mark.parametrize("small", [{}, {"members": 40, "queries": 70, "most_lists": 5}])
def test_near_duplicates(vectors, spark, small):
    rows = [(i, v) for i, v in good(vectors.collect()) if np.linalg.norm(v) > 0]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            x, y = rows[a][1], rows[b][1]
            link[a, b] = a != b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9
    root = np.array([i for i, _ in rows])
    for _ in range(n):
        root = np.array([min(root[a], root[link[a]].min() if link[a].any() else root[a]) for a in range(n)])
    want = sorted((i, int(link[k].sum()), int(root[k])) for k, (i, _) in enumerate(rows))
    got = [tuple(r) for r in pqdedup.near_duplicates(vectors, **small).collect()]
    assert len(got) == vectors.count()
    assert sorted(g[:3] for g in got if g[0] in {i for i, _ in rows}) == want
    assert all(g[1] == 0 and g[3] for g in got if g[0] in (300, 301, 302, 303, 305))
    assert pqdedup.near_duplicates(vectors.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["six dimensions", "tight clusters", "one cluster"])
def test_no_link_is_lost(spark, kind):
    """Counts of links at the parameters of the registered query, against all pairs."""
    rng = np.random.default_rng(3)
    if kind == "six dimensions":
        x = rng.normal(size=(3000, 6))
    elif kind == "tight clusters":
        x = np.repeat(rng.normal(size=(200, 32)), 10, 0) + rng.normal(size=(2000, 32)) * 0.15
    else:
        x = np.r_[rng.normal(size=16) + rng.normal(size=(700, 16)) * 0.25, rng.normal(size=(300, 16))]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = ((u @ u.T) >= 0.9).sum(1) - 1
    got = {r.vec_id: r.n_links for r in pqdedup.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist() and want.sum() > 1000


def test_rows_without_id_or_with_clashing_names(spark):
    rows = [(1, [1.0, 0.0], "x"), (None, [1.0, 0.0], "y"), (2, [1.0, 0.1], "z"), (3, [1e300, 1e299], "w"), (4, [1e-310, 0.0], "v")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component_id string").withColumn("n", F.lit("a")).withColumn("kept", F.lit(1))
    got = sorted(map(tuple, pqdedup.near_duplicates(df).collect()))
    assert got == [(i, 3, 1, i == 1) for i in (1, 2, 3, 4)]
    assert {r.query_id for r in maxscore.search(df.withColumn("score", F.lit("s")), F.col("vec_id") > 0).collect()} == {1, 2, 3, 4}


def top_by_hand(rows, scale):
    q = [(i, [math.floor(Fraction(scale) * Fraction(float(c))) if abs(scale * c) >= 2**52 else math.floor(scale * c) for c in v]) for i, v in rows]
    want = []
    for i, v in q:
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in q if j != i and len(w) == len(v))[:5]
            want += [(i, k + 1, j, max(-(2**63), min(2**63 - 1, -x))) for k, (x, j) in enumerate(s)]
    return sorted(want)


@pytest.mark.parametrize("scale", [256.0, 1e5, 1e12])
def test_top_k(vectors, scale):
    got = [tuple(r) for r in maxscore.search(vectors, F.col("vec_id") % 50 == 0, scale=scale, shard_rows=64, block_queries=2).collect()]
    assert sorted(got) == top_by_hand(good(vectors.collect()), scale)
    assert maxscore.search(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_huge_components(spark):
    """Any finite double: ranks by exact scores, the column held to the bounds of a long."""
    rows = [(0, [1e30, 1.0]), (1, [1e300, -1e300]), (2, [-1e308, 3.0]), (3, [1.5, 2.5]), (4, [1e30, 2.0]), (50, [2.0, -1e18]), (51, [1e-300, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in maxscore.search(df, F.col("vec_id") % 50 == 0).collect())
    assert got == top_by_hand(rows, 256.0)


SCHEMAS = {"find": {"q": ("STRING", True), "n": ("BIGINT", False)}}


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        (1, "a", "find", '{"q":"x", "n":2}', [], 1), (1, "b", "find", '{"n":1}', ["a"], 2), (1, "c", "find", '{"q":1}', ["b", "a"], 3), (1, "d", "other", "{}", ["gone"], 4),
        (1, "e", "find", "{bad", None, 5), (2, "f", "find", '{"q":"x"}', ["g"], 1), (2, "g", "find", '{"q":"x"}', ["f"], 2), (2, None, "find", None, None, 3), (1, "a", "find", "{}", [], 9),
    ], "conv_id long, call_id string, name string, arguments string, after array<string>, turn long")
    results = spark.createDataFrame([(1, "a", 2, "r1"), (1, "a", 3, "r2"), (1, "zz", 1, None)], "conv_id long, call_id string, turn long, content string")
    got = {r.call_id: r for r in toolcalls.link_tool_calls(calls, results, SCHEMAS).collect()}
    assert {k: r.level for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 0, "f": None, "g": None, None: 0, "zz": None}
    assert got["a"].valid and got["a"].canonical == '{"arguments":{"n":2,"q":"x"},"conv":1,"id":"a","name":"find","result":"r1"}'
    assert got["b"].errors == "missing:q,missing_result" and got["c"].errors.startswith("type:q")
    assert "unknown_tool" in got["d"].errors and "unknown_dependency" in got["d"].errors
    assert "invalid_json" in got["e"].errors and "cyclic" in got["f"].errors and "missing_id" in got[None].errors and got["zz"].errors == "orphan_result"
    assert json.loads(got["b"].canonical)["arguments"] == {"n": 1}
    assert toolcalls.link_tool_calls(calls.limit(0), results.limit(0), SCHEMAS).count() == 0


def test_ids_name_calls_within_a_conversation(spark):
    """The same id in three conversations, one of them null, with results and dependencies of its own."""
    calls = spark.createDataFrame([(c, i, "find", '{"q":"x"}', after, t, "extra") for c in (1, 2, None) for i, after, t in (("call_1", [], 1), ("call_2", ["call_1"], 2))],
                                  "conv_id long, call_id string, name string, arguments string, after array<string>, turn long, level string")
    results = spark.createDataFrame([(1, "call_1", 5, "one"), (2, "call_1", 5, "two"), (None, "call_1", 5, "none"), (2, "call_2", 6, "later"), (3, "call_2", 6, "orphan"), (3, None, 6, "left out")], "conv_id long, call_id string, turn long, content string")
    got = {(r.conv_id, r.call_id): r for r in toolcalls.link_tool_calls(calls, results, SCHEMAS).collect()}
    assert len(got) == 7 and {k: r.level for k, r in got.items()} == {(c, i): int(i[-1]) - 1 for c in (1, 2, None) for i in ("call_1", "call_2")} | {(3, "call_2"): None}
    assert [json.loads(got[c, "call_1"].canonical)["result"] for c in (1, 2, None)] == ["one", "two", "none"]
    assert got[2, "call_2"].valid and got[1, "call_2"].errors == "missing_result" and got[3, "call_2"].errors == "orphan_result"


def test_levels_of_deep_and_wide_graphs(spark):
    """A chain of 3000, ladders of nodes that wait for several, cycles and what is behind them, against a walk."""
    rng = np.random.default_rng(11)
    edges = [(i, i + 1) for i in range(3000)]  # i waits for i + 1
    edges += [(5000 + i, 5000 + j) for i in range(16) for j in {i + 1, i + 2, int(rng.integers(i + 1, 18))}]
    edges += [(5012, 100), (5013, 2000), (200, 5014)]
    edges += [(7000, 7001), (7001, 7002), (7002, 7000), (7003, 7000), (7004, 7003), (7005, 7004), (7005, 5010), (7006, 7006), (7007, 5005), (7007, 5006)]
    edges = sorted(set(edges))
    nodes = sorted({x for e in edges for x in e} | {9000})
    need = {n: {b for a, b in edges if a == n} for n in nodes}
    waits = {}
    for a, b in edges:
        waits.setdefault(b, []).append(a)
    todo = [n for n in nodes if not need[n]]
    want = dict.fromkeys(todo, 0)
    missing = {n: len(d) for n, d in need.items()}
    while todo:
        b = todo.pop()
        for a in waits.get(b, []):
            missing[a] -= 1
            if not missing[a]:
                want[a] = 1 + max(want[x] for x in need[a])
                todo.append(a)
    got = toolcalls.levels(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "node long, on long")).collect()
    assert len(got) == len(want) and {r.node: r.level for r in got} == want


def test_pipeline_stages(docs, none, spark):
    import corpus_pipeline

    for d in (docs.drop("weight"), none.drop("weight")):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            d = corpus_pipeline.stored(stage(spark, d, ""))
            if k < 4:
                assert d.columns == corpus_pipeline.COLUMNS
