"""Sharding against plain differencing with lists of items, and the law it states."""

import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.llm import queries, sharding


def plain(sizes, ways):
    """Differencing as written down: partial partitions with their items, the two of largest spread combined each time."""
    state = [(i, [(s, [i])] + [(0, []) for _ in range(ways - 1)]) for i, s in enumerate(sizes)]
    made = len(sizes)
    while len(state) > 1:
        state.sort(key=lambda p: (-(p[1][0][0] - p[1][-1][0]), p[0]))
        (_, a), (_, b) = state[:2]
        both = sorted([(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, b[::-1], strict=True)], key=lambda p: -p[0])
        state = [*state[2:], (made, both)]
        made += 1
    out = [0] * len(sizes)
    for k, (_, items) in enumerate(state[0][1] if state else []):
        for i in items:
            out[i] = k
    return out


def sums(sizes, part, ways):
    out = [0] * ways
    for s, p in zip(sizes, part, strict=True):
        out[p] += s
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40), st.integers(1, 8))
def test_is_plain_differencing(sizes, ways):
    got = sharding.difference(sizes, ways).tolist()
    assert got == plain(sizes, ways)


def test_known_split():
    """8, 7, 6, 5, 4 differ by 2 at the end of differencing, and a giant leaves the rest balanced."""
    assert sums([8, 7, 6, 5, 4], sharding.difference([8, 7, 6, 5, 4], 2), 2) == [14, 16]
    s = sums([1000, *[3] * 70], sharding.difference([1000, *[3] * 70], 8), 8)
    assert s == [30] * 7 + [1000]
    assert sharding.difference([], 8).tolist() == []


def law(rows, texts, ways=8):
    """One shard a text, sizes as stated, slots gapless; returns bytes by shard."""
    of, slots, total = defaultdict(set), defaultdict(list), defaultdict(int)
    by_id = {}
    for i, t in texts:
        by_id.setdefault(i, []).append((len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), t or ""))
    got = defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < ways
        got[r.doc_id].append((r.size, r.text_crc32))
        of[(r.size, r.text_crc32)].add(r.shard)
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(x[:2] for x in v) for i, v in by_id.items()}
    assert all(len(v) == 1 for v in of.values()) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    return [total[k] for k in range(ways)]


def test_awkward_rows(spark, docs, none):
    odd = docs.withColumn("shard", F.lit(-1)).withColumn("item", F.lit("x")).withColumn("times", F.lit(9)).union(docs.where("doc_id = 1").selectExpr("null", "text", "lang", "source", "n_chars", "weight", "1", "'y'", "2"))
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    a = sharding.shard(odd).collect()
    law(a, texts)
    assert sorted(map(repr, a)) == sorted(map(repr, sharding.shard(odd.repartition(7)).collect()))
    for grain in (1, 3):
        law(sharding.shard(odd, 3, grain=grain).collect(), texts, 3)
    assert sharding.shard(none).count() == 0
    empty = {r.doc_id: r.shard for r in a if r.size == 1}
    assert len(empty) == 2 and len(set(empty.values())) == 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_registered_query(spark, sf):
    """Near equal to the byte or so, or, where one group passes an eighth, the others are."""
    texts = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    total = law(queries.op13_sharding(spark, f"/root/testdata/{sf}").collect(), texts)
    groups = defaultdict(int)
    for _, t in texts:
        groups[t] += len((t or "").encode()) + 1
    assert max(total) - min(total) <= max(4, 8 * max(groups.values()) - sum(total))


def test_a_third_in_one_group(spark):
    """A third of all rows holds one text: it fills a shard, the other seven are equal to a few bytes; small groups share items."""
    rows = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('copy ', 40) ELSE concat(id, ' ', repeat('x', cast(id % 97 AS int))) END AS text")
    texts = [tuple(r) for r in rows.collect()]
    for grain, near in ((4096, 8), (256, 1000)):
        total = sorted(law(sharding.shard(rows, grain=grain).collect(), texts))
        assert total[-1] == 201 * 1000 and total[-2] - total[0] <= near
