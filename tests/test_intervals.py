"""Ranges and periods against comparisons of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import intervals as I
from foliospark.operators import relational


def test_bounds(spark):
    refs = {"B3:AA9": (2, 3, 27, 9), "$B$3": (2, 3, 2, 3), "B:D": (2, 1, 4, 1048576), "3:9": (1, 3, 16384, 9), "XFD1:A1048576": (1, 1, 16384, 1048576), "aa10:Z2": (26, 2, 27, 10)}
    df = spark.createDataFrame([(r,) for r in refs], "ref string").withColumns(I.bounds(F.col("ref")))
    assert {r.ref: (r.c1, r.r1, r.c2, r.r2) for r in df.collect()} == refs


def test_ranges_meet_like_all_pairs(spark):
    """Whole columns, whole rows, single cells, large and small blocks of three sheets."""
    rng = np.random.default_rng(4)
    rows = [(0, 900, 1, I.ROWS, 1, 1), (0, 901, 1, I.ROWS, 2, 2), (0, 902, 5, 5, 1, I.COLUMNS), (0, 903, 1, I.ROWS, 1, I.COLUMNS)]
    for k in range(150):
        r, c = int(rng.integers(1, 400)), int(rng.integers(1, 400))
        h, w = (int(2 ** rng.uniform(0, 9)) for _ in range(2))
        rows.append((k % 3, k, r, r + h - 1, c, c + w - 1))
    df = spark.createDataFrame(rows, "sheet int, id int, r1 int, r2 int, c1 int, c2 int")
    got = sorted(tuple(r) for r in I.overlapping_ranges(df, ["sheet"]).collect())
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] <= b[3] and b[2] <= a[3] and a[4] <= b[5] and b[4] <= a[5])
    assert got == want and len(got) == len(set(got))


def test_overlaps_are_counted_alike_in_small_and_large_tables(spark):
    """Sheets of 5, SMALL and more ranges; references read as `bounds` reads them, each overlap counted where it lies."""
    rng = np.random.default_rng(5)
    rows = [(sheet, k, f"{'ABCZ'[k % 4]}{int(rng.integers(1, 40))}:A{'BX'[k % 2]}{int(rng.integers(1, 40))}" if k % 9 else "C:D") for sheet, n in ((1, 5), (2, I.SMALL), (3, I.SMALL + 40)) for k in range(n)]
    df = spark.createDataFrame(rows, "sheet int, id int, ref string")
    ends = {(r.sheet, r.id): r for r in df.withColumns(I.bounds(F.col("ref"))).collect()}
    assert {(r.sheet, r.id): r for r in I.with_bounds(df, "ref").select("sheet", "id", "ref", "c1", "r1", "c2", "r2").collect()} == {k: tuple(r[c] for c in ("sheet", "id", "ref", "c1", "r1", "c2", "r2")) for k, r in ends.items()}
    meet = lambda a, b: a.sheet == b.sheet and a.r1 <= b.r2 and b.r1 <= a.r2 and a.c1 <= b.c2 and b.c1 <= a.c2
    want = sorted((a.sheet, a.id, a.ref, sum(meet(a, b) for b in ends.values())) for a in ends.values())
    assert sorted(tuple(r) for r in I.overlap_counts(I.with_bounds(df, "ref"), ["sheet"], ["ref"]).collect()) == want


def test_ranges_of_small_tables_are_written_counted(spark):
    """What is written of a small table is its counts, no bounds to be shuffled and joined again; repeats add up, and what lacks a table or
    a bound meets nothing."""
    rows = [(1, 1, 1, 2, 1, 2), (1, 2, 2, 3, 2, 3), (1, 2, 2, 3, 2, 3), (1, 3, 9, 9, None, 9), (None, 4, 1, 2, 1, 2), (2, 5, 1, 1, 1, 1)]
    before = len(getattr(spark, "_foliospark_written", ()))
    got = I.overlap_counts(spark.createDataFrame(rows, "sheet int, id int, r1 int, r2 int, c1 int, c2 int"), ["sheet"], [])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 3), (1, 2, 6), (2, 5, 1)]
    (path,) = spark._foliospark_written[before:]
    kept = spark.read.parquet(path)
    assert kept.where("overlapping is null or r1 is not null or c2 is not null").isEmpty()


@pytest.mark.parametrize("name, number", [("a", 1), ("Z", 26), ("AA", 27), ("XFD", 16384), ("ABCD", 19010), ("ZZZZZ", 12356630), ("", None)])
def test_letters_to_number(spark, name, number):
    assert spark.range(1).select(I.letters_to_number(F.lit(name)).alias("n")).first().n == number


def test_derived_tables_read_their_source_once(spark):
    """Statements and cells come from one scan of orders and lineitem, as the rows of the united branches."""
    from foliospark import derive as D

    for name, source in (("statements", "o_orderkey"), ("cells", "l_orderkey")):
        one = D.view(spark, "/root/testdata/sf0.001", name)
        kept = D._ONE_PASS.pop(name)
        try:
            many = D.view(spark, "/root/testdata/sf0.001", name)
        finally:
            D._ONE_PASS[name] = kept
        scans = [p for p in one._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation [" in p and source in p]
        assert len(scans) == 1 and one.schema.simpleString() == many.schema.simpleString()
        assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_active_at_many_times(spark):
    rng = np.random.default_rng(6)
    grants = [(f"u{rng.integers(3)}", "abc"[rng.integers(3)], int(s := rng.integers(0, 50)), int(s + rng.integers(-2, 30))) for _ in range(60)] + [("u0", "a", 5, None)]
    g = spark.createDataFrame(grants, "who string, item string, start long, stop long")
    got = {(r.as_of, r.who): (r.active, r.expired, r.active_items) for r in I.active_at(g, spark.range(0, 90, 3).select(F.col("id").alias("as_of")), who=["who"], item="item", start="start", end="stop").collect()}
    want = {}
    for t in range(0, 90, 3):
        for w in {x[0] for x in grants}:
            own = [x for x in grants if x[0] == w and x[3] is not None and x[2] < x[3]]
            on, off = [x for x in own if x[2] <= t < x[3]], [x for x in own if x[3] <= t]
            if on or off:
                want[t, w] = (len(on), len(off), ",".join(sorted({x[1] for x in on})))
    assert got == want


def test_coverage_is_the_area_of_unit_squares(spark):
    """Texts that overlap each other, regions that overlap, a page without any region."""
    spans = [(1, 1, 0, 0, 40, 12), (1, 1, 20, 6, 60, 18), (1, 1, 0, 40, 90, 52), (1, 2, 5, 5, 25, 15)]
    regions = [(1, 1, 0, "paragraph", 10, 0, 50, 10), (1, 1, 1, "table", 30, 5, 70, 45), (1, 1, 7, "footer", 0, 40, 90, 52)]
    s = spark.createDataFrame([(*x[:2], *map(float, x[2:])) for x in spans], "source_id long, page_number long, x1 double, y1 double, x2 double, y2 double")
    r = spark.createDataFrame([(*x[:4], *map(float, x[4:])) for x in regions], "source_id long, page_number long, region_id long, type string, x1 double, y1 double, x2 double, y2 double")
    got = {x.page_number: x for x in relational.apply("a07_coverage", spark, spans=s, regions=r).collect()}
    for page in (1, 2):
        cells = lambda boxes: {(x, y) for b in boxes for x in range(b[0], b[2]) for y in range(b[1], b[3])}
        text, seen = cells([b[2:] for b in spans if b[1] == page]), cells([b[4:] for b in regions if b[1] == page and b[3] != "footer"])
        tiles = lambda c: {(x // 16, y // 16) for x, y in c}
        open_ = sorted(tiles(text) - tiles(seen), key=lambda t: (t[1], t[0]))
        assert (got[page].text_area, got[page].covered_area, got[page].tiles, got[page].uncovered) == (len(text), len(text & seen), len(tiles(text)), len(open_))
        assert got[page].where_uncovered == " ".join(f"{x}:{y}" for x, y in open_)


def test_coverage_shuffles_boxes_once(spark):
    """A wide text of 3000 tiles, left of zero and above it too: boxes are shuffled, once, and no tile or strip is."""
    kinds = "source_id long, page_number long, x1 double, y1 double, x2 double, y2 double"
    s = spark.createDataFrame([(1, 1, -20.0, -8.0, 47980.0, 8.0), (2, 1, 0.0, 0.0, 16.0, 16.0)], kinds)
    r = spark.createDataFrame([(1, 1, 0, "table", 0.0, -16.0, 47980.0, 0.0), (1, 1, 1, "figure", 0.0, 0.0, 16.0, 4.0), (3, 1, 0, "table", 0.0, 0.0, 9.0, 9.0)], kinds.replace("page_number long,", "page_number long, region_id long, type string,"))
    out = relational.apply("a07_coverage", spark, spans=s, regions=r)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {x.source_id: x for x in out.collect()}
    assert set(got) == {1, 2} and (got[2].coverage, got[2].tiles, got[2].where_uncovered) == (0.0, 1, "0:0")
    assert (got[1].text_area, got[1].covered_area) == (48000 * 16.0, 47980 * 8 + 16 * 4.0)
    left = [f"{x}:-1" for x in (-2, -1)] + [f"{x}:0" for x in (-2, -1, *range(1, 2999))]
    assert (got[1].tiles, got[1].uncovered, got[1].where_uncovered) == (2 * 3001, len(left), " ".join(left))


def test_fragments_are_dealt_once(spark):
    """Fragments come from one scan of lineitem, as the rows of the united branches, and their merge shuffles nothing else."""
    from foliospark import derive as D
    from foliospark.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    one = D.view(spark, sf, "fragments")
    kept = D._ONE_PASS.pop("fragments")
    try:
        many = D.view(spark, sf, "fragments")
    finally:
        D._ONE_PASS["fragments"] = kept
    assert one.schema.simpleString() == many.schema.simpleString() and one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()
    plan = QUERIES["w07_merge_chain"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan parquet") == 1


def test_merge_chain_of_odd_fragments(spark):
    """Pages missing, rows without text, cells said twice, texts that hold the separators: as the statement in DuckDB."""
    import duckdb

    from foliospark.operators import relational as R

    rng = np.random.default_rng(3)
    texts = ["a", "b", None, "", "a|1:1:1:b", "1:1"]
    rows = []
    for t in range(60):
        for p in sorted(rng.choice(np.arange(1, 7), rng.integers(1, 6), replace=False).tolist()):
            for r in range(rng.integers(1, 6)):
                if rng.random() < 0.9:
                    rows += [(t, p, r, c, 1, int(rng.integers(1, 3)) if rng.random() < 0.1 else 1, r == 0, texts[rng.integers(0, 2 if rng.random() < 0.8 else 6)]) for c in range(rng.integers(1, 3))]
    rows += [(None, 1, 0, 0, 1, 1, True, "a"), (1, None, 0, 0, 1, 1, True, "a"), (2, 1, None, 0, 1, 1, False, "a")]
    kind = "table_id long, page_number long, row long, col long, row_span int, col_span int, is_header boolean, raw_text string"
    got = R.apply("w07_merge_chain", spark, fragments=spark.createDataFrame(rows, kind)).collect()
    d = duckdb.connect()
    d.execute("CREATE TABLE fragments (" + kind.replace("long", "bigint").replace(" string", " varchar") + ")")
    d.executemany("INSERT INTO fragments VALUES (?, ?, ?, ?, ?, ?, ?, ?)", rows)
    want = d.execute(R.duckdb("w07_merge_chain")).fetchall()
    order = lambda rs: sorted((tuple(r) for r in rs), key=repr)
    assert order(got) == order(want) and len({r.merged_row - r.source_row for r in got}) > 4
