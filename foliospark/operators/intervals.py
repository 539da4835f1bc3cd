"""Joins and sweeps over intervals: ranges of cells that overlap, grants that are active at given times."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.tables import written

#: Columns A to XFD and rows of a sheet.
COLUMNS, ROWS = 16384, 1048576


def letters_to_number(letters: Column) -> Column:
    """A is 1, Z 26, AA 27, XFD 16384; null for no letters."""
    up = F.upper(letters)
    nth = lambda i: F.ascii(F.substring(up, i, 1)) - 64
    # with A as 0 a number of base 26, to which every place adds one; no lambda, which would keep the whole from being compiled
    places = F.conv(F.translate(up, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789ABCDEFGHIJKLMNOP"), 26, 10).cast("decimal(38,0)")
    n = (places + ((F.pow(F.lit(26.0), F.length(up)) - 1) / 25).cast("decimal(38,0)")).cast("int")
    short = F.when(F.length(up) == 1, nth(1)).when(F.length(up) == 2, nth(1) * 26 + nth(2)).when(F.length(up) == 3, (nth(1) * 26 + nth(2)) * 26 + nth(3))
    return F.when(F.length(up) > 3, n).otherwise(short)


def bounds(ref: Column) -> dict[str, Column]:
    """c1, r1, c2, r2 of `B3:AA9`, `$B$3`, `B:D` (whole columns) or `3:9` (whole rows), in order whichever way round it is written."""
    part = lambda k, what: F.regexp_extract(F.element_at(F.split(F.replace(ref, F.lit("$"), F.lit("")), ":"), k), what, 0)
    col = lambda k: letters_to_number(part(k, "^[A-Za-z]+"))
    row = lambda k: F.nullif(part(k, "[0-9]+$"), F.lit("")).cast("int")
    ends = {"c": (F.coalesce(col(1), F.lit(1)), F.coalesce(col(-1), F.lit(COLUMNS))), "r": (F.coalesce(row(1), F.lit(1)), F.coalesce(row(-1), F.lit(ROWS)))}
    return {f"{d}{k}": f(*ends[d]) for d in "cr" for k, f in ((1, F.least), (2, F.greatest))}


def with_bounds(ranges: DataFrame, ref: str) -> DataFrame:
    """ranges with c1, r1, c2, r2 of the reference in column `ref`, as `bounds` gives them; each end is read once.

    Ends, their letters and digits, and their numbers are steps behind generators: in one expression the patterns would be
    matched again for every letter, and the code of it would be too long to be compiled."""
    own = ranges.columns
    once = lambda df, name, **of: df.select(*own, F.explode(F.array(F.struct(*[c.alias(n) for n, c in of.items()]))).alias(name))
    ends = F.split(F.replace(ref, F.lit("$"), F.lit("")), ":")
    parts = once(ranges, "__e", a=F.element_at(ends, 1), b=F.element_at(ends, -1))
    read = {f"{d}{k}": F.regexp_extract(f"__e.{k}", what, 0) for d, what in (("c", "^[A-Za-z]+"), ("r", "[0-9]+$")) for k in "ab"}
    parts = once(parts, "__s", **read)
    number = lambda k, edge: F.coalesce(letters_to_number(F.col(f"__s.{k}")) if k[0] == "c" else F.nullif(f"__s.{k}", F.lit("")).cast("int"), F.lit(edge))
    parts = once(parts, "__f", ca=number("ca", 1), cb=number("cb", COLUMNS), ra=number("ra", 1), rb=number("rb", ROWS))
    return parts.select(*own, *[f(f"__f.{d}a", f"__f.{d}b").alias(f"{d}{k}") for d in "cr" for k, f in ((1, F.least), (2, F.greatest))])


#: Ranges of a table of at most this many are compared with each other; those of larger tables meet by levels.
SMALL = 128
#: A level's stretch is so many powers of two longer than that of the level below.
STEP = 4


def _level(n: Column) -> Column:
    """The least level whose stretch holds n, as its power of two."""
    bits = F.length(F.bin(n - 1)).cast("int") - F.when(n == 1, 1).otherwise(0)
    return (F.ceil(bits / STEP) * STEP).cast("int")


def _sized(ranges: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """Ranges with how many ranges their table has, written once, as bounds may be parsed from text: a generator keeps the
    optimiser from copying that into every use."""
    ranges = ranges.select(*on, "id", *keep, F.inline(F.array(F.struct("r1", "r2", "c1", "c2"))))
    return written(ranges.withColumn("of", F.count("*").over(Window.partitionBy(*on))))


def _over(x: str, y: str) -> Column:
    c = lambda s, n: F.col(f"{s}.{n}")
    return (c(x, "r1") <= c(y, "r2")) & (c(y, "r1") <= c(x, "r2")) & (c(x, "c1") <= c(y, "c2")) & (c(y, "c1") <= c(x, "c2"))


def _in_small_tables(sized: DataFrame, on: list[str]) -> DataFrame:
    """Rows x and y of tables of at most SMALL ranges that overlap: one equi-join on the table, whose rows are shuffled once."""
    few = sized.where(F.col("of") <= SMALL)
    same = reduce(and_, [F.col(f"x.{n}") == F.col(f"y.{n}") for n in on])
    return few.alias("x").join(few.alias("y"), same).where(_over("x", "y"))


def overlapping_ranges(ranges: DataFrame, on: list[str]) -> DataFrame:
    """(on, a, b): the ids of ranges of one `on` that overlap, both ways and each with itself. ranges: on, id, r1, r2, c1, c2."""
    sized = _sized(ranges, on, [])
    few = _in_small_tables(sized, on).select(*[F.col(f"x.{n}").alias(n) for n in on], F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    return few.unionByName(_by_levels(sized.where(F.col("of") > SMALL), on))


def overlap_counts(ranges: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """(on, id, keep, overlapping): how many ranges of its table each range overlaps, itself included.

    Ranges of a small table are counted beside each other in the windows that tell its size, so their table is shuffled once, and what
    is written of them is the result; only ranges of larger tables are written with their bounds, to meet by levels. Ranges alike in id
    and `keep` count as one, with the sum."""
    edges = ["r1", "r2", "c1", "c2"]
    whole = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of_range = Window.partitionBy(*on, "id", *keep).orderBy(F.lit(0))
    ranges = ranges.select(*on, "id", *keep, F.inline(F.array(F.struct(*edges)))).where(reduce(and_, [F.col(n).isNotNull() for n in on]))
    # in the order of the last window, so that one sort serves all
    every = whole(Window.partitionBy(*on).orderBy("id", *keep))
    sized = ranges.withColumn("of", F.count("*").over(every))
    small = F.col("of") <= SMALL
    beside = sized.withColumn("beside", F.collect_list(F.when(small, F.struct(*edges))).over(every))
    over = lambda y: (F.col("c1") <= y["c2"]) & (y["c1"] <= F.col("c2")) & (F.col("r1") <= y["r2"]) & (y["r1"] <= F.col("r2"))
    n = beside.select(*on, "id", *keep, "of", *edges, F.size(F.filter("beside", over)).cast("bigint").alias("n"))
    summed = n.withColumns({"sum": F.sum("n").over(whole(of_range)), "nth": F.row_number().over(of_range)}).where(~small | ((F.col("nth") == 1) & (F.col("sum") > 0)))
    counted = written(summed.select(*on, "id", *keep, F.when(small, F.col("sum")).alias("overlapping"), *[F.when(~small, F.col(c)).alias(c) for c in edges]))
    few, many = counted.where("overlapping is not null").select(*on, "id", *keep, "overlapping"), counted.where("overlapping is null")
    counts = _by_levels(many, on).groupBy(*on, F.col("a").alias("id")).agg(F.count("*").alias("overlapping"))
    return few.unionByName(many.select(*on, "id", *keep).join(counts, [*on, "id"]))


def _by_levels(ranges: DataFrame, on: list[str]) -> DataFrame:
    """Overlaps as in `overlapping_ranges`, for tables of any number of ranges.

    A range of n rows has the level of the least power of 16 that holds n, and touches two stretches of that length at
    most; so it does at every higher level. Of two ranges one is at least as large in rows and columns (it then stands with its own
    levels, the other with every level from its own up), or one is larger in rows and the other in columns. They count in the
    first stretch that both touch. A range has four entries at most for each pair of levels that ranges of the table have (6
    times 5 at most, so those are broadcast): a whole column is two entries, not a million."""
    sized = ranges.select(*on, "id", "r1", "r2", "c1", "c2", _level(F.col("r2") - F.col("r1") + 1).alias("lr"), _level(F.col("c2") - F.col("c1") + 1).alias("lc"))
    rows, cols = sized.select(F.col("lr").alias("at_r")).distinct(), sized.select(F.col("lc").alias("at_c")).distinct()

    def entries(own_r: bool, own_c: bool, strict: bool = False) -> DataFrame:
        e = sized
        for own, level, at, known in ((own_r, "lr", "at_r", rows), (own_c, "lc", "at_c", cols)):
            higher = F.col(at) > F.col(level) if strict else F.col(at) >= F.col(level)
            e = e.withColumn(at, F.col(level)) if own else e.join(F.broadcast(known), higher)  # 6 or 5 rows at most
        e = e.withColumns({"fr": F.expr("shiftright(r1, at_r)"), "fc": F.expr("shiftright(c1, at_c)")})
        return e.withColumn("br", F.explode(F.expr("sequence(fr, shiftright(r2, at_r))"))).withColumn("bc", F.explode(F.expr("sequence(fc, shiftright(c2, at_c))")))

    def met(x: DataFrame, y: DataFrame, both_ways) -> DataFrame:
        c = lambda s, n: F.col(f"{s}.{n}")
        here = (c("x", "br") == F.greatest(c("x", "fr"), c("y", "fr"))) & (c("x", "bc") == F.greatest(c("x", "fc"), c("y", "fc")))
        found = x.alias("x").join(y.alias("y"), [c("x", n) == c("y", n) for n in (*on, "at_r", "at_c", "br", "bc")]).where(here & _over("x", "y"))
        pair = lambda p, q: F.struct(c(p, "id").alias("a"), c(q, "id").alias("b"))
        return found.select(*[c("x", n).alias(n) for n in on], F.inline(F.when(both_ways, F.array(pair("x", "y"), pair("y", "x"))).otherwise(F.array(pair("x", "y")))))

    unlike = (F.col("x.lr") != F.col("y.lr")) | (F.col("x.lc") != F.col("y.lc"))
    return met(entries(True, True), entries(False, False), unlike).unionByName(met(entries(True, False, True), entries(False, True, True), F.lit(True)))


def active_at(grants: DataFrame, times: DataFrame, *, who: list[str], item: str, start: str, end: str) -> DataFrame:
    """(as_of, who, active, expired, active_items): what holds at each time of `times` (as_of), start <= as_of < end.

    Starts, ends and times are events in one order, and counts run over them by who and item: a grant is two events,
    however many times are asked. Only times for which a who has any event before are returned; grants that end before they
    start or lack an end of their time never hold."""
    key = [*who, item]
    g = grants.where(F.col(start) < F.col(end))
    opened = g.select(*key, F.col(start).alias("at"), F.lit(0).alias("asks"), F.lit(1).alias("active"), F.lit(0).alias("expired"))
    closed = g.select(*key, F.col(end).alias("at"), F.lit(0).alias("asks"), F.lit(-1).alias("active"), F.lit(1).alias("expired"))
    asked = g.select(*key).distinct().crossJoin(F.broadcast(times)).select(*key, F.col("as_of").alias("at"), F.lit(1).alias("asks"), F.lit(0).alias("active"), F.lit(0).alias("expired"))  # the times that are asked for
    so_far = Window.partitionBy(*key).orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = opened.unionByName(closed).unionByName(asked).withColumns({"active": F.sum("active").over(so_far), "expired": F.sum("expired").over(so_far)}).where("asks = 1")
    held = F.array_sort(F.collect_list(F.when(F.col("active") > 0, F.col(item))))
    return run.groupBy(F.col("at").alias("as_of"), *who).agg(F.sum("active").alias("active"), F.sum("expired").alias("expired"), F.array_join(held, ",").alias("active_items")).where("active + expired > 0")
