"""Audit of how filters interact: survivors of every subset of filters by a Gray-code walk, differenced for every order."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_WORD = r"[^\x20\x09-\x0D]+"
_GAP = r"[\x20\x09-\x0D]+"


def text_rules(text: Column, least_words: int = 200) -> dict[str, Column]:
    """Failure conditions on a text: A short, B repetitive, C capitals, D symbols. Null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, _GAP), "")
    return {
        "A": F.size(words) < least_words,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")) > 2 * F.length(t),
        "D": t.rlike("[#$%&*|]"),
    }


def cells(df: DataFrame, rules: dict[str, Column], *, repeats: str | None = None, labels: DataFrame | None = None, part: str = "source",
          id_col: str = "doc_id", text: str = "text", marks: dict[str, Column] | None = None) -> DataFrame:
    """(part, mask, docs, one count per mark): how many documents of each part fail exactly the filters of `mask`.

    Bit k of mask is the k-th rule; with `repeats` one more filter of that name comes last, failing where a smaller id
    of the whole table has the same text (compared by a 128-bit digest, null as empty). `marks` are conditions on `labels`;
    a document counts for a mark if any label row of its id meets it. A null part is the empty string. Repeated rows are
    counted each and do not fail as repeats of their own id; a null id is smaller than nothing, has no smaller id and no
    labels. An empty table gives no cells. Only ids, digests and masks are shuffled, alike ones added up before each
    exchange; a text that many hold is one row a part and mask from the second exchange on.
    """
    marks = marks or {}
    names = list(marks)
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(rules.values())), F.lit(0))
    digest = F.unhex(F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))) if repeats else F.lit(None).cast("binary")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), digest.alias("d"), mask.cast("int").alias("mask"))
    rows = rows.groupBy("id", "part", "d", "mask").agg(F.count("*").alias("docs"))
    if marks:
        held = labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(*[F.max(F.when(c, 1).otherwise(0)).alias(m) for m, c in marks.items()])
        rows = rows.join(held, "id", "left")
    rows = rows.select("id", "part", "d", "mask", "docs", *[(F.col("docs") * F.coalesce(m, F.lit(0))).alias(m) for m in names])
    counted = ["docs", *names]
    if repeats:
        # one row a text, part and mask, with the row of its smallest id beside its sums
        of = rows.groupBy("d", "part", "mask", F.col("id").isNull().alias("no_id")).agg(*[F.sum(c).alias(c) for c in counted], F.min(F.struct("id", *counted)).alias("first"))
        least = F.min(F.when(~F.col("no_id"), F.col("first.id"))).over(Window.partitionBy("d"))
        of = of.withColumn("is_first", F.col("first.id") == least)
        bit = F.lit(1 << len(rules))
        kept = F.when(F.col("no_id"), F.struct(*counted)).when(F.col("is_first"), F.struct(*[F.col(f"first.{c}").alias(c) for c in counted])).otherwise(F.struct(*[F.lit(0).cast("long").alias(c) for c in counted]))
        of = of.withColumn("kept", kept)
        two = F.array(F.struct(F.col("mask"), *[F.col(f"kept.{c}").alias(c) for c in counted]), F.struct((F.col("mask") + bit).alias("mask"), *[(F.col(c) - F.col(f"kept.{c}")).alias(c) for c in counted]))
        rows = of.select("part", F.inline(two)).where("docs > 0")
    return rows.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in counted])


def walk(counts: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters, from counts by mask (axis 1).

    The subsets are met in Gray-code order, so each step toggles one filter: the counter of active failures goes up or
    down for the masks that hold it, and only those that leave or reach zero change the running survivors.
    """
    n_masks = counts.shape[1]
    masks = np.arange(n_masks)
    active, running = np.zeros(n_masks, np.int64), counts.sum(1)
    out, subset = np.empty_like(counts), 0
    out[:, 0] = running
    for step in range(1, n_masks):
        bit = step & -step
        subset ^= bit
        touched = (masks & bit) > 0
        if subset & bit:
            active[touched] += 1
            running = running - counts[:, touched & (active == 1)].sum(1)
        else:
            active[touched] -= 1
            running = running + counts[:, touched & (active == 0)].sum(1)
        out[:, subset] = running
    return out


def _by_part(cells: DataFrame, n: int, counted: list[str], fields: list[T.StructField], rows) -> DataFrame:
    """One row a part of at most 2 ** n cells; `rows(parts, states)` makes the result of some parts at a time."""
    packed = cells.groupBy("part").agg(F.collect_list(F.struct(F.col("mask").cast("int").alias("mask"), *[F.col(c).cast("long").alias(c) for c in counted])).alias("cells"))
    schema = T.StructType(fields)

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 64):
                s = b.slice(a, 64)
                parts, lists = s.column(0).to_pylist(), s.column(1)
                flat, own = lists.flatten(), np.repeat(np.arange(len(parts)), lists.value_lengths().to_numpy(zero_copy_only=False))
                counts = np.zeros((len(parts), 1 << n, len(counted)), np.int64)
                np.add.at(counts, (own, flat.field(0).to_numpy(zero_copy_only=False)), np.stack([flat.field(k + 1).to_numpy(zero_copy_only=False) for k in range(len(counted))], 1))
                yield pa.RecordBatch.from_arrays(rows(parts, walk(counts)), names=[f.name for f in fields])

    return packed.mapInArrow(run, schema)


def subset_states(cells: DataFrame, filters: str, marks: tuple[str, ...] = ()) -> DataFrame:
    """The stored states: per part and subset of filters (their names in order) the surviving documents and marks."""
    n, counted = len(filters), ["docs", *marks]
    subsets = ["".join(f for k, f in enumerate(filters) if m >> k & 1) for m in range(1 << n)]

    def rows(parts, states):
        return [pa.array(np.repeat(np.array(parts, object), len(subsets))), pa.array(subsets * len(parts)), *[pa.array(states[:, :, k].ravel()) for k in range(len(counted))]]

    return _by_part(cells, n, counted, [T.StructField("part", T.StringType()), T.StructField("subset", T.StringType()), *[T.StructField(c, T.LongType()) for c in counted]], rows)


def order_steps(cells: DataFrame, filters: str, marks: tuple[str, ...] = (), orders: list[str] | None = None) -> DataFrame:
    """Per part, order of the filters (default: all permutations) and step, as differences of the stored states.

    kept and removed are documents after and at the step, redundant those that fail its filter but went before,
    unique_fails those that fail no other filter, <mark>_lost the marked ones among removed, shapley the filter's removed
    documents summed over all permutations, whichever orders are listed.
    """
    n, full = len(filters), (1 << len(filters)) - 1
    every = ["".join(p) for p in permutations(filters)]
    listed = every if orders is None else orders
    at = {f: k for k, f in enumerate(filters)}

    def prefixes(names):
        bits = np.array([[1 << at[f] for f in o] for o in names], np.int64).reshape(len(names), n)
        after = np.cumsum(bits, 1)
        return bits, after - bits, after

    bits, before, after = (x.ravel() for x in prefixes(listed))
    all_bits, all_before, all_after = (x.ravel() for x in prefixes(every))
    which = np.array([at[f] for o in listed for f in o])

    def rows(parts, states):
        docs = states[:, :, 0]
        removed = docs[:, before] - docs[:, after]
        fails = docs[:, :1] - docs[:, [1 << k for k in range(n)]]
        unique = docs[:, [full ^ (1 << k) for k in range(n)]] - docs[:, [full]]
        over_all = docs[:, all_before] - docs[:, all_after]
        shapley = np.stack([over_all[:, all_bits == 1 << k].sum(1) for k in range(n)], 1)
        made = [docs[:, after], removed, fails[:, which] - removed, unique[:, which], *[states[:, before, k + 1] - states[:, after, k + 1] for k in range(len(marks))], shapley[:, which]]
        named = [pa.array(np.repeat(np.array(parts, object), len(which))), pa.array(np.tile(np.repeat(np.array(listed, object), n), len(parts))), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(listed) * len(parts)))]
        return [*named, *[pa.array(m.ravel()) for m in made]]

    fields = [T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType())]
    fields += [T.StructField(c, T.LongType()) for c in ("kept", "removed", "redundant", "unique_fails", *[f"{m}_lost" for m in marks], "shapley")]
    return _by_part(cells, n, ["docs", *marks], fields, rows)


ORACLE = r"""WITH g AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
  100 * length(regexp_replace(x, '[^A-Z]+', '', 'g')) > 2 * length(x), regexp_matches(x, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false)] AS fails
  FROM t LEFT JOIN g USING (doc_id)),
c AS (SELECT part, fails, count(*) AS docs, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, i AS step, o[i] AS k, o[:i - 1] AS earlier FROM o, l),
j AS (SELECT part, o, step, k, docs, good, toxic, fails[k] AS fail, len(list_filter(earlier, lambda e: fails[e])) > 0 AS gone, len(list_filter(fails, lambda e: e)) AS n FROM c, s),
r AS (SELECT part, list_aggregate(list_transform(o, lambda e: chr((64 + e)::INT)), 'string_agg', '') AS filter_order, step, k,
  sum(CASE WHEN NOT fail AND NOT gone THEN docs ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fail AND NOT gone THEN docs ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN fail AND gone THEN docs ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fail AND n = 1 THEN docs ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN fail AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fail AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM j GROUP BY part, o, step, k)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM r"""
