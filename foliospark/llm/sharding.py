"""Documents dealt to shards of nearly equal bytes by Karmarkar-Karp differencing; equal texts stay together."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliospark.llm.common import partitions_for, stored


def difference(sizes: list[int], ways: int) -> np.ndarray:
    """The part of each item, 0 to ways - 1, by differencing.

    Every item starts as a partial partition with itself in one part. The two partial partitions with the largest spread are
    combined, the fullest part of one with the emptiest of the other, until one is left; only differences to the emptiest part
    are kept, as what all parts share no longer matters. Each combination notes which parts of its two children it joined, so
    a walk from the last one down gives every item its part. Part 0 is the fullest; equal spreads are taken in the order they
    came, so the result depends on the order of the items alone.
    """
    n = len(sizes)
    if not n:
        return np.zeros(0, np.int32)
    heap = [(-s, i, (s, *[0] * (ways - 1))) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    children: list[tuple] = []
    while len(heap) > 1:
        _, x, a = heapq.heappop(heap)
        _, y, b = heapq.heappop(heap)
        sums = [p + q for p, q in zip(a, reversed(b), strict=True)]
        order = sorted(range(ways), key=lambda k: (-sums[k], k))
        least = sums[order[-1]]
        made = tuple(sums[k] - least for k in order)
        children.append((x, y, order))
        heapq.heappush(heap, (-made[0], n + len(children) - 1, made))
    part = np.zeros(n, np.int32)
    at = {heap[0][1]: list(range(ways))}  # the final part of each part of a node
    for node in range(n + len(children) - 1, n - 1, -1):
        final, (x, y, order) = at.pop(node), children[node - n]
        of = [0] * ways
        for k, slot in zip(order, final, strict=True):
            of[k] = slot
        at[x], at[y] = of, of[::-1]
    for i in range(n):
        part[i] = at[i][0]
    return part


def items_of(groups: DataFrame, grain: int) -> DataFrame:
    """groups (digest, bytes) with the item each belongs to: a group of a `grain`-th of all bytes or more is an item of its own.

    Smaller ones share `grain` items by a hash of the digest, so there are at most 2 * grain items however many groups."""
    total = groups.agg(F.sum("bytes").alias("all"))
    big = F.col("bytes") * grain >= F.col("all")
    return groups.crossJoin(F.broadcast(total)).select("digest", "bytes", big.alias("big"), F.when(big, F.hex("digest")).otherwise(_bundle(F.col("digest"), grain)).alias("item"))  # total: one row


def _bundle(digest, grain: int):
    """Of single groups while there are few: the digest decides alone, so every run and every retry agrees."""
    return F.pmod(F.xxhash64(digest), F.lit(grain)).cast("string")


def shard(df: DataFrame, n_shards: int = 8, *, id_col: str = "doc_id", text: str = "text", grain: int = 4096) -> DataFrame:
    """Per row: id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null, as this law moves rows when shards are added).

    size is the text's UTF-8 bytes plus 1. Rows of equal texts (by a 128-bit digest, null as empty) form a group, which stays
    in one shard; shards are as near in size as groups allow: one group larger than a shard's share fills a shard of its own
    and the others are balanced among themselves. Slots count a shard's rows from 0 without gaps, in the order of hashed
    ids; repeated rows take neighbouring slots. Null ids are rows like others; an empty table gives no rows; other columns
    are not read.

    Groups are added up on Spark, large ones are items of their own and small ones share items, so differencing gets at
    most 2 * `grain` items, and their shards are a table of proven size that is broadcast. Texts are read once and never
    shuffled; ranks come from counts of hashed blocks, so no task holds a shard.
    """
    spark = df.sparkSession
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.md5(t)).alias("digest"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("crc"))
    # one row an id and text, with how often it occurs
    rows = stored(rows.groupBy("id", "digest", "size", "crc").agg(F.count("*").alias("times")))
    items = items_of(rows.groupBy("digest").agg(F.sum(F.col("size") * F.col("times")).alias("bytes")), grain)
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("shard", T.IntegerType())])

    def dealt(batches):
        found = [b for b in batches if b.num_rows]
        if found:
            t = pa.Table.from_batches(found).sort_by([("bytes", "descending"), ("item", "ascending")]).combine_chunks()
            yield pa.RecordBatch.from_arrays([t["item"].combine_chunks(), pa.array(difference(t["bytes"].to_pylist(), n_shards))], names=schema.names)

    summed = items.groupBy("item").agg(F.sum("bytes").alias("bytes"))
    shards = stored(summed.repartition(1).mapInArrow(dealt, schema))  # 2 * grain items at most
    own = shards.where(F.length("item") == 32).select(F.unhex("item").alias("digest"), F.col("shard").alias("__own"))
    shared = shards.where(F.length("item") < 32).select("item", "shard")
    placed = rows.join(F.broadcast(own), "digest", "left").withColumn("item", F.when(F.col("__own").isNull(), _bundle(F.col("digest"), grain))).join(F.broadcast(shared), "item", "left")
    placed = placed.select("id", "digest", "size", "crc", "times", F.coalesce("__own", "shard").alias("shard"))
    blocks = partitions_for(rows.count(), 200_000, spark.sparkContext.defaultParallelism)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id", "digest"), F.lit(blocks)).cast("int"))
    counts = placed.groupBy("shard", "block").agg(F.sum("times").alias("n"))
    before = counts.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before"))
    inside = F.sum("times").over(Window.partitionBy("shard", "block").orderBy("id", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("times")
    ranked = placed.withColumn("inside", inside).join(before, ["shard", "block"])
    each = ranked.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    return each.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("inside") + F.col("copy")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
