"""What several operators of this subpackage share: shared-folder tables, Arrow text buffers, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only on one machine (tests), where the session names none, one of our own is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(spark, "_foliospark_shared", None) or tempfile.mkdtemp(prefix="foliospark-")
        spark._foliospark_shared = found
    spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, **options: int) -> DataFrame:
    """df written as Parquet (with the writer's `options`) in the shared folder and read back: cuts lineage, survives lost executors.

    The table stays until `discard` or `release`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    spark._foliospark_tables = {*getattr(spark, "_foliospark_tables", ()), path}
    got = spark.read.schema(df.schema).parquet(path)
    got._foliospark_path = path
    return got


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables. Only for those whose every reader has been written itself."""
    for df in tables:
        if path := getattr(df, "_foliospark_path", None):
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            spark._foliospark_tables.discard(path)


def release(spark: SparkSession) -> None:
    """Deletes every table that `stored` has left in this session, once the results that read them are written."""
    for path in list(getattr(spark, "_foliospark_tables", ())):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        spark._foliospark_tables.discard(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that long texts do not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type == pa.null():
        column = column.cast(pa.large_string())
    a = pc.fill_null(column, "").cast(pa.large_string())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def runs_by_bytes(sizes: list[int] | np.ndarray, most: int):
    """(first, after last) of consecutive items whose sizes add up to `most` at most, or of one larger item."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield first, i
            first, total = i, 0
        total += int(n) + 1
    if first < len(sizes):
        yield first, len(sizes)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def partitions_for(n_bytes: float, each: float, least: int) -> int:
    """How many partitions keep each at `each` bytes; grows with the input, `least` at least."""
    return int(max(least, -(-n_bytes // each)))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table of longs: (node, component), component the smallest node reachable.

    Each round hooks every node to its least neighbour, if that is less, follows the pointers to their roots by
    doubling, and goes on with the graph of roots. A root that stays a root in two rounds has taken in a node, as a
    neighbour that hooked elsewhere brings it next to a smaller root. So the nodes that still have edges halve in two
    rounds at least, in whatever order the ids run along a chain. Nothing is collected but whether rows are left.
    Self-loops keep single nodes.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = stored(pairs.union(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    graph, last, rounds = both.where("x <> y"), None, []
    while graph.limit(1).count():
        up = held = stored(graph.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("p")))
        while True:
            # a pointer leads to a smaller node, so no cycle; a root points to itself
            jump = up.select(F.col("x").alias("p"), F.col("p").alias("q"))
            far = stored(up.join(jump, "p").select("x", "p", "q"))
            discard(held)
            up, held = far.select("x", F.col("q").alias("p")), far
            if not far.where("p <> q").limit(1).count():
                break
        rounds.append((up, held))
        ends = graph.join(up, "x").select(F.col("p").alias("x"), "y").join(up.select(F.col("x").alias("y"), F.col("p").alias("q")), "y")
        graph = stored(ends.select("x", F.col("q").alias("y")).where("x <> y").distinct())
        if last is not None:
            discard(last)
        last = graph
    labels = None
    for up, held in reversed(rounds):
        if labels is not None:
            up = stored(up.join(labels.select(F.col("x").alias("p"), F.col("p").alias("q")), "p", "left").select("x", F.coalesce("q", "p").alias("p")))
            discard(held, *([labels] if hasattr(labels, "_foliospark_path") else []))
        labels = up
    nodes = both.select(F.col("x").alias("node")).distinct()
    if labels is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(labels, F.col("node") == F.col("x"), "left").select("node", F.coalesce("p", "node").alias("component"))
