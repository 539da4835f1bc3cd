"""Tables written in the folder that all executors share, so that a plan reads a result instead of computing it again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`. Only on one machine (tests), where the session names none, a folder of its own is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = getattr(spark, "_foliospark_folder", None) or tempfile.mkdtemp(prefix="foliospark-")
    spark._foliospark_folder = found
    return found


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back. It stays until `release`, as results read it when they are run."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    df.sparkSession._foliospark_written = [*getattr(df.sparkSession, "_foliospark_written", ()), path]
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes every table that `written` made in this session, once the results that read them are written; returns how many."""
    paths, spark._foliospark_written = getattr(spark, "_foliospark_written", []), []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)
