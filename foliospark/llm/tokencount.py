"""Token counts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliospark.llm.common import small_batches
from foliospark.llm.tokens import Encoder


def count_tokens(df: DataFrame, path: str, *, text: str = "text", keep: list[str] | None = None, limit: int = 512) -> DataFrame:
    """The columns `keep` (default: all but the text) with n_bytes, n_tokens and over_limit (n_tokens > limit).

    One map-only Arrow pass: only the kept columns and the text reach Python, only lengths come back. Long texts
    are cut at safe places and batches are balanced by size, so memory follows neither text nor table length.
    Null and empty texts have 0 tokens; repeated rows stay; an empty table gives no rows; columns of the input
    named like a result are replaced by it.
    """
    small_batches(df.sparkSession)
    made = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in (keep if keep is not None else df.columns) if c not in (*made, text)]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        enc = Encoder(path, lengths_only=True)
        for b in batches:
            col = b.column(len(keep))
            n = pa.array(enc([t or "" for t in col.to_pylist()]), pa.int64())
            size = pc.fill_null(pc.binary_length(col), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), size, n, pc.greater(n, limit)], names=[*keep, *made])

    return df.select(*[f"`{c}`" for c in keep], df[f"`{text}`"].cast("string").alias("__text")).mapInArrow(run, schema)
