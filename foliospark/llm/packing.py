"""Cost-balanced packing of documents into training sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliospark.llm.common import small_batches
from foliospark.llm.tokens import Encoder


def attention_cost(length, linear: float, quadratic: float):
    """Estimated cost of one piece: a linear share (projections, feed-forward) and a quadratic one (attention)."""
    return linear * length + quadratic * length * length


def assign(lengths: list[int], room: list[int], linear: float, quadratic: float) -> list[tuple[int, int, int]]:
    """Longest piece first, each to the cheapest sequence that still has room for all of it.

    Pieces that fit nowhere whole are then cut into what room is left, cheapest sequence first. Returns
    (piece, tokens taken from its front, sequence) in order; what exceeds the room stays unassigned.
    """
    free, cost, out, late = np.array(room, np.int64), np.zeros(len(room)), [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        can = np.where(free >= n, cost, np.inf)
        s = int(can.argmin()) if len(can) else -1
        if s < 0 or can[s] == np.inf:
            late.append(i)
            continue
        free[s] -= n
        cost[s] += attention_cost(n, linear, quadratic)
        out.append((i, n, s))
    for i in late:
        n = lengths[i]
        for s in sorted(np.flatnonzero(free), key=lambda s: (cost[s], s)):
            if not n:
                break
            take = int(min(n, free[s]))
            free[s] -= take
            cost[s] += attention_cost(take, linear, quadratic)
            n -= take
            out.append((i, take, int(s)))
    return out


def powers(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def pack(df: DataFrame, path: str, *, id_col: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 1,
         window: int = 4096, linear: float = 1.0, quadratic: float = 1 / 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    Map-only: each task encodes its rows, cuts off full sequences, and packs the rests in windows of `window`
    pieces; what a window leaves open moves on to the next. The last window of a task also opens sequences of
    power-of-two lengths, so every sequence is full. sequence_id holds the task's partition in its high bits.
    Windows follow the order of rows in the partition, which a table scan fixes. Null and empty texts are one
    end token; repeated rows are packed each; an empty table gives no rows; other columns are not read.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType
    fields = [("doc_id", kind)] + [(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType([T.StructField(*f) for f in fields + [("ids", T.BinaryType())] * with_ids])

    def run(batches):
        enc, count, rests = Encoder(path), 0, []
        base = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def put(doc, start, part, total, seq, offset):
            rows.append((doc, start, len(part) // 4, zlib.crc32(part), total, base + seq, offset, part)[: 7 + with_ids])

        def close(last: bool):
            nonlocal count, rests
            total = sum(len(r[2]) // 4 for r in rests)
            room = [capacity] * (total // capacity) + (powers(total % capacity) if last else [])
            used = [0] * len(room)
            at = [0] * len(rests)
            for i, n, s in assign([len(r[2]) // 4 for r in rests], room, linear, quadratic):
                doc, start, ids, whole = rests[i]
                put(doc, start + at[i], ids[4 * at[i] : 4 * (at[i] + n)], whole, count + s, used[s])
                at[i] += n
                used[s] += n
            count += len(room)
            rests = [(d, s + a, ids[4 * a :], w) for (d, s, ids, w), a in zip(rests, at, strict=True) if 4 * a < len(ids)]

        def flush():
            nonlocal rows
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema.fields)
            rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=schema.names)

        end, types = np.array([end_id], "<u4").tobytes(), None
        for b in batches:
            types = types or [b.schema.field(0).type, *[pa.int64()] * 6, *[pa.binary()] * with_ids]
            for doc, ids in zip(b.column(0).to_pylist(), enc([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids += end
                total, start = len(ids) // 4, 0
                while total - start >= capacity:
                    put(doc, start, ids[4 * start : 4 * (start + capacity)], total, count, 0)
                    count, start = count + 1, start + capacity
                if start < total:
                    rests.append((doc, start, ids[4 * start :], total))
                if len(rests) >= window:
                    close(False)
            if rows:
                yield flush()
        if rests:
            close(True)
            yield flush()

    return df.select(df[f"`{id_col}`"].alias("doc_id"), df[f"`{text}`"].cast("string").alias("text")).mapInArrow(run, schema)
