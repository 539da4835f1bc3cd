"""Exact top-k by inner product with MaxScore, over shards of the rows."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def finite(v: Column) -> Column:
    """True for an array without null or non-finite components."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))


def matrix(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(a), -1)


def top_of_shard(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int, lo: np.ndarray, hi: np.ndarray, chunk: int = 4096, step: int = 8):
    """The shard's k best rows for one query: (ids, scores).

    A term is one dimension; its impact is its product less the least product in the shard, so impacts are not
    negative and the greatest one bounds the term. Terms are split by bounds: those whose bounds together cannot
    lift a row to the k-th best score so far are non-essential. Essential terms are summed for every row; the
    others are probed, largest bound first, only for rows that can still compete.
    """
    least = np.minimum(q * lo, q * hi)
    bound = np.maximum(q * lo, q * hi) - least
    order = np.argsort(-bound, kind="stable")
    rest = np.r_[np.cumsum(bound[order][::-1])[::-1], 0]  # rest[t]: what terms t.. can still add
    base = least.sum()
    best_ids, best = np.zeros(0, np.int64), np.zeros(0, x.dtype)
    q_, least_ = q[order], least[order]
    for a in range(0, len(x), chunk):
        rows = np.flatnonzero(ids[a : a + chunk] != own) + a
        bar = best[-1] if len(best) == k else None
        cut = len(order) if bar is None else int(np.argmax(base + rest <= bar)) if (base + rest <= bar).any() else len(order)
        essential = order[:cut]
        score = base + (x[np.ix_(rows, essential)] @ q[essential] - least_[:cut].sum()) if cut else np.full(len(rows), base, x.dtype)
        at = cut
        while at < len(order) and len(rows):
            alive = score + rest[at] >= bar
            rows, score = rows[alive], score[alive]
            t = order[at : at + step]
            score = score + (x[np.ix_(rows, t)] @ q_[at : at + step] - least_[at : at + step].sum())
            at += step
        best_ids, best = np.r_[best_ids, ids[rows]], np.r_[best, score]
        keep = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[keep], best[keep]
    return best_ids, best


def whole(x: float, scale: float) -> int:
    """floor(scale * x) without overflow: the product is taken exactly where it lies beyond whole doubles."""
    y = scale * x
    return math.floor(y) if abs(y) < 2.0**52 else math.floor(Fraction(scale) * Fraction(x))


def sortable(score: int, digits: int = 700) -> str:
    """A text that orders like the whole number; wide enough for products of any finite doubles."""
    return f"{score + 10**digits:0{digits + 1}d}"


def search(df: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector: str = "embedding", scale: float = 256.0, k: int = 5,
           shard_rows: int = 16384, block_queries: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k rows of highest integer inner product.

    Components become floor(scale * x). All rows are dealt to shards by a hash of the id and all queries to
    blocks; each (block, shard) is searched by itself and only k rows a query leave it, so what moves is the rows
    once a block and the queries once a shard. Ties go to the smaller id. Vectors that are null or hold null or
    non-finite components take no part; only vectors of the query's length are its candidates; rows that carry
    the query's id are never its candidates and a repeated query id is asked once; repeated candidates each
    count; an empty table gives no rows; other columns are not read.

    Where the largest component could lift a score beyond 2**62, all scores are Python integers and rows are ranked
    by their exact values; the column `score` then holds them up to the bounds of a long.
    """
    x = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), x.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(finite(F.col("v")) & F.col("id").isNotNull() & (F.size("v") > 0))
    top = F.max(F.size("v") * F.pow(F.aggregate("v", F.lit(0.0), lambda a, c: F.greatest(a, F.abs(c))) * abs(scale) + 1, F.lit(2.0)))
    n, nq, most = rows.agg(F.count("*"), F.count_if("q"), top).first()
    big = (most or 0.0) >= 2.0**62
    v = F.col("v") if big else F.transform("v", lambda c: F.floor(F.lit(scale) * c))
    rows = rows.select("id", v.alias("v"), F.size("v").alias("dim"), "q")
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-nq // block_queries))
    deal = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    cands = rows.select("dim", deal(1, shards).alias("shard"), every(blocks).alias("block"), "id", "v")
    asked = rows.where("q").groupBy("id").agg(F.min("v").alias("v")).select(F.size("v").alias("dim"), every(shards).alias("shard"), deal(2, blocks).alias("block"), "id", "v")

    def integers(t: pa.Table) -> np.ndarray:
        if not big:
            return matrix(t["v"], np.int64)
        m = matrix(t["v"], np.float64)
        return np.array([[whole(c, scale) for c in r] for r in m.tolist()], object).reshape(m.shape)

    def run(asked: pa.Table, cands: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(asked) and len(cands):
            q, xi, ids = integers(asked), integers(cands), cands["id"].to_numpy()
            # in doubles where that is exact
            small = int(np.abs(q).max()) * int(np.abs(xi).max()) * (4 * xi.shape[1]) < 2**53
            x = xi.astype(np.float64) if small else xi
            lo, hi = x.min(0), x.max(0)
            for own, one in zip(asked["id"].to_pylist(), q.astype(x.dtype), strict=True):
                got, score = top_of_shard(x, ids, one, own, k, lo, hi)
                out[0].append(np.full(len(got), own))
                out[1].append(got)
                out[2].append(np.array([int(s) for s in score], object) if big else score.astype(np.int64))
        a, b, c = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]
        cols = {"query_id": a.astype(np.int64), "vec_id": b.astype(np.int64)}
        if not big:
            return pa.table(cols | {"score": c.astype(np.int64)})
        kept = [max(-(2**63), min(2**63 - 1, s)) for s in c.tolist()]
        return pa.table(cols | {"score": pa.array(kept, pa.int64()), "exact": pa.array([sortable(s) for s in c.tolist()], pa.string())})

    key = ("dim", "shard", "block")
    local = asked.groupBy(*key).cogroup(cands.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score long" + ", exact string" * big)
    w = Window.partitionBy("query_id").orderBy(F.desc("exact" if big else "score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
