"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, exact rerank."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import components, mix, stored
from foliospark.llm.maxscore import finite, matrix


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = nearest(x, c)[0]
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [squared(x[i : i + 4096], c) for i in range(0, len(x), 4096)]
    return np.concatenate([p.argmin(1) for p in parts]), np.concatenate([p.min(1) for p in parts])


class Quantiser:
    """Coarse centres and per-subspace codebooks of residuals, fitted on a bounded sample of unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int, codes: int, reach: float):
        self.reach = reach + 1e-9
        self.centres = kmeans(sample, lists, 8, 1)
        self.between = np.sqrt(squared(self.centres, self.centres))
        res = sample - self.centres[nearest(sample, self.centres)[0]]
        self.cuts = [s for s in np.array_split(np.arange(sample.shape[1]), subspaces) if len(s)]
        self.books = [kmeans(res[:, s], codes, 6, 2) for s in self.cuts]

    def place(self, x: np.ndarray):
        """(home list, bits of the lists to probe, codes, error of the coded vector) of unit vectors.

        A list is probed when the plane between its centre and the home centre is at most half the reach away."""
        d = squared(x, self.centres)
        home = d.argmin(1)
        probes = d - d.min(1)[:, None] <= self.reach * self.between[home] + 1e-9
        res = x - self.centres[home]
        codes = np.stack([nearest(res[:, s], b)[0] for s, b in zip(self.cuts, self.books, strict=True)], 1)
        back = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], 1)
        return home, np.packbits(probes, axis=1), codes.astype(np.uint8), np.linalg.norm(res - back, axis=1)

    def search(self, q: _Side, m: _Side, lists: np.ndarray, threshold: float, chunk: int = 512):
        """(query, member, whether only this side finds the pair) of all linked pairs, from the lists that queries probe.

        Asymmetric distances: |q - c - b|^2 of query q, centre c and coded residual b is |q - c|^2 + |c + b|^2 - |c|^2 less
        twice the product of q with each subspace's code word. Those products are one table per query; a member's are looked
        up by its codes and summed. A member stays when its own coding error could explain the distance."""
        found = [[], [], []]
        own = {b: np.flatnonzero(m.home == b) for b in np.flatnonzero(lists)}
        most = ((self.reach + m.err) ** 2 + 1e-4).astype(np.float32)  # single precision is off by far less
        back = np.concatenate([w[m.codes[:, c]] for c, w in enumerate(self.books)], 1)
        fixed = (((self.centres[m.home] + back) ** 2).sum(1) - (self.centres[m.home] ** 2).sum(1)).astype(np.float32)
        order = np.argsort(q.home, kind="stable")
        for at in range(0, len(order), chunk):
            k = order[at : at + chunk]
            tables = [(-2 * w @ q.x[k][:, s].T).astype(np.float32) for s, w in zip(self.cuts, self.books, strict=True)]
            for b, mine in own.items():
                ask = np.flatnonzero(q.probes[k, b])
                if not len(mine) or not len(ask):
                    continue
                total = fixed[mine][:, None] + ((q.x[k[ask]] - self.centres[b]) ** 2).sum(1).astype(np.float32)
                for c, table in enumerate(tables):
                    total += table[:, ask][m.codes[mine, c]]
                j, i = np.nonzero(total <= most[mine][:, None])
                i, j = k[ask[i]], mine[j]
                if len(i) * 16 > total.size:
                    cos = (m.x[mine] @ q.x[k[ask]].T)[total <= most[mine][:, None]]
                else:
                    cos = np.concatenate([(q.x[i[s : s + 65536]] * m.x[j[s : s + 65536]]).sum(1) for s in range(0, len(i), 65536)] or [np.zeros(0)])
                ok = (cos >= threshold) & (q.ids[i] != m.ids[j])
                i, j = i[ok], j[ok]
                found[0].append(i), found[1].append(j), found[2].append(~m.probes[j, q.home[i]])
        return tuple(np.concatenate(f) if f else np.zeros(0, t) for f, t in zip(found, (np.int64, np.int64, bool), strict=True))


class _Side:
    """The queries or the members of a block as arrays."""

    def __init__(self, t: pa.Table, lists: int):
        self.ids, self.home, self.err = t["id"].to_numpy(), t["home"].to_numpy(), t["err"].to_numpy()
        self.x = unit(matrix(t["v"], np.float64))
        self.codes = np.stack([np.frombuffer(c, np.uint8) for c in t["codes"].to_pylist()]).astype(np.int64)
        self.probes = np.unpackbits(np.stack([np.frombuffer(p, np.uint8) for p in t["probes"].to_pylist()]), axis=1, count=lists) > 0


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position connected to each of n positions by pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(df: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, sample: int = 16384,
                    most_lists: int = 1024, subspaces: int = 8, codes: int = 128, members: int = 4096, queries: int = 32768) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector, linked at cosine >= threshold.

    Equal vectors form one class and only classes are searched. The quantiser is fitted on about `sample` classes
    drawn by hash, with at most `most_lists` lists (the documented bounds); every class is then indexed in its home
    list and probes every list it could be linked with first. With r the distance of unit vectors at the threshold: the
    distances of two linked vectors to the plane between their home centres add up to r at most, so the nearer one
    lies within r / 2 of it and probes the other's list. No link is lost: neither to the probes, nor to the coded
    distances, which rule a member out only if its own coding error cannot explain them, before the exact cosine.

    Lists that lie side by side are dealt in groups of about `members` classes (longer lists are split), and classes
    ask a group once for all lists they probe there, `queries` at a time. Of the links of a block only counts and a
    spanning forest leave it, so no group of copies is expanded into pairs. A link found from one side counts for both.

    Vectors that are null, zero or hold null or non-finite components link with nothing; vectors of different
    lengths never link; rows without an id are left out; repeated rows are vectors of their own; an empty table gives
    no rows; other columns are not read.
    """
    spark = df.sparkSession
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id is not null")
    good = finite(F.col("v")) & (F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))) > 0)
    classes = stored(rows.where(good).groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))
    found = None
    for dim, total in sorted(tuple(r) for r in classes.groupBy(F.size("v")).count().collect()):  # lengths: one, as a rule
        own = classes.where(F.size("v") == dim)
        part = own.where(F.pmod(F.xxhash64("id", F.lit("pq")), F.lit(1 << 30)) < int(min(1.0, sample / total) * (1 << 30))).select("v")
        x = matrix(part.limit(2 * sample).toArrow()["v"], np.float64)
        if not len(x):
            x = matrix(own.select("v").limit(1).toArrow()["v"], np.float64)
        pq = Quantiser(unit(x), min(most_lists, max(1, math.isqrt(total))), min(subspaces, dim), min(codes, 256), math.sqrt(max(0.0, 2 - 2 * threshold)))
        got = _links(own, spark.sparkContext.broadcast(pq), threshold, members, -(-total // queries))
        found = got if found is None else found.unionByName(got)
    ids = rows.withColumn("ok", F.coalesce(good, F.lit(False)))
    if found is None:
        return ids.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found)
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    comp = components(found.where("b is not null and a <> b"))
    done = classes.join(links, classes["id"] == links["a"], "left").join(comp, F.col("id") == F.col("node"), "left")
    done = stored(done.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    hit = ids.where("ok").join(done, "v").select("vec_id", "n_links", "component_id")
    miss = ids.where("not ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return hit.unionByName(miss).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _groups(pq: Quantiser, sizes: dict[int, int], members: int) -> tuple[np.ndarray, np.ndarray]:
    """Per list its group and into how many parts the list is split; lists side by side share a group."""
    order = np.argsort(pq.centres @ np.linalg.svd(pq.centres - pq.centres.mean(0), full_matrices=False)[2][0])
    group, parts, g, held = np.zeros(len(order), np.int32), np.ones(len(order), np.int32), 0, 0
    for b in order.tolist():
        n = sizes.get(b, 0)
        if held and held + n > members:
            g, held = g + 1, 0
        group[b], parts[b], held = g, max(1, -(-n // members)), held + n
    return group, parts


def _links(classes: DataFrame, held, threshold: float, members: int, turns: int) -> DataFrame:
    """(a, b, links): counts of linked vectors per class (b null), and edges of a spanning forest per block."""

    def place(batches):
        for b in batches:
            home, probes, codes, err = held.value.place(unit(matrix(b.column("v"), np.float64)))
            cols = [b.column("id"), b.column("n"), b.column("v"), pa.array(home, pa.int32()), pa.array([p.tobytes() for p in probes], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "v", "home", "probes", "codes", "err"])

    indexed = "id long, n long, v array<double>, home int, probes binary, codes binary, err double"
    placed = stored(classes.select("id", "n", "v").mapInArrow(place, indexed))
    sizes = {r["home"]: r["count"] for r in placed.groupBy("home").count().collect()}  # at most a row a list
    group, parts = _groups(held.value, sizes, members)
    most = np.array([parts[group == g].max() for g in range(group.max() + 1)])  # parts of the group's lists
    salts = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

    def deal(batches):
        """Each class once a turn as a member of its home list, and once a group and part as a query."""
        for b in batches:
            ids, home = b.column("id").to_numpy(), b.column("home").to_numpy()
            h = [(mix(ids.astype(np.uint64) + s) >> np.uint64(1)).astype(np.int64) for s in salts]
            k = np.repeat(np.arange(len(ids)), turns)
            rows = [(group[home[k]], h[0][k] % parts[home[k]], np.tile(np.arange(turns), len(ids)), np.zeros(len(k), bool), k)]
            asked = np.unpackbits(np.stack([np.frombuffer(p, np.uint8) for p in b.column("probes").to_pylist()]), axis=1, count=len(group)) > 0
            for g in range(len(most)):
                k = np.flatnonzero(asked[:, group == g].any(1))
                for i in range(most[g]):
                    rows.append((np.full(len(k), g), np.full(len(k), i), h[1][k] % turns, np.ones(len(k), bool), k))
            g, i, j, q, k = (np.concatenate(c) for c in zip(*rows, strict=True))
            for a in range(0, len(k), len(ids)):  # as many rows a batch as came in
                s = slice(a, a + len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(g[s], pa.int32()), pa.array(i[s], pa.int32()), pa.array(j[s], pa.int32()), pa.array(q[s]), *b.take(pa.array(k[s])).columns], names=["g", "i", "j", "q", *b.schema.names])

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        out = ([], [], [])
        is_query = t["q"].to_numpy()
        q, m = t.filter(pa.array(is_query)), t.filter(pa.array(~is_query))
        if len(q) and len(m):
            a, b, one_way = held.value.search(*(_Side(x, len(group)) for x in (q, m)), group == key[0].as_py(), threshold)
            qi, mi, qn, mn = q["id"].to_numpy(), m["id"].to_numpy(), q["n"].to_numpy(), m["n"].to_numpy()
            counts = np.bincount(a, weights=mn[b], minlength=len(qi)), np.bincount(b[one_way], weights=qn[a[one_way]], minlength=len(mi))
            for ids, c in zip((qi, mi), counts, strict=True):
                k = np.flatnonzero(c)
                out[0].append(ids[k]), out[1].append(np.full(len(k), -1)), out[2].append(c[k].astype(np.int64))
            nodes, at = np.unique(np.r_[qi[a], mi[b]], return_inverse=True)
            root = local_roots(len(nodes), at[: len(a)], at[len(a) :])
            free = np.concatenate(out[0]) if out[0] else np.zeros(0, np.int64)
            return pa.table({"a": np.r_[free, nodes], "b": pa.array(np.r_[free, nodes[root]], mask=np.arange(len(free) + len(nodes)) < len(free)), "links": np.r_[np.concatenate(out[2]), np.zeros(len(nodes), np.int64)]})
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})

    dealt = placed.mapInArrow(deal, "g int, i int, j int, q boolean, " + indexed)
    return dealt.groupBy("g", "i", "j").applyInArrow(run, "a long, b long, links long")
