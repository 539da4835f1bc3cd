"""Exact n-gram Jaccard join by T-occurrence search (DivideSkip), with what it keeps on Spark.

1. Every task turns its texts into sets of hashed shingles and sends each shingle, four bytes and a two-byte place,
   to the bucket of its hash: the inverted lists of the whole corpus, without texts or ids. Of a shingle that a batch
   holds more than once only the count goes there, so a shingle that a third of all documents hold stays small.
2. A bucket knows how long its lists are. Lists of one document are dropped; the others' lengths go back to where
   the documents came from.
3. A document linked at threshold t shares at least T = ceil(t * size) shingles. One with fewer shared shingles is
   done. Of the others the T - 1 longest lists are set aside, as DivideSkip does, and only the short ones left
   are merged: documents that meet in none of them cannot be linked.
4. The documents of a short list meet its first one, the hub; a hub's documents form blocks of bounded size that share
   pivots. In each block DivideSkip runs over the block's own lists: short lists are merged by a heap, long ones are
   probed by binary search, exact overlaps decide. That joins groups of copies in linear work.
5. Where a hub had several blocks, its lists may still hold documents of different groups. Of the documents in such
   open lists, those outside the largest group meet all of them, block by block.
"""

from __future__ import annotations

from bisect import bisect_left
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import components, mix, partitions_for, small_batches, stored, utf8

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x1234567))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_R = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray, off: np.ndarray, window: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """(a hash per word of all texts, words per text); words are maximal runs of non-space bytes of one text."""
    space = _SPACE[data]
    head = np.zeros(len(data), bool)
    head[0:1] = True
    head[1:] = space[:-1]
    head[off[:-1][off[:-1] < len(data)]] = True
    starts = np.flatnonzero(head & ~space)
    per_text = np.diff(np.searchsorted(starts, off))
    out = np.zeros(len(starts), np.uint64)
    ends = np.r_[starts[1:], len(data)]
    powers = np.ones(1, np.uint64)
    a = 0
    while a < len(starts):  # in windows of bytes, so that memory does not follow long texts
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + window, "right")))
        lo, hi = starts[a], ends[b - 1]
        first = starts[a:b] - lo
        width = np.diff(np.r_[first, hi - lo])
        if width.max() > len(powers):
            powers = np.cumprod(np.r_[np.uint64(1), np.full(int(width.max()) + 64, _R)], dtype=np.uint64)
        place = np.arange(hi - lo) - np.repeat(first, width)
        value = _BYTE[data[lo:hi]] * powers[place]
        value[space[lo:hi]] = 0
        out[a:b] = np.add.reduceat(value, first)
        a = b
    return mix(out), per_text


def shingle_sets(column: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Per text its distinct shingles as sorted 64-bit hashes; fewer words than `size` are one shingle."""
    w, per_text = word_hashes(*utf8(column))
    n = len(w)
    rolled = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        rolled += w[k : n - size + 1 + k] * (_R ** np.uint64(k + 1)) if len(rolled) else rolled
    rolled = mix(rolled)
    out, at = [], 0
    for k in per_text:
        if k >= size:
            out.append(np.unique(rolled[at : at + k - size + 1]))
        elif k:
            own = w[at : at + k] * np.cumprod(np.full(k, _R))
            out.append(mix(own.sum(dtype=np.uint64, keepdims=True) + np.uint64(k)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += k
    return out


def overlap_needed(n: np.ndarray, num: int, den: int):
    """Shared shingles that a document of n needs at least, whatever the partner's size: ceil(n * num / den)."""
    return -(-n * num // den)


def merge_skip(lists: list[list[int]], weights: list[int], need: int, end: int, visit) -> None:
    """Visits the ids below `end` that occur in lists of at least `need` weight, in order: a heap of the lists' fronts.

    visit(id, weight) says from which id on it wants more; lists jump there. So do lists of less than `need` weight,
    when the id in front misses it, to the front that follows theirs."""
    at = [0] * len(lists)
    heap = [(l[0], k) for k, l in enumerate(lists) if l]
    heapify(heap)
    while heap and heap[0][0] < end:
        low, weight, popped = heap[0][0], 0, []
        while heap and heap[0][0] == low:
            popped.append(heappop(heap)[1])
            weight += weights[popped[-1]]
        if weight >= need:
            low = visit(low, weight)
            while heap and heap[0][0] < low:
                popped.append(heappop(heap)[1])
        else:
            while heap and weight + weights[heap[0][1]] < need:
                popped.append(heappop(heap)[1])
                weight += weights[popped[-1]]
            if not heap:
                break
            low = heap[0][0]
        for k in popped:
            at[k] = bisect_left(lists[k], low, at[k])
            if at[k] < len(lists[k]):
                heappush(heap, (lists[k][at[k]], k))


def divide_skip(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a block with den * |x & y| >= num * |x | y| that join all its groups, none inside a group joined.

    Lists with the same documents count as one with their number as its weight. Documents that a link has joined with
    the one in hand are jumped over."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = [len(sets[i]) for i in order]
    flat = np.concatenate([sets[i] for i in order])
    own = np.repeat(np.arange(len(order)), sizes)
    by = np.argsort(flat, kind="stable")  # lists of ascending positions
    keys, begin, count = np.unique(flat[by], return_index=True, return_counts=True)
    ids = own[by]
    mark = np.add.reduceat(mix(ids.astype(np.uint64) + np.uint64(1)), begin) + count.astype(np.uint64)
    _, example, kind = np.unique(mark, return_index=True, return_inverse=True)
    members = [ids[begin[k] : begin[k] + count[k]].tolist() for k in example]
    kinds = np.empty(len(flat), np.int64)
    kinds[by] = np.repeat(kind.ravel(), count)
    at = np.r_[0, np.cumsum(sizes)]
    root = list(range(len(order)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    pa_, pb_ = [], []
    for x in range(1, len(order)):
        n = sizes[x]
        need = int(overlap_needed(n, num, den))
        mine, weight = np.unique(kinds[at[x] : at[x + 1]], return_counts=True)
        lists = sorted((len(members[k]), k, w) for k, w in zip(mine.tolist(), weight.tolist(), strict=True) if members[k][0] < x)
        if sum(w for _, _, w in lists) < need:
            continue
        # the longest lists are set aside: more of them for longer lists, never so many that the merge proves nothing
        aside, most, long = 0, min(need - 1, need / (1 + 0.01 * np.log2(1 + lists[-1][0]))), []
        while lists and aside + lists[-1][2] <= most:
            long.append(lists.pop())
            aside += long[-1][2]
        long.sort(key=lambda l: -l[2])

        def visit(y, shared, x=x, n=n, long=long, rest=aside):
            enough = overlap_needed(num * (n + sizes[y]), 1, num + den)
            if den * sizes[y] >= num * n:
                for _, k, w in long:
                    if shared >= enough or shared + rest < enough:
                        break
                    p = bisect_left(members[k], y)
                    shared, rest = shared + w * (p < len(members[k]) and members[k][p] == y), rest - w
                if shared >= enough:
                    a, b = find(x), find(y)
                    root[max(a, b)] = min(a, b)
                    pa_.append(order[x]), pb_.append(order[y])
            y += 1
            while y < x and find(y) == find(x):
                y += 1
            return y

        merge_skip([members[k] for _, k, _ in lists], [w for *_, w in lists], need - aside, x, visit)
    return np.array(pa_, np.int64), np.array(pb_, np.int64)


def _fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and two 64-bit hashes of sets; the three together name a set."""
    n = np.array([len(s) for s in sets], np.int64)
    f1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
    f2 = np.array([mix(s ^ _R).sum(dtype=np.uint64) for s in sets], np.uint64)
    return n, mix(f1 + n.astype(np.uint64)).view(np.int64), mix(f2).view(np.int64)


def _postings(df: DataFrame, buckets: int, size: int) -> DataFrame:
    """Rows for the buckets (keys and places of shingles that the batch holds once; keys and counts of the others) and
    one row a batch about its documents and the places of the others. A batch is 65,536 rows at most: places are two bytes."""

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        for whole in batches:
            for start in range(0, whole.num_rows, 1 << 16):
                b = whole.slice(start, 1 << 16)
                src, k = (part << 24) | k, k + 1
                sets = shingle_sets(b.column(1), size)
                n, f1, f2 = _fingerprints(sets)
                about = np.stack([b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), n, f1, f2]).tobytes()
                _, first = np.unique(f1, return_index=True)  # equal sets of a batch count once
                first = first[n[first] > 0]
                flat = np.concatenate([sets[i] for i in first]) if len(first) else np.zeros(0, np.uint64)
                own = np.repeat(first.astype("<u2"), n[first])
                by = np.argsort(flat, kind="stable")
                keys, begin, count = np.unique(flat[by], return_index=True, return_counts=True)
                one, many = count == 1, count > 1
                row = np.repeat(many, count)
                rows = {}
                for cols, at, values in (((0, 1), one, own[by][begin]), ((2, 3), many, count.astype("<u4"))):
                    to = (keys[at] % np.uint64(buckets)).astype(np.int64)
                    o = np.argsort(to, kind="stable")
                    to, key, value = to[o], (keys[at] // np.uint64(buckets)).astype("<u4")[o], values[at][o]
                    cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
                    for i, j in zip(cut, np.r_[cut[1:], len(to)], strict=True) if len(to) else ():
                        r = rows.setdefault(int(to[i]), [b""] * 4)
                        r[cols[0]], r[cols[1]] = key[i:j].tobytes(), value[i:j].tobytes()
                out = [(bucket, *r) for bucket, r in rows.items()]
                out.append((-1 - src % buckets, about, keys[many].astype("<u8").tobytes(), count[many].astype("<u4").tobytes(), own[by][row].tobytes()))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array([src] * len(out), pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "src", *"abcd"])

    return df.mapInArrow(run, "bucket long, src long, a binary, b binary, c binary, d binary")


def _arrays(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(all values, the row each comes from) of a column of packed arrays."""
    parts = [np.frombuffer(x, kind) for x in column.to_pylist()]
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def _lengths(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """Of one bucket: the lists of two documents or more, dealt back to the batches they came from (kind 1: key, place,
    length; kind 2: key, length, where the batch knows the places). What is about a batch goes there as it is (kind 0)."""
    bucket = key[0].as_py()
    if bucket < 0:
        return pa.table({"src": t["src"], "kind": pa.array([0] * len(t), pa.int32()), **{c: t[c] for c in "abcd"}})
    (k1, s1), (k2, s2) = _arrays(t["a"], "<u4"), _arrays(t["c"], "<u4")
    own, times = _arrays(t["b"], "<u2")[0], _arrays(t["d"], "<u4")[0]
    keys, at = np.unique(np.r_[k1, k2], return_inverse=True)
    total = np.bincount(at, weights=np.r_[np.ones(len(k1)), times], minlength=len(keys)).astype(np.int64)[at]
    name = keys[at].astype(np.uint64) * np.uint64(1 << 32) + np.uint64(bucket) if len(at) else np.zeros(0, np.uint64)
    names, out = t["src"].to_pylist(), ([], [], [], [], [], [])
    for kind, src, full, n, place in ((1, s1, name[: len(k1)], total[: len(k1)], own), (2, s2, name[len(k1) :], total[len(k1) :], None)):
        use = np.flatnonzero(n > 1)
        use = use[np.argsort(src[use], kind="stable")]
        cut = np.flatnonzero(np.r_[True, np.diff(src[use]) != 0]) if len(use) else use
        for i, j in zip(cut, np.r_[cut[1:], len(use)], strict=True) if len(use) else ():
            u = use[i:j]
            blobs = (full[u].astype("<u8").tobytes(), n[u].astype("<u4").tobytes(), place[u].astype("<u2").tobytes() if place is not None else b"", b"")
            for c, v in zip(out, (names[src[u[0]]], kind, *blobs), strict=True):
                c.append(v)
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
    return pa.table(dict(zip(("src", "kind", *"abcd"), (pa.array(c, k) for c, k in zip(out, kinds, strict=True)), strict=True)))


def _shortest(num: int, den: int, buckets: int):
    """Of one batch: its documents, and of those with enough shared shingles the shortest lists to merge."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        about, a, own, n, totals = None, [], [], [], {}
        for kind, *x in zip(*(t[c].to_pylist() for c in ("kind", *"abcd")), strict=True):
            if kind == 0:
                about = np.frombuffer(x[0], np.int64).reshape(4, -1)
                several, times, places = np.frombuffer(x[1], "<u8"), np.frombuffer(x[2], "<u4"), np.frombuffer(x[3], "<u2")
            elif kind == 1:
                a.append(np.frombuffer(x[0], "<u8")), n.append(np.frombuffer(x[1], "<u4")), own.append(np.frombuffer(x[2], "<u2"))
            else:
                totals.setdefault("name", []).append(np.frombuffer(x[0], "<u8")), totals.setdefault("n", []).append(np.frombuffer(x[1], "<u4"))
        ids, size, f1, f2 = about
        if len(several):  # every list that the batch holds several documents of has come back with its length
            name, length = (np.concatenate(totals[c]) for c in ("name", "n"))
            known = (several // np.uint64(buckets)).astype("<u4").astype(np.uint64) * np.uint64(1 << 32) + several % np.uint64(buckets)
            by = np.argsort(name, kind="stable")
            at = by[np.searchsorted(name[by], known)]
            a.append(np.repeat(known, times)), n.append(np.repeat(length[at], times)), own.append(places)
        none = np.zeros(0, np.int64)
        take, of = np.zeros(0, np.uint64), none
        if a:
            a, own, n = np.concatenate(a), np.concatenate(own).astype(np.int64), np.concatenate(n)
            by = np.lexsort((a, n, own))  # one total order of lists for the whole corpus: length, then name
            a, own = a[by], own[by]
            shared = np.bincount(own, minlength=len(ids))
            rank = np.arange(len(own)) - (np.cumsum(shared) - shared)[own]
            merge = shared - overlap_needed(size, num, den) + 1
            keep = rank < merge[own]
            take, of = a[keep], own[keep]
        k = len(ids)
        pad = lambda x, m: np.r_[x.astype(np.int64), np.zeros(m, np.int64)]
        return pa.table({
            "doc_id": pad(ids, len(of)), "n": np.r_[size, size[of]], "f1": np.r_[f1, f1[of]], "f2": np.r_[f2, f2[of]],
            "list": pa.array(np.r_[np.zeros(k, np.int64), take.view(np.int64)], mask=np.r_[np.ones(k, bool), np.zeros(len(of), bool)]),
        })

    return run


def _block_links(num: int, den: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        ids = t["f1"].to_numpy()
        _, first = np.unique(ids, return_index=True)
        sets = [np.frombuffer(t["set"][int(i)].as_py(), "<u8") for i in first]
        ids = ids[first]
        a, b = divide_skip(sets, num, den) if len(ids) > 1 else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": ids[a], "b": ids[b]})

    return run


def link_groups(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100,
                block: int = 128, bucket_bytes: float = 4e6) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: exact groups at Jaccard similarity num/den or more.

    Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return, A-Z in
    lower case; null and empty texts have no shingle and link with nothing; repeated rows and equal texts fall in
    one group; different texts of one id are documents of their own, which share the id; rows without id are left out;
    an empty table gives no rows; other columns are not read. Documents with equal sets are one class and only classes
    are compared. component_id is the smallest id of the group.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where("doc_id is not null")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = partitions_for(total, bucket_bytes, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    lists = _postings(docs, buckets, size).groupBy("bucket").applyInArrow(_lengths, "src long, kind int, a binary, b binary, c binary, d binary")
    both = stored(lists.groupBy("src").applyInArrow(_shortest(num, den, buckets), "doc_id long, n long, f1 long, f2 long, list long"))
    meta, short = both.where("list is null").drop("list"), both.where("list is not null")
    classes = stored(meta.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")))
    # documents that meet in a short list, each with the list's first one
    first = stored(short.groupBy("list").agg(F.min("f1").alias("hub"), F.max("f1").alias("other")).where("hub <> other").select("list", "hub"))
    met = stored(short.select("list", "f1").join(first, "list").distinct())
    reps = classes.join(met.select("f1").distinct(), "f1", "left_semi").select(F.col("rep").alias("doc_id"), "f1")

    def as_sets(batches):
        for b in batches:
            sets = shingle_sets(b.column(0), size)
            f1 = b.column(1).to_numpy()
            own = np.flatnonzero(_fingerprints(sets)[1] == f1)  # an id may have other texts
            yield pa.RecordBatch.from_arrays([pa.array(f1[own]), pa.array([sets[i].tobytes() for i in own], pa.binary())], names=["f1", "set"])

    wanted = docs.join(stored(reps).hint("shuffle_hash"), "doc_id").select("text", "f1")
    sets = stored(wanted.mapInArrow(as_sets, "f1 long, set binary"))
    found = _link(met, sets, num, den, block)
    comp = stored(components(found))
    least = classes.join(comp, F.col("f1") == F.col("node")).groupBy("component").agg(F.min("rep").alias("least"))
    named = comp.join(least, "component").select("node", "least")
    done = classes.join(named, F.col("f1") == F.col("node"), "left").select("n", "f1", "f2", F.coalesce("least", "rep").alias("component_id"))
    none = meta.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return meta.where("n > 0").join(stored(done), ["n", "f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(none)


def _link(met: DataFrame, sets: DataFrame, num: int, den: int, block: int, pivots: int = 16) -> DataFrame:
    """Edges that connect what is linked; met: list, f1, hub of every document in every short list, sets: f1, set."""
    run, kind = _block_links(num, den), "a long, b long"
    cols = ["grp", "i", "j", "f1", "set"]
    parts = F.ceil(F.count("*") / block).cast("int").alias("blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = F.pmod(F.xxhash64("f1"), F.col("blocks")).cast("int")
    stars = met.select(F.col("hub").alias("grp"), "f1").distinct()
    hubs = stored(stars.groupBy("grp").agg(parts))
    with_sets = stars.join(hubs, "grp").join(sets, "f1")
    # pivots: the hub, and those of a group with the least hashes, so a share of its size decides, not a window
    rare = F.pmod(F.xxhash64("f1", F.lit("pivot")), F.lit(1 << 20)) < F.greatest(F.lit(1), F.lit(pivots * (1 << 20)) / (F.col("blocks") * block))
    to = F.when(rare | (F.col("f1") == F.col("grp")), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(deal))
    edges = stored(with_sets.select("grp", F.explode(to).alias("i"), F.lit(-1).alias("j"), "f1", "set").groupBy("grp", "i", "j").applyInArrow(run, kind))
    large = hubs.where("blocks > 1")
    if large.limit(1).count() == 0:
        return edges
    comp = components(edges)
    left = met.join(large.select(F.col("grp").alias("hub")), "hub", "left_semi").join(comp, F.col("f1") == F.col("node"), "left")
    left = stored(left.select("list", "f1", F.col("hub").alias("grp"), F.coalesce("component", "f1").alias("comp")))
    open_ = left.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    members = left.join(open_.select("list"), "list", "left_semi").select("grp", "f1", "comp").distinct()
    members = stored(members.join(members.groupBy("grp").agg(parts), "grp"))
    main = members.groupBy("grp", "comp").count().groupBy("grp").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
    strays = stored(members.join(main, "grp").where("comp <> main").select("grp", "blocks", "f1"))
    turns = stored(strays.groupBy("grp").agg(parts.alias("turns")))
    asks = strays.join(turns, "grp").select("grp", every("blocks").alias("i"), F.pmod(F.xxhash64("f1", F.lit(3)), F.col("turns")).cast("int").alias("j"), "f1")
    others = members.join(turns, "grp").select("grp", deal.alias("i"), every("turns").alias("j"), "f1")
    rest = asks.unionByName(others).join(sets, "f1").select(*cols).groupBy("grp", "i", "j").applyInArrow(run, kind)
    return edges.unionByName(stored(rest))
