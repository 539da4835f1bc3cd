"""Exact removal of repeated byte strings by a sparse suffix array, sorted deep-shallow.

Every string of `length` bytes holds an anchor: the place in it where the hash of the next GRAM bytes is least.
Equal strings hold equal anchors at equal places, so only suffixes at anchors need sorting (about one byte in 35),
and only those whose anchor bytes occur twice in the corpus; all others are dropped before any text moves.

The contexts of what remains meet by anchor, bucket by bucket. There their suffixes are sorted: multikey quicksort
over eight-byte characters to a shallow depth, then blind tries for the groups that still agree. So are the reversed
left contexts. Common prefixes of neighbours in both orders tell, for every string through an anchor, in
which class of equal strings it is; all but the earliest of a class are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import mix, partitions_for, small_batches, utf8

GRAM = 32
_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x7777))
_R = np.uint64(0x9E3779B97F4A7C15)


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every stretch of `width` items, by doubling."""
    have = 1
    while 2 * have <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    h, have, power = _BYTE[data], 1, np.array([_R])  # an array: scalars warn when they wrap
    while have < GRAM:
        h = h[:-have] + power * h[have:]
        have, power = 2 * have, power * power
    return mix(h)


def anchors(data: np.ndarray, off: np.ndarray, length: int, window: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(places in data, gram hashes) of the anchors of all strings of `length` bytes inside one text each."""
    reach = length - GRAM + 1
    places, keys = [], []
    for a in range(0, max(0, len(data) - length + 1), window):
        b = min(len(data) - length + 1, a + window)  # strings that start in [a, b)
        h = gram_hashes(data[a : b + length - 1])
        top = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        least = sliding(top, reach, np.minimum)
        end = off[np.searchsorted(off, np.arange(a, b), "right")]
        least[np.arange(a, b) + length > end] = 0
        wide = np.r_[np.zeros(reach - 1, np.uint32), least, np.zeros(reach - 1, np.uint32)]
        at = np.flatnonzero(top == sliding(wide, reach, np.maximum))
        places.append(at + a), keys.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, keys = np.concatenate(places), np.concatenate(keys)
    places, first = np.unique(places, return_index=True)
    return places, keys[first]


def blind_trie(raw: list[bytes], members: list[int], width: int, shared: int) -> tuple[list[int], list[int]]:
    """(order, common) of rows by a blind trie: a node holds only the place where its rows part and a child per byte there.

    A row goes down blindly, by the bytes at branch places alone, to any leaf; one comparison with that leaf's row tells
    where they part, and the branch is put there. Equal rows share a leaf. Branch places are the common prefixes, so the
    walk in byte order gives both the order and what each row shares with the one before (`shared` for the first).
    """
    root = [members[0]]  # a leaf is a list of rows, a node a tuple (place, children)
    for i in members[1:]:
        own, node = raw[i], root
        while type(node) is tuple:
            node = node[1].get(own[node[0]]) or next(iter(node[1].values()))
        other = raw[node[0]]
        if own == other:
            node.append(i)
            continue
        at = width - ((int.from_bytes(own, "big") ^ int.from_bytes(other, "big")).bit_length() + 7) // 8
        parent, node = None, root
        while type(node) is tuple and node[0] < at:
            parent, byte = node[1], own[node[0]]
            node = parent[byte]
        if type(node) is tuple and node[0] == at:
            node[1][own[at]] = [i]
            continue
        branch = (at, {other[at]: node, own[at]: [i]})
        if parent is None:
            root = branch
        else:
            parent[byte] = branch
    order, common, todo = [], [], [(root, shared)]
    while todo:
        node, shared = todo.pop()
        if type(node) is tuple:
            least, *others = sorted(node[1])
            todo += [(node[1][k], node[0]) for k in reversed(others)]
            todo.append((node[1][least], shared))
        else:
            order += node
            common += [shared, *[width] * (len(node) - 1)]
    return order, common


def deep_shallow(rows: np.ndarray, group: np.ndarray, shallow: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of byte rows within groups: order sorts by (group, bytes); common[i] is the length of the
    prefix that the i-th in order shares with the one before it (-1 where the group changes).

    Multikey quicksort over eight-byte characters down to `shallow` bytes, then a blind trie for each group that still
    agrees."""
    n, width = rows.shape
    chars = []
    for d in range(0, min(shallow, width), 8):
        part = np.zeros((n, 8), np.uint8)
        part[:, : min(8, width - d)] = rows[:, d : d + 8]
        chars.append(part.view(">u8").ravel().tolist())
    blob = rows.tobytes()
    raw: list[bytes] = [blob[k : k + width] for k in range(0, n * width, width)] if width else [b""] * n
    order: list[int] = []
    common: list[int] = []
    by = np.argsort(group, kind="stable")
    for a, b in _cuts(group[by]):
        todo: list[tuple] = [(by[a:b].tolist(), 0, -1)]
        while todo:
            # what the first row shares with the row before, or the character (as a tuple) in which they differ
            members, level, shared = todo.pop()
            if type(shared) is tuple:
                c = chars[shared[0]]
                shared = 8 * shared[0] + 8 - ((c[order[-1]] ^ c[members[0]]).bit_length() + 7) // 8 if len(members) == 1 else shared
            if len(members) == 1:
                order.append(members[0])
                common.append(shared)
            elif level < len(chars):
                c = chars[level]
                pivot = sorted((c[members[0]], c[members[len(members) // 2]], c[members[-1]]))[1]
                parts = [([i for i in members if c[i] < pivot], level), ([i for i in members if c[i] == pivot], level + 1), ([i for i in members if c[i] > pivot], level)]
                parts = [p for p in parts if p[0]]
                todo += [(m, l, (level,)) for m, l in reversed(parts[1:])]
                todo.append((*parts[0], shared))
            else:
                if type(shared) is tuple:  # all members agree in that character
                    c = chars[shared[0]]
                    shared = 8 * shared[0] + 8 - ((c[order[-1]] ^ c[members[0]]).bit_length() + 7) // 8
                o, k = blind_trie(raw, members, width, shared)
                order += o
                common += k
    return np.array(order, np.int64), np.array(common, np.int64)


def covered(ctx: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For contexts in corpus order: the first and last string through each anchor (as its offset in the context)
    that an earlier context holds too; last < first where there is none.

    ctx has length - GRAM bytes before the anchor and `length` from it on; left and right say how many are real.
    """
    n, before = len(ctx), length - GRAM
    first, last = np.full(n, before + 1), np.full(n, -1)
    if n < 2:
        return first, last
    grams = np.ascontiguousarray(ctx[:, before : before + GRAM]).view("V%d" % GRAM).ravel()
    group = np.unique(grams, return_inverse=True)[1]
    r_order, r_common = deep_shallow(np.ascontiguousarray(ctx[:, before + GRAM :]), group)  # the anchor's bytes agree in a group
    r_common = np.where(r_common < 0, -1, r_common + GRAM)
    l_order, l_common = deep_shallow(np.ascontiguousarray(ctx[:, :before][:, ::-1]), group)
    most = lambda order, c: (m := np.empty(n, np.int64), m.__setitem__(order, np.maximum(c, np.r_[c[1:], -1])))[0]
    r_most, l_most = most(r_order, r_common), most(l_order, l_common)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(before + 1):
        need_l, need_r = before - o, o + GRAM
        use = np.flatnonzero((left >= need_l) & (right >= need_r) & (l_most >= need_l) & (r_most >= need_r))
        if len(use) < 2:
            continue
        r_class[r_order] = np.cumsum(r_common < need_r)
        l_class[l_order] = np.cumsum(l_common < need_l)
        _, at = np.unique(r_class[use] * (n + 1) + l_class[use], return_index=True)
        later = np.ones(len(use), bool)
        later[at] = False
        use = use[later]
        first[use] = np.minimum(first[use], o)
        last[use] = o
    return first, last


def _pack(*arrays: np.ndarray) -> tuple[bytes, int]:
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return pa.compress(raw, codec="zstd", asbytes=True), len(raw)


def _unpack(blob: bytes, size: int, n: int, kinds) -> list[np.ndarray]:
    raw, out, at = pa.decompress(blob, size, codec="zstd", asbytes=True), [], 0
    for kind, width in kinds:
        step = n * width * np.dtype(kind).itemsize
        out.append(np.frombuffer(raw[at : at + step], kind).reshape(n, width) if width > 1 else np.frombuffer(raw[at : at + step], kind))
        at += step
    return out


def _cuts(sorted_key: np.ndarray):
    a = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]]) if len(sorted_key) else np.zeros(0, np.int64)
    return zip(a, np.r_[a[1:], len(sorted_key)], strict=True) if len(a) else ()


_OUT = "kind int, bucket long, n long, size long, blob binary"


def _rows(rows: list[tuple]) -> dict:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return dict(zip(("kind", "bucket", "n", "size", "blob"), (pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), strict=True))


def pair_codes(doc: np.ndarray, alt: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    """Whole numbers that order like the pairs (doc, alt), for each two arrays given."""
    docs, alts = [doc, *more[::2]], [alt, *more[1::2]]
    if not any(a.any() for a in alts):
        return docs
    both = np.stack([np.concatenate(docs), np.concatenate(alts)], 1)
    at = np.unique(both, axis=0, return_inverse=True)[1].ravel()
    return np.split(at, np.cumsum([len(d) for d in docs])[:-1])


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", length: int = 100, bucket_bytes: float = 4e6, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept] for every row.

    Texts count as UTF-8 bytes (null: empty). A byte goes when some string of `length` bytes that covers it also
    starts earlier: in a smaller id, or earlier in the same text; strings are judged on the input and never cross
    texts. Rows of one id and one text are one document, so repeated rows get equal results; different texts of one id
    are documents of their own, in the order of a hash of their texts. Rows without id are left out; an empty table
    gives no rows; other columns are not read. `kept` holds the remaining bytes.
    """
    spark = df.sparkSession
    small_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    h = F.xxhash64("text")
    ids = docs.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("n"), (F.min(h) < F.max(h)).alias("several"))
    total, several = ids.agg(F.sum("n"), F.count_if("several")).first()
    total = total or 0
    # alt tells texts of one id apart; it is 0, which packs to nothing, where an id has one text
    docs = docs.withColumn("alt", F.lit(0).cast("bigint"))
    if several:
        docs = docs.join(ids.where("several").select("doc_id", "several"), "doc_id", "left").select("doc_id", "text", F.when(F.col("several"), F.shiftrightunsigned(h, 1)).otherwise(F.lit(0)).cast("bigint").alias("alt"))
    docs = docs.select("doc_id", "alt", "text")
    buckets = partitions_for(total / 2, bucket_bytes, 2 * tasks)
    doc_buckets = partitions_for(total, 2 * bucket_bytes, tasks)
    before = length - GRAM

    def dealt_by(to: np.ndarray, kind: int, *arrays: np.ndarray) -> list[tuple]:
        """Rows (kind, bucket, n, size, blob) of arrays, dealt by their buckets."""
        by = np.argsort(to, kind="stable")
        to, arrays = to[by], [a[by] for a in arrays]
        return [(kind, int(to[i]), int(j - i), *_pack(*(a[i:j] for a in arrays))[::-1]) for i, j in _cuts(to)]

    def find(batches):
        """Anchors by bucket of their bytes (kind 0). Of bytes that occur twice in a batch one place goes there, marked, and
        all go to the buckets of their documents (kind 1): so bytes that are everywhere send one place a batch."""
        for b in batches:
            data, off = utf8(b.column(2))
            place, key = anchors(data, off, length)
            of = np.searchsorted(off, place, "right") - 1
            doc, alt = (b.column(c).to_numpy(zero_copy_only=False).astype("<i8")[of] for c in (0, 1))
            pos = (place - off[of]).astype("<u4")
            by = np.lexsort((pos, alt, doc, key))
            key, doc, alt, pos = key[by], doc[by], alt[by], pos[by]
            new = np.r_[True, key[1:] != key[:-1]][: len(key)]
            fresh = new | np.r_[True, (doc[1:] != doc[:-1]) | (alt[1:] != alt[:-1]) | (pos[1:] != pos[:-1])][: len(key)]
            key, doc, alt, pos, new = key[fresh], doc[fresh], alt[fresh], pos[fresh], new[fresh]
            more = np.r_[~new[1:], False][: len(key)]  # another place follows
            many, one = ~new | more, new
            rows = dealt_by(doc[many] % doc_buckets, 1, doc[many], alt[many], pos[many])
            rows += dealt_by((key[one] % np.uint64(buckets)).astype(np.int64), 0, (key[one] // np.uint64(buckets)).astype("<u4"), doc[one], alt[one], pos[one], more[one].astype("u1"))
            yield pa.RecordBatch.from_pydict(_rows(rows))

    def gather(t: pa.Table, kinds):
        parts = [_unpack(b, s, n, kinds) for b, s, n in zip(t["blob"].to_pylist(), t["size"].to_pylist(), t["n"].to_pylist(), strict=True)]
        return [np.concatenate(p) for p in zip(*parts, strict=True)] if parts else [np.zeros((0, w) if w > 1 else 0, k) for k, w in kinds]

    def twice(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        """Anchors whose bytes occur at two places or more, dealt to the buckets of their documents."""
        if key[0].as_py() == 1:
            return pa.table({k: t[k] for k in ("kind", "bucket", "n", "size", "blob")})
        key_, doc, alt, pos, marked = gather(t, (("<u4", 1), ("<i8", 1), ("<i8", 1), ("<u4", 1), ("u1", 1)))
        by = np.lexsort((pos, alt, doc, key_))
        key_, doc, alt, pos, marked = key_[by], doc[by], alt[by], pos[by], marked[by] > 0
        fresh = np.r_[True, (key_[1:] != key_[:-1]) | (doc[1:] != doc[:-1]) | (alt[1:] != alt[:-1]) | (pos[1:] != pos[:-1])][: len(key_)]
        run_ = np.cumsum(np.r_[True, key_[1:] != key_[:-1]][: len(key_)]) - 1
        many = ((np.bincount(run_[fresh]) > 1) | (np.bincount(run_, weights=marked) > 0))[run_] & fresh & ~marked
        return pa.table(_rows(dealt_by(doc[many] % doc_buckets, 1, doc[many], alt[many], pos[many])))

    def contexts(texts: pa.Table, marks: pa.Table) -> pa.Table:
        """The marked anchors with their bytes around, dealt by anchor; of equal contexts only the first leaves."""
        if not len(texts) or not len(marks):
            return pa.table(_rows([]))
        doc, alt, pos = gather(marks, (("<i8", 1), ("<i8", 1), ("<u4", 1)))
        data, off = utf8(texts["text"])
        own, code = pair_codes(texts["doc_id"].to_numpy(), texts["alt"].to_numpy(), doc, alt)
        by = np.lexsort((pos, code))
        by = by[np.r_[True, (code[by][1:] != code[by][:-1]) | (pos[by][1:] != pos[by][:-1])]]
        doc, alt, pos, code = doc[by], alt[by], pos[by], code[by]
        known, row = np.unique(own, return_index=True)
        row = row[np.searchsorted(known, code)]
        start, end = off[row], off[row + 1]
        place = start + pos
        left, right = np.minimum(before, place - start), np.minimum(length, end - place)
        rows = []
        for a in range(0, len(doc), 1 << 15):
            sl = slice(a, a + (1 << 15))
            step = np.arange(-before, length)
            at = place[sl, None] + step
            real = (step >= -left[sl, None]) & (step < right[sl, None])
            ctx = np.where(real, data[np.clip(at, 0, len(data) - 1)], 0).astype(np.uint8)
            d, e, p, l, r = doc[sl], alt[sl], pos[sl], left[sl], right[sl]
            whole = np.concatenate([ctx, l[:, None].astype(np.uint8), r[:, None].astype(np.uint8)], 1)
            _, first = np.unique(np.ascontiguousarray(whole).view("V%d" % whole.shape[1]).ravel(), return_index=True)
            later = np.ones(len(d), bool)
            later[first] = False
            later &= l + r >= length
            rows += dealt_by(d[later] % doc_buckets, 1, d[later], e[later], (p - l)[later].astype("<i8"), (p + r)[later].astype("<i8"))
            first.sort()
            ctx, d, e, p, l, r = ctx[first], d[first], e[first], p[first], l[first], r[first]
            gram = gram_hashes(np.ascontiguousarray(ctx[:, before : before + GRAM]).ravel())[::GRAM] if len(ctx) else np.zeros(0, np.uint64)
            rows += dealt_by((gram % np.uint64(buckets)).astype(np.int64), 0, d.astype("<i8"), e.astype("<i8"), p.astype("<u4"), l.astype(np.uint8), r.astype(np.uint8), ctx)
        return pa.table(_rows(rows))

    def judge(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        """Spans to remove, dealt to the buckets of their documents; spans that are known already pass."""
        if key[0].as_py() == 1:
            return pa.table({k: t[k] for k in ("kind", "bucket", "n", "size", "blob")})
        doc, alt, pos, left, right, ctx = gather(t, (("<i8", 1), ("<i8", 1), ("<u4", 1), ("u1", 1), ("u1", 1), ("u1", before + length)))
        by = np.lexsort((pos, alt, doc))
        doc, alt, pos, left, right, ctx = doc[by], alt[by], pos[by].astype(np.int64), left[by].astype(np.int64), right[by].astype(np.int64), ctx[by]
        first, last = covered(ctx, left, right, length)
        hit = np.flatnonzero(last >= first)
        doc, alt, a, b = doc[hit], alt[hit], pos[hit] - before + first[hit], pos[hit] - before + last[hit] + length
        return pa.table(_rows(dealt_by(doc % doc_buckets, 1, doc, alt, a, b)))

    def cut(texts: pa.Table, spans: pa.Table) -> pa.Table:
        if not len(texts):
            return pa.table({k: pa.array([], v) for k, v in made.items()})
        doc, alt, a, b = gather(spans, (("<i8", 1), ("<i8", 1), ("<i8", 1), ("<i8", 1)))
        data, off = utf8(texts["text"])
        own_code, code = pair_codes(texts["doc_id"].to_numpy(), texts["alt"].to_numpy(), doc, alt)
        by = np.lexsort((b, a, code))
        code, a, b = code[by], a[by], b[by]
        lo, hi = np.searchsorted(code, own_code), np.searchsorted(code, own_code, "right")
        out = {k: [] for k in made}
        for k, i in enumerate(texts["doc_id"].to_pylist()):
            own = data[off[k] : off[k + 1]]
            kept, removed, n, at = [], 0, 0, 0
            if hi[k] > lo[k]:
                s, e = a[lo[k] : hi[k]], np.maximum.accumulate(b[lo[k] : hi[k]])
                head = np.r_[True, s[1:] > e[:-1]]
                starts, ends = s[head], np.r_[e[:-1][head[1:]], e[-1]]
                for x, y in zip(starts.tolist(), ends.tolist(), strict=True):
                    kept.append(own[at:x].tobytes())
                    removed, n, at = removed + y - x, n + 1, y
            kept = b"".join([*kept, own[at:].tobytes()])
            for c, v in zip(out, (i, len(own), removed, n, hashlib.sha256(kept).hexdigest(), kept), strict=False):
                out[c].append(v)
        return pa.table({k: pa.array(v, made[k]) for k, v in out.items()})

    made = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    made |= {"kept": pa.binary()} if with_bytes else {}
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    # one exchange of the texts serves both the contexts and the cut
    dealt = docs.withColumn("bucket", F.pmod("doc_id", F.lit(doc_buckets))).repartition(F.col("bucket"))
    marks = docs.mapInArrow(find, _OUT).groupBy("kind", "bucket").applyInArrow(twice, _OUT)
    around = dealt.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(contexts, _OUT)
    spans = around.groupBy("kind", "bucket").applyInArrow(judge, _OUT)
    return dealt.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(cut, schema)
