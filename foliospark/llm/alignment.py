"""Cross-tokenizer alignment: token ends of two tokenizers merged in independent pieces of equal work (merge path)."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliospark.llm.common import runs_by_bytes, small_batches, stored
from foliospark.llm.tokens import Encoder


def token_bytes(path: str) -> list[bytes]:
    """The bytes each id stands for: byte-level entries decoded (.json), pieces with marks as spaces (.model)."""
    if path.endswith(".json"):
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        added = {t["id"] for t in spec["added_tokens"]}
        out = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            out[i] = piece.encode() if i in added else bytes(chars[c] for c in piece)
        return out
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    return [bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in range(s.get_piece_size())]


def split_points(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two sorted arrays stands on every `work`-th diagonal: items taken of a and of b, a first on ties.

    All diagonals are searched at once, each by its own binary search, so no piece waits for another."""
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, work), total)
    lo, hi = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        take = open_ & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(d - mid - 1, 0, len(b) - 1)])
        lo, hi = np.where(take, mid + 1, lo), np.where(open_ & ~take, mid, hi)
    return lo, d - lo


def piece_overlaps(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int):
    """One piece of the merge: (tokens of a, tokens of b, ends of a that meet one of b, ends of b that meet one of a).

    Every different end closes a stretch that exactly one token of each side covers, so the links are the ends. A tie cut
    in two by a diagonal leaves its end of a to this piece and that of b to the next, which finds it at the seam."""
    ea, eb = a[i0:i1], b[j0:j1]
    over = j0 + np.searchsorted(eb, ea)
    at = np.searchsorted(ea, eb)
    tie = (at < len(ea)) & (ea[np.minimum(at, len(ea) - 1)] == eb) if len(ea) else np.zeros(len(eb), bool)
    shared_a, shared_b = i0 + at[tie], j0 + np.flatnonzero(tie)
    if i0 and len(eb) and a[i0 - 1] == eb[0]:
        tie[0] = True
        shared_a, shared_b = np.append(shared_a, i0 - 1), np.append(shared_b, j0)
    own = np.flatnonzero(~tie)
    return np.concatenate([np.arange(i0, i1), i0 + at[own]]), np.concatenate([over, j0 + own]), shared_a, shared_b


def merge_ends(a: np.ndarray, b: np.ndarray, work: int = 1 << 15):
    """(token of a, token of b) of every link, and which ends of a and of b close a group, of two sorted arrays of ends.

    The pieces between neighbouring diagonals are worked out one by one, and the groups that run over a seam are stitched."""
    close_a, close_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    i, j = split_points(a, b, work)
    links = []
    for k in range(len(i) - 1):
        of_a, of_b, shared_a, shared_b = piece_overlaps(a, b, i[k], i[k + 1], j[k], j[k + 1])
        close_a[shared_a], close_b[shared_b] = True, True
        links.append((of_a, of_b))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *[x for x, _ in links]]), np.concatenate([none, *[x for _, x in links]]), close_a, close_b


class Aligner:
    """Two tokenizers and what their ids stand for."""

    def __init__(self, path_a: str, path_b: str, work: int):
        self.encoders = [Encoder(p, plain=True) for p in (path_a, path_b)]
        self.bytes = [token_bytes(p) for p in (path_a, path_b)]
        self.sizes = [np.array([len(x) for x in t], np.int64) for t in self.bytes]
        self.work = work
        n = max(map(len, self.bytes))
        self.digits = np.zeros((n, len(str(n))), np.uint8)
        self.width = np.array([len(str(i)) for i in range(n)])
        for i in range(n):
            self.digits[i, : self.width[i]] = np.frombuffer(str(i).encode(), np.uint8)

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides per text, none where the joined bytes of a side are not the text behind a space."""
        ids = [[np.frombuffer(x, "<u4") for x in e(t)] for e, t in zip(self.encoders, ([" " + t if t else "" for t in texts], texts), strict=True)]
        none = np.zeros(0, np.uint32)
        out = []
        for t, a, b in zip(texts, *ids, strict=True):
            want = b" " + t.encode("utf-8", "surrogatepass")
            same = t and all(b"".join(map(table.__getitem__, x.tolist())) == want for table, x in zip(self.bytes, (a, b), strict=True))
            out.append((a, b) if same else (none, none))
        return out

    def written(self, ids_a, ids_b, close_a, close_b, last: np.ndarray) -> list[bytes]:
        """`a1,a2|b1;a3|b2` of each text; `last` is after which of all tokens a text ends."""
        upto_a, upto_b = np.flatnonzero(close_a) + 1, np.flatnonzero(close_b) + 1
        group_a, group_b = np.cumsum(close_a) - close_a, np.cumsum(close_b) - close_b
        at_a = np.arange(len(ids_a)) + np.append(0, upto_b)[group_a]
        at_b = np.arange(len(ids_b)) + upto_a[group_b] if len(upto_a) else np.zeros(0, np.int64)
        n = len(ids_a) + len(ids_b)
        rows, width = np.zeros((n, self.digits.shape[1] + 1), np.uint8), np.zeros(n, np.int64)
        for ids, at, end in ((ids_a, at_a, np.where(close_a, ord("|"), ord(","))), (ids_b, at_b, np.where(close_b, ord(";"), ord(",")))):
            rows[at, :-1], width[at] = self.digits[ids], self.width[ids]
            rows[at, self.width[ids]] = end
        flat = rows[np.arange(rows.shape[1]) < (width + 1)[:, None]].tobytes()
        ends = np.append(0, np.cumsum(width + 1))[np.append(0, last)]
        return [flat[x : y - 1] if y > x else b"" for x, y in zip(ends[:-1], ends[1:], strict=True)]

    def pack(self, texts: list[str]) -> dict:
        """What the texts hold together: per text its figures and its different pairs, and the pack's pairs with counts."""
        tokens = self.tokens(texts)
        n_a, n_b = (np.array([len(t[k]) for t in tokens], np.int64) for k in (0, 1))
        ids_a, ids_b = (np.concatenate([np.zeros(0, np.uint32), *[t[k] for t in tokens]]).astype(np.int64) for k in (0, 1))
        a, b = np.cumsum(self.sizes[0][ids_a]), np.cumsum(self.sizes[1][ids_b])
        of_a, of_b, close_a, close_b = merge_ends(a, b, self.work)
        text = np.repeat(np.arange(len(texts)), n_a)
        key = ids_a[of_a] << 32 | ids_b[of_b]
        order = np.lexsort((key, text[of_a]))
        key, own = key[order], text[of_a][order]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])]) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.r_[first, len(key)])
        pairs, at = np.unique(key[first], return_inverse=True)
        total = np.bincount(at, weights=times, minlength=len(pairs)).astype(np.int64)
        return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(text[close_a], minlength=len(texts)), "n_links": np.bincount(own, minlength=len(texts)),
                "groups": self.written(ids_a, ids_b, close_a, close_b, np.cumsum(n_a + n_b)), "n_pairs": np.bincount(own[first], minlength=len(texts)),
                "at": at.astype(np.int32), "times": times.astype(np.int64), "pairs": pairs, "total": total}


_FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_pairs")
#: Packs are stored in row groups of so many: a reader holds a whole group at once, however long the table's files are.
ROW_GROUP = {"parquet.block.row.count.limit": 8}


def narrow(v: np.ndarray) -> bytes:
    """Numbers of 0 or more as bytes, each as wide as the greatest needs."""
    return v.astype(f"<{np.min_scalar_type(int(v.max(initial=0))).str[1:]}").tobytes()


def widened(data: bytes, n: int) -> np.ndarray:
    """The n numbers that `narrow` wrote."""
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def packs(df: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text: str = "text", pack_bytes: int = 2 << 20, work: int = 1 << 15, with_groups: bool = False) -> DataFrame:
    """One row a run of texts of about `pack_bytes` (one text, if longer): their figures, and the pack's pairs with counts.

    A pair is a's id in the high and b's in the low 32 bits. What leaves a pack is its different pairs, so a pair that every
    text holds counts once a pack in whatever is shuffled. Which pairs a text holds and how often (`at`, `times`) are bytes, which
    the JVM passes on without an element, level or copy for each of them."""
    small_batches(df.sparkSession)
    doc = [T.StructField("id", df.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in _FIGURES], T.StructField("sha256", T.StringType())] + [T.StructField("groups", T.StringType())] * with_groups
    schema = T.StructType([T.StructField("pack", T.LongType()), T.StructField("docs", T.ArrayType(T.StructType(doc))), *[T.StructField(c, T.BinaryType()) for c in ("at", "times")], *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("pairs", "total")]])

    def run(batches):
        aligner, base, count = None, TaskContext.get().partitionId() << 32, 0
        for b in batches:
            aligner = aligner or Aligner(path_a, path_b, work)
            for x, y in runs_by_bytes(pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist(), pack_bytes):
                got = aligner.pack([t or "" for t in b.column(1).slice(x, y - x).to_pylist()])
                figures = [b.column(0).slice(x, y - x), *[pa.array(got[c].astype(np.int64)) for c in _FIGURES], pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in got["groups"]])]
                if with_groups:
                    figures.append(pa.array([g.decode() for g in got["groups"]]))
                docs = pa.StructArray.from_arrays(figures, names=[f.name for f in doc])
                whole = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
                yield pa.RecordBatch.from_arrays([pa.array([base + count]), whole(docs), *[pa.array([narrow(got[c])], pa.binary()) for c in ("at", "times")], *[whole(pa.array(got[c])) for c in ("pairs", "total")]], names=schema.names)
                count += 1

    return df.select(df[f"`{id_col}`"].alias("id"), df[f"`{text}`"].cast("string").alias("text")).mapInArrow(run, schema)


def pair_counts(packed: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, count, best) over all packs; best: no other pair of its b id has a higher count.

    The window holds one b id's pairs, as many as the first vocabulary has entries at most."""
    each = packed.select(F.inline(F.arrays_zip("pairs", "total"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("total").alias("count"))
    each = each.select("pair", F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b_id"), "count")
    return each.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b_id")))


def align(df: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text: str = "text", pack_bytes: int = 2 << 20, work: int = 1 << 15, with_groups: bool = False) -> DataFrame:
    """Per text: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups].

    Both sides encode the text behind a space, strings of special tokens as plain text; byte ranges of tokens that overlap
    link, offsets where tokens of both sides end cut the text into groups. n_best counts the links whose pair no other pair of
    its b id exceeds in links of all texts, count_sum adds up those counts over the links. A null or empty text, and one that
    a side does not give back byte for byte, has no tokens: zeros and an empty string. Repeated rows are counted and
    returned each; an empty table gives no rows; other columns are not read.

    Encoding and merging are one pass over the texts, stored; the pairs' counts are an aggregation of the packs' pairs, which
    go back to their packs by a join on the pair and one on the pack.
    """
    packed = stored(packs(df, path_a, path_b, id_col=id_col, text=text, pack_bytes=pack_bytes, work=work, with_groups=with_groups), **ROW_GROUP)
    asked = packed.select("pack", F.explode("pairs").alias("pair"))
    answers = asked.join(pair_counts(packed).select("pair", "count", "best"), "pair").groupBy("pack").agg(F.collect_list(F.struct("pair", "count", "best")).alias("found"))
    doc = packed.schema["docs"].dataType.elementType
    made = [T.StructField(id_col, doc["id"].dataType), *[T.StructField(c, T.LongType()) for c in (*_FIGURES[:4], "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())] + [T.StructField("groups", T.StringType())] * with_groups
    schema = T.StructType(made)

    def run(batches):
        for b in batches:
            columns = {c: b.column(c) for c in b.schema.names}
            for r in range(b.num_rows):
                docs = columns["docs"][r].values
                upto = np.append(0, np.cumsum(docs.field("n_pairs").to_numpy(zero_copy_only=False)))
                at, times = (widened(columns[c][r].as_buffer(), int(upto[-1])) for c in ("at", "times"))
                count = best = np.zeros(0, np.int64)
                if columns["found"][r].is_valid:
                    found = columns["found"][r].values
                    order = np.argsort(found.field(0).to_numpy(zero_copy_only=False))
                    count, best = (found.field(k).to_numpy(zero_copy_only=False)[order].astype(np.int64) for k in (1, 2))
                sums = [np.append(0, np.cumsum(v[at] * times))[upto] for v in (best, count)]
                out = [docs.field("id"), *[docs.field(c) for c in _FIGURES[:4]], *[pa.array(np.diff(s)) for s in sums], docs.field("sha256"), *([docs.field("groups")] if with_groups else [])]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return packed.select("pack", "docs", "at", "times").join(answers, "pack", "left").drop("pack").mapInArrow(run, schema)
