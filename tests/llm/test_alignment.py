"""Cross-tokenizer alignment against a plain double loop over byte ranges."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.llm import alignment, queries, tokens

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    """[(id, text)] -> rows of the operator, by the libraries alone, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    t, s = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    held, counts = [], Counter()
    for i, text in rows:
        if not text:
            held.append((i, [], [], [], []))
            continue
        a, b = t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)
        bytes_a = [bytes(chars[c] for c in t.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(s.id_to_piece(x)[3:5], 16)]) if s.is_byte(x) else s.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            held.append((i, [], [], [], []))
            continue
        ends = [np.cumsum([len(x) for x in y]) for y in (bytes_a, bytes_b)]
        links, j = [], 0
        for k in range(len(a)):
            start = ends[0][k] - len(bytes_a[k])
            while ends[1][j] <= start:
                j += 1
            m = j
            while m < len(b) and ends[1][m] - len(bytes_b[m]) < ends[0][k]:
                links.append((a[k], b[m]))
                m += 1
        groups, x, y = [], 0, 0
        for e in sorted({*ends[0]} & {*ends[1]}):
            p, q = int(np.searchsorted(ends[0], e)) + 1, int(np.searchsorted(ends[1], e)) + 1
            groups.append((a[x:p], b[y:q]))
            x, y = p, q
        counts.update(links)
        held.append((i, a, b, links, groups))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    out = []
    for i, a, b, links, groups in held:
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return out


def key(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


ODD = ["a\n\n b", "don't  stop", "é<|endoftext|>é <s> <unk>", " " * 70, " lead", "trail ", "▁x ▁ y", "ﬁne ① Ａ é", "\x00\x01 x\ty\r\n", "日本語 テキスト 👩‍👩‍👧 word", "x" * 3000]


def test_awkward_texts(spark, docs, none):
    more = spark.createDataFrame([(100 + i, t, None, None, None, None) for i, t in enumerate(ODD)], docs.schema)
    odd = docs.union(more).withColumn("pack", F.lit(1)).withColumn("n_a", F.lit(2)).withColumn("found", F.lit(3))
    got = alignment.align(odd, A, B).collect()
    assert key(got) == key(plain([(r.doc_id, r.text) for r in odd.collect()]))
    assert {r.doc_id: r for r in got}[5][1:] == (0, 0, 0, 0, 0, 0, "")
    assert key(alignment.align(odd, A, B, pack_bytes=1, work=7).collect()) == key(got)
    assert alignment.align(none, A, B).count() == 0
    said = alignment.align(odd, A, B, with_groups=True).where("groups <> ''").collect()
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in said) and len(said) > 10


def test_stored_packs_are_read_in_small_groups(spark):
    """A reader holds a row group at once: eight packs at most, and of a pack's texts bytes, no element a pair."""
    import pyarrow.dataset as ds

    before = set(getattr(spark, "_foliospark_tables", ()))
    rows = [(i, f"one two {i} three " * 3) for i in range(50)]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), A, B, pack_bytes=1)
    (path,) = spark._foliospark_tables - before
    stored = ds.dataset(path.removeprefix("file:"), format="parquet")
    assert max(g.num_rows for f in stored.get_fragments() for g in f.row_groups) <= 8 and stored.count_rows() == 50
    assert {str(stored.schema.field(c).type) for c in ("at", "times")} == {"binary"}
    assert key(got.collect()) == key(plain(rows))


def test_numbers_as_narrow_bytes():
    for v, width in (([], 1), ([0, 255], 1), ([256, 0], 2), ([65536], 4), ([1 << 40, 3], 8)):
        data = alignment.narrow(np.array(v, np.int64))
        assert len(data) == width * len(v) and alignment.widened(data, len(v)).tolist() == v


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert key(queries.op12_token_alignment(spark, sf).collect()) == key(plain([tuple(r) for r in rows]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=60), st.integers(1, 40))
def test_pieces_are_independent(x, y, work):
    """Whatever the work of a piece, links and groups are those of one merge; pieces differ by one item at most."""
    n = min(sum(x), sum(y))
    a, b = ([e for e in np.cumsum(v) if e < n] + [n] for v in (x, y))
    a, b = np.array(a), np.array(b)
    of_a, of_b, close_a, close_b = alignment.merge_ends(a, b, work)
    start = lambda v: np.append(0, v[:-1])
    want = {(i, j) for i in range(len(a)) for j in range(len(b)) if max(start(a)[i], start(b)[j]) < min(a[i], b[j])}
    assert sorted(zip(of_a.tolist(), of_b.tolist(), strict=True)) == sorted(want)
    both = {*a.tolist()} & {*b.tolist()}
    assert [e in both for e in a] == close_a.tolist() and [e in both for e in b] == close_b.tolist()
    i, j = alignment.split_points(a, b, work)
    assert (np.diff(i + j)[:-1] == work).all() and sorted(np.concatenate([a, b])) == [v for k in range(len(i) - 1) for v in sorted([*a[i[k] : i[k + 1]], *b[j[k] : j[k + 1]]])]


@pytest.mark.parametrize("text", ["a b " * 200_000, "x" * 400_000, "▁ b" * 100_000, "é ü  " * 90_000, "word\n" * 60_000 + " end "])
def test_model_cuts_are_safe(text):
    """Stretches of a text give the ids of the whole through sentencepiece."""
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=B)
    e = tokens.Encoder(B)
    assert e.cuts and np.frombuffer(e([text])[0], "<u4").tolist() == s.encode(text)
    assert tokens.pieces("ab cd  ef", 2, marked=True) == ["ab", "cd", " ef"]
