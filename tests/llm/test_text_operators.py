"""Each operator on the awkward rows of `docs`, against a brute-force version."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from foliospark.llm import jaccard, langid, mixing, packing, secrets, suffix, tokencount, tokens

BPE = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]


def test_encoder_is_the_library(docs):
    texts = [r.text or "" for r in docs.collect()] + ["a\n\n b", "don't  stop", "\t\tx  y", "é<|endoftext|>é", " " * 50, "\x1c a\x1c\x1cb", "end \n"]
    want = library(texts)
    for own in (False, True):
        got = [np.frombuffer(b, "<u4").tolist() for b in tokens.Encoder(BPE, own_library=own)(texts)]
        assert got == want
    assert tokens.Encoder(BPE, lengths_only=True)(texts) == [len(w) for w in want]


def test_whole_table_is_the_librarys(spark):
    """Every document of a real table, and very long texts, id by id; and a library that parts is not passed over."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += [" ".join(texts[:60]), "x" * 200_000, "a b\n" * 60_000, "é ü " * 50_000]
    want = library(texts)
    enc = tokens.Encoder(BPE)
    assert [np.frombuffer(b, "<u4").tolist() for b in enc(texts)] == want
    assert tokens.Encoder(BPE, lengths_only=True)(texts) == [len(w) for w in want]
    enc._ids = lambda t: [np.zeros(3, "<u4") for _ in t]
    with pytest.raises(RuntimeError):
        enc(["plain words"])


def test_clashing_names(spark, docs):
    """Columns of the input named like results or like what operators add inside."""
    odd = docs.select("doc_id", "text", "lang", "source", *[F.lit(-1).alias(c) for c in ("start", "length", "offset", "n_shingles", "list", "f1", "spans", "live", "held", "__keep", "__row", "score", "entropy", "rejected", "rate", "weight", "__source", "bucket", "kind", "n_bytes")])
    for f in (lambda d: packing.pack(d, BPE).drop("sequence_id", "offset"), lambda d: tokencount.count_tokens(d, BPE, keep=["doc_id"]), secrets.scan, lambda d: langid.identify(d, langid.learn(d), keep=["doc_id"])):
        assert sorted(map(repr, f(odd).collect())) == sorted(map(repr, f(docs.drop("weight")).collect()))
    kept = mixing.mix_sources(odd)
    assert kept.where("rate > 1 or weight < 0").count() == 0 and {"weight", "rate"} <= set(kept.columns)


def test_cuts_are_safe():
    text = "word   x\n\ny  z'll <|endoftext|> 12   a " * 500
    parts = tokens.pieces(text, 50)
    assert "".join(parts) == text and len(parts) > 50
    assert sum(library(parts), []) == library([text])[0]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(name, docs):
    path = public_tokenizers.path(name)
    texts = [r.text or "" for r in docs.limit(5).collect()]
    assert [len(b) // 4 for b in tokens.Encoder(path)(texts)] == tokens.Encoder(path, lengths_only=True)(texts)


def test_token_counts(docs, none):
    got = sorted(tuple(r) for r in tokencount.count_tokens(docs, BPE, keep=["doc_id"]).collect())
    rows = docs.collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), len(i), len(i) > 512) for r, i in zip(rows, library([r.text or "" for r in rows]), strict=True))
    assert got == want
    assert tokencount.count_tokens(none, BPE).count() == 0
    assert tokencount.count_tokens(docs.withColumn("n_tokens", F.lit("clash")), BPE).schema["n_tokens"].dataType.simpleString() == "bigint"


def test_packing_keeps_every_id_once(docs, none):
    rows = docs.collect()
    ids = {r.doc_id: i + [1] for r, i in zip(rows, library([r.text or "" for r in rows]), strict=True)}
    got = packing.pack(docs.coalesce(1), BPE, capacity=256, window=8).collect()
    seen = {}
    for p in sorted(got, key=lambda p: (p.doc_id, p.start)):
        part = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()
        assert p.ids_crc32 == zlib.crc32(part) and p.doc_tokens == len(ids[p.doc_id])
        seen[p.doc_id] = seen.get(p.doc_id, 0) + p.length
    assert seen == {i: len(x) * (2 if i == 4 else 1) for i, x in ids.items()}
    room = {}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == room.get(p.sequence_id, 0)
        room[p.sequence_id] = p.offset + p.length
    assert all(n == 256 or n & (n - 1) == 0 for n in room.values())
    assert packing.pack(none, BPE).count() == 0


def test_assign_is_cost_balanced():
    lengths = [9, 7, 5, 4, 4, 3, 2, 2]
    got = packing.assign(lengths, [12, 12, 12], 1.0, 0.5)
    assert sorted(sum(n for i, n, _ in got if i == k) for k in range(8)) == sorted(lengths)
    assert [s for i, _, s in got[:3]] == [0, 1, 2]  # the three longest open one sequence each


def sets(rows):
    out = {}
    for r in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r.text or "").encode()))
        out[r.doc_id] = frozenset(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()
    return out


def brute_groups(s):
    """The smallest id that each id reaches over links of all pairs."""
    ids = sorted(s)
    links = [(i, j) for k, i in enumerate(ids) for j in ids[k + 1 :] if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])]
    root, more = {i: i for i in ids}, True
    while more:
        more = False
        for i, j in links:
            low = min(root[i], root[j])
            more |= root[i] != low or root[j] != low
            root[i] = root[j] = low
    return root


def test_jaccard_groups(docs, none):
    got = jaccard.link_groups(docs).collect()
    s = sets(docs.collect())
    root = brute_groups(s)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((r.doc_id, len(s[r.doc_id]), root[r.doc_id]) for r in docs.collect())
    assert root[3] == 1 and root[8] == 7
    assert jaccard.link_groups(none).count() == 0


def test_jaccard_large_group_in_blocks(spark):
    """A group of copies larger than a block, chained so that not all are linked directly."""
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in range(i % 7):
            w[(i * 5 + k * 11) % 60] = f"x{i}-{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    root = brute_groups(sets(df.collect()))
    got = {r.doc_id: r.component_id for r in jaccard.link_groups(df, block=8).collect()}
    assert got == root


def test_jaccard_of_hubs_in_several_blocks(spark):
    """Many documents around one passage, so that a hub has several blocks and lists stay open; ids with two texts."""
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(40)]
    rows = []
    for i in range(90):
        own = [f"o{i // 3}-{k}" for k in range(int(rng.integers(4, 12)))]
        rows.append((i, " ".join(base + own + [f"x{i}"] * (i % 2))))
    rows += [(3, " ".join(base[:20])), (95, " ".join(base[:20])), (3, rows[3][1]), (96, None), (None, rows[0][1]), (97, "one two"), (98, "w " * 70000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("f1", F.lit("clash")).withColumn("list", F.lit(2))
    kept = [(k, i, t) for k, (i, t) in enumerate(rows) if i is not None]
    s = {k: v for k, v in zip([k for k, *_ in kept], [sets([type("R", (), {"doc_id": 0, "text": t})])[0] for _, _, t in kept], strict=True)}
    root = brute_groups(s)
    least = {}
    for k, i, _ in kept:
        least[root[k]] = min(least.get(root[k], i), i)
    want = sorted((i, len(s[k]), least[root[k]]) for k, i, _ in kept)
    for block in (8, 128):
        assert sorted(map(tuple, jaccard.link_groups(df, block=block).collect())) == want


def test_merge_skip_counts_weights():
    rng = np.random.default_rng(2)
    for need in (1, 3, 9, 20):
        lists = [sorted(set(rng.integers(0, 60, int(rng.integers(1, 30))).tolist())) for _ in range(12)]
        weights = rng.integers(1, 5, 12).tolist()
        sums = {x: sum(w for l, w in zip(lists, weights, strict=True) if x in l) for x in range(50)}
        seen, jumped = [], []
        jaccard.merge_skip(lists, weights, need, 50, lambda x, n: seen.append((x, n)) or x + 1)
        assert seen == [(x, n) for x, n in sums.items() if n >= need]
        jaccard.merge_skip(lists, weights, need, 50, lambda x, n: jumped.append((x, n)) or x + 10)
        want = []
        for x, n in seen:
            if not want or x >= want[-1][0] + 10:
                want.append((x, n))
        assert jumped == want


def test_divide_skip_probes_long_lists():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 2**63, 80).astype(np.uint64)
    s = [np.unique(np.r_[common[: 80 - k % 9], rng.integers(0, 2**63, k % 9 + 1).astype(np.uint64)]) for k in range(40)]
    a, b = jaccard.divide_skip(s, 80, 100)
    assert len(a) == 39  # all in one group, each joined once


def test_secrets(docs, none):
    a = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    for r in docs.collect():
        t = r.text or ""
        s = [(m.start(), 0, "assign", m.end()) for m in a.finditer(t) if len(m[2]) >= 6]
        s += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        s += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        w = ",".join(f"{k}:{x}:{y}" for x, _, k, y in sorted(s))
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(w.encode()).hexdigest()
        assert set(filter(None, w.split(","))) <= set(g.spans.split(","))
    assert got[12].n_access == 1 and got[12].n_hex == 1
    # one value, two owners: an example; values of one owner: live
    assert got[13].n_example >= 1 and got[12].n_live == 1  # a repeated word in hex does not look generated
    assert secrets.scan(none).count() == 0


def test_redaction(docs):
    got = secrets.scan(docs, keep=["doc_id", "text"])
    text = {r.doc_id: r.t for r in got.select("doc_id", secrets.redact(F.col("text"), F.col("live")).alias("t")).collect()}
    assert text[12] == 'token = "abc123DEF456ghi789" and [secret] deadbeefdeadbeefdeadbeef01'
    assert text[5] is None and text[7] == "one two"


def test_mixing_meets_targets(docs, none):
    cells = mixing.stored(docs.select(F.coalesce("source", F.lit("")).alias("__source"), F.coalesce("lang", F.lit("")).alias("__lang"), mixing.tokens_of(F.col("text")).alias("t")).groupBy("__source", "__lang").agg(F.sum("t").alias("tokens")).where("tokens > 0"))
    got = mixing.rake(cells, ["__source", "__lang"], {"__source": 0.5, "__lang": 1.0}, rounds=40).toPandas()
    tok = got.groupby("__lang").tokens.sum() / got.tokens.sum()
    assert np.allclose(got.groupby("__lang").share.sum(), tok, atol=1e-6)
    # raking stops by itself where the sums meet the targets, in every dimension
    spark = docs.sparkSession
    full = mixing.stored(spark.createDataFrame([(a, b, 10 + 7 * i + 31 * j) for i, a in enumerate("xyz") for j, b in enumerate("pq")], "__source string, __lang string, tokens long"))
    done = mixing.rake(full, ["__source", "__lang"], {"__source": 0.5, "__lang": 0.7}).toPandas()
    for d, p in (("__source", 0.5), ("__lang", 0.7)):
        want = (done.groupby(d).tokens.sum().astype(float) ** p).pipe(lambda x: x / x.sum())
        assert np.allclose(done.groupby(d).share.sum(), want, atol=1e-9)
    kept = mixing.mix_sources(docs.withColumn("rate", F.lit(1)))
    assert {"weight", "rate", "n_tokens"} <= set(kept.columns) and kept.where("rate > 1").count() == 0
    assert mixing.mix_sources(none).count() == 0


def test_topics_and_tokens(spark):
    rows = ["", None, "Licensed under the MIT License", "my token and my phone", "token http phone", "x " * 5000 + "license", "abcd 12345 ü!? ab"]
    got = [tuple(r) for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(mixing.topic_of(F.col("t")), mixing.tokens_of(F.col("t"))).collect()]
    assert [g[0] for g in got] == ["general", "general", "legal", "technical", "technical", "general", "general"]
    assert got[1][1] == got[0][1] == 0 and got[6][1] == (50 * 17 + 98 - 75 * 3) // 100
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 60")
    rows = docs.select("lang", "text", mixing.tokens_of(F.col("text")).alias("n")).collect()
    real = [len(i) for i in library([r.text for r in rows])]
    for lang in ("en", "de", "fr", "es"):
        n, m = sum(r.n for r in rows if r.lang == lang), sum(k for r, k in zip(rows, real, strict=True) if r.lang == lang)
        assert abs(n / m - 1) < 0.06


def repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted({(r.doc_id, r.text or "") for r in rows}):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest())
    return out


def test_repeat_removal(docs, none):
    want = repeats(docs.collect())
    got = suffix.remove_repeats(docs).collect()
    assert len(got) == docs.count()
    assert all(tuple(r)[1:] == want[r.doc_id] for r in got)
    assert want[14][1] == 399 and want[2][1] == want[2][0]
    assert suffix.remove_repeats(none).count() == 0


def test_texts_of_one_id_are_documents_of_their_own(spark):
    """Two texts of one id, a copy of one of them, a repeated row: what repeats goes, in whole results."""
    from tests.llm.conftest import words

    a, b, c = words(21, 60)[:303], words(22, 60)[:303], words(23, 90)
    rows = [(1, a), (1, b), (2, a + b[:13]), (3, c), (3, c), (4, None), (4, c[50:300]), (None, a), (5, "x" * 150000)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit(1)).withColumn("alt", F.lit("z"))).collect())
    n = len(c)
    assert got == sorted([(1, 303, 0), (1, 303, 0), (2, 316, 303), (3, n, 0), (3, n, 0), (4, 0, 0), (4, 250, 250), (5, 150000, 149999)])


def test_deep_shallow_sorts_suffixes():
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 100, (300, 40)).astype(np.uint8)
    rows[100:200] = rows[:100]
    rows[150:200, 30:] = rng.integers(97, 99, (50, 10))
    group = rng.integers(0, 3, 300)
    order, common = suffix.deep_shallow(rows, group)
    keys = [(group[i], rows[i].tobytes()) for i in order]
    assert keys == sorted(keys)
    for k in range(1, 300):
        a, b = rows[order[k - 1]], rows[order[k]]
        want = -1 if keys[k][0] != keys[k - 1][0] else int(np.argmin(a == b)) if (a != b).any() else 40
        assert common[k] == want


def test_language_models(spark, docs, none):
    """Two invented languages of different letters; what fits neither is rejected."""
    from tests.llm.conftest import words

    swap = str.maketrans("aeioubcdlmnrst", "qwxyzjkpvfghuo")
    rows = [(i, words(i, 60) if i % 2 else words(i, 60).translate(swap), "aa" if i % 2 else "bb") for i in range(1, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df.where("doc_id < 150"))
    got = {r.doc_id: r for r in langid.identify(df.where("doc_id >= 150"), model).collect()}
    assert all(r.lang_pred == r.lang and 0.9 < r.score <= 1 and not r.rejected for r in got.values())
    odd = {r.doc_id: r for r in langid.identify(docs, model, keep=["doc_id"]).collect()}
    assert odd[5].lang_pred == odd[6].lang_pred == odd[15].lang_pred == "und" and odd[5].score == 0 and odd[5].rejected
    assert langid.identify(none, model).count() == 0
    blank = langid.learn(none)
    assert {r.lang_pred for r in langid.identify(docs, blank).collect()} == {"und"}


ODD = ["Az ember azert tanul, hogy megismerje a vilagot, amelyben el, es hogy kepes legyen boldogulni benne minden nap",
       "Litwo, ojczyzno moja, ty jestes jak zdrowie, ile cie trzeba cenic, ten tylko sie dowie, kto cie stracil"]
ODD += ["".join(np.random.default_rng(k).choice(list("abcdefghijklmnopqrstuvwxyz "), 300)) for k in range(5)]


@pytest.mark.parametrize("split", range(4))
def test_rejection_holds_its_rate(spark, split):
    """Learned from three quarters of a real table: hardly any own text goes, foreign and random texts do; mislabelled
    texts among the calibrating ones do not switch rejection off; labels beyond the bound are not learned."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    wrong = spark.createDataFrame([(100000 + k, t, "de") for k, t in enumerate(ODD)], docs.schema)
    model = langid.learn(docs.where(f"doc_id % 4 <> {split}").unionByName(wrong))
    got = langid.identify(docs.where(f"doc_id % 4 = {split}"), model).collect()
    # document 39 is half French, half English
    assert sum(r.rejected for r in got) <= max(1, 5e-4 * len(got)) and all(r.lang_pred == r.lang for r in got if r.doc_id != 39)
    assert model(ODD)[3].all()
    if split == 0:
        assert langid.learn(docs, most_langs=2).scorer.langs == ["en", "fr"]


def test_a_fifth_of_a_small_language_is_wrong(spark):
    """A quarter as many texts of random letters, or texts of the other languages, as the smallest language has own ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    fit, held = docs.where("doc_id % 4 <> 1"), docs.where("doc_id % 4 = 1")
    n = fit.where("lang = 'es'").count() // 4
    rng = np.random.default_rng(5)
    for texts in (["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 200 + k, p=rng.dirichlet(np.ones(27)))) for k in range(n)], [r.text for r in held.where("lang <> 'es'").limit(n).collect()]):
        wrong = spark.createDataFrame([(100000 + k, t, "es") for k, t in enumerate(texts)], docs.schema)
        model = langid.learn(fit.unionByName(wrong))
        got = langid.identify(held, model).collect()
        assert sum(r.rejected for r in got) <= 1 and sum(r.lang_pred != r.lang for r in got) == 0
        assert model(ODD)[3].all()


def test_few_rows(spark):
    """Too few rows of any label: only texts without letters are rejected. One label with enough: the other takes its centre."""
    from tests.llm.conftest import words

    rows = [(i, words(i, 60), "aa" if i < 120 else "bb") for i in range(125)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = langid.learn(df.where("doc_id > 115"))
    assert np.isinf(few.bound).all() and few(["12 !", ODD[0]])[3].tolist() == [True, False]
    one = langid.learn(df)
    assert len(set(one.bound.tolist())) == 1 and one([words(500, 60), ODD[2]])[3].tolist() == [False, True]
    assert langid.learn(df, most_rows=40).scorer.langs in (["aa"], ["aa", "bb"])


class PlainKneserNey:
    """Interpolated Kneser-Ney over dicts of tuples, as the formula is written."""

    def __init__(self, streams):
        from collections import Counter, defaultdict

        self.counts = [None] * (langid.ORDER + 1)
        self.counts[langid.ORDER] = Counter(g for s in streams for g in s)
        for n in range(langid.ORDER - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.total, self.kinds = [defaultdict(int) for _ in self.counts], [defaultdict(int) for _ in self.counts]
        for n in range(1, langid.ORDER + 1):
            for g, c in self.counts[n].items():
                self.total[n][g[:-1]] += c
                self.kinds[n][g[:-1]] += 1

    def p(self, g):
        n = len(g)
        if n == 0:
            return 1 / langid.CLASSES
        below, context = self.p(g[1:]), g[:-1]
        if not self.total[n][context]:
            return below
        d = langid.DISCOUNT
        return max(self.counts[n][g] - d, 0) / self.total[n][context] + d * self.kinds[n][context] / self.total[n][context] * below


def test_models_are_plain_kneser_ney(spark):
    """Entropies and predictions of the fitted models, held against dicts without hashing or arrays, on a real table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").select("doc_id", "text", "lang")
    model = langid.learn(docs)
    alphabet, langs = model.scorer.alphabet, model.scorer.langs

    def stream(t):
        cls = [0 if not c.isalpha() else alphabet.index(c.lower()) + 1 if c.lower() in alphabet else langid.CLASSES - 1 for c in t]
        cls = [c for k, c in enumerate(cls) if c or not k or cls[k - 1]]
        return [tuple(([0] * (langid.ORDER - 1) + cls)[k : k + langid.ORDER]) for k in range(len(cls))]

    rows = docs.collect()
    codes = lambda t: [tuple(c >> langid.BITS * k & langid.CLASSES - 1 for k in range(langid.ORDER - 1, -1, -1)) for c in langid.grams([t], langid.class_table(alphabet))[0].tolist()]
    assert all(codes(r.text) == stream(r.text) for r in rows[:40])
    fitted = {l: PlainKneserNey([stream(r.text) for r in rows if r.lang == l]) for l in langs}
    scorer = langid.Scorer(alphabet, {l: langid.KneserNey(*np.unique(langid.grams([r.text for r in rows if r.lang == l], langid.class_table(alphabet))[0], return_counts=True)) for l in langs})
    ce = scorer.entropies([r.text for r in rows[:40]])[0]
    for r, got in zip(rows[:40], ce, strict=True):
        s = stream(r.text)
        want = [-sum(np.log(fitted[l].p(g)) for g in s) / max(len(s), 1) for l in langs]
        assert np.allclose(got, want, atol=1e-9)
        if s:
            assert model([r.text])[0][0] == langs[int(np.argmin(want))] or not any(c.isalpha() for c in r.text)


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abc "), 3000))
    code, n = np.unique(langid.grams([text], langid.class_table("abc"))[0], return_counts=True)
    m = langid.KneserNey(code, n)
    for context in (code[:5] >> langid.BITS):
        p = np.exp(m.log_prob((context << langid.BITS) + np.arange(langid.CLASSES)))
        assert abs(p.sum() - 1) < 1e-9
