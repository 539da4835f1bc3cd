"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliospark.llm.common import discard, mix, runs_by_bytes, small_batches, stored

ORDER, BITS = 4, 6
CLASSES = 1 << BITS
DISCOUNT = 0.75
_LOW = 0x3000


def class_table(alphabet: str) -> np.ndarray:
    """Class of each code point below U+3000: 0 no letter, 1.. a letter of the alphabet, the last any other letter."""
    at = {c: i + 1 for i, c in enumerate(alphabet)}
    return np.array([at.get(c.lower(), CLASSES - 1) if (c := chr(p)).isalpha() else 0 for p in range(_LOW)], np.uint8)


def classes(text: str, table: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = table[np.minimum(points, _LOW - 1)]
    for p in np.unique(points[points >= _LOW]):
        out[points == p] = CLASSES - 1 if chr(p).isalpha() else 0
    return out


def grams(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all 4-grams, the text each belongs to, letters per text); runs of non-letters count as one."""
    lengths = np.array([len(t) for t in texts], np.int64)
    cls = classes("".join(texts), table)
    own = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    letters = np.bincount(own[cls > 0], minlength=len(texts))
    if not len(cls):
        return np.zeros(0, np.int32), own, letters
    fresh = np.ones(len(cls), bool)
    fresh[1:] = (cls[1:] > 0) | (cls[:-1] > 0) | (own[1:] != own[:-1])
    cls, own = cls[fresh].astype(np.int32), own[fresh]
    code = cls.copy()
    for k in range(1, ORDER):
        before = np.zeros_like(cls)
        before[k:] = np.where(own[k:] == own[:-k], cls[:-k], 0)
        code |= before << (BITS * k)
    return code, own, letters


class KneserNey:
    """One language's model: per order a sorted array of n-gram hashes beside interpolated probabilities, and a
    sorted array of context hashes beside back-off weights."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.levels = []
        order = np.argsort(codes)
        codes, counts = codes[order].astype(np.int64), counts[order].astype(np.float64)
        tables = [(codes, counts)]
        for n in range(ORDER - 1, 0, -1):  # below the top: in how many different contexts to the left
            tables.append(tuple(np.unique(tables[-1][0] & ((1 << (BITS * n)) - 1), return_counts=True)))
        lower = None
        for n, (keys, c) in zip(range(1, ORDER + 1), reversed(tables), strict=True):
            context, at, kinds = np.unique(keys >> BITS, return_inverse=True, return_counts=True)
            total = np.bincount(at, weights=c)
            back = DISCOUNT * kinds / total
            below = np.full(len(keys), 1 / CLASSES) if lower is None else lower(keys & ((1 << (BITS * (n - 1))) - 1))
            p = np.maximum(c - DISCOUNT, 0) / total[at] + back[at] * below
            self.levels.append((*self._sorted(keys, p), *self._sorted(context, back)))
            lower = lambda q, n=n: self._level(q, n)

    @staticmethod
    def _hash(keys):
        return mix(np.asarray(keys).astype(np.uint64) + np.uint64(0x51))

    @classmethod
    def _sorted(cls, keys, values):
        h = cls._hash(keys)
        order = np.argsort(h)
        return h[order], values[order]

    @staticmethod
    def _find(keys, values, asked, other):
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where(keys[at] == asked, values[at], other)

    def _level(self, codes, n):
        keys, p, contexts, back = self.levels[n - 1]
        known = self._find(keys, p, self._hash(codes), np.nan)
        gone = np.isnan(known)
        if gone.any():
            rest = codes[gone]
            below = self._level(rest & ((1 << (BITS * (n - 1))) - 1), n - 1) if n > 1 else np.full(len(rest), 1 / CLASSES)
            known[gone] = self._find(contexts, back, self._hash(rest >> BITS), 1.0) * below
        return known

    def log_prob(self, codes):
        return np.log(self._level(np.asarray(codes, np.int64), ORDER))


class Scorer:
    def __init__(self, alphabet: str, models: dict[str, KneserNey]):
        self.alphabet, self.langs, self.models, self.scratch = alphabet, list(models), list(models.values()), None

    def entropies(self, texts: list[str], stretch: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy per text and language in nats a character, characters, letters).

        Long texts are scored in stretches, whose sums add up; a stretch begins without context."""
        if self.scratch is None:
            self.table, self.scratch = class_table(self.alphabet), np.zeros(1 << (BITS * ORDER), np.int32)
        parts = [(i, t[a : a + stretch]) for i, t in enumerate(texts) for a in range(0, len(t), stretch)]
        sums, size, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts)), np.zeros(len(texts))
        for a, b in runs_by_bytes([len(p) for _, p in parts], stretch):
            code, own, n = grams([p for _, p in parts[a:b]], self.table)
            of = np.array([i for i, _ in parts[a:b]])
            np.add.at(letters, of, n)
            if not len(code):
                continue
            self.scratch[code] = 1
            seen = np.flatnonzero(self.scratch)
            self.scratch[seen] = np.arange(len(seen), dtype=np.int32)
            at = self.scratch[code]
            self.scratch[seen] = 0
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            np.add.at(size, of[own[first]], np.diff(np.r_[first, len(own)]))
            for k, m in enumerate(self.models):
                np.add.at(sums[:, k], of[own[first]], np.add.reduceat(-m.log_prob(seen)[at], first))
        return sums / np.maximum(size, 1)[:, None], size, letters


def tail_bound(own: np.ndarray, rate: float, body: float = 0.9, shape: float = 0.5, least: float = 0.014) -> float:
    """A value that a share of at most `rate` of such values exceeds.

    A generalised Pareto tail of a stated, heavy shape is laid on what exceeds the quantile `body`. Its scale comes from
    the median excess (`least` at least, for small samples), which a few mislabelled values do not move.
    """
    if not len(own):
        return np.inf
    start = np.quantile(own, body)
    over = own[own > start] - start
    middle = max(np.median(over) if len(over) else 0.0, least)
    return float(start + middle * (((1 - body) / rate) ** shape - 1) / (2**shape - 1))


class Identifier:
    """What learn() makes and identify() uses: the scorer, and per language the entropy from which a text is rejected."""

    def __init__(self, scorer: Scorer, bound: np.ndarray, sure_from: int):
        self.scorer, self.bound, self.sure_from = scorer, bound, sure_from

    def __call__(self, texts: list[str]):
        ce, _, letters = self.scorer.entropies(texts)
        if not ce.shape[1]:
            return ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
        best = ce.argmin(1)
        low = ce[np.arange(len(ce)), best]
        score = 1 / np.exp(np.minimum((low[:, None] - ce) * 20, 0)).sum(1)
        rejected = (letters == 0) | ((letters >= self.sure_from) & (low > self.bound[best]))
        none = letters == 0
        pred = ["und" if z else self.scorer.langs[k] for k, z in zip(best, none, strict=True)]
        return pred, np.where(none, 0.0, score), np.where(none, np.nan, low), rejected


def learn(labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 3000, most_rows: int = 200_000, least_rows: int = 20,
          most_langs: int | None = None, clear: float = 0.25, false_rejection: float = 5e-4, sure_from: int = 40) -> Identifier:
    """An Identifier from labelled rows.

    Fitting and calibration see a bounded sample: about `per_lang` rows of each label, drawn by a hash of the key, and
    `most_rows` in all, fewer of each where there are very many labels (labels that would then hold less than
    `least_rows` rows are not learned, nor are those after the `most_langs` most frequent ones, if that is given). The
    sample is written once; what leaves it are counts of at most CLASSES ** ORDER n-grams a label and a few numbers a row.

    Labels may be wrong. The sample is cut in two halves and each half is scored by models of the other. A row goes when
    another language fits it better by `clear` nats a character, or when its entropy lies further above the median of its label than hardly any row
    does (`tail_bound` of all labels together, each about its own median); wrong rows that are alike can still hold each other. What stays is fitted anew, half by half for
    calibration and as a whole for use.

    A text is rejected when it has no letter at all, or at least `sure_from` letters and a best entropy beyond its
    language's bound: the median of the language, plus the excess that a share of at most `false_rejection` of all
    calibrating texts reaches, pooled over languages, so neither a few wrong labels nor a small language can move it far,
    plus a third of the way from there to what texts of one language score under the models of the others. A language with
    less than `least_rows` calibrating rows takes the greatest median of the others; where no language has as many, only texts
    without letters are rejected. Rows with a null text or label teach nothing.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string"), F.lit("langid")), F.lit(1 << 20)).alias("h")).where("text is not null and lang is not null")
    learned = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(min(most_rows // least_rows, most_langs or most_rows))
    each = F.least(F.lit(per_lang), F.lit(most_rows) / F.count("*").over(Window.partitionBy()))  # over the learned labels alone
    share = stored(learned.select("lang", (F.least(F.lit(1.0), each / F.col("n")) * (1 << 20)).cast("long").alias("below")))
    if not share.limit(1).count():
        return Identifier(Scorer("", {}), np.zeros(0), sure_from)
    # most_rows // least_rows labels at most
    drawn = rows.join(F.broadcast(share), "lang").where("h < below").select("text", "lang", (F.col("h") % 2).alias("half"), F.monotonically_increasing_id().alias("row"))
    sample = stored(drawn)

    def letters(batches):
        for b in batches:
            table = np.zeros(_LOW, np.int64)
            for t in b.column(0).to_pylist():
                p = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
                table += np.bincount(p[p < _LOW], minlength=_LOW)
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], names=["p", "n"])

    many = sample.select("text").mapInArrow(letters, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "p").collect()
    alphabet = "".join([c for r in many if (c := chr(r["p"])).isalpha()][: CLASSES - 2])

    def fitted(gone: np.ndarray) -> list[Scorer]:
        """Models of the half 1, of the half 0 and of both, without the rows `gone` (sorted)."""
        held = spark.sparkContext.broadcast(gone)  # some of the sample's row numbers

        def counted(batches):
            table = class_table(alphabet)
            for b in batches:
                keep = ~np.isin(b.column(3).to_numpy(), held.value)
                groups: dict = {}
                for t, l, h, k in zip(*(b.column(i).to_pylist() for i in range(3)), keep, strict=True):
                    if k:
                        groups.setdefault((l, h), []).append(t)
                for (l, h), own in sorted(groups.items()):
                    for x, y in runs_by_bytes([len(t) for t in own], 1 << 21):
                        code, n = np.unique(grams(own[x:y], table)[0], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([str(l)] * len(code)), pa.array([h] * len(code), pa.int64()), pa.array(code.astype(np.int64)), pa.array(n)], names=["lang", "half", "code", "n"])

        got = sample.mapInArrow(counted, "lang string, half long, code long, n long").groupBy("lang", "half", "code").agg(F.sum("n").alias("n")).toPandas()
        out = []
        for part in (got[got["half"] == 1], got[got["half"] == 0], got.groupby(["lang", "code"], as_index=False)["n"].sum()):
            out.append(Scorer(alphabet, {l: KneserNey(g["code"].to_numpy(), g["n"].to_numpy()) for l, g in sorted(part.groupby("lang")) if len(g)}))
        return out

    def scored(models: list[Scorer], gone: np.ndarray):
        """Of each row left with enough letters, under the other half's models: (row, label, entropy by language)."""
        both, held = spark.sparkContext.broadcast(models[:2]), spark.sparkContext.broadcast(gone)

        def measured(batches):
            for b in batches:
                texts, labels, halves, number = (b.column(i).to_pylist() for i in range(4))
                left = ~np.isin(np.array(number), held.value)
                for h, m in enumerate(both.value):
                    own = [i for i, x in enumerate(halves) if x == h and left[i] and labels[i] in m.langs]
                    ce, _, n = m.entropies([texts[i] for i in own]) if own else (np.zeros((0, 1)), None, np.zeros(0))
                    use = [k for k in range(len(own)) if n[k] >= sure_from]
                    at = np.array([m.langs.index(labels[own[k]]) for k in use], int)
                    mine = ce[use, at] if use else np.zeros(0)
                    rest = ce[use].copy() if use else np.zeros((0, 1))
                    rest[np.arange(len(use)), at] = np.inf
                    other = rest.argmin(1) if len(use) else np.zeros(0, int)
                    cols = [pa.array([number[own[k]] for k in use], pa.int64()), pa.array([labels[own[k]] for k in use], pa.string()), pa.array(mine, pa.float64()), pa.array([m.langs[k] for k in other], pa.string()), pa.array(rest[np.arange(len(use)), other], pa.float64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["row", "lang", "own", "next", "other"])

        return sample.mapInArrow(measured, "row long, lang string, own double, next string, other double").toPandas()  # a few numbers a row of the sample

    none = np.zeros(0, np.int64)
    first = scored(fitted(none), none)
    beyond = first["own"] - first.groupby("lang")["own"].transform("median")
    wrong = (first["other"] < first["own"] - clear) | (beyond > tail_bound(beyond.to_numpy(), false_rejection, body=0.75))
    gone = np.sort(first["row"][wrong].to_numpy())
    models = fitted(gone)
    clean = scored(models, gone)
    discard(sample, share)
    many = clean.groupby("lang")["own"].agg(["median", "size"])
    centre = many["median"][many["size"] >= least_rows].to_dict()
    if not centre:
        return Identifier(models[2], np.full(len(models[2].langs), np.inf), sure_from)
    known = clean[clean["lang"].isin(centre)]
    reach = tail_bound((known["own"] - known["lang"].map(centre)).to_numpy(), false_rejection)
    foreign = known[known["next"].isin(centre)]
    if len(foreign):
        reach += max(0.0, float(np.quantile(foreign["other"] - foreign["next"].map(centre), 0.01)) - reach) / 3
    return Identifier(models[2], np.array([centre.get(l, max(centre.values())) + reach for l in models[2].langs]), sure_from)


def identify(df: DataFrame, model: Identifier, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default all) with lang_pred, score, entropy and rejected, one map-only Arrow pass.

    A null text and a text without letters are `und` with score 0 and are rejected; repeated rows stay; an empty
    table gives no rows; columns of df named like a result are replaced. The model is a bounded closure.
    """
    small_batches(df.sparkSession)
    made = ("lang_pred", "score", "entropy", "rejected")
    keep = [c for c in (df.columns if keep is None else keep) if c not in made]
    kinds = (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, k) for n, k in zip(made, kinds, strict=True))])
    held = df.sparkSession.sparkContext.broadcast(model)  # bounded: see learn()

    def run(batches):
        m = held.value
        for b in batches:
            pred, score, low, rejected = m([t or "" for t in b.column(len(keep)).to_pylist()])
            out = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.float64(), from_pandas=True), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *out], names=[*keep, *made])

    return df.select(*[f"`{c}`" for c in keep], df[f"`{text}`"].cast("string").alias("__text")).mapInArrow(run, schema)
