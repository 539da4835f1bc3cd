"""Mixing sources to target weights by iterative proportional fitting; DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.common import discard, stored

#: Target share of each value of a dimension: its token share to this power, brought to a sum of one.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Rounds after which raking stops even if the targets are not met, and rounds between two looks at how far off they are.
ROUNDS, EVERY = 200, 8
#: So many cells go through a round in one task, without an exchange; more are dealt by the dimension that is scaled.
CELLS_A_TASK = 200_000
#: Hundredths of a token that a character, a byte beyond one of a character, and a space (which a token takes in) count.
#: Held against a byte-level BPE file the sum is 1.00 of its tokens, with a spread of 4 per cent by document and within 5
#: per cent for each language; a quarter of the bytes spreads by 7 per cent and is off by up to 18 between languages.
CHARACTER, EXTRA_BYTE, SPACE = 50, 98, -75
#: Words (or their beginnings) that speak for a topic.
TOPICS = {
    "legal": ("license", "copyright", "warrant", "rights", "reserved", "permission", "liab"),
    "technical": ("token", "password", "secret", "api_key", "http", "function", "return", "import"),
    "contact": ("email", "e-mail", "phone", "call ", "contact", "address"),
}
#: A topic needs one of its words in so many characters.
STRETCH = 4000


def tokens_of(text: Column) -> Column:
    """Estimated tokens from lengths alone, a quarter of the characters at least; null and empty texts have none."""
    t = F.coalesce(text, F.lit(""))
    n, extra, spaces = F.length(t), F.octet_length(t) - F.length(t), F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    return F.greatest(F.floor((CHARACTER * n + EXTRA_BYTE * extra + SPACE * spaces) / 100), F.floor((n + 3) / 4)).cast("bigint")


def topic_of(text: Column) -> Column:
    """The topic whose words occur most in the text, the first one listed among equals; `general` where they are too few."""
    t = F.lower(F.coalesce(text, F.lit("")))
    times = lambda w: F.floor((F.length(t) - F.length(F.replace(t, F.lit(w), F.lit("")))) / len(w))
    n = {k: reduce(Column.__add__, [times(w) for w in words]) for k, words in TOPICS.items()}
    best = F.greatest(*n.values())
    out = F.when((best == 0) | (best * STRETCH < F.length(t)), "general")
    for k, c in n.items():
        out = out.when(c == best, k)
    return out


def rake(cells: DataFrame, dims: list[str], temper: dict[str, float], targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, every: int = EVERY, tolerance: float = 1e-13) -> DataFrame:
    """cells (dims, tokens) with `share`, raked until each dimension's sums meet its targets.

    `targets` may give a table (dimension, target) of shares per dimension, bounded as the dimension's values
    are; else `temper` forms them from the tokens. A round scales the cells to one dimension after another; only
    the table of cells, never documents, is shuffled, and not even that while one task holds it. After every `every` rounds the sums are compared with the targets:
    raking ends when none is off by more than `tolerance`, or after `rounds` rounds, as cells that are missing can make
    targets that contradict each other.
    """
    total = cells.groupBy().agg(F.sum("tokens").cast("double").alias("__all"))
    w = cells.crossJoin(F.broadcast(total)).withColumn("share", F.col("tokens") / F.col("__all")).drop("__all")  # total: one row
    for d in dims:
        t = (targets or {}).get(d)
        if t is None:
            sums = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(float(temper[d]))).alias("__p"))
            t = sums.crossJoin(F.broadcast(sums.groupBy().agg(F.sum("__p").alias("__s")))).select(d, (F.col("__p") / F.col("__s")).alias("target"))
        w = w.join(t.select(F.col(d), F.col("target").alias(f"__t_{d}")), d)
    w = stored(w)
    near = (lambda t: t.coalesce(1)) if w.count() <= CELLS_A_TASK else lambda t: t
    for done in range(0, rounds, every):
        last, w = w, near(w)
        for _ in range(min(every, rounds - done)):
            for d in dims:
                now = F.sum("share").over(Window.partitionBy(d))
                w = w.withColumn("share", F.when(now > 0, F.col("share") * F.col(f"__t_{d}") / now).otherwise(0.0))
        w = stored(w)
        discard(last)
        off = [w.groupBy(d).agg(F.abs(F.sum("share") - F.first(f"__t_{d}")).alias("off")) for d in dims]
        worst = reduce(DataFrame.union, [o.select("off") for o in off]).agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            break
    return w.drop(*[f"__t_{d}" for d in dims])


def mix_sources(df: DataFrame, *, dims: dict[str, Column] | None = None, tokens: Column | None = None, id_col: str = "doc_id",
                text: str = "text", temper: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None,
                rate: float = 1.0, size: float | None = None, rounds: int = ROUNDS, seed: str = "mix") -> DataFrame:
    """The sampled rows of df with columns __<dimension>, n_tokens, weight and rate.

    weight is a cell's raked share over its token share; a document is kept with probability proportional to it,
    scaled so that the most wanted cell is kept at `rate`. So one rare cell can shrink all others; with `size`, the
    expected sample is that share of all tokens instead, and a document whose rate exceeds 1 is repeated: whole copies,
    and one more by the draw for the fraction. The draw is a hash of the id, so a rerun keeps the
    same rows. Tokens are the column `tokens`, or n_tokens where df has it (counted by `count_tokens`, say), else an estimate
    from lengths. Null dimension values form a value of their own; documents without text carry no tokens and keep
    their cell's rate (0 in a cell without tokens); repeated rows are drawn alike; an empty table gives no rows; columns of
    df named like an added one are replaced.
    """
    temper, t = temper or TEMPER, F.col(f"`{text}`")
    dims = dims or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(t)}
    names = [f"__{d}" for d in dims]
    if tokens is None:
        tokens = F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)) if "n_tokens" in df.columns else tokens_of(t)
    rows = df.drop("weight", "rate").withColumns({f"__{d}": F.coalesce(c.cast("string"), F.lit("")) for d, c in dims.items()} | {"n_tokens": tokens})
    cells = stored(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"))
    raked = rake(cells, names, {f"__{d}": p for d, p in temper.items()}, {f"__{d}": x for d, x in (targets or {}).items()}, rounds)
    all_ = cells.groupBy().agg(F.sum("tokens").cast("double").alias("__all"))
    w = raked.crossJoin(F.broadcast(all_)).withColumn("weight", F.col("share") / (F.col("tokens") / F.col("__all")))
    if size is None:
        most = w.groupBy().agg(F.max("weight").alias("__most"))
        w = w.crossJoin(F.broadcast(most)).select(*names, "weight", (F.col("weight") / F.col("__most") * F.lit(float(rate))).alias("rate"))
    else:
        w = w.select(*names, "weight", (F.col("weight") * F.lit(float(size))).alias("rate"))
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    drawn = rows.join(stored(w), names)
    if size is None:
        return drawn.where(draw < F.col("rate"))
    copies = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return drawn.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest(copies, F.lit(1))))).where(F.col("__copy") <= copies).drop("__copy")


def oracle(size: float, rounds: int = 24) -> str:
    """DuckDB SQL of the same sample of a share `size` of all tokens, its rounds unrolled: as many as bring the sums to the targets here."""
    dims = list(TEMPER)
    count = {k: " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in ws) for k, ws in TOPICS.items()}
    topic = f"CASE WHEN greatest({', '.join(f'n_{k}' for k in count)}) * {STRETCH} < n OR greatest({', '.join(f'n_{k}' for k in count)}) = 0 THEN 'general'"
    for k in count:
        topic += f" WHEN n_{k} = greatest({', '.join(f'n_{k}' for k in count)}) THEN '{k}'"
    tokens = f"greatest(({CHARACTER} * length(x) + {EXTRA_BYTE} * (strlen(x) - length(x)) + {SPACE} * (length(x) - length(replace(x, ' ', '')))) // 100, (length(x) + 3) // 4)"
    ctes = ["f AS (SELECT doc_id, coalesce(source,'') AS source, coalesce(lang,'') AS lang, coalesce(text,'') AS x, lower(coalesce(text,'')) AS t FROM documents)",
            f"g AS (SELECT doc_id, source, lang, length(t) AS n, {tokens} AS n_tokens, {', '.join(f'{c} AS n_{k}' for k, c in count.items())} FROM f)",
            f"docs AS MATERIALIZED (SELECT doc_id, source, lang, {topic} END AS topic, n_tokens FROM g)",
            "cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL HAVING sum(n_tokens) > 0)",
            "tot AS (SELECT sum(tokens) AS t FROM cells)"]
    for d in dims:
        ctes.append(f"p_{d} AS (SELECT {d}, pow(sum(tokens), {TEMPER[d]}) AS p FROM cells GROUP BY {d})")
        ctes.append(f"t_{d} AS MATERIALIZED (SELECT {d}, p / (SELECT sum(p) FROM p_{d}) AS target FROM p_{d})")
    ctes.append("r0 AS (SELECT source, lang, topic, tokens, tokens / (SELECT t FROM tot) AS share FROM cells)")
    for k in range(rounds * len(dims)):
        d = dims[k % len(dims)]
        ctes.append(f"r{k + 1} AS MATERIALIZED (SELECT r.source, r.lang, r.topic, r.tokens, r.share * t.target / sum(r.share) OVER (PARTITION BY r.{d}) AS share FROM r{k} r JOIN t_{d} t ON r.{d} = t.{d})")
    ctes.append(f"w AS MATERIALIZED (SELECT source, lang, topic, share / (tokens / (SELECT t FROM tot)) AS weight FROM r{rounds * len(dims)})")
    return "WITH " + ",\n".join(ctes) + f""",
d AS (SELECT doc_id, source, lang, topic, n_tokens, weight, weight * {size} AS rate, ('0x' || substr(md5('mix:' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS draw FROM docs JOIN w USING (source, lang, topic)),
c AS (SELECT *, unnest(range((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT)) AS copy FROM d)
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(rate, 6) AS rate FROM c"""
