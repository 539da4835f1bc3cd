"""Secret scan with corpus-wide ownership frequency; DataFrame functions only.

Base kinds are found by regular expressions; every candidate value is hashed and counted over the whole corpus by
distinct repositories (documents) and owners (sources). A value that several owners or many documents hold is a copied
example; a value of one owner and few documents that looks generated is reported as `live`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import stored

#: (kind, pattern, group that holds the value, least length of that value), in the order of reports. Fixed values.
KINDS = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # runs are maximal, so asking for the least length in the pattern drops the same runs
    ("hex", r"[0-9a-f]{24,}+", 0, 24),
)
LIVE = "live"
_SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string>>"
_HELD = "array<struct<start:bigint,end:bigint,kind:string,owners:bigint,docs:bigint>>"


def _spans(text: Column, whole: Column, value: Column, rank: int) -> Column:
    """Spans of one kind, from what lies between its matches: code points before each match add up to its start."""
    kind, pattern, _, least = KINDS[rank]
    parts = F.split(text, pattern, -1)
    long = F.lit(0).cast("bigint")

    def step(acc, i):
        start = acc["at"] + F.length(F.get(acc["parts"], i))
        end = start + F.length(F.get(whole, i))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), F.get(value, i).alias("value"))
        return F.struct(end.alias("at"), acc["parts"].alias("parts"), F.concat(acc["out"], F.array(span)).alias("out"))

    empty = F.array().cast(_SPAN)
    start = F.struct(long.alias("at"), parts.alias("parts"), empty.alias("out"))
    all_ = F.aggregate(F.sequence(F.lit(0), F.size(whole) - 1), start, step, lambda a: a["out"])
    return F.when(F.size(whole) == 0, empty).otherwise(F.filter(all_, lambda s: F.length(s["value"]) >= least))


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `__spans`: the base spans of every whole text (null: empty), by start and then kind as listed."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    for rank, (_, pattern, group, _) in enumerate(KINDS):
        df = df.withColumn(f"__w{rank}", F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
        df = df.withColumn(f"__v{rank}", F.regexp_extract_all(t, F.lit(pattern), F.lit(group)) if group else F.col(f"__w{rank}"))
    found = [_spans(t, F.col(f"__w{r}"), F.col(f"__v{r}"), r) for r in range(len(KINDS))]
    df = df.withColumn("__spans", F.array_sort(F.concat(*found)))
    return df.drop(*[f"__{k}{r}" for r in range(len(KINDS)) for k in "wv"])


def _count(kind: str) -> Column:
    return F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("bigint")


def scan(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", owner: str = "source", keep: list[str] | None = None,
         most_owners: int = 1, most_docs: int = 16, least_length: int = 16, least_distinct: int = 8) -> DataFrame:
    """The columns `keep` with n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, live (spans) and held.

    held has every base span with the numbers of owners and of distinct documents that hold its value. A value is live when at most `most_owners`
    owners and `most_docs` distinct documents hold it and it has `least_length` characters,
    `least_distinct` of them different, and both letters and digits; other values are examples. Texts are read
    once; the corpus counts run over the few candidates, first by (value, owner, document), so a value that a
    third of all rows hold arrives combined. Null text: no spans. A null owner counts as one owner, a null id as
    one document; repeated rows each give a row and count once; an empty table gives no rows; kept columns named like
    a result are replaced by it.
    """
    made = {*(f"n_{k}" for k, *_ in KINDS), "base_sha256", "spans", "n_live", "n_example", "live", "held"}
    keep = [c for c in ([id_col] if keep is None else keep) if c not in made]
    # own names, so that no column of the input can clash
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__keep"), F.col(f"`{id_col}`").cast("string").alias("__doc"), F.col(f"`{owner}`").cast("string").alias("__owner"), F.col(f"`{text}`").alias("__text"))
    base = stored(base_spans(rows, "__text").drop("__text").withColumn("__row", F.monotonically_increasing_id()))
    each = base.where(F.size("__spans") > 0).select("__row", "__doc", "__owner", F.explode("__spans").alias("s"))
    each = each.select("__row", "__doc", "__owner", F.sha2(F.col("s.value"), 256).alias("__h"), "s")
    seen = each.select("__h", F.coalesce("__owner", F.lit("")).alias("__owner"), F.coalesce("__doc", F.lit("")).alias("__doc")).distinct()
    owners = seen.groupBy("__h", "__owner").agg(F.count("*").alias("docs"))
    held = stored(owners.groupBy("__h").agg(F.count("*").alias("owners"), F.sum("docs").alias("docs")))
    v = F.col("s.value")
    looks = (F.length(v) >= least_length) & (F.size(F.array_distinct(F.split(v, ""))) >= least_distinct) & v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    live = F.struct((F.col("s.end") - F.length(v)).alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit(LIVE).alias("kind"), F.col("s.end").alias("end"), v.alias("value"))
    is_live = (F.col("owners") <= most_owners) & (F.col("docs") <= most_docs) & looks
    judged = each.join(held, "__h").groupBy("__row").agg(
        F.array_sort(F.collect_set(F.when(is_live, live))).alias("__live"), F.count(F.when(~is_live, 1)).alias("n_example"),
        F.array_sort(F.collect_list(F.struct("s.start", "s.end", "s.kind", "owners", "docs"))).alias("__held"),
    )
    none = F.array().cast(_SPAN)
    out = base.join(judged, "__row", "left").withColumn("__live", F.coalesce("__live", none))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return out.select(
        "__keep.*",
        *[_count(k).alias(f"n_{k}") for k, *_ in KINDS],
        F.sha2(written(F.col("__spans")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("__spans", "__live"))).alias("spans"),
        F.size("__live").cast("bigint").alias("n_live"),
        F.coalesce("n_example", F.lit(0)).cast("bigint").alias("n_example"),
        F.col("__live").alias("live"),
        F.coalesce("__held", F.array().cast(_HELD)).alias("held"),
    )


def redact(text: Column, live: Column, mask: str = "[secret]") -> Column:
    """text with every live span replaced; overlapping spans become one mask."""

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    end = lambda a: F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, F.length(text)))
    return F.when(F.size(live) > 0, F.aggregate(live, start, step, end)).otherwise(text)
