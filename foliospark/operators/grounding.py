"""Whether what an answer states stands in its evidence: numbers, dates, quotes and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.tables import written

NUMBER, DATE, QUOTE = r"(?:^|[^\w.])(\d[\d,]*(?:\.\d+)?)", r"\d{4}-\d{2}-\d{2}", '"([^"]+)"'
TOKEN = r"\w+|[^\w\s]"
#: Letters of evidence that a claim may hold in one row; more of them are looked up by joins.
IN_ROW = 1 << 16


def tokens(text: Column) -> Column:
    """Words and single signs in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def positions(evidence: DataFrame) -> DataFrame:
    """(claim, pos, word): the words of all evidence lines of a claim, numbered through in the order of line_no.

    Only the lines' numbers of words run through a window, not the words."""
    lines = evidence.select("claim", "line_no", tokens(F.coalesce("text", F.lit(""))).alias("w")).withColumn("n", F.size("w"))
    before = F.sum("n").over(Window.partitionBy("claim").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    return lines.withColumn("before", before).select("claim", "before", F.posexplode("w").alias("at", "word")).select("claim", (F.col("before") + F.col("at")).alias("pos"), "word")


def quotes_found(quotes: DataFrame, evidence: DataFrame) -> DataFrame:
    """The (claim, v) of quotes whose words stand one behind the other in the claim's evidence, over the ends of lines, too.

    The index of positions is asked for the quote's rarest word alone; the places this gives are then held against the other
    words, each at its own position. A quote without any word is found nowhere."""
    index = written(positions(evidence))
    words = quotes.select("claim", "v").distinct().withColumn("w", tokens(F.col("v"))).select("claim", "v", F.size("w").alias("n"), F.posexplode("w").alias("i", "word"))
    often = index.groupBy("claim", "word").agg(F.count("*").alias("often"))
    known = words.join(often, ["claim", "word"]).groupBy("claim", "v", "n").agg(F.count("*").alias("hits"), F.min_by(F.struct("i", "word"), F.struct("often", "i")).alias("rare"))
    starts = known.where("hits = n").select("claim", "v", "n", F.col("rare.i").alias("i"), F.col("rare.word").alias("word")).join(index, ["claim", "word"]).select("claim", "v", "n", (F.col("pos") - F.col("i")).alias("start"))
    held = starts.join(words.drop("n"), ["claim", "v"]).withColumn("pos", F.col("start") + F.col("i")).join(index, ["claim", "pos", "word"])
    return held.groupBy("claim", "v", "start", "n").agg(F.count("*").alias("held")).where("held = n").select("claim", "v").distinct()


def _kinds(kind: str, values: Column) -> Column:
    return F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("v")))


def _figures(text: Column) -> Column:
    """Numbers, without the commas that group their digits, and dates of a text."""
    number = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")))
    return F.concat(_kinds("number", number), _kinds("date", F.regexp_extract_all(text, F.lit(DATE), F.lit(0))))


def _held_in_row(said: DataFrame, evidence: DataFrame) -> DataFrame:
    """(block_id, j): what is said and whether it is ok, where all evidence of a claim is one row: its words in one string."""
    lines = evidence.groupBy("claim").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    whole = lines.select("claim", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))
    held = whole.select("claim", F.concat(F.lit(" "), F.array_join(tokens(F.col("text")), " "), F.lit(" ")).alias("words"), F.array_distinct(_figures(F.col("text"))).alias("known"))
    quote = lambda v: (F.size(tokens(v)) > 0) & F.contains("words", F.concat(F.lit(" "), F.array_join(tokens(v), " "), F.lit(" ")))
    ok = lambda x: F.coalesce(F.when(x["kind"] == "quote", quote(x["v"])).otherwise(F.array_contains("known", x)), F.lit(False))
    rows = F.transform("said", lambda x: F.struct("claim", x["kind"].alias("kind"), x["v"].alias("v"), ok(x).alias("ok")))
    return said.join(held, "claim", "left").select("block_id", rows.alias("j"))


def _held_by_index(said: DataFrame, evidence: DataFrame) -> DataFrame:
    """The same by joins alone, whatever the evidence of a claim comes to."""
    t = written(said.select("block_id", "claim", F.explode("said").alias("t")).select("block_id", "claim", "t.*").distinct())
    known = evidence.select("claim", F.explode(_figures(F.col("text"))).alias("t")).select("claim", "t.*")
    known = known.unionByName(quotes_found(t.where("kind = 'quote'"), evidence).withColumn("kind", F.lit("quote"))).distinct().withColumn("ok", F.lit(True))
    j = t.join(known, ["claim", "kind", "v"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    return j.groupBy("block_id").agg(F.collect_list(F.struct("claim", "kind", "v", "ok")).alias("j"))


def ground(claims: DataFrame, evidence: DataFrame, most: int = IN_ROW) -> DataFrame:
    """block_id, issues, score, grounded of claim texts (block_id, claim, text) against all evidence lines (claim, line_no, text).

    Dates and numbers must be among the evidence's dates and numbers, however numbers are grouped; quotes must stand there word
    by word. The score is the share that does; a text that states none of these gives no row. Claims whose evidence has
    `most` letters or fewer hold it as a row; those with more are looked up in an index of positions."""
    said = claims.select("block_id", "claim", F.concat(_figures(F.col("text")), _kinds("quote", F.regexp_extract_all("text", F.lit(QUOTE), F.lit(1)))).alias("said")).where(F.size("said") > 0)
    large = written(evidence.groupBy("claim").agg(F.sum(F.length("text")).alias("n")).where((F.col("n") > most) & F.col("claim").isNotNull()).select("claim"))
    if large.isEmpty():
        held = _held_in_row(said, evidence)
    else:
        part = lambda df, how: df.join(large, "claim", how)
        held = _held_in_row(part(said, "left_anti"), part(evidence, "left_anti")).unionByName(_held_by_index(part(said, "left_semi"), part(evidence, "left_semi")))
    j = held.groupBy("block_id").agg(F.array_distinct(F.flatten(F.collect_list("j"))).alias("j"))
    bad = F.transform(F.array_sort(F.transform(F.filter("j", lambda x: ~x["ok"]), lambda x: F.struct(x["kind"], x["v"]))), lambda x: F.concat(x["kind"], F.lit(":"), x["v"]))
    j = j.select("block_id", F.size("j").alias("n"), bad.alias("bad"))
    return j.select("block_id", F.when(F.size("bad") > 0, F.array_join("bad", ",")).alias("issues"), F.round((F.col("n") - F.size("bad")) / F.col("n"), 4).alias("score"), (F.size("bad") == 0).alias("grounded"))


def answers(fields: DataFrame, evidence: DataFrame, citable: DataFrame) -> DataFrame:
    """Per answer (claim): what is left of it under both policies. fields: block_id, claim, text, cites (array of block ids).

    kept: fields that are grounded or state nothing (`drop_field` leaves those); rejected: whether one is not, which rejects the
    answer under `reject_all`; citations: cited ids that `citable` (claim, id) holds; dropped: how many cited ids it does not."""
    judged = fields.join(ground(fields, evidence).select("block_id", "score", "grounded"), "block_id", "left")
    a = judged.groupBy("claim").agg(F.count_if(F.coalesce("grounded", F.lit(True))).alias("kept"), F.bool_or(~F.coalesce("grounded", F.lit(True))).alias("rejected"), F.expr("(sum(cast(round(coalesce(score, 1) * 10000) AS bigint)) div count(*)) / 10000e0").alias("score"))
    cited = fields.select("claim", F.explode("cites").alias("id")).distinct().join(citable.select("claim", "id").distinct().withColumn("valid", F.lit(True)), ["claim", "id"], "left")
    c = cited.groupBy("claim").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("valid"), F.col("id")))), ",").alias("citations"), F.count_if(F.col("valid").isNull()).alias("dropped"))
    return a.join(c, "claim", "left").select("claim", "kept", "rejected", "score", F.coalesce("citations", F.lit("")).alias("citations"), F.coalesce("dropped", F.lit(0)).alias("dropped"))
