"""The registered queries of this subpackage: thin `opN_<name>` functions over the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str = BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.tokencount import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id"])


#: Tools that the derived calls of op2 name.
TOOLS = {
    "lookup": {"text_md5": ("STRING", True), "limit": ("BIGINT", True), "lang": ("STRING", False)},
    "search": {"text_md5": ("STRING", True), "limit": ("BIGINT", True), "lang": ("STRING", True)},
    "summarise": {"text_md5": ("STRING", True), "limit": ("BIGINT", False)},
}


def tool_messages(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results derived from chat turns: an assistant's turn calls a tool named by a hash, waits in three
    of four cases for the call two turns before, and the user's next turn is its result in six of seven."""
    key = F.concat_ws(":", F.lit("tool"), "conv_id", "turn")
    m = conversations.withColumn("h", F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")).withColumn("d", F.md5(F.coalesce("text", F.lit(""))))
    call = lambda t: F.concat(F.lit("call-"), t)
    limit = F.when(F.col("h") % 5 == 0, F.concat(F.lit('"'), F.col("turn"), F.lit('"'))).otherwise(F.col("turn").cast("string"))
    lang = F.when(F.col("h") % 11 == 0, F.lit("")).otherwise(F.lit(',"lang":"en"'))
    args = F.when(F.col("h") % 13 == 0, F.lit('{"text_md5":')).otherwise(F.concat(F.lit('{"text_md5":"'), "d", F.lit('", "limit": '), limit, lang, F.lit("}")))
    calls = m.where("role = 'assistant'").select(
        "conv_id", call(F.col("turn")).alias("call_id"), F.element_at(F.array(*[F.lit(t) for t in sorted(TOOLS)]), (1 + F.col("h") % 3).cast("int")).alias("name"),
        args.alias("arguments"), F.when((F.col("h") % 4 != 0) & (F.col("turn") >= 2), F.array(call(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("after"), "turn",
    )
    results = m.where("role = 'user' and turn > 0 and h % 7 <> 0").select("conv_id", call(F.col("turn") - 1).alias("call_id"), "turn", F.col("d").alias("content"))
    return calls, results


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.toolcalls import link_tool_calls

    return link_tool_calls(*tool_messages(table(spark, sf_dir, "conversations")), TOOLS)


_OP2 = """WITH RECURSIVE m AS (SELECT *, ('0x' || substr(md5('tool:' || conv_id || ':' || turn), 1, 8))::BIGINT AS h, md5(coalesce(text, '')) AS d FROM conversations),
c AS (SELECT conv_id, turn, 'call-' || turn AS call_id, ['lookup','search','summarise'][1 + h % 3] AS name, h, d,
  h % 4 <> 0 AND turn >= 2 AS waits FROM m WHERE role = 'assistant'),
k AS (SELECT c.*, p.turn AS dep FROM c LEFT JOIN c p ON c.waits AND p.conv_id = c.conv_id AND p.turn = c.turn - 2),
l AS (SELECT conv_id, turn, 0 AS level FROM k WHERE dep IS NULL UNION ALL SELECT k.conv_id, k.turn, l.level + 1 FROM k JOIN l ON k.conv_id = l.conv_id AND k.dep = l.turn),
r AS (SELECT conv_id, 'call-' || (turn - 1) AS call_id, d AS content FROM m WHERE role = 'user' AND turn > 0 AND h % 7 <> 0),
j AS (SELECT coalesce(k.conv_id, r.conv_id) AS conv_id, coalesce(k.call_id, r.call_id) AS call_id, k.name, k.turn, l.level, k.h, k.d, k.waits, k.dep, r.content, k.call_id IS NOT NULL AS is_call
  FROM k JOIN l USING (conv_id, turn) FULL JOIN r ON k.conv_id = r.conv_id AND k.call_id = r.call_id),
e AS (SELECT *, list_filter([
  CASE WHEN is_call AND h % 13 = 0 THEN 'invalid_json' END,
  CASE WHEN is_call AND h % 13 <> 0 AND name = 'search' AND h % 11 = 0 THEN 'missing:lang' END,
  CASE WHEN is_call AND h % 13 <> 0 AND h % 5 = 0 THEN 'type:limit' END,
  CASE WHEN is_call AND content IS NULL THEN 'missing_result' END,
  CASE WHEN waits AND dep IS NULL THEN 'unknown_dependency' END,
  CASE WHEN NOT is_call THEN 'orphan_result' END], lambda x: x IS NOT NULL) AS e FROM j),
q AS (SELECT *, CASE WHEN NOT is_call OR h % 13 = 0 THEN 'null' ELSE '{' || CASE WHEN h % 11 = 0 THEN '' ELSE '"lang":"en",' END || '"limit":'
  || CASE WHEN h % 5 = 0 THEN '"' || turn || '"' ELSE turn::VARCHAR END || ',"text_md5":"' || d || '"}' END AS args FROM e)
SELECT conv_id, call_id, name, turn, level, content IS NOT NULL AS has_result, len(e) = 0 AS valid, array_to_string(e, ',') AS errors,
  '{"arguments":' || args || ',"conv":' || coalesce(conv_id::VARCHAR, 'null') || ',"id":"' || call_id || '","name":' || coalesce('"' || name || '"', 'null')
  || ',"result":' || coalesce('"' || content || '"', 'null') || '}' AS canonical FROM q"""


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.jaccard import link_groups

    return link_groups(table(spark, sf_dir, "documents"))


#: op4 samples this share of all tokens.
MIX_SIZE = 0.5


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.mixing import mix_sources

    got = mix_sources(table(spark, sf_dir, "documents"), size=MIX_SIZE)
    return got.select("doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), "n_tokens", F.round("weight", 6).alias("weight"), F.round("rate", 6).alias("rate"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents")).drop("live")


def held_out(doc_id):
    """Documents kept from learning."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.langid import identify, learn

    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    got = identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.pqdedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.suffix import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.maxscore import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.interactions import cells, order_steps, text_rules

    marks = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    found = cells(table(spark, sf_dir, "documents"), text_rules(F.col("text")), repeats="E", labels=table(spark, sf_dir, "labels"), marks=marks)
    return order_steps(found, "ABCDE", tuple(marks))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.alignment import align

    return align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_tool_calls, op3_ngram_jaccard, op4_mixing, op5_token_counts, op6_secret_scan, op7_language_id, op8_embedding_dedup, op9_repeat_removal, op10_topk, op11_filter_audit, op12_token_alignment, op13_sharding)}
ORACLES: dict[str, str] = {}


def _oracles() -> None:
    from foliospark.llm import interactions, mixing

    ORACLES["op2_tool_calls"] = _OP2
    ORACLES["op4_mixing"] = mixing.oracle(MIX_SIZE)
    ORACLES["op11_filter_audit"] = interactions.ORACLE
    ORACLES["op10_topk"] = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


_oracles()
