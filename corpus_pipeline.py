"""Corpus pipeline over `documents`: language, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
What a stage decides takes effect on what the next one reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import stored
from foliospark.llm.jaccard import link_groups
from foliospark.llm.langid import identify, learn
from foliospark.llm.mixing import mix_sources
from foliospark.llm.packing import pack
from foliospark.llm.queries import tokenizer_path
from foliospark.llm.secrets import redact, scan

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what no language model fits; `lang` becomes the predicted language.

    Null and empty texts and texts without a letter go; so do texts of 40 letters or more whose entropy hardly any text
    of their best language reaches. Null labels teach nothing, without any label all goes; ties go to the language first
    in the alphabet, repeated rows fare alike, an empty table stays empty; other columns are dropped."""
    found = identify(docs.select(*COLUMNS), learn(docs))
    return found.where("not rejected").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; of that id all rows do, so repeated rows stay.

    Null and empty texts link with nothing and stay, as do rows without an id; an empty table stays empty."""
    groups = link_groups(docs)
    gone = stored(groups.where("component_id <> doc_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are masked; examples stay as they are. No row goes; n_chars of masked texts is counted anew.

    Null and empty texts stay; a null source is one owner, a null id one document; repeated rows are masked alike."""
    found = scan(docs, keep=COLUMNS)
    masked = found.withColumn("text", redact(F.col("text"), F.col("live")))
    return masked.withColumn("n_chars", F.when(F.size("live") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of as many tokens as came in, whose shares by source, language and topic meet their targets; rare cells repeat.

    Null sources and languages are values of their own. Null and empty texts hold no tokens and fare as their cell does; in
    a cell without any token they go. Draws are by id: repeated rows fare alike; an empty table stays empty."""
    return mix_sources(docs, size=1.0).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, dealt to training sequences. Null and empty texts are one end token, repeated rows packed each."""
    return pack(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
