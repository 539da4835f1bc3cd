"""A rare source takes its own share and does not shrink the others."""

from pyspark.sql import functions as F

from foliospark.llm import mixing, queries


def test_rare_source_does_not_shrink_the_sample(spark):
    import corpus_pipeline

    rows = [(i, f"{i:04d} " + "word " * 200, "en", "s1" if i % 3 else "s2", 1005) for i in range(2000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for extra in ([], [(5000, "rare " * 200, "en", "new", 1000)]):
        df = spark.createDataFrame(rows + extra, schema)
        got = corpus_pipeline.mixing(spark, df, "")
        assert 0.9 * len(rows) < got.count() < 1.1 * len(rows)
        by = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
        want = {s: sum(r[3] == s for r in rows + extra) ** 0.5 for s in by}
        assert all(abs(by[s] / got.count() - want[s] / sum(want.values())) < 0.03 for s in by) and len(by) == 2 + len(extra)
        # copies of a document: its rate, rounded down or up by the draw
        n = {(r.doc_id, r.rate): r["count"] for r in mixing.mix_sources(df, size=1.0).groupBy("doc_id", "rate").count().collect()}
        assert all(int(rate) <= c <= int(rate) + 1 for (_, rate), c in n.items())


def test_registered_query_keeps_its_size(spark, tmp_path):
    """One document of a new source moves the sample of the registered query by less than a per cent of the corpus."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rare = spark.createDataFrame([(900_001, "some words " * 50, "en", "new", 550)], "doc_id long, text string, lang string, source string, n_chars long")
    rare = rare.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])
    kept = []
    for k, d in enumerate((docs, docs.unionByName(rare))):
        d.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        kept.append(queries.op4_mixing(spark, f"{tmp_path}/{k}").collect())
        every = d.select(F.sum(mixing.tokens_of(F.col("text")))).first()[0]
        assert abs(sum(r.n_tokens for r in kept[k]) / (every * queries.MIX_SIZE) - 1) < 0.1
    assert abs(len(kept[0]) - len(kept[1])) <= 10


def test_counted_tokens_are_taken(spark):
    """A column n_tokens stands for the estimate; a null in it is no token."""
    df = spark.createDataFrame([(i, "w " * 50, "en", "a" if i % 2 else "b", 1000 if i % 2 else 10) for i in range(400)] + [(900, "w", "en", "a", None)], "doc_id long, text string, lang string, source string, n_tokens long")
    got = mixing.mix_sources(df, size=1.0, temper={"source": 1.0, "lang": 1.0, "topic": 1.0})
    assert {r.n_tokens for r in got.collect()} <= {0, 10, 1000} and all(abs(r.weight - 1) < 1e-9 for r in got.collect())
