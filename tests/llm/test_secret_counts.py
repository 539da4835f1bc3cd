"""A credential is judged by how many owners and how many documents hold it."""

from foliospark.llm import secrets


def test_value_copied_widely_in_one_source_is_an_example(spark):
    """One value in 40 documents of one source, another in two rows of one document and one more."""
    wide, own = "abc123DEF456ghi789", "zyx987WVU654tsr321"
    rows = [(i, f"password = {wide} end", "s1") for i in range(40)] + [(i, f"token: {own}", "s2") for i in (100, 100, 101)] + [(200, "plain", "s1")]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {(r.n_live, r.n_example) for r in got if r.doc_id < 40} == {(0, 1)}
    assert {(r.n_live, r.n_example) for r in got if r.doc_id in (100, 101)} == {(1, 0)}
    assert {tuple((h.owners, h.docs) for h in r.held) for r in got if r.doc_id < 40} == {((1, 40),)}
    assert {tuple((h.owners, h.docs) for h in r.held) for r in got if r.doc_id in (100, 101)} == {((1, 2),)}
    assert [r.held for r in got if r.doc_id == 200] == [[]]
