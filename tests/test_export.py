"""Renderers on micro-tables: gaps, repeated cells, quotes, bars and nulls; merged fragments."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators.relational import apply
from foliospark.sources.export import RENDERERS, document_markdown
import foliospark.operators.governance_sql  # noqa: F401


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(1, 0, 0, "a"), (1, 0, 1, 'say "x"'), (1, 2, 1, "p|q"), (1, 2, 1, "p"), (1, 3, 0, None), (2, 1, 0, "<b>, c")]
    return spark.createDataFrame(rows, "table_id long, row long, col long, raw_text string")


@pytest.mark.parametrize(("name", "one", "two"), [
    ("csv", 'a,"say ""x"""\n,\n,p|q\n,', '\n"<b>, c"'),
    ("markdown", '| a | say "x" |\n|---|---|\n|  |  |\n|  | p\\|q |\n|  |  |', "|  |\n|---|\n| <b>, c |"),
    ("json", '[["a","say \\"x\\""],["",""],["","p|q"],["",""]]', '[[""],["<b>, c"]]'),
    ("html", "<table><tr><td>a</td><td>say &quot;x&quot;</td></tr><tr><td></td><td></td></tr><tr><td></td><td>p|q</td></tr><tr><td></td><td></td></tr></table>", "<table><tr><td></td></tr><tr><td>&lt;b&gt;, c</td></tr></table>"),
])
def test_renderers(cells, name, one, two):
    assert {r.table_id: r.body for r in RENDERERS[name](cells).collect()} == {1: one, 2: two}
    assert RENDERERS[name](cells.where("table_id > 9")).count() == 0


def test_all_renderers_share_one_grid(spark, cells):
    """Tables are read and laid out once for all renderers of a grid; a renderer of another kind is applied to the cells."""
    from foliospark.sources.export import rendered

    more = {**RENDERERS, "n": lambda df: df.groupBy("table_id").agg(F.count("*").cast("string").alias("body"))}
    got = rendered(cells, more, F.upper)
    want = {(r.table_id, name, r.body.upper()) for name, render in more.items() for r in render(cells).collect()}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) == 10 and set(rows) == want
    plan = rendered(cells, RENDERERS, F.upper)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1


def test_document_markdown(spark):
    rows = [(1, 1, 0, "title", " T "), (1, 1, 1, "equation", "x=1"), (1, 2, 2, "paragraph", None), (1, 2, 3, "paragraph", "end")]
    df = spark.createDataFrame(rows, "source_id long, page_number long, line_no long, block_type string, text string")
    assert document_markdown(df).first().markdown == "<!-- page 1 -->\n\n# T\n\n$$\nx=1\n$$\n\n<!-- page 2 -->\n\nend"


def test_merge_drops_repeated_leading_rows(spark):
    grid = {1: ["head", "unit", "1"], 2: ["head", "unit", "2", "3"], 3: ["unit", "4"]}
    rows = [(7, p, r, 0, 1, 1, False, v) for p, vs in grid.items() for r, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "table_id long, page_number long, row long, col long, row_span int, col_span int, is_header boolean, raw_text string")
    got = apply("w07_merge_chain", spark, fragments=df).orderBy("merged_row").collect()
    assert [r.raw_text for r in got] == ["head", "unit", "1", "2", "3", "unit", "4"]
    assert [r.merged_row for r in got] == list(range(7)) and got[0].caption == "Continued across pages 1–3"
