"""Queries over the renderers."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.derive import view
from foliospark.registry import query
from foliospark.sources.export import RENDERERS, document_markdown, rendered, source_csv, source_json

# every cell of the grid, empty where the table has none
_GRID = """WITH d AS (SELECT table_id, max(row) AS last_row, max(col) AS last_col FROM cells GROUP BY table_id),
g AS (SELECT table_id, row, unnest(generate_series(0, last_col)) AS col FROM (SELECT *, unnest(generate_series(0, last_row)) AS row FROM d) q),
v AS (SELECT g.table_id, g.row, g.col, coalesce(c.raw_text, '') AS v FROM g LEFT JOIN cells c ON g.table_id = c.table_id AND g.row = c.row AND g.col = c.col)"""


@query("s16_export_table", _GRID + """, l AS (SELECT table_id, row, string_agg(CASE WHEN contains(v, ',') OR contains(v, '"') THEN '"' || replace(v, '"', '""') || '"' ELSE v END, ',' ORDER BY col) AS l FROM v GROUP BY table_id, row)
SELECT table_id, string_agg(l, chr(10) ORDER BY row) AS body FROM l GROUP BY table_id""", ("cells",))
def s16(spark, sf):
    return view(spark, sf, "cells").transform(RENDERERS["csv"])


@query("s16_export_markdown", _GRID + """, l AS (SELECT table_id, row, '| ' || string_agg(replace(v, '|', '\\|'), ' | ' ORDER BY col) || ' |' || CASE WHEN row = 0 THEN chr(10) || '|' || repeat('---|', count(*)) ELSE '' END AS l FROM v GROUP BY table_id, row)
SELECT table_id, string_agg(l, chr(10) ORDER BY row) AS body FROM l GROUP BY table_id""", ("cells",))
def s16m(spark, sf):
    return view(spark, sf, "cells").transform(RENDERERS["markdown"])


@query("s16_export_json", _GRID + """, l AS (SELECT table_id, row, '[' || string_agg('"' || v || '"', ',' ORDER BY col) || ']' AS l FROM v GROUP BY table_id, row)
SELECT table_id, '[' || string_agg(l, ',' ORDER BY row) || ']' AS body FROM l GROUP BY table_id""", ("cells",))
def s16j(spark, sf):
    return view(spark, sf, "cells").transform(RENDERERS["json"])


_LINES = {
    "html": ("'<tr>' || string_agg('<td>' || v || '</td>', '' ORDER BY col) || '</tr>'", "'<table>' || string_agg(l, '' ORDER BY row) || '</table>'"),
    "csv": ("string_agg(CASE WHEN contains(v, ',') OR contains(v, '\"') THEN '\"' || replace(v, '\"', '\"\"') || '\"' ELSE v END, ',' ORDER BY col)", "string_agg(l, chr(10) ORDER BY row)"),
    "markdown": ("'| ' || string_agg(replace(v, '|', '\\|'), ' | ' ORDER BY col) || ' |' || CASE WHEN row = 0 THEN chr(10) || '|' || repeat('---|', count(*)) ELSE '' END", "string_agg(l, chr(10) ORDER BY row)"),
    "json": ("'[' || string_agg('\"' || v || '\"', ',' ORDER BY col) || ']'", "'[' || string_agg(l, ',' ORDER BY row) || ']'"),
}


@query("u01_registry", _GRID + ", " + ", ".join(f"{f} AS (SELECT table_id, '{f}' AS format, sha256({whole}) AS digest FROM (SELECT table_id, row, {line} AS l FROM v GROUP BY table_id, row) GROUP BY table_id)" for f, (line, whole) in _LINES.items()) + " " + " UNION ALL ".join(f"SELECT * FROM {f}" for f in _LINES), ("cells",))
def u01(spark, sf):
    """Each registered renderer over the same tables, by the digest of what it makes."""
    return rendered(view(spark, sf, "cells"), RENDERERS, lambda body: F.sha2(body, 256)).withColumnRenamed("value", "digest")


@query("s16_export_source", """WITH p AS (SELECT source_id, page_number, list({'block_id': block_id, 'type': block_type, 'text': text} ORDER BY line_no) AS blocks FROM blocks GROUP BY ALL),
d AS (SELECT source_id, list({'page_number': page_number, 'blocks': blocks} ORDER BY page_number) AS pages FROM p GROUP BY source_id)
SELECT s.source_id, to_json({'source_id': s.source_id, 'title': s.display_name, 'pages': coalesce(d.pages, [])})::VARCHAR AS body FROM sources s LEFT JOIN d ON s.source_id = d.source_id""", ("blocks", "sources"))
def s16_source(spark, sf):
    return source_json(view(spark, sf, "blocks"), view(spark, sf, "sources").select("source_id", "display_name"))


@query("s16_export_source_csv", """WITH l AS (SELECT source_id, page_number, line_no, page_number || ',' || line_no || ',' || block_type || ',' || CASE WHEN regexp_matches(text, '[",\r\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS r FROM blocks)
SELECT source_id, 'page,line,type,text' || chr(10) || string_agg(r, chr(10) ORDER BY page_number, line_no) AS body FROM l GROUP BY source_id""", ("blocks",))
def s16_source_csv(spark, sf):
    return source_csv(view(spark, sf, "blocks"))


@query("s15_markdown", """WITH b AS (SELECT source_id, page_number, line_no, trim(text) AS t, block_type FROM blocks),
l AS (SELECT *, CASE block_type WHEN 'title' THEN '# ' || t WHEN 'heading' THEN '## ' || t WHEN 'equation' THEN '$$' || chr(10) || t || chr(10) || '$$' ELSE nullif(t, '') END AS b FROM b),
p AS (SELECT source_id, page_number, '<!-- page ' || page_number || ' -->' || coalesce(chr(10) || chr(10) || string_agg(b, chr(10) || chr(10) ORDER BY line_no), '') AS t FROM l GROUP BY source_id, page_number)
SELECT source_id, string_agg(t, chr(10) || chr(10) ORDER BY page_number) AS markdown FROM p GROUP BY source_id""", ("blocks",))
def s15(spark, sf):
    return document_markdown(view(spark, sf, "blocks"))
