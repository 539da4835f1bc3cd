"""Operators that are one relational statement: named templates over DataFrames.

`apply(name, spark, **frames)` runs a template over any frames with the columns it reads; Catalyst plans it like any
query. Theta joins meet in an equi-join on page and grid bucket first, so none becomes a nested loop. `duckdb(name)`
gives the same statement for DuckDB, which tests and the registry compare against.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from foliospark.operators import pages

OPERATORS: dict[str, tuple[tuple[str, ...], str]] = {}
#: Operators that Spark runs page by page; their statement is DuckDB's alone.
BY_PAGE = {"a07_coverage": pages.coverage, "w07_merge_chain": pages.merge_chain}


def operator(name: str, reads: str, sql: str) -> None:
    OPERATORS[name] = (tuple(reads.split()), sql)


def _macro(sql: str, name: str, put) -> str:
    """Replaces name(...) with put(inside), brackets balanced, from left to right."""
    while (m := re.search(rf"\b{name}\(", sql)):
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = sql[: m.start()] + put(sql[m.end() : end - 1]) + sql[end:]
    return sql


def _unroll(word: str):
    return lambda inside: f"{word}({inside.rpartition(' AS ')[0]}) AS {inside.rpartition(' AS ')[2]}"


def apply(name: str, spark: SparkSession, **frames: DataFrame) -> DataFrame:
    reads, sql = OPERATORS[name]
    if name in BY_PAGE:
        return BY_PAGE[name](**{n: frames[n] for n in reads})
    sql = re.sub(r"STRAGG\((.+?) BY (.+?) SEP '(.*?)'\)", r"listagg(\1, '\3') WITHIN GROUP (ORDER BY \2)", sql)
    sql = _macro(sql, "SHA", lambda x: f"sha2({x}, 256)")
    sql = re.sub(r"\bRE'", "r'", sql).replace(", 'g')", ")")  # Spark replaces all anyway
    sql = _macro(sql, "UNROLL", _unroll("explode"))
    sql = _macro(sql, "DOUBLED", lambda x: f"cast({x} AS double)")
    sql = sql.replace("{", "{{").replace("}", "}}")  # frames are named in braces
    for n in reads:
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **{n: frames[n] for n in reads})


_TO_DUCK = [(r"\bcollect_list\(", "list("), (r"\barray_sort\(", "list_sort("), (r"\barray_distinct\(", "list_distinct("), (r"\bsize\(", "len("), (r"\barray_join\(", "array_to_string("), (r"\bdiv\b", "//"),
            (r"\bAS string\)", "AS varchar)"), (r"\bbround\(", "round_even("), (r"\bdatediff\((\w+(?:\.\w+)?), (\w+(?:\.\w+)?)\)", r"date_diff('day', \2, \1)"), (r"\bfilter\((.+?), (\w) -> ", r"list_filter(\1, lambda \2: "),
            (r"\btransform\((.+?), (\w) -> ", r"list_transform(\1, lambda \2: "), (r"\barray\(", "list_value("), (r"\barray_contains\(", "list_contains("), (r"\bmap_", "map_"), (r"\bsequence\((.+?), (.+?)\)", r"generate_series(\1, \2)"),
            (r"\bLEFT (ANTI|SEMI) JOIN", r"\1 JOIN"), (r"STRAGG\((.+?) BY (.+?) SEP '(.*?)'\)", r"string_agg(\1, '\3' ORDER BY \2)"), (r"\bRE'", "'"), (r"\bregexp_like\(", "regexp_matches("), (r"\bsplit\(", "string_split("), (r"\bpmod\(", "mod(")]


def duckdb(name: str) -> str:
    sql = _macro(OPERATORS[name][1], "UNROLL", _unroll("unnest"))
    sql = _macro(sql, "DOUBLED", lambda x: f"cast({x} AS double)")
    sql = _macro(sql, "SHA", lambda x: f"sha256({x})")
    sql = _macro(sql, "count_if", lambda x: f"cast(COUNT_IF_({x}) AS bigint)").replace("COUNT_IF_(", "count_if(")  # else hugeint
    for a, b in _TO_DUCK:
        sql = re.sub(a, b, sql)
    return sql


IOU = """greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))
 / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"""
#: The share of a's area inside b.
INSIDE = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / nullif((a.x2 - a.x1) * (a.y2 - a.y1), 0)"
#: Both boxes in the grid rows of 64 units that they touch: the first row both touch is the only one where a pair counts.
_GRID = """ga AS (SELECT *, UNROLL(sequence(cast(floor(y1 / 64) AS int), cast(floor(y2 / 64) AS int)) AS g) FROM {a}), gb AS (SELECT *, UNROLL(sequence(cast(floor(y1 / 64) AS int), cast(floor(y2 / 64) AS int)) AS g) FROM {b}),
j AS (SELECT {cols} FROM ga a JOIN gb b ON a.source_id = b.source_id AND a.page_number = b.page_number AND a.g = b.g WHERE a.g = greatest(cast(floor(a.y1 / 64) AS int), cast(floor(b.y1 / 64) AS int)))"""


def grid(a: str, b: str, cols: str) -> str:
    return _GRID.replace("{a}", a).replace("{b}", b).replace("{cols}", cols)


# geometry: boxes on pages

operator("j01_iou_join", "spans ocr_spans", f"WITH {grid('spans', 'ocr_spans', f'a.source_id, a.page_number, a.line_no AS native, b.line_no AS ocr, {IOU} AS iou')} SELECT source_id, page_number, native, ocr, round(iou, 4) AS iou FROM j WHERE iou >= 0.3")
operator("j02_containment_join", "spans regions", f"WITH {grid('spans', 'regions', f'a.source_id, a.page_number, a.line_no, b.region_id, {INSIDE} AS share')} SELECT source_id, page_number, line_no, region_id, round(share, 4) AS share FROM j WHERE share >= 0.5")
operator("j03_consensus_mutual_best", "spans ocr_spans", f"""WITH {grid('spans', 'ocr_spans', f'a.source_id, a.page_number, a.line_no AS native, b.line_no AS ocr, a.text AS t1, b.text AS t2, {IOU} AS iou')},
r AS (SELECT *, row_number() OVER (PARTITION BY source_id, page_number, native ORDER BY iou DESC, ocr) AS r1, row_number() OVER (PARTITION BY source_id, page_number, ocr ORDER BY iou DESC, native) AS r2 FROM j WHERE iou >= 0.3)
SELECT source_id, page_number, native, ocr, t1 = t2 AS unanimous FROM r WHERE r1 = 1 AND r2 = 1""")
operator("j04_orphan_text", "spans regions", f"WITH {grid('spans', 'regions', f'a.source_id, a.page_number, a.line_no, {INSIDE} AS share, b.type')}, c AS (SELECT DISTINCT source_id, page_number, line_no FROM j WHERE share >= 0.5 AND type <> 'footer') SELECT s.source_id, s.page_number, s.line_no, 'text lies in no region' AS warning FROM spans s LEFT ANTI JOIN c ON s.source_id = c.source_id AND s.page_number = c.page_number AND s.line_no = c.line_no")
operator("j05_missing_outputs", "pipeline_steps", "WITH need AS (SELECT 'route' AS step UNION ALL SELECT 'layout' UNION ALL SELECT 'assembly' UNION ALL SELECT 'confidence'), ids AS (SELECT DISTINCT source_id FROM pipeline_steps), ok AS (SELECT source_id, step FROM pipeline_steps WHERE ok) SELECT x.source_id, STRAGG(x.step BY x.step SEP ',') AS missing FROM (SELECT i.source_id, n.step FROM ids i CROSS JOIN need n) x LEFT ANTI JOIN ok ON x.source_id = ok.source_id AND x.step = ok.step GROUP BY x.source_id")
operator("j06_in_cell", "spans ocr_spans regions", f"WITH cell AS (SELECT o.* FROM ocr_spans o JOIN regions r ON o.source_id = r.source_id AND o.page_number = r.page_number AND o.line_no div 5 = r.region_id WHERE r.type = 'table'), {grid('spans', 'cell', f'a.source_id, a.page_number, a.line_no, {INSIDE} AS share, a.text AS t1, b.text AS t2')} SELECT DISTINCT source_id, page_number, line_no FROM j WHERE share >= 0.35 AND position(substr(lower(t1), 2) IN lower(t2)) > 0")
operator("j07_same_box", "spans ocr_spans", "WITH a AS (SELECT *, UNROLL(array(floor(x1) - 1, floor(x1), floor(x1) + 1) AS k) FROM spans), b AS (SELECT *, floor(x1) AS k FROM ocr_spans) SELECT a.source_id, a.line_no AS a_line, b.line_no AS b_line FROM a JOIN b ON a.source_id = b.source_id AND a.page_number = b.page_number AND a.k = b.k WHERE abs(a.x1 - b.x1) <= 1 AND abs(a.y1 - b.y1) <= 1 AND abs(a.x2 - b.x2) <= 1 AND abs(a.y2 - b.y2) <= 1")
operator("j09_nearest_caption", "regions", """WITH f AS (SELECT * FROM regions WHERE type = 'figure'), c AS (SELECT * FROM regions WHERE type = 'caption'),
p AS (SELECT f.source_id, f.page_number, f.region_id AS figure, c.region_id AS caption, greatest(0, greatest(c.y1 - f.y2, f.y1 - c.y2)) AS gap, least(f.x2, c.x2) - greatest(f.x1, c.x1) AS overlap, c.y2 - c.y1 AS h FROM f JOIN c ON f.source_id = c.source_id AND f.page_number = c.page_number)
SELECT source_id, page_number, figure, caption, gap FROM (SELECT *, row_number() OVER (PARTITION BY source_id, page_number, figure ORDER BY gap, overlap DESC, caption) AS r FROM p WHERE gap <= 1.5 * h AND overlap > 0) q WHERE r = 1""")
operator("j18_virtual_page_lookup", "blocks", "WITH v AS (SELECT source_id, page_number, cast(row_number() OVER (PARTITION BY source_id % 20 ORDER BY source_id, page_number) AS bigint) AS virtual_page FROM (SELECT DISTINCT source_id, page_number FROM blocks) d) SELECT b.block_id, v.virtual_page FROM blocks b LEFT JOIN v ON b.source_id = v.source_id AND b.page_number = v.page_number")
operator("a05_consensus_vote", "spans ocr_spans", """WITH t AS (SELECT source_id, page_number, line_no, text, 1.0 * confidence AS w, confidence FROM spans UNION ALL SELECT source_id, page_number, line_no, text, 0.7 * confidence, confidence FROM ocr_spans),
g AS (SELECT source_id, page_number, line_no, text, sum(w) AS w, count(*) AS n FROM t GROUP BY source_id, page_number, line_no, text), k AS (SELECT source_id, page_number, line_no, max_by(text, struct_pack_w) AS winner, count(*) AS groups, max(w) AS best, sum(w) AS total FROM (SELECT *, w * 10 + CASE WHEN n > 1 THEN 1 ELSE 0 END AS struct_pack_w FROM g) q GROUP BY source_id, page_number, line_no)
SELECT source_id, page_number, line_no, winner, CASE WHEN groups = 1 THEN 'unanimous' WHEN best > 0.5 * total THEN 'majority' ELSE 'split' END AS agreement FROM k""")
operator("a06_escalations", "blocks", "SELECT source_id, page_number, count_if(coalesce(agreement, 1) < 0.5) AS escalated, count_if(coalesce(engine, 0) < 0.6) AS needs_review FROM blocks GROUP BY source_id, page_number")
# area of text (spans) and of its part inside regions: strips between neighbouring left and right edges, in each the union of
# heights; tiles of 16 units in both directions that text touches and no region does
_AREA = """e{0} AS (SELECT DISTINCT source_id, page_number, x FROM (SELECT source_id, page_number, x1 AS x FROM {1} UNION ALL SELECT source_id, page_number, x2 FROM {1}) u),
s{0} AS (SELECT source_id, page_number, x AS lo, lead(x) OVER (PARTITION BY source_id, page_number ORDER BY x) AS hi FROM e{0}),
i{0} AS (SELECT s.source_id, s.page_number, s.lo, s.hi, b.y1, b.y2, max(b.y2) OVER (PARTITION BY s.source_id, s.page_number, s.lo ORDER BY b.y1, b.y2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM s{0} s JOIN {1} b ON s.source_id = b.source_id AND s.page_number = b.page_number AND b.x1 <= s.lo AND b.x2 >= s.hi),
a{0} AS (SELECT source_id, page_number, sum((hi - lo) * greatest(0e0, y2 - greatest(y1, coalesce(reach, y1)))) AS area FROM i{0} GROUP BY source_id, page_number)"""
_TILES = "SELECT source_id, page_number, tx, UNROLL(sequence(cast(floor(y1 / 16) AS int), cast(floor((y2 - 1e-9) / 16) AS int)) AS ty) FROM (SELECT source_id, page_number, y1, y2, UNROLL(sequence(cast(floor(x1 / 16) AS int), cast(floor((x2 - 1e-9) / 16) AS int)) AS tx) FROM {0}) v"
operator("a07_coverage", "spans regions", f"""WITH r AS (SELECT * FROM regions WHERE type <> 'footer' AND region_id % 6 <> 4), t AS (SELECT * FROM spans WHERE x2 > x1 AND y2 > y1),
p AS (SELECT t.source_id, t.page_number, greatest(t.x1, r.x1) AS x1, greatest(t.y1, r.y1) AS y1, least(t.x2, r.x2) AS x2, least(t.y2, r.y2) AS y2 FROM t JOIN r ON t.source_id = r.source_id AND t.page_number = r.page_number WHERE least(t.x2, r.x2) > greatest(t.x1, r.x1) AND least(t.y2, r.y2) > greatest(t.y1, r.y1)),
{_AREA.format(1, "t")}, {_AREA.format(2, "p")},
q AS (SELECT DISTINCT * FROM ({_TILES.format("t")}) w), c AS (SELECT DISTINCT * FROM ({_TILES.format("r")}) w),
n AS (SELECT q.source_id, q.page_number, count(*) AS tiles, count_if(c.tx IS NULL) AS uncovered, coalesce(STRAGG(CASE WHEN c.tx IS NULL THEN q.tx || ':' || q.ty END BY q.ty * 100000 + q.tx SEP ' '), '') AS where_uncovered
  FROM q LEFT JOIN c ON q.source_id = c.source_id AND q.page_number = c.page_number AND q.tx = c.tx AND q.ty = c.ty GROUP BY q.source_id, q.page_number)
SELECT n.source_id, n.page_number, round(a1.area, 4) AS text_area, round(coalesce(a2.area, 0e0), 4) AS covered_area, round(coalesce(a2.area, 0e0) / a1.area, 6) AS coverage, n.tiles, n.uncovered, n.where_uncovered
FROM n JOIN a1 ON n.source_id = a1.source_id AND n.page_number = a1.page_number LEFT JOIN a2 ON n.source_id = a2.source_id AND n.page_number = a2.page_number""")
operator("a08_document_status", "blocks", "WITH p AS (SELECT source_id, page_number, avg(CASE WHEN engine IS NULL THEN 0e0 ELSE 1e0 END) AS coverage, bool_or(block_type = 'equation' AND engine IS NULL) AS orphan FROM blocks GROUP BY source_id, page_number) SELECT source_id, CASE WHEN min(coverage) >= 0.9 AND NOT bool_or(orphan) THEN 'complete' ELSE 'partial' END AS status, round(avg(coverage), 8) AS coverage FROM p GROUP BY source_id")
operator("a12_words_to_lines", "spans", "SELECT source_id, page_number, line_no div 3 AS line, STRAGG(text BY line_no SEP ' ') AS text, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, round(avg(CASE WHEN confidence >= 0 THEN confidence END), 8) AS confidence FROM spans GROUP BY source_id, page_number, line_no div 3")
operator("a13_handwriting", "ocr_spans", "SELECT source_id, page_number, count(*) >= 3 AND avg(confidence) < 0.45 AS handwriting, round(avg(confidence), 8) AS mean FROM ocr_spans GROUP BY source_id, page_number")
# faint captions stand for form fields, which the derived regions do not have
operator("a14_layout_class", "regions", """WITH k AS (SELECT source_id, page_number, region_id, CASE WHEN type = 'caption' AND confidence < 0.3 THEN 'form_field' ELSE type END AS type, x1, y1, x2, y2 FROM regions), d AS (SELECT source_id, page_number, max(x2) + 72 AS pw, max(y2) + 80 AS ph FROM k GROUP BY source_id, page_number),
r AS (SELECT k.*, d.pw, d.ph, k.type = 'paragraph' AND k.x2 - k.x1 < 0.65 * d.pw AS body FROM k JOIN d ON k.source_id = d.source_id AND k.page_number = d.page_number),
c AS (SELECT source_id, page_number, count_if(gap IS NULL OR gap > 0.19 * pw) AS cols, count(*) AS n FROM (SELECT source_id, page_number, pw, (x1 + x2) / 2 - lag((x1 + x2) / 2) OVER (PARTITION BY source_id, page_number ORDER BY (x1 + x2) / 2, region_id) AS gap FROM r WHERE body) g GROUP BY source_id, page_number),
p AS (SELECT source_id, page_number, max(pw) AS pw, max(ph) AS ph, count(*) AS n, count_if(type = 'form_field') AS fields, sum(CASE WHEN type = 'table' THEN (x2 - x1) * (y2 - y1) ELSE 0 END) / (max(pw) * max(ph)) AS share, count_if(type IN ('paragraph', 'title') AND y2 < ph / 3) AS heads FROM r GROUP BY source_id, page_number)
SELECT p.source_id, p.page_number, CASE WHEN fields >= 4 THEN 'form' WHEN share >= 0.6 THEN 'spreadsheet_like' WHEN share >= 0.25 AND heads >= 2 THEN 'invoice_like' WHEN pw > ph * 1.3 AND p.n <= 6 THEN 'slide' WHEN coalesce(c.cols, 0) >= 2 AND c.n >= 4 THEN 'multi_column' ELSE 'single_column' END AS layout
FROM p LEFT JOIN c ON p.source_id = c.source_id AND p.page_number = c.page_number""")
operator("w02_reading_index", "blocks", "SELECT block_id, cast(row_number() OVER (PARTITION BY source_id ORDER BY page_number, y1, x1, line_no) - 1 AS bigint) AS reading_order_index FROM blocks")
operator("w13_paragraphs", "spans", """WITH g AS (SELECT *, CASE WHEN y1 - lag(y2) OVER (PARTITION BY source_id, page_number ORDER BY y1, line_no) > 1.5 * (y2 - y1) THEN 1 ELSE 0 END AS brk FROM spans), i AS (SELECT *, sum(brk) OVER (PARTITION BY source_id, page_number ORDER BY y1, line_no ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT source_id, page_number, cast(island AS bigint) AS paragraph, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n_lines FROM i GROUP BY source_id, page_number, island""")
operator("o01_line_order", "ocr_spans", "SELECT source_id, line_no, cast(row_number() OVER (PARTITION BY source_id, page_number ORDER BY bround(y1 / 5, 0), x1, line_no) AS bigint) AS native_pos, cast(row_number() OVER (PARTITION BY source_id, page_number ORDER BY bround(y1 / 10, 0), x1, line_no) AS bigint) AS ocr_pos FROM ocr_spans")
# a narrow region right of a wide one that it overlaps in height; every fifth region is moved to the margin of a page 800 wide
operator("o07_sidebars", "regions", """WITH r AS (SELECT source_id, page_number, region_id, type, CASE WHEN region_id % 5 = 4 THEN 700e0 ELSE x1 END AS x1, CASE WHEN region_id % 5 = 4 THEN 780e0 ELSE least(x2, 690e0) END AS x2, CASE WHEN region_id % 5 = 4 THEN y1 - 60 ELSE y1 END AS y1, y2 FROM regions WHERE type = 'paragraph' OR type = 'table')
SELECT a.source_id, a.page_number, a.region_id FROM r a LEFT SEMI JOIN r b ON a.source_id = b.source_id AND a.page_number = b.page_number AND a.x2 - a.x1 < 0.25 * 800 AND 0.25 * 800 < 0.5 * (b.x2 - b.x1) AND a.y1 < b.y2 AND a.y2 > b.y1 AND a.x1 >= b.x2 - 1""")

# scoring

operator("a01_block_confidence", "blocks", """SELECT block_id, round((coalesce(0.5 * engine, 0) + coalesce(0.2 * agreement, 0) + coalesce(0.15 * layout, 0) + 0.15 * CASE check_status WHEN 'fail' THEN 0.0 ELSE 1.0 END)
 / (CASE WHEN engine IS NULL THEN 0 ELSE 0.5 END + CASE WHEN agreement IS NULL THEN 0 ELSE 0.2 END + CASE WHEN layout IS NULL THEN 0 ELSE 0.15 END + 0.15), 8) AS confidence FROM blocks""")
operator("a02_document_confidence", "blocks", """WITH c AS (SELECT source_id, (coalesce(0.5 * engine, 0) + coalesce(0.2 * agreement, 0) + coalesce(0.15 * layout, 0) + 0.15 * CASE check_status WHEN 'fail' THEN 0.0 ELSE 1.0 END)
 / (CASE WHEN engine IS NULL THEN 0 ELSE 0.5 END + CASE WHEN agreement IS NULL THEN 0 ELSE 0.2 END + CASE WHEN layout IS NULL THEN 0 ELSE 0.15 END + 0.15) AS c, (x2 - x1) * (y2 - y1) AS area, check_status = 'fail' AS bad FROM blocks) SELECT source_id,
 round(CASE WHEN count_if(bad) > 0 THEN 0.7 * sum(c * area) / sum(area) + 0.3 * min(CASE WHEN bad THEN c END) ELSE sum(c * area) / sum(area) END, 6) AS confidence FROM c GROUP BY source_id""")
operator("a03_document_badge", "blocks", "SELECT source_id, count_if(check_status = 'pass') AS passed, count_if(check_status = 'fail') AS mismatched, CASE WHEN count_if(check_status = 'fail') > 0 THEN 'mismatch' ELSE 'verified' END AS badge FROM blocks GROUP BY source_id")
operator("a04_page_review", "blocks", "SELECT source_id, page_number, bool_or(check_status = 'fail' OR coalesce(engine, 1.0) < 0.6) AS needs_review FROM blocks GROUP BY source_id, page_number")
operator("a24_region_text", "spans regions ocr_spans", f"""WITH {grid('spans', 'regions', f'a.source_id, a.page_number, a.line_no, a.text, a.x1, a.y1, b.region_id, {INSIDE} AS share')}, m AS (SELECT j.*, o.confidence, o.text = j.text AS agrees FROM j LEFT JOIN ocr_spans o ON j.source_id = o.source_id AND j.page_number = o.page_number AND j.line_no = o.line_no WHERE share >= 0.5)
SELECT source_id, page_number, region_id, STRAGG(text BY bround(y1 / 5, 0), x1, line_no SEP ' ') AS text, round(avg(confidence), 8) AS confidence, count_if(coalesce(agrees, false)) AS agreeing, bool_or(coalesce(confidence, 0) < 0.6) AS review FROM m GROUP BY source_id, page_number, region_id""")
operator("j19_confidence_lookup", "spans ocr_spans regions", "SELECT s.source_id, s.line_no, o.confidence AS consensus, r.confidence AS layout FROM spans s LEFT JOIN ocr_spans o ON s.source_id = o.source_id AND s.page_number = o.page_number AND s.line_no = o.line_no LEFT JOIN regions r ON s.source_id = r.source_id AND s.page_number = r.page_number AND s.line_no div 5 = r.region_id")
operator("j20_inconsistent_labels", "cells", "WITH l AS (SELECT table_id % 50 AS grp, c.raw_text AS label, v.raw_text AS value FROM (SELECT * FROM cells WHERE col = 0 AND NOT is_header) c JOIN (SELECT table_id AS t2, row AS r2, raw_text FROM cells WHERE col = 1) v ON c.table_id = v.t2 AND c.row = v.r2), k AS (SELECT grp, label FROM l GROUP BY grp, label HAVING count(DISTINCT value) > 1) SELECT l.grp, l.label, l.value FROM l LEFT SEMI JOIN k ON l.grp = k.grp AND l.label = k.label")
operator("p12_region_split", "regions", "SELECT source_id, region_id, CASE WHEN confidence < 0.3 THEN 'warning' ELSE 'region' END AS kind FROM regions")
operator("p13_bands", "ocr_spans", "SELECT source_id, line_no, CASE WHEN confidence <= 0.6 THEN 'low' WHEN confidence <= 0.85 THEN 'medium' ELSE 'high' END AS band FROM ocr_spans")
operator("p14_type_split", "blocks", "SELECT source_id, count_if(block_type = 'table') AS tables, count_if(block_type = 'figure') AS figures, count_if(block_type = 'equation') AS equations, count_if(check_status = 'warn') AS warnings FROM blocks GROUP BY source_id")
operator("f27_header_row", "cells", "SELECT table_id, NOT bool_or(row = 0 AND regexp_like(raw_text, RE'^\\(?-?[0-9,]+(\\.[0-9]+)?\\)?%?$')) AND bool_or(row > 0 AND regexp_like(raw_text, RE'^\\(?-?[0-9,]+(\\.[0-9]+)?\\)?%?$')) AS has_header FROM cells GROUP BY table_id")

# tables

_N = "CASE WHEN regexp_like(raw_text, RE'^[0-9,]+$') THEN cast(replace(raw_text, ',', '') AS bigint) END"
operator("a09_total_check", "cells", f"""WITH n AS (SELECT *, {_N} AS n FROM cells), t AS (SELECT table_id, row FROM cells WHERE col = 0 AND row > 0 AND regexp_like(lower(raw_text), RE'\\b(sub)?total\\b')),
c AS (SELECT table_id, col, row, n, sum(CASE WHEN row > 0 THEN n END) OVER (PARTITION BY table_id, col ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM n WHERE col > 0)
SELECT c.table_id, c.col, CASE WHEN abs(above - n) <= 0.01 THEN 'pass' ELSE 'mismatch' END AS status, cast(above AS bigint) AS computed, n AS stated FROM c JOIN t ON c.table_id = t.table_id AND c.row = t.row WHERE n IS NOT NULL AND above IS NOT NULL""")
operator("a10_table_dims", "cells", """WITH d AS (SELECT table_id, max(row + row_span) AS n_rows, max(col + col_span) AS n_cols FROM (SELECT table_id, row, row_span, CASE WHEN table_id % 9 = 0 THEN col * 400 ELSE col END AS col, col_span FROM cells) c GROUP BY table_id), n AS (SELECT *, n_cols - 1 AS c0, (n_cols - 1) div 26 - 1 AS c1, ((n_cols - 1) div 26 - 1) div 26 - 1 AS c2 FROM d)
SELECT table_id, n_rows, n_cols, 'A1:' || CASE WHEN c0 >= 702 THEN chr(cast(65 + c2 % 26 AS int)) ELSE '' END || CASE WHEN c0 >= 26 THEN chr(cast(65 + c1 % 26 AS int)) ELSE '' END || chr(cast(65 + c0 % 26 AS int)) || n_rows AS used_range FROM n""")
operator("a11_table_confidence", "cells", "SELECT table_id, round(avg(DOUBLED(confidence)), 8) AS confidence FROM cells GROUP BY table_id")
operator("a21_cell_cap", "cells", "SELECT table_id, row, col, raw_text, total FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row, col) AS r, count(*) OVER (PARTITION BY table_id) AS total FROM cells) q WHERE r <= 6")
operator("w06_continuation", "fragments", """WITH p AS (SELECT table_id, page_number, max(col) + 1 AS n_cols, bool_or(is_header) AS header, STRAGG(CASE WHEN is_header THEN raw_text END BY col SEP '|') AS head FROM fragments GROUP BY table_id, page_number)
SELECT table_id, page_number, coalesce(lag(n_cols) OVER (PARTITION BY table_id ORDER BY page_number) = n_cols AND (NOT header OR lag(head) OVER (PARTITION BY table_id ORDER BY page_number) = head), false) AS continues FROM p""")
# rows that a fragment repeats from the start of the one before, three at most, fall away
operator("w07_merge_chain", "fragments", """WITH s AS (SELECT table_id, page_number, row, STRAGG(col || ':' || row_span || ':' || col_span || ':' || raw_text BY col SEP '|') AS sig FROM fragments GROUP BY table_id, page_number, row),
l AS (SELECT *, row < 3 AND sig = lag(sig) OVER (PARTITION BY table_id, row ORDER BY page_number) AND page_number - 1 = lag(page_number) OVER (PARTITION BY table_id, row ORDER BY page_number) AS same FROM s),
e AS (SELECT table_id, page_number, max(row) + 1 AS n_rows, max(CASE WHEN row = 0 AND same THEN 1 ELSE 0 END) AS e0, max(CASE WHEN row = 1 AND same THEN 1 ELSE 0 END) AS e1, max(CASE WHEN row = 2 AND same THEN 1 ELSE 0 END) AS e2 FROM l GROUP BY table_id, page_number),
n AS (SELECT table_id, page_number, n_rows, e0 + e0 * e1 + e0 * e1 * e2 AS dropped FROM e),
o AS (SELECT *, coalesce(sum(n_rows - dropped) OVER (PARTITION BY table_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - dropped AS row_offset, min(page_number) OVER (PARTITION BY table_id) AS first_page, max(page_number) OVER (PARTITION BY table_id) AS last_page FROM n)
SELECT f.table_id, f.page_number AS source_page, f.row AS source_row, cast(f.row + o.row_offset AS bigint) AS merged_row, f.col, f.raw_text, CASE WHEN o.last_page > o.first_page THEN 'Continued across pages ' || o.first_page || '–' || o.last_page END AS caption FROM fragments f JOIN o ON f.table_id = o.table_id AND f.page_number = o.page_number WHERE f.row >= o.dropped""")
