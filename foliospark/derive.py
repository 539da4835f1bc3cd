"""Tables that Spark derives from the given ones, each beside its DuckDB twin.

The given tables hold no statements, cells, boxes or logs. These views lay them out of orders, documents and
events by plain arithmetic on keys, so every operator has an input that grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Text shared by both dialects; {idiv} and others differ. View -> (tables and views it reads, SQL).
_SQL = {
    # one line per order and side, plus a head per (side, customer, year): what two sources say about one thing
    "statements": (("orders", "customer"), """
WITH o AS (SELECT o.o_orderkey AS k, o.o_custkey AS c, {year} AS y, cast(floor(o.o_totalprice) AS bigint) AS amt, c.c_name AS who
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
s AS (SELECT *, 'A' AS side, amt AS v FROM o UNION ALL
  SELECT *, 'B' AS side, CASE k % 10 WHEN 4 THEN amt + amt * 3 {idiv} 1000 WHEN 5 THEN amt + amt * 3 {idiv} 100 WHEN 6 THEN amt + amt {idiv} 10 WHEN 7 THEN amt + amt * 4 {idiv} 10 ELSE amt END AS v FROM o),
h AS (SELECT DISTINCT side, c, y, who FROM s),
l AS (
  SELECT side, c, y, 0 AS line_no, 'Customer: ' || who AS text FROM h UNION ALL
  SELECT side, c, y, 1, 'Period: ' || y || '-01-01 to ' || y || '-12-31' FROM h UNION ALL
  SELECT side, c, y, 2 + k, CASE
    WHEN k % 20 = 8 THEN 'Order ' || k || ' salary: approx 10-12k'
    WHEN k % 20 = 9 THEN 'Order ' || k || ' net cost: $ ' || {commas} || ' per month'
    WHEN k % 20 = 10 THEN 'Order ' || k || ' total: ' || CASE WHEN side = 'A' THEN 'Rs. ' ELSE 'USD ' END || {commas}
    WHEN k % 20 = 18 THEN 'Order ' || k || ' gst rate: ' || (v % 30) || '%'
    WHEN k % 20 = 19 THEN 'Order ' || k || ' due: ' || (1 + v % 35) || '/' || (1 + v % 12) || '/' || y
    WHEN k % 20 = 3 THEN 'Order ' || k || ' gross revenue: (' || {commas} || '.50)'
    WHEN k % 20 = 4 THEN 'Order ' || k || ' closing balance: INR ' || (v % 90 + 1) || '.5 lakh'
    ELSE 'Order ' || k || ' total: Rs. ' || {commas} || '.50' END FROM s)
SELECT 'case-' || c AS case_id, side || '-' || c || '-' || y AS source_id, side || '-' || c || '-' || y || '-b' || line_no AS block_id,
  cast(line_no AS bigint) AS line_no, text, 0.9e0 - 0.1e0 * (line_no % 3) AS block_confidence FROM l"""),
    # one table per order: rows are line numbers, columns item, qty, price, disc; the Total row is wrong for 1 in 7
    "cells": (("lineitem",), """
WITH l AS (SELECT l_orderkey AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r, l_partkey AS p,
  cast(l_quantity AS bigint) AS q, cast(floor(l_extendedprice) AS bigint) AS e, cast(round(l_discount * 100) AS bigint) AS d FROM lineitem),
n AS (SELECT t, max(r) AS n, sum(q) AS q, sum(e) AS e FROM l GROUP BY t),
x AS (
  SELECT t, 0 AS r, 0 AS c, 'item' AS v FROM n UNION ALL SELECT t, 0, 1, 'qty' FROM n UNION ALL SELECT t, 0, 2, 'price' FROM n UNION ALL SELECT t, 0, 3, 'disc' FROM n UNION ALL
  SELECT t, r, 0, 'Part ' || p FROM l UNION ALL SELECT t, r, 1, cast(q AS {str}) FROM l UNION ALL SELECT t, r, 2, {commas_e} FROM l UNION ALL SELECT t, r, 3, d || '%' FROM l UNION ALL
  SELECT t, n + 1, 0, 'Total' FROM n UNION ALL SELECT t, n + 1, 1, cast(CASE WHEN t % 7 = 0 THEN q + 1 ELSE q END AS {str}) FROM n UNION ALL SELECT t, n + 1, 2, {commas_e} FROM n)
SELECT cast(t AS bigint) AS table_id, cast(1 + r {idiv} 3 AS bigint) AS page_number, cast(r AS bigint) AS row, cast(c AS bigint) AS col, 1 AS row_span, 1 AS col_span, r = 0 AS is_header, v AS raw_text,
  1e0 - ((t + r + c) % 5) / 20e0 AS confidence FROM x"""),
    # the same tables as they lie on pages: rows counted anew on each, every other table repeats its header row
    "fragments": (("cells",), """
SELECT table_id, page_number, row - 3 * (page_number - 1) + CASE WHEN page_number > 1 AND table_id % 2 = 0 THEN 1 ELSE 0 END AS row, col, row_span, col_span, is_header, raw_text FROM cells UNION ALL
SELECT h.table_id, p.page_number, cast(0 AS bigint), h.col, h.row_span, h.col_span, true, h.raw_text FROM cells h JOIN (SELECT DISTINCT table_id, page_number FROM cells) p ON h.table_id = p.table_id
WHERE h.row = 0 AND p.page_number > 1 AND h.table_id % 2 = 0"""),
    # document lines with boxes, 40 to a page
    "spans": (("documents",), """
SELECT doc_id AS source_id, cast(1 + n {idiv} 40 AS bigint) AS page_number, cast(n AS bigint) AS line_no, line AS text, 72e0 AS x1, 100e0 + 16 * (n % 40) AS y1,
  72e0 + 6 * length(line) AS x2, 112e0 + 16 * (n % 40) AS y2, 1e0 AS confidence FROM {lines} WHERE length(line) > 0"""),
    # a second reading of the same lines: boxes moved, one text in five altered, one line in ten missing
    "ocr_spans": (("spans",), """
SELECT source_id, page_number, line_no, CASE WHEN (source_id * 31 + line_no * 7) % 5 = 0 THEN 'x' || substr(text, 2) ELSE text END AS text,
  x1 + (source_id + line_no) % 3 AS x1, y1 + (source_id * 3 + line_no) % 4 AS y1, x2 + (source_id + line_no) % 3 AS x2, y2 + (source_id * 3 + line_no) % 4 AS y2,
  0.5e0 + ((source_id + line_no * 13) % 50) / 100e0 AS confidence FROM spans WHERE (source_id * 17 + line_no * 11) % 10 <> 0"""),
    "regions": (("spans",), """
WITH g AS (SELECT source_id, page_number, line_no {idiv} 5 AS k, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, min(line_no) AS first FROM spans GROUP BY 1, 2, 3)
SELECT source_id, page_number, cast(k AS bigint) AS region_id, CASE k % 8 WHEN 0 THEN 'title' WHEN 3 THEN 'table' WHEN 5 THEN 'figure' WHEN 6 THEN 'caption' WHEN 7 THEN 'footer' ELSE 'paragraph' END AS type,
  x1, y1, x2, y2, ((source_id + k * 29) % 100) / 100e0 AS confidence FROM g"""),
    "blocks": (("spans",), """
SELECT source_id || '-' || line_no AS block_id, source_id, page_number, line_no, CASE line_no % 9 WHEN 2 THEN 'heading' WHEN 4 THEN 'table' WHEN 7 THEN 'figure' WHEN 8 THEN 'equation' ELSE 'paragraph' END AS block_type,
  text, x1, y1, x2, y2, CASE WHEN (source_id + line_no) % 4 = 0 THEN NULL ELSE 0.4e0 + ((source_id * 7 + line_no) % 60) / 100e0 END AS engine,
  CASE WHEN (source_id + line_no) % 6 = 0 THEN NULL ELSE ((source_id + line_no * 3) % 100) / 100e0 END AS agreement, CASE WHEN (source_id + line_no) % 5 = 0 THEN NULL ELSE 0.8e0 END AS layout,
  CASE WHEN (source_id * 5 + line_no) % 11 = 0 THEN 'fail' WHEN (source_id + line_no) % 7 = 0 THEN 'warn' ELSE 'pass' END AS check_status FROM spans"""),
    "sources": (("documents",), """
SELECT doc_id AS source_id, 'doc ' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.pdf' WHEN 3 THEN '.csv' ELSE '.exe' END AS display_name, text,
  cast(coalesce({bytes}, 0) AS bigint) AS size_bytes, cast(1 + length(coalesce(text, '')) {idiv} 3000 AS bigint) AS page_count, 'user' || doc_id % 7 AS uploaded_by, source AS tenant_id, {sha}(coalesce(text, '')) AS sha256 FROM documents"""),
    "audit": (("events",), """
SELECT event_id AS seq, user_id AS actor_id, 'tenant' || user_id % 50 AS tenant_id, ts, event_type, CASE event_type WHEN 'error' THEN 'denied' ELSE 'ok' END AS outcome,
  'case-' || event_id % 40 AS case_id, 'obj-' || event_id % 300 AS object_id, props FROM events"""),
    "action_events": (("events",), """
SELECT 'act-' || event_id {idiv} 6 AS action_id, event_id AS seq, ts, 'user' || user_id % 4 AS actor, 'user' || (event_id {idiv} 6) % 4 AS drafter,
  CASE event_id % 6 WHEN 0 THEN 'submit' WHEN 1 THEN CASE user_id % 5 WHEN 0 THEN 'reject' ELSE 'approve' END WHEN 2 THEN CASE user_id % 3 WHEN 0 THEN 'save_edit' ELSE 'execute' END WHEN 3 THEN 'submit' WHEN 4 THEN 'approve' ELSE 'execute' END AS decision,
  CASE WHEN event_id % 6 >= 2 AND user_id % 3 = 0 THEN 'h2' ELSE 'h1' END AS content_hash, 'key-' || event_id {idiv} 12 AS idempotency_key FROM events"""),
    "logins": (("events",), """
SELECT 'user' || user_id % 97 AS username, event_id AS seq, ts, event_type = 'signup' AS success, '10.' || user_id % 200 || '.' || event_id % 250 || '.' || user_id % 251 AS ip
FROM events WHERE event_type IN ('error', 'signup')"""),
    "grants": (("customer",), """
SELECT c_custkey AS grant_id, 'user' || c_custkey % 60 AS user_id, CASE c_custkey % 3 WHEN 0 THEN 'facts' WHEN 1 THEN 'findings' ELSE 'sources' END AS resource,
  CASE c_custkey % 3 WHEN 0 THEN CASE c_custkey % 2 WHEN 0 THEN 'normalized_value' ELSE 'subject' END WHEN 1 THEN 'statement' ELSE 'uploaded_by' END AS col, cast(c_custkey % 1000 AS bigint) AS valid_until FROM customer WHERE c_custkey % 4 = 0"""),
    "requests": (("customer",), """
SELECT c_custkey AS request_id, 'user' || c_custkey % 60 AS user_id, CASE c_custkey % 4 WHEN 0 THEN 'facts' WHEN 1 THEN 'findings' WHEN 2 THEN 'sources' ELSE 'ledger' END AS resource,
  CASE c_custkey % 5 WHEN 0 THEN 'normalized_value' WHEN 1 THEN 'metric' WHEN 2 THEN 'statement' WHEN 3 THEN 'subject' ELSE 'display_name' END AS col,
  CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'review of ' || c_name END AS reason, CASE c_custkey % 6 WHEN 0 THEN '3d' WHEN 1 THEN '24 h' WHEN 2 THEN '31 days' WHEN 3 THEN 'soon' WHEN 4 THEN '2w' ELSE '12' END AS duration,
  'user' || c_nationkey % 60 AS approver, CASE c_custkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'rejected' END AS status FROM customer"""),
    "catalog": ((), """
SELECT 'sources' AS resource, 'source_id' AS col, 0 AS pos, false AS sensitive UNION ALL SELECT 'sources', 'display_name', 1, false UNION ALL SELECT 'sources', 'size_bytes', 2, false UNION ALL SELECT 'sources', 'uploaded_by', 3, true UNION ALL
SELECT 'facts', 'fact_id', 0, false UNION ALL SELECT 'facts', 'metric', 1, false UNION ALL SELECT 'facts', 'subject', 2, true UNION ALL SELECT 'facts', 'normalized_value', 3, true UNION ALL SELECT 'facts', 'currency', 4, false UNION ALL
SELECT 'findings', 'finding_id', 0, false UNION ALL SELECT 'findings', 'severity', 1, false UNION ALL SELECT 'findings', 'statement', 2, true"""),
    "pipeline_steps": (("documents",), """
SELECT d.doc_id AS source_id, s.step, (d.doc_id * 7 + s.k * 13) % 17 <> 0 AS ok FROM documents d CROSS JOIN
(SELECT 0 AS k, 'route' AS step UNION ALL SELECT 1, 'layout' UNION ALL SELECT 2, 'assembly' UNION ALL SELECT 3, 'confidence') s"""),
}
#: Rows of the tables with their order's totals, the cells a row gives rise to, and what a cell says.
_TABLE_ROWS = """i AS (SELECT {by_t} l_orderkey AS t, l_linenumber, l_partkey AS p, l_suppkey, l_quantity, l_extendedprice, cast(l_quantity AS bigint) AS q, cast(floor(l_extendedprice) AS bigint) AS e, cast(round(l_discount * 100) AS bigint) AS d FROM lineitem),
l AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY l_linenumber, p, l_suppkey, l_quantity, l_extendedprice) AS r FROM i),
n AS (SELECT t, r, p, q, e, d, count(*) OVER (PARTITION BY t) AS n, sum(q) OVER (PARTITION BY t) AS sq, sum(e) OVER (PARTITION BY t) AS se FROM l)"""
_TABLE_CODES = "CASE WHEN r = 1 AND r = n THEN array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10) WHEN r = 1 THEN array(0, 1, 2, 3, 4, 5, 6, 7) WHEN r = n THEN array(0, 1, 2, 3, 8, 9, 10) ELSE array(0, 1, 2, 3) END"
_CELL_TEXT = """CASE code WHEN 0 THEN 'Part ' || p WHEN 1 THEN cast(q AS {str}) WHEN 2 THEN {commas_e} WHEN 3 THEN d || '%'
  WHEN 4 THEN 'item' WHEN 5 THEN 'qty' WHEN 6 THEN 'price' WHEN 7 THEN 'disc' WHEN 8 THEN 'Total' WHEN 9 THEN cast(CASE WHEN t % 7 = 0 THEN sq + 1 ELSE sq END AS {str}) ELSE format_number(se, 0) END"""
#: The same rows for Spark from one pass: where the SQL above unites many branches over one join or window, each row is read
#: once and copied by codes, so that tables are shuffled once however many lines or cells come of a row.
_ONE_PASS = {
    "statements": """
WITH o AS (SELECT {by_c} o.o_orderkey AS k, o.o_custkey AS c, {year} AS y, cast(floor(o.o_totalprice) AS bigint) AS amt, c.c_name AS who
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
n AS (SELECT *, row_number() OVER (PARTITION BY c, y, who ORDER BY k) AS nth FROM o),
u AS (SELECT *, explode(CASE WHEN nth = 1 THEN array(0, 1, 2, 3, 4, 5) ELSE array(0, 1) END) AS code FROM n),
s AS (SELECT k, c, y, who, code, CASE WHEN code % 2 = 0 THEN 'A' ELSE 'B' END AS side, CASE WHEN code = 1 THEN CASE k % 10 WHEN 4 THEN amt + amt * 3 {idiv} 1000 WHEN 5 THEN amt + amt * 3 {idiv} 100 WHEN 6 THEN amt + amt {idiv} 10 WHEN 7 THEN amt + amt * 4 {idiv} 10 ELSE amt END ELSE amt END AS v FROM u),
l AS (SELECT side, c, y, CASE WHEN code < 2 THEN 2 + k WHEN code < 4 THEN cast(0 AS bigint) ELSE cast(1 AS bigint) END AS line_no, CASE
    WHEN code IN (2, 3) THEN 'Customer: ' || who
    WHEN code IN (4, 5) THEN 'Period: ' || y || '-01-01 to ' || y || '-12-31'
    {orders} AS text
  FROM s)
{select}""",
    "cells": f"""
WITH {_TABLE_ROWS},
u AS (SELECT *, explode({_TABLE_CODES}) AS code FROM n),
x AS (SELECT t, CASE WHEN code < 4 THEN r WHEN code < 8 THEN 0 ELSE n + 1 END AS r, code % 4 AS c, {_CELL_TEXT} AS v FROM u)
{{select}}""",
    # codes from 11 on are the header's cells, four for each page it is repeated on
    "fragments": f"""
WITH {_TABLE_ROWS},
m AS (SELECT *, CASE WHEN r = 1 AND t % 2 = 0 THEN cast((n + 1) div 3 AS int) ELSE 0 END AS again FROM n),
u AS (SELECT *, explode(CASE WHEN again > 0 THEN concat({_TABLE_CODES}, sequence(11, 10 + 4 * again)) ELSE {_TABLE_CODES} END) AS code FROM m),
x AS (SELECT t, CASE WHEN code < 4 THEN r WHEN code < 8 THEN 0 WHEN code < 11 THEN n + 1 ELSE 0 END AS r, CASE WHEN code < 11 THEN code ELSE 4 + (code - 11) % 4 END AS code,
  CASE WHEN code < 4 THEN 1 + r div 3 WHEN code < 8 THEN 1 WHEN code < 11 THEN 1 + (n + 1) div 3 ELSE 2 + (code - 11) div 4 END AS page, p, q, e, d, sq, se FROM u)
SELECT cast(t AS bigint) AS table_id, cast(page AS bigint) AS page_number, cast(CASE WHEN code BETWEEN 4 AND 7 THEN 0 ELSE r - 3 * (page - 1) + CASE WHEN page > 1 AND t % 2 = 0 THEN 1 ELSE 0 END END AS bigint) AS row,
  cast(code % 4 AS bigint) AS col, 1 AS row_span, 1 AS col_span, code BETWEEN 4 AND 7 AS is_header, {_CELL_TEXT} AS raw_text FROM x""",
}
#: What the one-pass form reads where that is not what the SQL names.
_ONE_PASS_READS = {"fragments": ("lineitem",)}


def _one_pass(name: str) -> str:
    """The one-pass form, with the wording of lines and the last SELECT taken from the SQL itself."""
    sql, out = _SQL[name][1], _ONE_PASS[name]
    lines = sql[sql.index("WHEN k % 20 = 8 ") : sql.index(" FROM s)\nSELECT ")] if name == "statements" else ""
    return out.replace("{orders}", lines).replace("{select}", sql[sql.rindex("\nSELECT ") + 1 :])


_SPARK = {"idiv": "div", "year": "year(o.o_orderdate)", "commas": "format_number(v, 0)", "commas_e": "format_number(e, 0)", "str": "string", "bytes": "octet_length(text)", "sha": "sha256x",
          "lines": "(SELECT doc_id, n, line FROM documents LATERAL VIEW posexplode(split(coalesce(text, ''), '\\n')) x AS n, line)"}
_DUCK = {"idiv": "//", "year": "year(o.o_orderdate)", "commas": "format('{:,}', v)", "commas_e": "format('{:,}', e)", "str": "varchar", "bytes": "strlen(text)", "sha": "sha256",
         "lines": "(SELECT doc_id, i - 1 AS n, line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents), unnest(a) WITH ORDINALITY AS u(line, i))"}


def _text(name: str, dialect: dict[str, str]) -> str:
    sql = _one_pass(name) if dialect is _SPARK and name in _ONE_PASS else _SQL[name][1]
    for k, v in dialect.items():
        sql = sql.replace("{" + k + "}", v)
    return sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; views it builds on are inlined, so Catalyst prunes through them."""
    reads = _ONE_PASS_READS.get(name, _SQL[name][0]) if name in _ONE_PASS else _SQL[name][0]
    frames = {n: base(spark, sf_dir, n) if n in BASE else view(spark, sf_dir, n) for n in reads}
    sql = _text(name, _SPARK).replace("sha256x(coalesce(text, ''))", "sha2(coalesce(text, ''), 256)")
    for n in frames:  # dataframe arguments are written in braces
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {n} ", f"{word} {{{n}}} ").replace(f"{word} {n})", f"{word} {{{n}}})").replace(f"{word} {n}\n", f"{word} {{{n}}}\n")
        if sql.endswith(f"FROM {n}"):
            sql = sql[: -len(n)] + f"{{{n}}}"
    # few bytes are much work here: the number of parts is stated, or a session that fits parts to bytes makes one of them
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    for key in "tc":
        sql = sql.replace("{by_" + key + "}", f"/*+ REPARTITION({parts}, {key}) */")
    return spark.sql(sql, **frames)


def duck(sql: str, views: tuple[str, ...] = ()) -> str:
    """DuckDB SQL with the derived views it names, and those they build on, as common table expressions."""
    need: list[str] = []

    def add(n):
        for d in _SQL[n][0]:
            if d not in BASE:
                add(d)
        if n not in need:
            need.append(n)

    for v in views:
        add(v)
    if not need:
        return sql
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({_text(n, _DUCK)})" for n in need)
    recursive = "RECURSIVE " if sql.startswith("WITH RECURSIVE ") else ""
    rest = sql.removeprefix("WITH RECURSIVE ").removeprefix("WITH ") if sql.startswith("WITH ") else None
    return f"WITH {recursive}{ctes}" + (f",\n{rest}" if rest is not None else f"\n{sql}")
