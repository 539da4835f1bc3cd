"""Queries over readers, page operators, nested data, folds, SQL functions and governed statements."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf

from foliospark.derive import base, view
from foliospark.functions import nested as N
from foliospark.functions import scalars as S
from foliospark.functions.text import nfkc, partial, similarity, token_set
from foliospark.operators import pages as P
from foliospark.operators import governance_sql, relational  # noqa: F401  (the first fills the table of operators)
from foliospark.operators import grounding as G
from foliospark.operators import reasoning as R
from foliospark.operators.relational import duckdb
from foliospark.operators.review import TRANSITIONS, fold_actions
from foliospark.plans.governed import analyse, decide, run_governed
from foliospark.qs.reasoning import ENTITY, FACTS, findings_sql
from foliospark.registry import query
from foliospark.sources import documents as D
from foliospark.streaming import jobs as J
from foliospark.tables import shared_dir, written


@query("s07_csv_cells", "SELECT table_id, row, col, raw_text AS value FROM cells", ("cells",))
def s07(spark, sf):
    """Tables written as text (fields that hold a comma, a quote or a line break are quoted) and read again."""
    v = F.col("raw_text")
    field = F.when(v.rlike("[,\"\n]"), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    lines = view(spark, sf, "cells").groupBy("table_id", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", field.alias("v")))), lambda x: x["v"]), ",").alias("l"))
    text = lines.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "l"))), lambda x: x["l"]), "\n").alias("text"))
    return D.csv_cells(text, "table_id", "text").select("table_id", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), "value")


@query("s08_json_values", "SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events")
def s08(spark, sf):
    return base(spark, sf, "events").select("event_id", D.json_value(F.col("props"), "$.k", "int").alias("k"))


@query("s09_xml_values", """WITH n AS (SELECT source_id, uploaded_by, size_bytes, unnest(range(0, source_id % 3 + 1)) AS seq FROM sources WHERE source_id % 13 <> 5)
SELECT source_id, seq::INT AS seq, uploaded_by || '&<' AS who, CASE WHEN source_id % 7 <> 3 OR seq <> 1 THEN size_bytes + seq END AS size_bytes, 'b' AS unit, false AS is_corrupt FROM n UNION ALL
SELECT source_id, NULL, NULL, NULL, NULL, true FROM sources WHERE source_id % 13 = 5""", ("sources",))
def s09(spark, sf):
    """Files of one to three entries; sizes that are no number, and files cut short."""
    one = lambda i: F.concat(F.lit("<entry unit='b'><by>"), "uploaded_by", F.lit("&amp;&lt;</by><size>"), F.when((F.col("source_id") % 7 == 3) & (i == 1), "many").otherwise((F.col("size_bytes") + i).cast("string")), F.lit("</size></entry>"))
    entries = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("source_id") % 3).cast("int")), one), " ")
    x = F.concat(F.lit("<?xml version='1.0'?><file><note>kept out</note>"), entries, F.when(F.col("source_id") % 13 == 5, "<entry>").otherwise("</file>"))
    got = D.xml_rows(view(spark, sf, "sources").select("source_id", x.alias("x")), "x", "entry", "_unit string, by string, size long")
    return got.select("source_id", "seq", F.col("by").alias("who"), F.col("size").alias("size_bytes"), F.col("_unit").alias("unit"), "is_corrupt")


@query("s10_html_blocks")
def s10(spark, sf):
    return D.html_blocks(base(spark, sf, "pages"))


@query("s10_html_headings", "SELECT page_id, trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)) AS h1, len(regexp_extract_all(html, '<li[ >]')) AS items FROM pages")
def s10h(spark, sf):
    return base(spark, sf, "pages").select("page_id", F.trim(F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1)).alias("h1"), F.size(F.regexp_extract_all("html", F.lit("<li[ >]"), F.lit(0))).cast("bigint").alias("items"))


_MD = "CASE doc_id % 3 WHEN 0 THEN '## Head' || chr(10) || '- one' || chr(10) || '2) two' || chr(10) || '| a | b|' || chr(10) || '|---|:---:|' || chr(10) || 'c|d' || chr(10) ELSE '' END || coalesce(text, '')"


@query("s11_text_blocks", f"""WITH r AS (SELECT doc_id, i, line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT doc_id, string_split(replace(replace({_MD}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS a FROM documents), unnest(a) WITH ORDINALITY AS u(line, i)),
l AS (SELECT *, CASE WHEN s = '' THEN 'blank' WHEN s LIKE '```%' THEN 'code_fence' WHEN regexp_matches(s, '^#{{1,6}}\\s+') THEN 'heading' WHEN s LIKE '%|%' THEN 'table' WHEN regexp_matches(line, '^\\s*(?:[-*•+]\\s+|\\d+[.)]\\s+)') THEN 'list' ELSE 'paragraph' END AS kind
 FROM r WHERE NOT (s LIKE '%|%' AND regexp_matches(s, '^[|]*\\s*:?-{{3,}}:?\\s*(?:[|]\\s*:?-{{3,}}:?\\s*)*[|]*$'))),
b AS (SELECT *, sum((kind <> coalesce(p, '') OR kind IN ('heading', 'code_fence'))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l)),
t AS (SELECT *, CASE kind WHEN 'heading' THEN regexp_replace(s, '^#{{1,6}}\\s+', '') WHEN 'table' THEN trim(regexp_replace(regexp_replace(s, '^[|]+|[|]+$', '', 'g'), '\\s*[|]\\s*', ' | ', 'g')) WHEN 'list' THEN regexp_replace(line, '^\\s*(?:[-*•+]\\s+|\\d+[.)]\\s+)', '• ') ELSE s END AS t FROM b)
SELECT doc_id, block::BIGINT AS block, any_value(kind) AS block_type, max(CASE WHEN kind = 'heading' THEN length(regexp_extract(s, '^(#+)', 1)) ELSE 0 END)::BIGINT AS level, CASE WHEN any_value(kind) = 'paragraph' THEN string_agg(t, ' ' ORDER BY i) ELSE string_agg(t, chr(10) ORDER BY i) END AS text FROM t WHERE kind <> 'blank' GROUP BY doc_id, block""")
def s11(spark, sf):
    return D.text_blocks(base(spark, sf, "documents").select("doc_id", F.expr(_MD).alias("text")))


@query("s12_emails")
def s12(spark, sf):
    c = base(spark, sf, "conversations")
    raw = F.concat(F.lit("From: user"), "conv_id", F.lit("@example.org\nSubject: turn "), "turn", F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return D.emails(c.select(F.concat_ws("-", "conv_id", "turn").alias("message_id"), raw.alias("raw")), "message_id", "raw")


_TITLE, _SURE = "list_contains(string_split(coalesce(v.columns, ''), ','), 'statement')", "list_contains(string_split(coalesce(v.columns, ''), ','), 'severity')"


@query("p06_redacted_findings", f"""WITH v AS (SELECT * FROM ({duckdb("p02_visible_columns")}) WHERE resource = 'findings'), f AS ({findings_sql("SELECT *")})
SELECT finding_id, 'user' || 4 * (line % 15) AS user_id, CASE WHEN {_TITLE} THEN severity ELSE 'hidden' END AS severity, CASE WHEN {_TITLE} THEN title ELSE 'Potential discrepancy' END AS title, CASE WHEN {_TITLE} THEN abs_diff END AS abs_diff, CASE WHEN {_TITLE} THEN pct_diff END AS pct_diff,
 CASE WHEN {_TITLE} THEN explanations ELSE '' END AS explanations, CASE WHEN {_SURE} THEN confidence ELSE 0 END AS confidence FROM (SELECT *, cast(regexp_extract(fact_a || fact_b, '[0-9]+') AS HUGEINT) % 1000003 AS line FROM f) f LEFT JOIN v ON v.user_id = 'user' || 4 * (line % 15)""", ("statements", "grants", "catalog"))
def p06(spark, sf):
    """What is left of a finding for a user who may not see its statement, or not its severity, by the columns visible to them."""
    f = R.findings(R.pairs(written(R.line_facts(view(spark, sf, "statements")))))
    f = f.withColumn("user_id", F.concat(F.lit("user"), 4 * (F.regexp_extract(F.concat("fact_a", "fact_b"), "[0-9]+", 0).cast("decimal(38,0)") % 1000003 % 15).cast("int")))
    seen = relational.apply("p02_visible_columns", spark, grants=view(spark, sf, "grants"), catalog=view(spark, sf, "catalog")).where("resource = 'findings'").select("user_id", F.split("columns", ",").alias("columns"))
    has = lambda c: F.coalesce(F.array_contains("columns", c), F.lit(False))
    f = f.join(seen, "user_id", "left").withColumns({"__title": has("statement"), "__sure": has("severity")})
    return redacted_findings(f, F.col("__title"), F.col("__sure"))


def redacted_findings(f, title, confidence):
    """Findings with general words for hidden titles; without a title there are no figures or explanations either."""
    return f.select("finding_id", "user_id", F.when(title, F.col("severity")).otherwise("hidden").alias("severity"), F.when(title, F.col("title")).otherwise("Potential discrepancy").alias("title"), F.when(title, F.col("abs_diff")).alias("abs_diff"),
                    F.when(title, F.col("pct_diff")).alias("pct_diff"), F.when(title, F.col("explanations")).otherwise("").alias("explanations"), F.when(confidence, F.col("confidence")).otherwise(0.0).alias("confidence"))


_MASK = "regexp_replace({}, '([\\w.+-])[\\w.+-]*@([\\w-]+\\.[\\w.]+)', '\\1***@\\2', 'g')"


def _record(df):
    """A document as nested data: texts under masked names at several depths, beside evidence and other fields."""
    mail = F.concat(F.lit("mail jane.doe@example.org "), F.coalesce("source", F.lit("")))
    fact = F.struct(mail.alias("raw_value"), F.col("lang").alias("metric"), F.struct(mail.alias("excerpt"), F.struct(mail.alias("body"), mail.alias("other")).alias("inner")).alias("detail"), F.array(F.struct(mail.alias("excerpt"))).alias("evidence"))
    return df.select("doc_id", F.struct(F.array(fact).alias("facts"), mail.alias("text"), F.create_map(F.lit("subject"), mail, F.lit("kept"), mail).alias("more"), F.struct(F.lit(1).alias("page")).alias("location")).alias("data"))


_M = "'mail jane.doe@example.org ' || coalesce(source, '')"


@query("p08_deep_mask", f"""SELECT doc_id, {_MASK.format(_M)} AS raw_value, {_MASK.format(_M)} AS excerpt, {_MASK.format(_M)} AS body, {_M} AS other, {_MASK.format(_M)} AS evidence, {_MASK.format(_M)} AS text, {_MASK.format(_M)} AS subject, {_M} AS kept FROM documents""")
def p08(spark, sf):
    d = _record(base(spark, sf, "documents"))
    d = d.select("doc_id", N.map_fields(F.col("data"), d.schema["data"].dataType, N.MASKED, S.mask_text).alias("d"))
    f = F.get("d.facts", F.lit(0))
    return d.select("doc_id", f["raw_value"].alias("raw_value"), f["detail"]["excerpt"].alias("excerpt"), f["detail"]["inner"]["body"].alias("body"), f["detail"]["inner"]["other"].alias("other"), F.get(f["evidence"], F.lit(0))["excerpt"].alias("evidence"), F.col("d.text").alias("text"), F.col("d.more")["subject"].alias("subject"), F.col("d.more")["kept"].alias("kept"))


@query("p09_strip_evidence", f"""SELECT doc_id, '{{"facts":[{{"raw_value":"' || {_M} || '","metric":' || coalesce('"' || lang || '"', 'null') || ',"detail":{{"excerpt":"' || {_M} || '","inner":{{"body":"' || {_M} || '","other":"' || {_M} || '"}}}}}}],"text":"' || {_M} || '","more":{{"subject":"' || {_M} || '","kept":"' || {_M} || '"}}}}' AS json FROM documents""")
def p09(spark, sf):
    d = _record(base(spark, sf, "documents"))
    return d.select("doc_id", F.to_json(N.drop_fields(F.col("data"), d.schema["data"].dataType, N.EVIDENCE), {"ignoreNullFields": "false"}).alias("json"))


@query("p10_secret_keys", "SELECT seq, '[redacted]' AS api_key, coalesce(props, '') AS props FROM audit", ("audit",))
def p10(spark, sf):
    m = F.create_map(F.lit("API_Key"), F.lit("abc"), F.lit("props"), F.coalesce("props", F.lit("")))
    safe = F.transform_values(m, lambda k, v: F.when(F.lower(k).rlike("password|secret|token|api_key|authorization|cookie|private"), "[redacted]").otherwise(v))
    return view(spark, sf, "audit").select("seq", safe.alias("m")).select("seq", F.col("m")["API_Key"].alias("api_key"), F.col("m")["props"].alias("props"))


@query("j08_region_merge")
def j08(spark, sf):
    return P.merge_regions(view(spark, sf, "regions"))


@query("j03_consensus_clusters")
def j03(spark, sf):
    return P.consensus_clusters(P.as_candidates(view(spark, sf, "spans"), view(spark, sf, "ocr_spans")))


_CLOSE = "SELECT source_id, page_number, line_no, x1 + 100 * (line_no * 7 % 3) AS x1, y1 - 9 * (line_no % 40) AS y1, y2 - 9 * (line_no % 40) AS y2 FROM {0}"


@query("w14_rows_of_boxes", f"""WITH RECURSIVE b AS ({_CLOSE.format("ocr_spans")}), n AS (SELECT *, (y1 + y2) / 2 AS c, y2 - y1 AS h, row_number() OVER (PARTITION BY source_id, page_number ORDER BY y1, x1, line_no) AS n FROM b),
f AS (SELECT source_id, page_number, line_no, x1, n, 0::BIGINT AS row, c AS total, 1::BIGINT AS k FROM n WHERE n = 1
  UNION ALL SELECT n.source_id, n.page_number, n.line_no, n.x1, n.n, CASE WHEN abs(n.c - f.total / f.k) < 0.6 * n.h THEN f.row ELSE f.row + 1 END, CASE WHEN abs(n.c - f.total / f.k) < 0.6 * n.h THEN f.total + n.c ELSE n.c END, CASE WHEN abs(n.c - f.total / f.k) < 0.6 * n.h THEN f.k + 1 ELSE 1 END
  FROM f JOIN n ON n.source_id = f.source_id AND n.page_number = f.page_number AND n.n = f.n + 1)
SELECT source_id, page_number, line_no, row AS grid_row, row_number() OVER (PARTITION BY source_id, page_number, row ORDER BY x1, line_no) - 1 AS grid_col FROM f""", ("ocr_spans",))
def w14(spark, sf):
    """Lines that lie 7 units below each other, 12 high: the mean of a row decides which of them start a new one."""
    return P.grid_rows(spark.sql(_CLOSE.format("{o}"), o=view(spark, sf, "ocr_spans")))


@query("a05_fuzzy_vote")
def a05(spark, sf):
    parts = [view(spark, sf, n).select("source_id", "page_number", "line_no", F.lit(n).alias("extractor"), "text", (F.lit(w) * F.col("confidence")).alias("weight")) for n, w in (("spans", 1.0), ("ocr_spans", 0.7))]
    return P.fuzzy_vote(parts[0].unionByName(parts[1]))


@query("j13_shared_entities")
def j13(spark, sf):
    d = base(spark, sf, "documents")
    return R.shared_entities(d.select(F.col("doc_id").alias("source_id"), F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(ENTITY), F.lit(1))).alias("entities")))


_COLUMNS = "SELECT source_id, page_number, region_id, type, x1 + 170 * (region_id * 5 % 3) AS x1, y1, x1 + 170 * (region_id * 5 % 3) + CASE WHEN region_id % 4 = 1 THEN 400 ELSE 90 + x2 * 7 % 60 END AS x2, y2, confidence FROM {0}"


@query("o06_order_agreement", f"""WITH RECURSIVE r AS ({_COLUMNS.format("regions")}), w AS (SELECT source_id, page_number, max(x2) + 72 AS w FROM r GROUP BY ALL),
b AS (SELECT r.source_id, r.page_number, region_id, x1, y1, (x2 - x1) / 2 + x1 AS c, w, x2 - x1 > 0.6 * w AS wide FROM r JOIN w ON r.source_id = w.source_id AND r.page_number = w.page_number WHERE type NOT IN ('header', 'footer', 'caption')),
n AS (SELECT *, row_number() OVER (PARTITION BY source_id, page_number ORDER BY c, region_id) AS n, row_number() OVER (PARTITION BY source_id, page_number ORDER BY y1, x1, region_id) AS first FROM b),
f AS (SELECT source_id, page_number, n, first, c AS lead, wide AS lead_wide, 0 AS col FROM n WHERE n = 1 UNION ALL
  SELECT n.source_id, n.page_number, n.n, n.first, CASE WHEN n.wide OR f.lead_wide OR n.c >= f.lead + 0.15 * n.w THEN n.c ELSE f.lead END, CASE WHEN n.wide OR f.lead_wide OR n.c >= f.lead + 0.15 * n.w THEN n.wide ELSE f.lead_wide END, CASE WHEN n.wide OR f.lead_wide OR n.c >= f.lead + 0.15 * n.w THEN f.col + 1 ELSE f.col END
  FROM f JOIN n ON n.source_id = f.source_id AND n.page_number = f.page_number AND n.n = f.n + 1),
s AS (SELECT source_id, page_number, first, row_number() OVER (PARTITION BY source_id, page_number ORDER BY col, first) AS second FROM f),
p AS (SELECT a.source_id, a.page_number, count(*) AS pairs, count_if(a.second > b.second)::BIGINT AS inversions FROM s a JOIN s b ON a.source_id = b.source_id AND a.page_number = b.page_number AND a.first < b.first GROUP BY ALL),
k AS (SELECT r.source_id, r.page_number, count(*) FILTER (type NOT IN ('header', 'footer', 'caption')) AS regions FROM r GROUP BY ALL)
SELECT k.source_id, k.page_number, regions, coalesce(inversions, 0) AS inversions, coalesce(round(1 - inversions / pairs::DOUBLE, 8), 1) AS agreement FROM k LEFT JOIN p ON k.source_id = p.source_id AND k.page_number = p.page_number""", ("regions",))
def o06(spark, sf):
    """Pages of three columns with wide regions between them."""
    return P.order_agreement(spark.sql(_COLUMNS.format("{r}"), r=view(spark, sf, "regions")))


@query("o05_reading_order")
def o05(spark, sf):
    return P.reading_order(view(spark, sf, "regions"))


@query("w04_chain_build", "WITH l AS (SELECT tenant_id, list(seq || '|' || event_type ORDER BY seq) AS e FROM audit GROUP BY tenant_id) SELECT tenant_id, list_reduce(e, lambda h, x: sha256(h || x), repeat('0', 64)) AS head, len(e) AS n FROM l", ("audit",))
def w04(spark, sf):
    """A tenant's chain is sequential by nature; tenants run in parallel."""
    e = view(spark, sf, "audit").groupBy("tenant_id").agg(F.array_sort(F.collect_list(F.struct("seq", "event_type"))).alias("e"))
    head = F.aggregate("e", F.lit("0" * 64), lambda h, x: F.sha2(F.concat(h, x["seq"].cast("string"), F.lit("|"), x["event_type"]), 256))
    return e.select("tenant_id", head.alias("head"), F.size("e").cast("bigint").alias("n"))


_CHAINED = """WITH RECURSIVE n AS (SELECT tenant_id, seq, event_type, row_number() OVER (PARTITION BY tenant_id ORDER BY seq) AS n FROM audit),
c AS (SELECT tenant_id, seq, event_type, n, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || seq || '|' || event_type) AS hash FROM n WHERE n = 1
  UNION ALL SELECT n.tenant_id, n.seq, n.event_type, n.n, c.hash, sha256(c.hash || n.seq || '|' || n.event_type) FROM c JOIN n ON n.tenant_id = c.tenant_id AND n.n = c.n + 1)"""
_VERIFIED = _CHAINED + """,
t AS (SELECT tenant_id, seq, event_type, n, CASE WHEN seq % 401 = 7 THEN 'relinked' ELSE prev_hash END AS prev_hash, CASE WHEN seq % 211 = 5 THEN 'tampered' ELSE hash END AS hash FROM c WHERE seq % 307 <> 11),
f AS (SELECT tenant_id, seq, n - lag(n, 1, 0) OVER w <> 1 AS gap, prev_hash <> lag(hash, 1, repeat('0', 64)) OVER w AS broken_link, hash <> sha256(prev_hash || seq || '|' || event_type) AS hash_mismatch FROM t WINDOW w AS (PARTITION BY tenant_id ORDER BY n))
SELECT tenant_id, seq, gap, broken_link, hash_mismatch, CASE WHEN gap OR broken_link OR hash_mismatch THEN array_to_string(list_filter([CASE WHEN gap THEN 'gap' END, CASE WHEN broken_link THEN 'broken_link' END, CASE WHEN hash_mismatch THEN 'hash_mismatch' END], lambda x: x IS NOT NULL), ',') ELSE 'ok' END AS problem FROM f"""


def _tampered(spark, sf):
    """Every tenant's log, some rows tampered with, relinked or taken out after it was written."""
    log = J.audit_log(view(spark, sf, "audit").select("tenant_id", "seq", "event_type"))
    hurt = {"hash": F.when(F.col("seq") % 211 == 5, "tampered").otherwise(F.col("hash")), "prev_hash": F.when(F.col("seq") % 401 == 7, "relinked").otherwise(F.col("prev_hash"))}
    return log.withColumns(hurt).where("seq % 307 <> 11")


def _verified(spark, sf):
    """Every row of every tenant's chain."""
    return J.verify_chain(_tampered(spark, sf))


query("w03_chain_verify", _VERIFIED, ("audit",))(_verified)
query("w03_chain_verify_all", _VERIFIED, ("audit",))(_verified)


@query("w05_page_verify", _VERIFIED[: _VERIFIED.index("f AS (SELECT tenant_id, seq, n - lag")].rstrip().rstrip(",") + """,
f AS (SELECT * FROM t WHERE event_type = 'error')
SELECT f.tenant_id, f.seq, f.n > 1 AND p.n IS NULL AS gap, f.prev_hash = CASE WHEN f.n = 1 THEN repeat('0', 64) ELSE coalesce(p.hash, '') END AS linked, f.hash = sha256(f.prev_hash || f.seq || '|' || f.event_type) AS intact
FROM f LEFT JOIN t p ON p.tenant_id = f.tenant_id AND p.n = f.n - 1""", ("audit",))
def w05(spark, sf):
    """The errors of a log that was tampered with, each against its true predecessor, whatever its type."""
    log = written(_tampered(spark, sf))
    return J.verify_page(log.where("event_type = 'error'"), log)


@query("r04_sliding_counters", """WITH e AS (SELECT event_type, time_bucket(INTERVAL 15 minutes, ts::TIMESTAMP, TIMESTAMP '1970-01-01') AS b FROM events)
SELECT strftime(b - k * INTERVAL 15 minutes, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM e, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL""")
def r04_sliding(spark, sf):
    """Events of each type in windows of an hour that start every quarter of an hour."""
    w = J.window_counts(base(spark, sf, "events"), "1 hour", "15 minutes")
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("r04_session_counters", """WITH e AS (SELECT user_id, ts::TIMESTAMP AS ts, coalesce(ts::TIMESTAMP >= lag(ts::TIMESTAMP) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 hours, true) AS fresh FROM events),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 hours, '%Y-%m-%d %H:%M:%S') AS stop, count(*) AS n FROM s GROUP BY user_id, k""")
def r04_session(spark, sf):
    """Events of each user in sessions that six idle hours end."""
    w, f = J.session_counts(base(spark, sf, "events"), "6 hours"), "yyyy-MM-dd HH:mm:ss"
    return w.select("user_id", F.date_format("session_window.start", f).alias("start"), F.date_format("session_window.end", f).alias("stop"), "n")


@query("r05_audit_chain", _CHAINED + " SELECT tenant_id, seq, prev_hash, hash FROM c", ("audit",))
def r05(spark, sf):
    """The chain that the stream job appends, from its batch twin."""
    return J.audit_chain(view(spark, sf, "audit").select("tenant_id", "seq", "event_type"))


@query("r06_expired_grants", "SELECT grant_id, valid_until AS expired_at FROM grants WHERE valid_until <= 300", ("grants",))
def r06(spark, sf):
    """Each grant whose end has passed, once, however often it is written: the batch twin of the stream with timers."""
    g = view(spark, sf, "grants")
    again = g.unionByName(g.where("grant_id % 3 = 0"))
    return again.groupBy("grant_id").agg(F.max("valid_until").alias("expired_at")).where("expired_at <= 300")


@query("f03_number_tokens", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN '0' ELSE regexp_replace(cast(cast(round(l_discount * 100) AS INT) / 100 AS DECIMAL(10,2))::VARCHAR, '0+$', '') END AS token FROM lineitem")
def f03(spark, sf):
    cents = F.round(F.col("l_discount") * 100).cast("int")
    return base(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.number_token(F.concat(F.lit("0."), F.lpad(cents.cast("string"), 2, "0"), F.lit("0"))).alias("token"))


@query("f12_iban", "SELECT c_custkey, (('3214282912345698765432' || lpad(c_custkey::VARCHAR, 2, '0')[-2:] || '1611' || '82')::HUGEINT) % 97 = 1 AS ok FROM customer")
def f12(spark, sf):
    # a number whose last account digits vary by customer
    s = F.concat(F.lit("GB82WEST123456987654"), F.lit("32"), F.substring(F.lpad(F.col("c_custkey").cast("string"), 2, "0"), -2, 2))
    return base(spark, sf, "customer").select("c_custkey", S.iban_ok(s).alias("ok"))


@query("f14_masked_mail", "SELECT doc_id, len(regexp_extract_all(regexp_replace(coalesce(text, ''), '[^\\x01-\\x7F]', 'x', 'g'), '([\\w.+-])[\\w.+-]*@([\\w-]+\\.[\\w.]+)')) AS mails FROM documents")
def f14(spark, sf):
    t = S.mask_text(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x01-\x7F]", "x"))
    return base(spark, sf, "documents").select("doc_id", F.size(F.regexp_extract_all(t, F.lit(r"\*\*\*@[\w-]+\.[\w.]+"), F.lit(0))).cast("bigint").alias("mails"))


@query("f15_masked_ip", "SELECT seq, regexp_replace(ip, '\\.\\d+$', '.x') AS ip FROM logins", ("logins",))
def f15(spark, sf):
    return view(spark, sf, "logins").select("seq", S.mask_ip(F.col("ip")).alias("ip"))


@query("f17_similarity")
def f17(spark, sf):
    """Ratio, token-set and partial ratio of the two readings of each line."""
    a, b = view(spark, sf, "spans"), view(spark, sf, "ocr_spans").withColumnRenamed("text", "other")
    j = a.join(b.select("source_id", "line_no", "other"), ["source_id", "line_no"])
    return j.select("source_id", "line_no", F.round(similarity("text", "other"), 4).alias("ratio"), F.round(token_set("text", "other"), 4).alias("token_set"), F.round(partial("text", "other"), 4).alias("partial"))


@query("f20_display", """SELECT l_orderkey, l_linenumber, format('{:,}', cast(floor(l_extendedprice) AS BIGINT)) AS price, cast(round(l_discount * 100) AS INT) || '%' AS disc, CASE WHEN l_linenumber % 2 = 0 THEN '(' ELSE '' END || '$' || format('{:,}', cast(floor(l_quantity) AS BIGINT)) || CASE WHEN l_linenumber % 2 = 0 THEN ')' ELSE '' END AS money,
  strftime(l_shipdate, '%d/%m/%Y') AS dmy, strftime(l_shipdate, '%d-%b-%y') AS dby, strftime(l_shipdate, '%Y-%m-%d') AS ymd FROM lineitem""")
def f20(spark, sf):
    q = F.floor("l_quantity") * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
    money = F.when(q < 0, F.concat(F.lit("("), S.display(-q, 0, thousands=True, symbol="$"), F.lit(")"))).otherwise(S.display(q, 0, thousands=True, symbol="$"))
    day = lambda f: S.display_date(F.col("l_shipdate"), f)
    return base(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.display(F.floor("l_extendedprice"), 0, thousands=True).alias("price"), S.display(F.round(F.col("l_discount") * 100) / 100, 0, percent=True).alias("disc"), money.alias("money"),
                                              day("dd/mm/yyyy").alias("dmy"), day("d-mmm-yy").alias("dby"), day("yyyy-mm-dd").alias("ymd"))


@query("r02_rate_limit")
def r02(spark, sf):
    e = base(spark, sf, "events").select(F.concat(F.lit("host"), F.col("user_id") % 40).alias("host"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return J.rate_limit(e)


@query("r07_newest_progress", "SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS newest, count(*) AS n FROM events GROUP BY user_id")
def r07(spark, sf):
    """Events ingested as a file stream, twice with one checkpoint, which adds nothing; then each user's newest status."""
    folder = f"{shared_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    schema = base(spark, sf, "events").schema
    src = f"{folder}/src"
    base(spark, sf, "events").write.parquet(src)
    for _ in range(2):
        J.ingest(spark.readStream.schema(schema).parquet(src), f"{folder}/out", f"{folder}/ck").awaitTermination()
    got = spark.read.schema(schema).parquet(f"{folder}/out")
    return got.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.max("event_id").alias("newest"), F.count("*").alias("n"))


def register_functions(spark) -> None:
    """Scalar functions for SQL users: SQL functions that the analyser inlines, and the Arrow functions by name."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION folio_mask_mail(s STRING) RETURNS STRING RETURN regexp_replace(s, r'([\\w.+-])[\\w.+-]*@([\\w-]+\\.[\\w.]+)', '$1***@$2')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION folio_severity(p DOUBLE) RETURNS STRING RETURN CASE WHEN p >= 20 THEN 'high' WHEN p >= 5 THEN 'medium' ELSE 'low' END")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION folio_amount(s STRING) RETURNS DECIMAL(38, 10) RETURN
      CASE WHEN trim(s) LIKE '(%)' OR trim(s) LIKE '-%' THEN -1 ELSE 1 END * try_cast(replace(regexp_replace(trim(s), r'^[()\\-]+|[()\\-]+$', ''), ',', '') AS DECIMAL(38, 10))""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION folio_date(s STRING) RETURNS DATE RETURN CASE WHEN s RLIKE r'^\\d{4}-\\d{2}-\\d{2}$' THEN try_cast(s AS DATE)
      WHEN s RLIKE r'^\\d{1,2}[/.]\\d{1,2}[/.]\\d{4}$' THEN try_cast(concat_ws('-', split(s, '[/.]')[2], lpad(split(s, '[/.]')[1], 2, '0'), lpad(split(s, '[/.]')[0], 2, '0')) AS DATE) END""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION folio_iban_ok(s STRING) RETURNS BOOLEAN RETURN
      aggregate(filter(split(concat(substr(s, 5), substr(s, 1, 4)), ''), c -> c <> ''), 0, (a, c) -> (a * CASE WHEN c RLIKE '[0-9]' THEN 10 ELSE 100 END + CASE WHEN c RLIKE '[0-9]' THEN ascii(c) - 48 ELSE ascii(c) - 55 END) % 97) = 1""")
    spark.udf.register("folio_nfkc", nfkc)
    spark.udf.register("folio_similarity", similarity)


@query("u02_sql_functions", """SELECT o_orderkey, CASE WHEN o_orderkey % 40 >= 20 THEN 'high' WHEN o_orderkey % 40 >= 5 THEN 'medium' ELSE 'low' END AS severity, 'u***@example.org' AS mail, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * floor(o_totalprice)::DOUBLE AS amount,
  try_cast(year(o_orderdate) || '-02-' || (28 + o_orderkey % 3) AS DATE)::VARCHAR AS day, ('3214282912345698765432' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || '161182')::HUGEINT % 97 = 1 AS iban_ok, 'A ' || o_orderkey AS name, 100.0::DOUBLE AS same FROM orders""")
def u02(spark, sf):
    register_functions(spark)
    money = "concat(CASE WHEN o_orderkey % 2 = 0 THEN '(' ELSE '' END, format_number(floor(o_totalprice), 0), CASE WHEN o_orderkey % 2 = 0 THEN ')' ELSE '' END)"
    return base(spark, sf, "orders").selectExpr(
        "o_orderkey", "folio_severity(o_orderkey % 40) AS severity", "folio_mask_mail(concat('user', o_orderkey, '@example.org')) AS mail", f"cast(folio_amount({money}) AS double) AS amount",
        "cast(folio_date(concat(28 + o_orderkey % 3, '/2/', year(o_orderdate))) AS string) AS day", "folio_iban_ok(concat('GB82WEST12345698765432', lpad(cast(o_orderkey % 100 AS string), 2, '0'))) AS iban_ok",
        "folio_nfkc(concat('Ａ  ', o_orderkey)) AS name", "folio_similarity(o_orderstatus, o_orderstatus) AS same",
    )


@arrow_udtf(returnType="block_id string, label string, num string, is_date boolean")
class LineFacts:
    """The facts of lines as rows, a batch of lines at a time: block_id and text in, labels and raw values out."""

    def eval(self, lines: pa.RecordBatch):
        rows = []
        for block, text in zip(lines.column(0).to_pylist(), lines.column(1).to_pylist(), strict=True):
            dates = _DATE_LINE.findall(text or "")
            rows += [(block, label, day, True) for label, day in dates]
            if not dates and (m := _NUMBER_LINE.search(text or "")) and len(m[1].strip()) >= 3:
                rows.append((block, m[1], f"{m[4]}-{m[5]}" if m[5] else m[4], False))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.table(dict(zip(("block_id", "label", "num", "is_date"), (pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.string(), pa.bool_()), strict=True)), strict=True)))


_NUMBER_LINE, _DATE_LINE = re.compile(R.LINE, re.ASCII), re.compile(R.DATELINE, re.ASCII)


@query("u03_fact_table_function", f"WITH {FACTS} SELECT block_id, label, raw_value AS num, rule IN ('DATE_ISO', 'DATE_DMY') AS is_date FROM n", ("statements",))
def u03(spark, sf):
    """The same rows as the fact query, from a table function that SQL users can call on any lines."""
    spark.udtf.register("line_facts", LineFacts)
    return spark.sql("SELECT * FROM line_facts(TABLE(SELECT block_id, text FROM {s}))", s=view(spark, sf, "statements"))


@query("u04_vote", """WITH t AS (SELECT source_id, page_number, line_no, text, 1.0::DOUBLE * confidence AS w FROM spans UNION ALL SELECT source_id, page_number, line_no, text, 0.7::DOUBLE * confidence FROM ocr_spans),
g AS (SELECT source_id, page_number, line_no, text, sum(w) AS w, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source_id, page_number, line_no ORDER BY w DESC, text) AS r, count(*) OVER (PARTITION BY source_id, page_number, line_no) AS groups, sum(w) OVER (PARTITION BY source_id, page_number, line_no) AS total FROM g)
SELECT source_id, page_number, line_no, text AS winner, CASE WHEN groups = 1 THEN 'unanimous' WHEN w > 0.5 * total THEN 'majority' ELSE 'split' END AS agreement FROM r WHERE r = 1""", ("spans", "ocr_spans"))
def u04(spark, sf):
    """The vote over candidate texts as one aggregate: equal texts add up their weights, the heaviest wins, ties by text."""
    w = {"spans": 1.0, "ocr_spans": 0.7}
    t = None
    for name, reliability in w.items():
        one = view(spark, sf, name).select("source_id", "page_number", "line_no", "text", (F.lit(reliability) * F.col("confidence")).alias("w"))
        t = one if t is None else t.unionByName(one)
    g = t.groupBy("source_id", "page_number", "line_no", "text").agg(F.sum("w").alias("w"))
    best = F.min_by(F.struct("text", "w"), F.struct(-F.col("w"), "text"))
    v = g.groupBy("source_id", "page_number", "line_no").agg(best.alias("b"), F.count("*").alias("groups"), F.sum("w").alias("total"))
    agreement = F.when(F.col("groups") == 1, "unanimous").when(F.col("b.w") > 0.5 * F.col("total"), "majority").otherwise("split")
    return v.select("source_id", "page_number", "line_no", F.col("b.text").alias("winner"), agreement.alias("agreement"))


@query("g01_governed_sql", "SELECT source_id, size_bytes FROM sources WHERE tenant_id = 'src3' AND size_bytes > 100 ORDER BY source_id LIMIT 500", ("sources",))
def g01(spark, sf):
    mine = view(spark, sf, "sources").where("tenant_id = 'src3'").select("source_id", "display_name", "size_bytes")
    reason, rows = run_governed(spark, "SELECT source_id, size_bytes FROM sources WHERE size_bytes > 100 ORDER BY source_id", {"sources": mine})
    if reason:
        raise ValueError(reason)
    return rows


def _frames(spark, sf):
    """What users may query: sources, findings (here: differing lines) and facts (here: lines), with all their columns."""
    s = view(spark, sf, "sources").select("source_id", "display_name", "size_bytes", "uploaded_by")
    l = view(spark, sf, "statements").select(F.col("block_id").alias("fact_id"), F.col("source_id").alias("metric"), F.col("case_id").alias("subject"), F.col("text").alias("normalized_value"), F.lit("INR").alias("currency"))
    a = view(spark, sf, "action_events").where("decision = 'reject'").select(F.col("seq").alias("finding_id"), F.col("decision").alias("severity"), F.col("action_id").alias("statement"))
    return {"sources": s, "facts": l, "findings": a}


SENSITIVE = {"sources": {"uploaded_by"}, "facts": {"subject", "normalized_value"}, "findings": {"statement"}}
#: Statements that users ask, by what they touch.
ASKED = (
    "SELECT source_id, size_bytes FROM sources WHERE size_bytes > 100 LIMIT 50", "SELECT source_id FROM sources", "SELECT count(*) AS n FROM facts LIMIT 1", "SELECT f.metric, count(*) AS n FROM facts f GROUP BY f.metric HAVING count(*) > 3 LIMIT 20",
    "SELECT subject FROM facts LIMIT 5", "SELECT s.uploaded_by FROM sources s JOIN findings f ON s.source_id = f.finding_id LIMIT 9", "SELECT * FROM ledger", "SELECT secret FROM sources", "WITH x AS (SELECT severity FROM findings) SELECT severity, count(*) AS n FROM x GROUP BY severity LIMIT 3",
)
_FRAMES = "n AS (SELECT 'sources' AS t, count(*) AS c FROM sources UNION ALL SELECT 'facts', count(*) FROM statements UNION ALL SELECT 'findings', count(*) FROM action_events WHERE decision = 'reject')"
_WANT = [("sources", "sources.size_bytes,sources.source_id", "", 50), ("sources", "sources.source_id", "", None), ("facts", "", "", 1), ("facts", "facts.metric", "", 20), ("facts", "facts.subject", "facts.subject", 5),
         ("findings,sources", "findings.finding_id,sources.source_id,sources.uploaded_by", "sources.uploaded_by", 9), None, None, ("findings", "findings.severity", "", 3)]
_Q = "q(id, tables, columns, sensitive, lim) AS (VALUES " + ", ".join(f"({i}, '{w[0]}', '{w[1]}', '{w[2]}', {w[3] or 'NULL'}::INT)" if w else f"({i}, NULL, NULL, NULL, NULL::INT)" for i, w in enumerate(_WANT)) + ")"
_DECIDED = f"WITH {_FRAMES}, {_Q}, e AS (SELECT q.*, (SELECT max(c) FROM n WHERE list_contains(string_split(q.tables, ','), n.t)) AS row_estimate FROM q)"


def _decisions(spark, sf):
    """Every asked statement through the gate: (id, decision, reason, tables, columns, sensitive, estimate)."""
    frames, rows, counts = _frames(spark, sf), [], {}
    for i, sql in enumerate(ASKED):
        said, why, a, n = decide(spark, sql, frames, SENSITIVE, counts=counts)
        rows.append((i, said, why, *([None] * 3 if why and said == "BLOCK" else [",".join(x) for x in (a.tables, a.columns, a.sensitive)]), n))
    return spark.createDataFrame(rows, "id int, decision string, reason string, tables string, columns string, sensitive string, row_estimate long")


@query("g02_query_analysis", _DECIDED + " SELECT id, tables, columns, sensitive, row_estimate FROM e WHERE tables IS NOT NULL", ("sources", "statements", "action_events"))
def g02(spark, sf):
    return _decisions(spark, sf).where("decision <> 'BLOCK'").select("id", "tables", "columns", "sensitive", "row_estimate")


_SAID = "CASE WHEN tables IS NULL THEN 'BLOCK' WHEN sensitive <> '' OR row_estimate > 1000 AND lim IS NULL THEN 'CONFIRM' ELSE 'ALLOW' END"


@query("g03_decision", _DECIDED + f" SELECT r.request_id, e.id AS statement, {_SAID} AS decision FROM requests r JOIN e ON r.request_id % {len(ASKED)} = e.id", ("sources", "statements", "action_events", "requests"))
def g03(spark, sf):
    """Each request asks one of the statements; all are judged by the gate."""
    d = F.broadcast(_decisions(spark, sf))  # one row a statement
    return view(spark, sf, "requests").join(d, F.col("request_id") % len(ASKED) == F.col("id")).select("request_id", F.col("id").alias("statement"), "decision")


@query("g04_approval_rules", _DECIDED + f""", r AS (SELECT *, CASE WHEN request_id % 2 = 0 THEN 'approve' ELSE 'reject' END AS said FROM requests)
SELECT r.request_id, CASE WHEN r.status <> 'pending' THEN 'CONFLICT' WHEN r.approver = r.user_id THEN 'SELF_APPROVAL' WHEN said = 'reject' THEN 'REJECTED' WHEN cast(substr(r.user_id, 5) AS INT) % 3 <> 0 AND e.sensitive <> '' THEN 'BLOCKED_FOR_REQUESTER' ELSE 'EXECUTED' END AS outcome
FROM r JOIN e ON r.request_id % {len(ASKED)} = e.id WHERE {_SAID} = 'CONFIRM'""", ("sources", "statements", "action_events", "requests"))
def g04(spark, sf):
    """Requests that need a second person: rules first, then each statement through the gate again with the columns that
    the requester may see (every third user: all; others: what is not sensitive), once a statement and kind of user."""
    frames = _frames(spark, sf)
    known = {n: df.columns for n, df in frames.items()}
    plain = {n: df.drop(*SENSITIVE[n]) for n, df in frames.items()}
    rows = [(i, full, analyse(spark, sql, frames if full else plain, known=known).reason is None) for i, sql in enumerate(ASKED) for full in (True, False)]
    again = F.broadcast(spark.createDataFrame(rows, "id int, full boolean, open boolean"))  # two rows a statement
    confirm = F.broadcast(_decisions(spark, sf).where("decision = 'CONFIRM'").select("id"))
    r = view(spark, sf, "requests").withColumns({"id": (F.col("request_id") % len(ASKED)).cast("int"), "full": F.substring("user_id", 5, 9).cast("int") % 3 == 0, "said": F.when(F.col("request_id") % 2 == 0, "approve").otherwise("reject")})
    out = F.when(F.col("status") != "pending", "CONFLICT").when(F.col("approver") == F.col("user_id"), "SELF_APPROVAL").when(F.col("said") == "reject", "REJECTED").when(~F.col("open"), "BLOCKED_FOR_REQUESTER").otherwise("EXECUTED")
    return r.join(confirm, "id").join(again, ["id", "full"]).select("request_id", out.alias("outcome"))


@query("a23_governed_aggregate", "WITH v AS (SELECT c_mktsegment AS segment, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey) SELECT segment, count(*) AS n FROM v GROUP BY segment HAVING count(*) > 10 ORDER BY n DESC, segment LIMIT 500")
def a23(spark, sf):
    sql = "WITH v AS (SELECT c_mktsegment AS segment, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey) SELECT segment, count(*) AS n FROM v GROUP BY segment HAVING count(*) > 10 ORDER BY n DESC, segment"
    reason, rows = run_governed(spark, sql, {"orders": base(spark, sf, "orders").select("o_orderkey", "o_custkey"), "customer": base(spark, sf, "customer").select("c_custkey", "c_mktsegment")})
    if reason:
        raise ValueError(reason)
    return rows


@query("a19_record_hash", """SELECT source_id, sha256('{"name":' || to_json(display_name || ' "a" ' || chr(92) || ' b' || chr(9) || 'c') || ',"size":' || size_bytes || '}') AS content_hash FROM sources""", ("sources",))
def a19(spark, sf):
    """The hash of a record's canonical JSON: keys in order, no spaces, strings escaped. Names hold quotes, backslashes, tabs."""
    name = F.concat("display_name", F.lit(' "a" ' + chr(92) + " b\tc"))
    return view(spark, sf, "sources").select("source_id", F.sha2(F.to_json(F.struct(name.alias("name"), F.col("size_bytes").alias("size"))), 256).alias("content_hash"))


_CLAIM = "CASE WHEN source_id LIKE 'B-%' THEN text || CASE line_no % 7 WHEN 0 THEN ' on 2031-01-01' WHEN 1 THEN ' \"never said here at all\"' WHEN 2 THEN ' \"order\"' WHEN 3 THEN ' \"12-31 Order\"' WHEN 4 THEN ' \"-31 order ' || (line_no - 2) || '\"' ELSE '' END ELSE text END"
_SIDES = f"""s AS (SELECT substr(source_id, 1, 1) AS side, substr(source_id, 3) AS claim, line_no, block_id, {_CLAIM} AS text FROM statements)"""
_WORDS = "' ' || array_to_string(regexp_extract_all(lower({}), '\\w+|[^\\w\\s]'), ' ') || ' '"
_GROUNDED = f"""{_SIDES}, ev AS (SELECT claim, {_WORDS.format("string_agg(text, chr(10) ORDER BY line_no)")} AS ctx FROM s WHERE side = 'A' GROUP BY claim),
en AS (SELECT DISTINCT claim, 'number' AS kind, replace(unnest(regexp_extract_all(text, '{G.NUMBER}', 1)), ',', '') AS v FROM s WHERE side = 'A' UNION ALL SELECT DISTINCT claim, 'date', unnest(regexp_extract_all(text, '{G.DATE}')) FROM s WHERE side = 'A'),
t AS (SELECT block_id, claim, 'number' AS kind, replace(unnest(list_distinct(regexp_extract_all(text, '{G.NUMBER}', 1))), ',', '') AS v FROM s WHERE side = 'B' UNION ALL SELECT block_id, claim, 'date', unnest(list_distinct(regexp_extract_all(text, '{G.DATE}'))) FROM s WHERE side = 'B' UNION ALL SELECT block_id, claim, 'quote', unnest(list_distinct(regexp_extract_all(text, '{G.QUOTE}', 1))) FROM s WHERE side = 'B'),
j AS (SELECT DISTINCT t.block_id, t.claim, t.kind, t.v, CASE WHEN t.kind = 'quote' THEN coalesce(contains(ev.ctx, {_WORDS.format("t.v")}), false) ELSE en.v IS NOT NULL END AS ok FROM t LEFT JOIN en ON t.claim = en.claim AND t.kind = en.kind AND t.v = en.v LEFT JOIN ev ON t.claim = ev.claim),
g AS (SELECT block_id, string_agg(CASE WHEN NOT ok THEN kind || ':' || v END, ',' ORDER BY kind, v) AS issues, round(count_if(ok) / count(*)::DOUBLE, 4) AS score, bool_and(ok) AS grounded FROM j GROUP BY block_id)"""


def _sides(spark, sf):
    s = view(spark, sf, "statements").select(F.substring("source_id", 1, 1).alias("side"), F.expr("substr(source_id, 3)").alias("claim"), "line_no", "block_id", F.expr(_CLAIM).alias("text"))
    s = written(s)  # both sides, and the answers' fields and citations, come of one pass over the orders
    return s.where("side = 'B'"), s.where("side = 'A'")


@query("g05_grounding", f"WITH {_GROUNDED} SELECT block_id, issues, score, grounded FROM g", ("statements",))
def g05(spark, sf):
    """Numbers, dates and quotes that a line of source B states and source A, its evidence, does not hold; quotes over the ends of lines."""
    return G.ground(*_sides(spark, sf))


@query("g05_answers", f"""WITH {_GROUNDED}, b AS (SELECT s.claim, s.block_id, s.line_no, coalesce(g.grounded, true) AS ok, coalesce(g.score, 1) AS score FROM s LEFT JOIN g ON s.block_id = g.block_id WHERE side = 'B'),
c AS (SELECT DISTINCT b.claim, 'A' || substr(block_id, 2) AS id FROM b UNION SELECT claim, 'X-' || line_no % 3 FROM b WHERE line_no % 5 = 0),
v AS (SELECT c.claim, string_agg(CASE WHEN a.block_id IS NOT NULL THEN c.id END, ',' ORDER BY c.id) AS citations, count_if(a.block_id IS NULL) AS dropped FROM c LEFT JOIN s a ON a.block_id = c.id AND a.claim = c.claim AND a.side = 'A' GROUP BY c.claim)
SELECT b.claim, count_if(ok)::BIGINT AS kept, bool_or(NOT ok) AS rejected, (sum(round(score * 10000)::BIGINT) // count(*))::DOUBLE / 10000 AS score, coalesce(any_value(v.citations), '') AS citations, any_value(v.dropped)::BIGINT AS dropped FROM b JOIN v ON b.claim = v.claim GROUP BY b.claim""", ("statements",))
def g05_answers(spark, sf):
    """Source B of a claim as an answer: fields kept, whether it is rejected as a whole, and its citations of source A that exist."""
    said, evidence = _sides(spark, sf)
    cites = F.array_compact(F.array(F.concat(F.lit("A"), F.expr("substr(block_id, 2)")), F.when(F.col("line_no") % 5 == 0, F.concat(F.lit("X-"), F.col("line_no") % 3))))
    return G.answers(said.withColumn("cites", cites), evidence, evidence.select("claim", F.col("block_id").alias("id")))


_T = "CASE h.state || '|' || e.decision " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TRANSITIONS.items()) + " END"
_OK = f"""coalesce({_T} IS NOT NULL AND CASE WHEN e.decision IN ('approve', 'reject') THEN e.actor <> e.drafter WHEN e.decision = 'execute' THEN h.approved_hash = e.content_hash AND epoch(e.ts::TIMESTAMP)::BIGINT - epoch(h.approved_at::TIMESTAMP)::BIGINT <= 604800
  ELSE e.actor = e.drafter OR e.actor = 'user0' END, false)"""


@query("g07_state_machine", f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY action_id ORDER BY seq) AS n FROM action_events),
h AS (SELECT DISTINCT action_id, idempotency_key, 0::BIGINT AS n, 'draft' AS state, NULL::VARCHAR AS approved_hash, NULL::TIMESTAMP AS approved_at, NULL::BIGINT AS executed, 0 AS refused FROM action_events
  UNION ALL SELECT h.action_id, h.idempotency_key, e.n, CASE WHEN x.ok AND x.changed THEN 'in_review' WHEN x.ok THEN x.nxt ELSE h.state END, CASE WHEN x.ok AND e.decision = 'approve' THEN e.content_hash WHEN x.ok AND x.changed THEN NULL ELSE h.approved_hash END,
   CASE WHEN x.ok AND e.decision = 'approve' THEN e.ts::TIMESTAMP WHEN x.ok AND x.changed THEN NULL ELSE h.approved_at END, CASE WHEN x.ok AND e.decision = 'execute' THEN e.seq ELSE h.executed END, h.refused + CASE WHEN x.ok THEN 0 ELSE 1 END
  FROM h JOIN e ON e.action_id = h.action_id AND e.n = h.n + 1, LATERAL (SELECT {_OK} AS ok, {_T} AS nxt, coalesce(e.decision = 'save_edit' AND h.state = 'approved' AND h.approved_hash <> e.content_hash, false) AS changed) x),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY action_id ORDER BY n DESC) AS r FROM h) WHERE r = 1), f AS (SELECT *, min(executed) OVER (PARTITION BY idempotency_key) AS first FROM l)
SELECT action_id, CASE WHEN executed IS NOT NULL AND executed <> first THEN 'approved' ELSE state END AS state, refused::BIGINT AS refused, coalesce(executed = first, false) AS ran FROM f""", ("action_events",))
def g07(spark, sf):
    """The log of each action folded: separation of duties, approval bound to the content, expiry, one execution a key."""
    return fold_actions(view(spark, sf, "action_events"))
