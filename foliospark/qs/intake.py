"""Queries over intake, text checks and names: derived contents vary what the given texts do not."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.derive import base, view
from foliospark.functions import scalars as S
from foliospark.functions.checks import text_checks
from foliospark.functions.text import nfkc
from foliospark.registry import query
from foliospark.sources import intake as files
from foliospark.sources.documents import flatten_blocks


def _headed(key: str, text: str) -> str:
    """SQL of both dialects: the text with one of several heads, by key."""
    return f"CASE {key} % 8 WHEN 0 THEN '%PDF-1.4 ' WHEN 1 THEN '#!/bin/sh ' WHEN 2 THEN ' <!DOCTYPE html>' WHEN 3 THEN 'Subject: ' WHEN 4 THEN '<?xml?>' ELSE '' END || coalesce({text}, '')"


_SNIFF = """CASE WHEN c LIKE '!%PDF%' ESCAPE '!' THEN 'application/pdf' WHEN c LIKE '#!%' THEN 'application/x-executable' WHEN regexp_matches(lower(c), '^\\s*(<!doctype html|<html)') THEN 'text/html'
 WHEN regexp_matches(lower(c), '^\\s*<[?]xml') THEN 'application/xml' WHEN regexp_matches(lower(c), '^\\s*(from|received|mime-version|return-path|date|subject):') THEN 'message/rfc822'
 WHEN ext = 'csv' AND regexp_matches(c, '\\S') THEN 'text/csv' WHEN ext = 'md' AND regexp_matches(c, '\\S') THEN 'text/markdown' WHEN regexp_matches(c, '\\S') THEN 'text/plain' END"""


@query("s01_intake_manifest", f"""WITH s AS (SELECT source_id, page_count, lower(regexp_extract(display_name, '[.]([^.]*)$', 1)) AS ext, {_headed('source_id', 'text')} AS c FROM sources),
m AS (SELECT *, CASE WHEN c <> '' THEN {_SNIFF} END AS mime FROM s), x AS (SELECT *, NOT coalesce(CASE mime WHEN 'application/pdf' THEN ext = 'pdf' WHEN 'text/csv' THEN ext = 'csv' WHEN 'text/markdown' THEN ext = 'md' WHEN 'text/plain' THEN ext = 'txt' ELSE false END, false) AS wrong FROM m),
k AS (SELECT *, CASE WHEN c = '' THEN 'EMPTY_FILE' WHEN strlen(c) > 52428800 THEN 'TOO_LARGE' WHEN mime IS NULL OR mime = 'application/x-executable' THEN 'UNSUPPORTED_FORMAT' WHEN wrong AND mime <> 'application/pdf' THEN 'FORMAT_MISMATCH' WHEN page_count > 1000 THEN 'TOO_LARGE' END AS code FROM x)
SELECT source_id, mime, code, CASE WHEN code IS NULL THEN 'accepted' ELSE 'rejected' END AS status, CASE WHEN code IS NULL AND wrong THEN 'FILE_EXTENSION_MISMATCH' END AS warning FROM k""", ("sources",))
def s01(spark, sf):
    s = view(spark, sf, "sources").select("source_id", "display_name", "page_count", F.encode(F.expr(_headed("source_id", "text")), "UTF-8").alias("content"))
    return files.manifest(s, pages="page_count").select("source_id", F.col("detected_mime").alias("mime"), "code", "status", "warning")


@query("s02_sniff_type", f"WITH p AS (SELECT page_id, 'html' AS ext, {_headed('page_id', 'html')} AS c FROM pages) SELECT page_id, {_SNIFF} AS mime FROM p")
def s02(spark, sf):
    return base(spark, sf, "pages").select("page_id", files.sniff(F.encode(F.expr(_headed("page_id", "html")), "UTF-8"), F.lit("html")).alias("mime"))


@query("s03_extension_mismatch", f"""WITH s AS (SELECT source_id, lower(regexp_extract(display_name, '[.]([^.]*)$', 1)) AS ext, {_headed('source_id', 'text')} AS c FROM sources), m AS (SELECT source_id, ext, CASE WHEN c <> '' THEN {_SNIFF} END AS mime FROM s)
SELECT source_id, mime, CASE WHEN mime IS NULL OR mime = 'application/x-executable' THEN 'unknown' WHEN coalesce(CASE mime WHEN 'application/pdf' THEN ext = 'pdf' WHEN 'text/csv' THEN ext = 'csv' WHEN 'text/markdown' THEN ext = 'md' WHEN 'text/plain' THEN ext = 'txt' ELSE false END, false) THEN 'match' WHEN mime = 'application/pdf' THEN 'warn' ELSE 'reject' END AS verdict FROM m""", ("sources",))
def s03(spark, sf):
    """What the bytes say against the name: a strong type outweighs a wrong extension, a weak one is refused with it."""
    s = view(spark, sf, "sources").select("source_id", files.extension(F.col("display_name")).alias("ext"), F.encode(F.expr(_headed("source_id", "text")), "UTF-8").alias("c"))
    return s.select("source_id", files.sniff(F.col("c"), F.col("ext")).alias("mime"), "ext").select("source_id", "mime", files.extension_verdict(F.col("mime"), F.col("ext")).alias("verdict"))


@query("s13_flatten_blocks", "SELECT source_id, page_number, line_no, text FROM spans", ("spans",))
def s13(spark, sf):
    """Documents as nested pages of blocks, flattened to one row a block."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    page = lambda p: F.struct((p + 1).cast("bigint").alias("page_number"), F.transform(F.slice(lines, p * 40 + 1, F.lit(40)), lambda t, k: F.struct((p * 40 + k).cast("bigint").alias("line_no"), t.alias("text"))).alias("blocks"))
    nested = base(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 40).cast("int")), page).alias("pages"))
    return flatten_blocks(nested).where("text <> ''")


@query("f16_normal", "SELECT p_partkey, lower(trim(regexp_replace(p_name || ' ½ ﬁn  Ａ' , '\\s+', ' ', 'g'))) AS folded, replace(replace(replace(regexp_replace(trim(p_name), '\\s+', ' ', 'g') || ' ½ ﬁn Ａ', '½', '1⁄2'), 'ﬁ', 'fi'), 'Ａ', 'A') AS nfkc FROM part")
def f16(spark, sf):
    t = F.concat("p_name", F.lit(" ½ ﬁn  Ａ"))
    return base(spark, sf, "part").select("p_partkey", S.normal(t).alias("folded"), nfkc(t).alias("nfkc"))


def _garbled(key: str) -> str:
    """SQL of both dialects: in one text of seven a letter became a replacement character, in another a private one."""
    return f"CASE {key} % 7 WHEN 1 THEN replace(text, 'e', '\ufffd') WHEN 4 THEN replace(text, 'a', '\ue000') ELSE text END"


_BAD = "[\\x{E000}-\\x{F8FF}\\x{FFFD}]"


@query("a20_page_garbage", f"""WITH g AS (SELECT source_id, page_number, {_garbled('source_id')} AS t FROM spans), p AS (SELECT source_id, page_number, sum(length(t) - length(regexp_replace(t, '{_BAD}', '', 'g'))) AS bad, sum(length(t)) AS n FROM g GROUP BY ALL)
SELECT source_id, page_number, round(bad / n::DOUBLE, 8) AS garbage_ratio, bad / n::DOUBLE <= 0.2 AS usable FROM p""", ("spans",))
def a20(spark, sf):
    t = view(spark, sf, "spans").select("source_id", "page_number", F.expr(_garbled("source_id")).alias("t"))
    p = t.groupBy("source_id", "page_number").agg(F.sum(S.garbage_count(F.col("t"))).alias("bad"), F.sum(F.length("t")).alias("n"))
    return p.select("source_id", "page_number", F.round(F.col("bad") / F.col("n"), 8).alias("garbage_ratio"), (F.col("bad") / F.col("n") <= 0.2).alias("usable"))


@query("f19_garbage", f"""WITH g AS (SELECT doc_id, coalesce({_garbled('doc_id')}, '') AS t FROM documents), r AS (SELECT doc_id, coalesce((length(t) - length(regexp_replace(t, '{_BAD}', '', 'g'))) / nullif(length(t), 0)::DOUBLE, 0) AS r FROM g)
SELECT doc_id, round(r, 8) AS garbage, round(1 - least(1, 3 * r), 4) AS confidence FROM r""")
def f19(spark, sf):
    r = S.garbage_ratio(F.coalesce(F.expr(_garbled("doc_id")), F.lit("")))
    return base(spark, sf, "documents").select("doc_id", r.alias("r")).select("doc_id", F.round("r", 8).alias("garbage"), F.round(1 - F.least(F.lit(1.0), 3 * F.col("r")), 4).alias("confidence"))


_TEXT = "text || CASE line_no % 5 WHEN 0 THEN ' from 1995-12-31 to 1/2/1994' WHEN 1 THEN ' or 1,00,000' WHEN 2 THEN ' is 1200%' WHEN 3 THEN ' on 31/02/2020' ELSE '' END"


@query("f11_text_checks", f"""WITH s AS (SELECT block_id, {_TEXT} AS t FROM statements),
d AS (SELECT *, list_concat(list_transform(regexp_extract_all(t, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b'), lambda x: TRY_CAST(x AS DATE)), list_transform(regexp_extract_all(t, '\\b\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}\\b'), lambda x: TRY_CAST(split_part(x, '/', 3) || '-' || lpad(split_part(x, '/', 2), 2, '0') || '-' || lpad(split_part(x, '/', 1), 2, '0') AS DATE))) AS dates FROM s),
v AS (SELECT *, list_filter(dates, lambda x: x IS NOT NULL) AS valid FROM d)
SELECT block_id, array_to_string(list_filter([CASE WHEN len(dates) > 0 THEN 'date_validity:' || CASE WHEN len(dates) = len(valid) THEN 'pass' ELSE 'fail' END END,
 CASE WHEN regexp_matches(t, '(?i)\\b(from|between)\\b.*\\b(to|and)\\b') AND len(valid) >= 2 THEN 'date_ordering:' || CASE WHEN valid[1] <= valid[2] THEN 'pass' ELSE 'fail' END END,
 CASE WHEN regexp_matches(t, '\\b\\d{{1,3}},\\d{{1,2}}(,\\d{{3}})*([^\\d]|$)|\\d+,,\\d+|\\d+[.]\\d+[.]\\d+') THEN 'currency_format:warn' END,
 CASE WHEN regexp_matches(t, '(^|[^\\w.])\\d[\\d,]*([.]\\d+)?([^\\w]|$)') THEN 'unit_sanity:' || CASE WHEN t LIKE '%1200!%%' ESCAPE '!' THEN 'warn' ELSE 'pass' END END], lambda x: x IS NOT NULL), ',') AS checks FROM v""", ("statements",))
def f11(spark, sf):
    c = F.transform(text_checks(F.expr(_TEXT)), lambda x: F.concat_ws(":", x["name"], x["status"]))
    return view(spark, sf, "statements").select("block_id", F.array_join(c, ",").alias("checks"))


@query("f13_luhn", """WITH d AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(coalesce(text, ''), '\\b(?:\\d[ -]?){13,19}\\b')), '\\D', '', 'g') AS digits FROM documents)
SELECT doc_id, digits, list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN digits[length(digits) - i + 1]::INT WHEN digits[length(digits) - i + 1]::INT > 4 THEN 2 * digits[length(digits) - i + 1]::INT - 9 ELSE 2 * digits[length(digits) - i + 1]::INT END)) % 10 = 0 AS ok FROM d""")
def f13(spark, sf):
    d = base(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\b(?:\d[ -]?){13,19}\b"), F.lit(0))).alias("raw"))
    n = F.regexp_replace("raw", r"\D", "")
    return d.select("doc_id", n.alias("digits"), F.call_function("luhn_check", n).alias("ok"))


_SPELT = "CASE (table_id + row + col) % 6 WHEN 1 THEN '(' || raw_text || ')' WHEN 2 THEN '-' || raw_text WHEN 3 THEN raw_text || '.25' WHEN 4 THEN ' (' || raw_text || '.5)' WHEN 5 THEN '$' || raw_text ELSE raw_text END"


@query("f02_cell_numbers", f"""WITH c AS (SELECT table_id, row, col, raw_text AS raw, (table_id + row + col) % 6 AS k, {_SPELT} AS text FROM cells),
n AS (SELECT *, CASE WHEN regexp_matches(raw, '^[0-9,]+$') THEN replace(raw, ',', '')::DECIMAL(38,10) WHEN regexp_matches(raw, '^[0-9]+%$') AND k NOT IN (1, 3, 4) THEN replace(raw, '%', '')::DECIMAL(38,10) END AS v FROM c)
SELECT table_id, row, col, text, CASE k WHEN 1 THEN -v WHEN 2 THEN -v WHEN 3 THEN v + 0.25 WHEN 4 THEN -(v + 0.5) WHEN 5 THEN NULL ELSE v END::DECIMAL(38,10) AS value,
 CASE WHEN v IS NULL OR k = 5 THEN NULL WHEN raw LIKE '%!%' ESCAPE '!' THEN 'percent_strip' WHEN k IN (1, 4) THEN 'parentheses_negative' WHEN raw LIKE '%,%' THEN 'strip_thousands_separator' ELSE 'plain_number' END AS rule FROM n""".replace("'%!%' ESCAPE '!'", "'%!%' ESCAPE '!'"), ("cells",))
def f02(spark, sf):
    """Cells spelt plainly, in parentheses, with a minus, with decimals, and with a currency sign, which makes them no number."""
    c = view(spark, sf, "cells").withColumn("text", F.expr(_SPELT))
    return c.withColumn("n", S.cell_number(F.col("text"))).select("table_id", "row", "col", "text", "n.value", "n.rule")


@query("f21_cell_names", "SELECT table_id, row, col * 9 AS col, CASE WHEN col * 9 >= 26 THEN chr(64 + (col * 9 // 26)::INT) ELSE '' END || chr(65 + (col * 9 % 26)::INT) || (row + 1) AS name, col * 9 AS back FROM cells", ("cells",))
def f21(spark, sf):
    c = view(spark, sf, "cells").select("table_id", "row", (F.col("col") * 9).alias("col"))
    c = c.withColumn("name", S.a1(F.col("row"), F.col("col")))
    return c.withColumn("back", S.a1_col(F.col("name")).cast("bigint"))


_NAME = "'in/' || substr(text, 1, 40 + cast(doc_id % 120 AS int)) || CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.very-long-extension' ELSE '' END"


@query("f22_file_names", f"""WITH p AS (SELECT doc_id, list_last(string_split_regex(coalesce({_NAME}, ''), '[\\\\/]')) AS n FROM documents),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(n, '[\\p{{Cc}}\\p{{Cf}}\\p{{Co}}]', '', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}_.\\- ()]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') AS n FROM p),
k AS (SELECT doc_id, n, regexp_extract(n, '^(.*)[.][^.]*$', 1) AS stem, regexp_extract(n, '[.]([^.]*)$', 1) AS ext FROM c)
SELECT doc_id, CASE WHEN n = '' THEN 'file' WHEN length(n) <= 120 THEN n WHEN stem <> '' THEN substr(stem, 1, 100) || '.' || substr(ext, 1, 10) ELSE substr(n, 1, 120) END AS name FROM k""")
def f22(spark, sf):
    return base(spark, sf, "documents").select("doc_id", S.file_name(F.expr(_NAME)).alias("name"))


@query("f16_normal_text", "SELECT doc_id, sha256(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))) AS h FROM documents")
def f16(spark, sf):
    return base(spark, sf, "documents").select("doc_id", F.sha2(S.normal(F.coalesce("text", F.lit(""))), 256).alias("h"))
