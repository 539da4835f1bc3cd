"""Queries over ranges of cells, periods of grants and address ranges, against SQL that compares all pairs or lists the answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.derive import base, view
from foliospark.functions import addresses
from foliospark.operators import intervals as I
from foliospark.registry import query

#: Ranges written down per cell: blocks of two by two at letters up to XFD, every seventh a whole column, every eleventh a row.
_REF = """CASE WHEN (table_id + row + col) % 7 = 0 THEN {l1} || ':' || {l1} WHEN (table_id + row + col) % 11 = 0 THEN (row + 1) || ':' || (row + 1)
 WHEN (row + col) % 5 = 0 THEN {l2} || (row + 3) || ':' || {l1} || (row + 1) ELSE {l1} || (row + 1) || ':' || {l2} || (row + 2) END"""


def _letters(n: str) -> str:
    """Letters of column number n (1 to 18278)."""
    c = lambda x: f"chr(cast(65 + {x} AS int))"
    return f"(CASE WHEN {n} > 702 THEN {c(f'(({n}) - 703) {{div}} 676')} ELSE '' END || CASE WHEN {n} > 26 THEN {c(f'((({n}) - 27) {{div}} 26) % 26')} ELSE '' END || {c(f'(({n}) - 1) % 26')})"


#: The column number of a cell's range, and that of its other end.
_COLUMN = "(1 + (col * 25 + (table_id % 3) * 350) * (1 + table_id % 5))"
_SECOND = "(n + 1 + row % 40)"


def _refs(div: str) -> str:
    n = _COLUMN
    return _REF.format(l1=_letters(n), l2=_letters(f"({n} + 1 + row % 40)")).replace("{div}", div)


@query("j21_range_overlap", f"""WITH a AS (SELECT table_id, row * 10 + col AS id, {_refs('//')} AS ref, 1 + (col * 25 + (table_id % 3) * 350) * (1 + table_id % 5) AS n FROM cells),
r AS (SELECT c.table_id, a.id, a.ref, CASE WHEN (c.table_id + row + col) % 7 = 0 THEN n WHEN (c.table_id + row + col) % 11 = 0 THEN 1 ELSE n END AS c1,
  CASE WHEN (c.table_id + row + col) % 7 = 0 THEN n WHEN (c.table_id + row + col) % 11 = 0 THEN 16384 ELSE n + 1 + row % 40 END AS c2,
  CASE WHEN (c.table_id + row + col) % 7 = 0 THEN 1 ELSE row + 1 END AS r1,
  CASE WHEN (c.table_id + row + col) % 7 = 0 THEN 1048576 WHEN (c.table_id + row + col) % 11 = 0 THEN row + 1 WHEN (row + col) % 5 = 0 THEN row + 3 ELSE row + 2 END AS r2
  FROM a JOIN cells c ON a.table_id = c.table_id AND a.id = c.row * 10 + c.col)
SELECT a.table_id, a.id, a.ref, count(*) AS overlapping FROM r a JOIN r b ON a.table_id = b.table_id AND a.r1 <= b.r2 AND b.r1 <= a.r2 AND a.c1 <= b.c2 AND b.c1 <= a.c2 GROUP BY a.table_id, a.id, a.ref""", ("cells",))
def j21(spark, sf):
    """How many ranges of its table each range overlaps; bounds are read off the written references."""
    cells = view(spark, sf, "cells").select("table_id", "row", "col", F.expr(_COLUMN).alias("n"))
    # letters are spelled once, behind a generator, as `_refs` names them eight times
    cells = cells.select("table_id", "row", "col", F.inline(F.array(F.struct(F.expr(_letters("n").replace("{div}", "div")).alias("l1"), F.expr(_letters(_SECOND).replace("{div}", "div")).alias("l2")))))
    refs = cells.select("table_id", (F.col("row") * 10 + F.col("col")).alias("id"), F.expr(_REF.format(l1="l1", l2="l2")).alias("ref"))
    return I.overlap_counts(I.with_bounds(refs, "ref"), ["table_id"], ["ref"])


@query("j22_active_grants", """WITH g AS (SELECT user_id, resource, col, valid_until - grant_id % 400 AS valid_from, valid_until FROM grants), t AS (SELECT unnest(range(0, 1000, 8)) AS as_of),
c AS (SELECT as_of, user_id, resource, col, count(*) FILTER (valid_from <= as_of AND as_of < valid_until) AS active, count(*) FILTER (valid_until <= as_of) AS expired FROM g, t WHERE valid_from < valid_until GROUP BY ALL)
SELECT as_of, user_id, resource, sum(active)::BIGINT AS active, sum(expired)::BIGINT AS expired, coalesce(string_agg(col, ',' ORDER BY col) FILTER (active > 0), '') AS active_items FROM c GROUP BY ALL HAVING sum(active) + sum(expired) > 0""", ("grants",))
def j22(spark, sf):
    """Active and expired grants of each user and resource at 125 times."""
    g = view(spark, sf, "grants").withColumn("valid_from", F.col("valid_until") - F.col("grant_id") % 400)
    return I.active_at(g, spark.range(0, 1000, 8).select(F.col("id").alias("as_of")), who=["user_id", "resource"], item="col", start="valid_from", end="valid_until")


#: What every second page links to, and what is to be said of it.
LINKS = (
    ("http://10.1.2.3/a", "NON_PUBLIC"), ("https://[::1]:8080/", "NON_PUBLIC"), ("http://[0:0:0:0:0:0:0:1]/", "NON_PUBLIC"), ("http://[::ffff:7f00:1]/", "NON_PUBLIC"), ("http://[::ffff:192.168.1.1]/", "NON_PUBLIC"), ("http://127.1/", "NON_PUBLIC"),
    ("http://2130706433/x", "NON_PUBLIC"), ("http://0x7f.0.0.1/", "NON_PUBLIC"), ("http://017700000001/", "NON_PUBLIC"), ("http://[fe80::1%25eth0]/", "NON_PUBLIC"), ("http://100.64.0.9/", "NON_PUBLIC"), ("http://user@224.0.0.1/", "NON_PUBLIC"),
    ("http://[64:FF9B:1::5]/", "NON_PUBLIC"), ("http://192.0.0.8/", "NON_PUBLIC"), ("http://192.0.0.9/", "OK"), ("http://8.8.8.8/dns", "OK"), ("https://[2a00:1450::1]/", "OK"), ("http://134744072/", "OK"), ("http://[2001:20::7]/", "OK"), ("http://[::ffff:808:808]/", "OK"),
    ("http://256.1.1.1/", "BAD_ADDRESS"), ("http://[1::2::3]/", "BAD_ADDRESS"), ("http://1.2.3.4.5/", "BAD_ADDRESS"), ("ftp://files.org/x", "SCHEME"), ("http://a.blocked.example/", "DENIED"), ("http:///nohost", "NO_HOST"), ("http://intranet/", "NOT_ALLOWED"), ("http://a.localhost./", "NOT_ALLOWED"),
)
_HOST = r"lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]*)', 1))"


@query("g11_url_screen", f"""WITH l AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{u}', '{v}')" for k, (u, v) in enumerate(LINKS))}) AS v(k, url, verdict))
SELECT page_id, l.url, l.verdict FROM pages JOIN l ON page_id % {2 * len(LINKS)} = 2 * l.k UNION ALL
SELECT page_id, url, CASE WHEN NOT regexp_matches(lower(url), '^https?://') THEN 'SCHEME' WHEN {_HOST} = '' THEN 'NO_HOST' WHEN regexp_matches({_HOST}, '(^|[.])(example[.]net|blocked[.]example)$') THEN 'DENIED' WHEN NOT regexp_matches({_HOST}, '(^|[.])(org|com|net|example)$') THEN 'NOT_ALLOWED' ELSE 'OK' END FROM pages WHERE page_id % 2 = 1""")
def g11(spark, sf):
    """URLs of pages, every other one replaced by a link in some spelling of an address."""
    at = F.element_at(F.array(*[F.lit(u) for u, _ in LINKS]), (F.col("page_id") % (2 * len(LINKS)) / 2 + 1).cast("int"))
    pages = base(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, at).otherwise(F.col("url")).alias("url"))
    return pages.withColumn("verdict", addresses.screen(F.col("url"), ("example.net", "blocked.example"), ("org", "com", "net", "example"))[1])
