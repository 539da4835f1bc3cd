"""Facts, comparisons, findings, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.derive import base, view
from foliospark.functions import scalars as S
from foliospark.operators import reasoning as R
from foliospark.registry import query
from foliospark.tables import written

L = R.LINE.replace("'", "''")
D = R.DATELINE.replace("'", "''")
_AMOUNT = """CASE WHEN t LIKE '(%)' OR t LIKE '-%' THEN -1 ELSE 1 END * try_cast(replace(regexp_replace(t, '^[()\\-]+|[()\\-]+$', '', 'g'), ',', '') AS DECIMAL(18,4)) * CASE lower(mult) WHEN 'k' THEN 1000::DECIMAL(10,0)
  WHEN 'lakh' THEN 100000 WHEN 'lakhs' THEN 100000 WHEN 'crore' THEN 10000000 WHEN 'crores' THEN 10000000 WHEN 'million' THEN 1000000 WHEN 'm' THEN 1000000 ELSE 1 END"""
_RULE = """CASE lower(mult) WHEN 'k' THEN 'NUM_MULT_K' WHEN 'lakh' THEN 'NUM_MULT_LAKH' WHEN 'lakhs' THEN 'NUM_MULT_LAKH' WHEN 'crore' THEN 'NUM_MULT_CRORE' WHEN 'crores' THEN 'NUM_MULT_CRORE' WHEN 'million' THEN 'NUM_MULT_MILLION' WHEN 'm' THEN 'NUM_MULT_MILLION'
  ELSE CASE WHEN t LIKE '(%)' THEN 'NUM_PARENS_NEGATIVE' WHEN t LIKE '%,%' THEN 'NUM_THOUSANDS_COMMA' ELSE 'NUM_PLAIN' END END"""
_PLAIN = "regexp_replace(cast(cast({} AS DECIMAL(38,10)) AS VARCHAR), '\\.?0+$', '')"
_ISO = """try_cast(CASE WHEN regexp_full_match(d, '\\d{4}-\\d{2}-\\d{2}') THEN d ELSE regexp_extract(d, '[/.](\\d{4})$', 1) || '-' || lpad(regexp_extract(d, '^\\d+[/.](\\d+)', 1), 2, '0') || '-' || lpad(regexp_extract(d, '^(\\d+)', 1), 2, '0') END AS DATE)"""
_CAT = "CASE " + " ".join(f"WHEN regexp_matches(lower(label), '{'|'.join(w)}') THEN '{c}'" for c, w in S.CATEGORIES) + " END"
_BASIS = "CASE WHEN lower(label) LIKE '%gross%' THEN 'gross' WHEN regexp_matches(lower(label), '\\bnet\\b|take.?home') THEN 'net' ELSE 'unknown' END"
_FREQ = "CASE WHEN lower(freq) LIKE '%month%' THEN 'monthly' WHEN lower(freq) LIKE '%week%' THEN 'weekly' WHEN freq <> '' THEN 'annual' " + " ".join(f"WHEN lower(label) LIKE '%{k}%' THEN '{v}'" for k, v in S.FREQUENCIES) + " END"
_CUR = "CASE lower(cur) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.CURRENCIES.items()) + " END"
#: The fact tables as common table expressions over `statements`.
FACTS = f"""h AS MATERIALIZED (SELECT case_id, source_id, trim(arg_min(s, line_no) FILTER (s <> '')) AS subject, try_cast(arg_min(a, line_no) FILTER (a <> '') AS DATE) AS ps, try_cast(arg_min(b, line_no) FILTER (b <> '') AS DATE) AS pe
  FROM (SELECT *, regexp_extract(text, '{R.SUBJECT}', 2) AS s, regexp_extract(text, '{R.PERIOD}', 1) AS a, regexp_extract(text, '{R.PERIOD}', 2) AS b FROM statements) GROUP BY ALL),
g AS MATERIALIZED (SELECT *, regexp_matches(text, '{D}') AS dated, regexp_extract(text, '{L}', 1) AS label, regexp_extract(text, '{L}', 2) AS approx, regexp_extract(text, '{L}', 3) AS cur, trim(regexp_extract(text, '{L}', 4)) AS t,
  regexp_extract(text, '{L}', 5) AS num2, regexp_extract(text, '{L}', 6) AS mult, regexp_extract(text, '{L}', 7) AS pct, regexp_extract(text, '{L}', 8) AS freq FROM statements),
n AS MATERIALIZED (SELECT case_id, source_id, block_id, block_confidence, label, CASE WHEN num2 <> '' THEN t || '-' || num2 ELSE t END AS raw_value, CASE WHEN num2 = '' THEN {_PLAIN.format(_AMOUNT)} END AS normalized_value,
  CASE WHEN num2 <> '' THEN 'RANGE_ABSTAIN' WHEN pct <> '' THEN 'PCT_STRIP' ELSE {_RULE} END AS rule, CASE WHEN pct <> '' THEN 'percent' END AS unit, {_CUR} AS currency, {_FREQ} AS frequency, true AS hp,
  list_filter([CASE WHEN num2 <> '' THEN '{R.RANGED}' END, CASE WHEN approx <> '' THEN '{R.APPROXIMATE}' END, CASE WHEN cur = '$' THEN '{R.BARE_DOLLAR}' END], lambda x: x IS NOT NULL) AS notes FROM g WHERE NOT dated AND regexp_matches(text, '{L}') AND length(trim(label)) >= 3
  UNION ALL SELECT case_id, source_id, block_id, block_confidence, label, d, {_ISO}::VARCHAR, CASE WHEN regexp_matches(d, '^[0-9]{{4}}-') THEN 'DATE_ISO' ELSE 'DATE_DMY' END, 'date', NULL, NULL, false, CASE WHEN {_ISO} IS NULL THEN ['{R.NO_DAY}'] ELSE [] END
  FROM (SELECT *, regexp_extract(text, '{D}', 1) AS label, regexp_extract(text, '{D}', 2) AS d FROM (SELECT case_id, source_id, block_id, block_confidence, text, dated FROM g) WHERE dated)),
facts AS MATERIALIZED (SELECT substr(sha256(n.case_id || '|' || n.source_id || '|' || block_id || '|' || lower(regexp_replace(trim(label), '\\s+', ' ', 'g')) || '|' || raw_value), 1, 16) AS fact_id, n.case_id, n.source_id, block_id,
  coalesce(subject, 'unknown') AS subject, lower(regexp_replace(trim(label), '\\s+', ' ', 'g')) AS metric, raw_value, normalized_value, rule, unit, currency, frequency, CASE WHEN hp THEN ps END AS period_start, CASE WHEN hp THEN pe END AS period_end,
  {_CAT} AS category, {_BASIS} AS basis, len(notes) + (subject IS NULL)::INT AS n_notes, CASE WHEN subject IS NULL THEN list_prepend('{R.NO_SUBJECT}', notes) ELSE notes END AS notes, round(block_confidence * CASE WHEN len(notes) + (subject IS NULL)::INT > 0 THEN 0.8 ELSE 1.0 END, 4) AS confidence FROM n LEFT JOIN h USING (case_id, source_id))"""
PAIRS = FACTS + """,
v AS MATERIALIZED (SELECT * FROM facts WHERE normalized_value IS NOT NULL),
p AS MATERIALIZED (SELECT a.case_id, a.metric, a AS a, b AS b FROM v a JOIN v b ON a.case_id = b.case_id AND lower(a.subject) = lower(b.subject) AND a.metric = b.metric AND a.source_id < b.source_id),
k AS MATERIALIZED (SELECT *, list_filter([CASE WHEN a.currency IS DISTINCT FROM b.currency THEN 'same_currency' END, CASE WHEN a.frequency IS DISTINCT FROM b.frequency THEN 'compatible_frequency' END,
  CASE WHEN (a.period_start IS NOT NULL OR b.period_start IS NOT NULL) AND NOT coalesce(abs(date_diff('day', a.period_start, b.period_start)) <= 5 AND abs(date_diff('day', a.period_end, b.period_end)) <= 5, false) THEN 'compatible_period' END,
  CASE WHEN a.basis IS DISTINCT FROM b.basis THEN 'same_basis' END, CASE WHEN a.category IS DISTINCT FROM b.category THEN 'same_category' END], lambda x: x IS NOT NULL) AS failed FROM p),
d AS MATERIALIZED (SELECT *, CASE WHEN a.unit = 'date' THEN abs(date_diff('day', try_cast(a.normalized_value AS DATE), try_cast(b.normalized_value AS DATE)))::DECIMAL(38,10) ELSE abs(try_cast(a.normalized_value AS DECIMAL(28,10)) - try_cast(b.normalized_value AS DECIMAL(28,10)))::DECIMAL(38,10) END AS abs_diff FROM k WHERE len(failed) = 0),
e AS MATERIALIZED (SELECT *, round(CASE WHEN a.unit = 'date' THEN CASE WHEN abs_diff = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END ELSE coalesce(abs_diff::DOUBLE / nullif(greatest(abs(try_cast(a.normalized_value AS DOUBLE)), abs(try_cast(b.normalized_value AS DOUBLE))), 0) * 100, 0) END, 4) AS pct_diff FROM d)"""
FACT_COLS = ["fact_id", "case_id", "source_id", "block_id", "subject", "metric", "raw_value", "normalized_value", "rule", "unit", "currency", "frequency", "period_start", "period_end", "category", "basis", "confidence"]
V = ("statements",)


def facts(spark, sf):
    return R.line_facts(view(spark, sf, "statements"))


def pairs(spark, sf):
    """Facts are written once and read for both sides."""
    return R.pairs(written(facts(spark, sf)))


@query("f06_line_facts", f"WITH {FACTS} SELECT {', '.join(FACT_COLS)}, n_notes FROM facts", V)
def f06(spark, sf):
    return facts(spark, sf).select(*FACT_COLS, F.size("notes").alias("n_notes"))


@query("f01_amounts", f"WITH {FACTS} SELECT block_id, cast({_AMOUNT} AS DOUBLE) AS value, {_RULE} AS rule FROM g WHERE t <> '' AND NOT dated", V)
def f01(spark, sf):
    s = view(spark, sf, "statements").where(~F.col("text").rlike(R.DATELINE)).select("block_id", F.regexp_extract("text", R.LINE, 4).alias("t"), F.regexp_extract("text", R.LINE, 6).alias("m")).where("t <> ''")
    a = S.amount(F.col("t"), F.col("m"))
    return s.select("block_id", a["value"].cast("double").alias("value"), a["rule"].alias("rule"))


@query("f04_dates", f"SELECT block_id, {_ISO}::VARCHAR AS iso FROM (SELECT block_id, regexp_extract(text, '{D}', 2) AS d FROM statements) WHERE d <> ''", V)
def f04(spark, sf):
    return view(spark, sf, "statements").select("block_id", F.regexp_extract("text", R.DATELINE, 2).alias("d")).where("d <> ''").select("block_id", S.to_iso(F.col("d")).cast("string").alias("iso"))


_DMY = "lpad(regexp_extract({0}, '^\\d+[/.](\\d+)', 1), 2, '0') || '-' || lpad(regexp_extract({0}, '^(\\d+)', 1), 2, '0')"


@query("f05_dates_in_text", f"""WITH x AS (SELECT source_id, unnest(list_concat(regexp_extract_all(text, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b'), list_transform(regexp_extract_all(text, '\\b\\d{{1,2}}[/.]\\d{{1,2}}[/.]\\d{{4}}\\b'), lambda d: regexp_extract(d, '(\\d{{4}})$', 1) || '-' || {_DMY.format('d')}))) AS d FROM statements)
SELECT source_id, list_sort(list_distinct(list(d))) AS dates FROM x WHERE try_cast(d AS DATE) IS NOT NULL GROUP BY source_id""", V)
def f05(spark, sf):
    found = view(spark, sf, "statements").select("source_id", F.explode(S.dates_in(F.col("text"))).alias("d"))
    return found.groupBy("source_id").agg(F.array_sort(F.collect_set(F.col("d").cast("string"))).alias("dates"))


@query("f08_classifiers", f"WITH {FACTS} SELECT block_id, {_CAT} AS category, {_BASIS} AS basis, {_FREQ} AS frequency FROM g WHERE label <> ''", V)
def f08(spark, sf):
    label, freq = F.regexp_extract("text", R.LINE, 1), F.regexp_extract("text", R.LINE, 8)
    return view(spark, sf, "statements").where(label != "").select("block_id", S.category(label).alias("category"), S.basis(label).alias("basis"), S.frequency(label, freq).alias("frequency"))


@query("f09_currency", f"WITH {FACTS} SELECT block_id, {_CUR} AS currency, cur = '$' AS ambiguous FROM g WHERE cur <> ''", V)
def f09(spark, sf):
    cur = F.regexp_extract("text", R.LINE, 3)
    return view(spark, sf, "statements").where(cur != "").select("block_id", S.currency(cur).alias("currency"), (cur == "$").alias("ambiguous"))


@query("f10_stable_ids", "SELECT block_id, substr(sha256(case_id || '|' || source_id), 1, 16) AS link_id, substr(sha256(source_id || '|' || block_id || '|table'), 1, 16) AS table_id FROM statements", V)
def f10(spark, sf):
    return view(spark, sf, "statements").select("block_id", S.stable_id("case_id", "source_id").alias("link_id"), S.stable_id("source_id", "block_id", F.lit("table")).alias("table_id"))


@query("a15_subject_period", f"WITH {FACTS} SELECT case_id, source_id, subject, ps AS period_start, pe AS period_end FROM h", V)
def a15(spark, sf):
    return R.heads(view(spark, sf, "statements"))


@query("j10_fact_pairs", f"WITH {PAIRS} SELECT case_id, metric, a.fact_id AS fact_a, b.fact_id AS fact_b FROM p", V)
def j10(spark, sf):
    return pairs(spark, sf).select("case_id", "metric", F.col("a.fact_id").alias("fact_a"), F.col("b.fact_id").alias("fact_b"))


@query("j11_comparability", f"WITH {PAIRS} SELECT a.fact_id AS fact_a, b.fact_id AS fact_b, array_to_string(failed, ',') AS failed, len(failed) = 0 AS comparable FROM k", V)
def j11(spark, sf):
    return R.checked(pairs(spark, sf)).select(F.col("a.fact_id").alias("fact_a"), F.col("b.fact_id").alias("fact_b"), F.array_join("failed", ",").alias("failed"), (F.size("failed") == 0).alias("comparable"))


@query("j12_not_comparable", f"WITH {PAIRS} SELECT a.fact_id AS fact_a, b.fact_id AS fact_b, metric, 'Not comparable: ' || array_to_string(failed, '; ') AS reason FROM k WHERE len(failed) > 0", V)
def j12(spark, sf):
    return R.not_comparable(pairs(spark, sf)).select(F.col("a.fact_id").alias("fact_a"), F.col("b.fact_id").alias("fact_b"), "metric", "reason")


@query("f23_differences", f"WITH {PAIRS} SELECT a.fact_id AS fact_a, b.fact_id AS fact_b, {_PLAIN.format('abs_diff')} AS abs_diff, pct_diff FROM e", V)
def f23(spark, sf):
    return R.differences(pairs(spark, sf)).select(F.col("a.fact_id").alias("fact_a"), F.col("b.fact_id").alias("fact_b"), S.plain(F.col("abs_diff")).alias("abs_diff"), "pct_diff")


@query("f24_severity", f"WITH {PAIRS} SELECT a.fact_id AS fact_a, CASE WHEN pct_diff >= 20 THEN 'high' WHEN pct_diff >= 5 THEN 'medium' ELSE 'low' END AS severity, pct_diff > 0.5 AS exceeds FROM e", V)
def f24(spark, sf):
    return R.differences(pairs(spark, sf)).select(F.col("a.fact_id").alias("fact_a"), S.severity(F.col("pct_diff")).alias("severity"), "exceeds")


_FIND = f"""WITH {PAIRS} SELECT substr(sha256(array_to_string(list_sort([a.fact_id, b.fact_id]), '|') || 'pairwise_discrepancy'), 1, 16) AS finding_id, case_id, metric, a.subject AS subject, a.fact_id AS fact_a, b.fact_id AS fact_b,
  a.source_id AS source_a, b.source_id AS source_b, {_PLAIN.format('abs_diff')} AS abs_diff, pct_diff, CASE WHEN pct_diff >= 20 THEN 'high' WHEN pct_diff >= 5 THEN 'medium' ELSE 'low' END AS severity,
  round(least(a.confidence, b.confidence) * CASE WHEN a.basis = 'unknown' OR b.basis = 'unknown' THEN 0.9 ELSE 1.0 END, 4) AS confidence,
  array_to_string(list_filter([CASE WHEN pct_diff < 1 THEN 'pct_diff_below_1' END, CASE WHEN a.basis = 'unknown' OR b.basis = 'unknown' THEN 'same_basis' END, CASE WHEN a.period_start IS NULL OR b.period_start IS NULL THEN 'compatible_period' END,
    CASE WHEN list_sort(string_split(regexp_replace(a.normalized_value, '[.\\-]', '', 'g'), '')) = list_sort(string_split(regexp_replace(b.normalized_value, '[.\\-]', '', 'g'), '')) AND regexp_replace(a.normalized_value, '[.\\-]', '', 'g') <> regexp_replace(b.normalized_value, '[.\\-]', '', 'g') THEN 'digit_comparison' END, 'coverage'], lambda x: x IS NOT NULL), ',') AS explanations,
  'Potential discrepancy: ' || metric || ' differs between ' || a.source_id || ' and ' || b.source_id AS title FROM e WHERE pct_diff > 0.5"""


def findings_sql(select: str) -> str:
    """SQL over the rows of the findings query: `SELECT ...` without its FROM."""
    head, tail = _FIND.split("SELECT substr(sha256(array_to_string(list_sort", 1)
    return f"{head}{select} FROM (SELECT substr(sha256(array_to_string(list_sort{tail})"


@query("findings", _FIND, V)
def findings(spark, sf):
    """Where do two sources of one case disagree, and how badly?"""
    return R.findings(pairs(spark, sf))


@query("p15_finding_rows", _FIND.replace("SELECT substr(sha256(array_to_string(list_sort", "SELECT finding_id, title, confidence FROM (SELECT substr(sha256(array_to_string(list_sort") + ")", V)
def p15(spark, sf):
    return R.findings(pairs(spark, sf)).select("finding_id", "title", "confidence")


@query("f25_explanations", _FIND.replace("SELECT substr(sha256(array_to_string(list_sort", "SELECT finding_id, explanations FROM (SELECT substr(sha256(array_to_string(list_sort") + ")", V)
def f25(spark, sf):
    return R.findings(pairs(spark, sf)).select("finding_id", "explanations")


@query("s14_resource_facts", f"""WITH {FACTS} SELECT fact_id, metric, subject, normalized_value, currency, array_to_string(notes, '; ') AS ambiguity_notes, '{{"source_id":"' || source_id || '","block_id":"' || block_id || '"}}' AS evidence FROM facts""", V)
def s14f(spark, sf):
    """Facts as the table that users query: notes as one text, evidence as JSON."""
    return facts(spark, sf).select("fact_id", "metric", "subject", "normalized_value", "currency", F.array_join("notes", "; ").alias("ambiguity_notes"), F.to_json(F.struct("source_id", "block_id")).alias("evidence"))


@query("s14_resource_findings", findings_sql("""SELECT finding_id, title, severity, confidence, replace(explanations, ',', '; ') AS possible_explanations, '[{"source_id":"' || source_a || '","fact_id":"' || fact_a || '"},{"source_id":"' || source_b || '","fact_id":"' || fact_b || '"}]' AS evidence"""), V)
def s14d(spark, sf):
    f = R.findings(pairs(spark, sf))
    side = lambda k: F.struct(F.col(f"source_{k}").alias("source_id"), F.col(f"fact_{k}").alias("fact_id"))
    return f.select("finding_id", "title", "severity", "confidence", F.replace("explanations", F.lit(","), F.lit("; ")).alias("possible_explanations"), F.to_json(F.array(side("a"), side("b"))).alias("evidence"))


@query("j16_comparison_finding", f"WITH {PAIRS}, c AS (SELECT array_to_string(list_sort([a.fact_id, b.fact_id]), '|') AS pair, len(failed) = 0 AS comparable FROM k), f AS (SELECT array_to_string(list_sort([b.fact_id, a.fact_id]), '|') AS pair, round(pct_diff, 4) AS pct_diff FROM e WHERE pct_diff > 0.5) SELECT c.pair, c.comparable, f.pair IS NOT NULL AS has_finding, f.pct_diff FROM c LEFT JOIN f ON c.pair = f.pair", V)
def j16(spark, sf):
    """Every comparison with its finding, if it has one; they meet on the two facts in whatever order."""
    return R.comparison_findings(R.pairs(written(facts(spark, sf).where("normalized_value is not null").drop(*R.UNCOMPARED, "confidence"))))


_LINKS_OF = "SELECT 'case-' || c_custkey AS case_id, 'src-' || c_custkey % 400 AS source_id, CASE c_custkey % 7 WHEN 0 THEN 'rejected' WHEN 1 THEN 'confirmed' ELSE 'suggested' END AS status FROM customer"


@query("j25_case_rollup", f"""WITH {PAIRS}, s AS (SELECT case_id, count(DISTINCT source_id) AS sources, count(*) AS lines FROM statements GROUP BY case_id), l AS (SELECT 'case-' || c_custkey AS case_id, count(*) AS links FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1),
ff AS (SELECT case_id, count(*) AS facts FROM facts GROUP BY case_id), cc AS (SELECT case_id, count(*) AS comparisons FROM k GROUP BY case_id), dd AS (SELECT case_id, count(*) AS findings, max(CASE WHEN pct_diff >= 20 THEN 3 WHEN pct_diff >= 5 THEN 2 ELSE 1 END) AS worst FROM e WHERE pct_diff > 0.5 GROUP BY case_id)
SELECT s.case_id, s.sources, s.lines, coalesce(links, 0) AS links, coalesce(facts, 0) AS facts, coalesce(comparisons, 0) AS comparisons, coalesce(findings, 0) AS findings, CASE worst WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' END AS worst FROM s LEFT JOIN l USING (case_id) LEFT JOIN ff USING (case_id) LEFT JOIN cc USING (case_id) LEFT JOIN dd USING (case_id)""", V)
def j25(spark, sf):
    """A case at one look: each leg is aggregated by case before they meet."""
    lines = view(spark, sf, "statements")
    fs = written(facts(spark, sf))
    p = R.pairs(fs)
    n = lambda df, name: df.groupBy("case_id").agg(F.count("*").alias(name))
    s = lines.groupBy("case_id").agg(F.count_distinct("source_id").alias("sources"), F.count("*").alias("lines"))
    l = n(base(spark, sf, "customer").where("c_custkey % 7 <> 0").select(F.concat(F.lit("case-"), F.col("c_custkey")).alias("case_id")), "links")
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    d = R.findings(p).groupBy("case_id").agg(F.count("*").alias("findings"), F.max(rank).alias("w"))
    out = s.join(l, "case_id", "left").join(n(fs, "facts"), "case_id", "left").join(n(p, "comparisons"), "case_id", "left").join(d, "case_id", "left")
    return out.select("case_id", "sources", "lines", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("links", "facts", "comparisons", "findings")], F.when(F.col("w") == 3, "high").when(F.col("w") == 2, "medium").when(F.col("w") == 1, "low").alias("worst"))


@query("j25_case_view", f"""WITH {PAIRS}, s AS (SELECT case_id, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS sources FROM statements GROUP BY case_id), l AS (SELECT case_id, string_agg(source_id || ':' || status, ',' ORDER BY source_id, status) AS links FROM ({_LINKS_OF}) GROUP BY case_id),
ff AS (SELECT case_id, sha256(string_agg(fact_id || coalesce(normalized_value, ''), ',' ORDER BY fact_id)) AS facts FROM facts GROUP BY case_id), cc AS (SELECT case_id, count(*) AS comparisons FROM k GROUP BY case_id), dd AS (SELECT case_id, string_agg(finding_id, ',' ORDER BY finding_id) AS findings FROM ({findings_sql("SELECT case_id, finding_id").replace("WITH ", "WITH ", 1)}) GROUP BY case_id)
SELECT s.case_id, s.sources, coalesce(l.links, '') AS links, coalesce(ff.facts, '') AS facts, coalesce(cc.comparisons, 0) AS comparisons, coalesce(dd.findings, '') AS findings FROM s LEFT JOIN l USING (case_id) LEFT JOIN ff USING (case_id) LEFT JOIN cc USING (case_id) LEFT JOIN dd USING (case_id)""", V)
def j25_view(spark, sf):
    """The collected legs of each case, written short: facts by a digest, pairs by their number."""
    fs = written(facts(spark, sf).drop(*R.UNCOMPARED))
    p = R.pairs(fs)
    own = spark.sql(_LINKS_OF.replace("FROM customer", "FROM {c}"), c=base(spark, sf, "customer"))
    v = R.case_view(view(spark, sf, "statements"), own, fs, p, R.findings(p))
    text = lambda c, f: F.array_join(F.transform(c, f), ",")
    said = text("facts", lambda x: F.concat(x["fact_id"], F.coalesce(x["normalized_value"], F.lit(""))))
    return v.select("case_id", text("sources", lambda x: x["source_id"]).alias("sources"), text("links", lambda x: F.concat(x["source_id"], F.lit(":"), x["status"])).alias("links"), F.when(F.size("facts") > 0, F.sha2(said, 256)).otherwise("").alias("facts"),
                    F.size("comparisons").cast("bigint").alias("comparisons"), text("findings", lambda x: x["finding_id"]).alias("findings"))


@query("j26_finding_status", findings_sql("SELECT finding_id, CASE WHEN finding_id < '4' THEN 'dismissed' WHEN finding_id < '8' THEN 'acknowledged' ELSE 'open' END AS status"), V)
def j26f(spark, sf):
    """Findings computed anew keep the status that a review gave the same ones before."""
    f = written(R.findings(pairs(spark, sf)).select("finding_id"))
    before = f.where("finding_id < '8'").select("finding_id", F.when(F.col("finding_id") < "4", "dismissed").otherwise("acknowledged").alias("status"))
    return R.keep_status(f, before)


@query("o02_fact_order", f"WITH {FACTS} SELECT subject, metric, source_id, fact_id FROM facts ORDER BY 1, 2, 3, 4", V)
def o02(spark, sf):
    return facts(spark, sf).select("subject", "metric", "source_id", "fact_id").orderBy("subject", "metric", "source_id", "fact_id")


TABLE_FACTS = """x AS MATERIALIZED (SELECT * FROM cells), lab AS MATERIALIZED (SELECT table_id, row, raw_text AS label FROM x WHERE col = 0 AND NOT regexp_matches(raw_text, '^[\\d,.() \\-]*$')), hd AS MATERIALIZED (SELECT table_id, col, raw_text AS q FROM x WHERE is_header),
tf AS (SELECT x.table_id, x.row, x.col, lower(label || ' (' || q || ')') AS metric, raw_text AS raw_value, regexp_replace(cast(cast(replace(raw_text, ',', '') AS DECIMAL(38,10)) AS VARCHAR), '\\.?0+$', '') AS normalized_value, CASE WHEN raw_text LIKE '%,%' THEN 'NUM_THOUSANDS_COMMA' ELSE 'NUM_PLAIN' END AS rule
  FROM x JOIN lab USING (table_id, row) LEFT JOIN hd ON hd.table_id = x.table_id AND hd.col = x.col WHERE x.col > 0 AND NOT is_header AND regexp_full_match(raw_text, '[\\d,]+'))"""


def table_facts(spark, sf):
    return R.table_facts(view(spark, sf, "cells"), F.concat(F.lit("table-"), "table_id"))


@query("f07_table_facts", f"WITH {TABLE_FACTS} SELECT table_id || '-' || row || '-' || col AS block_id, metric, raw_value, normalized_value, rule FROM tf", ("cells",))
def f07(spark, sf):
    return table_facts(spark, sf).select("block_id", "metric", "raw_value", "normalized_value", "rule")


@query("t01_fact_union", f"WITH {FACTS}, {TABLE_FACTS} SELECT CASE WHEN unit IS NULL THEN 'none' ELSE unit END AS unit, count(*) AS n FROM (SELECT unit FROM facts UNION ALL SELECT NULL FROM tf) GROUP BY 1", ("statements", "cells"))
def t01(spark, sf):
    # the ids of percentages come twice, as after a rerun
    f = facts(spark, sf).select("*", F.explode(F.when(F.col("unit") == "percent", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("run"))
    return R.newest_facts(f.unionByName(table_facts(spark, sf).withColumn("run", F.lit(1)))).groupBy(F.coalesce("unit", F.lit("none")).alias("unit")).agg(F.count("*").alias("n"))


# links between documents

ID, MAIL = r"\b[A-Z0-9-]{6,}\b", r"@([A-Za-z0-9.-]+\.[A-Za-z]{2,})"
ENTITY = r"\b([A-Z][a-zA-Z&.]+(?:\s+[A-Z][a-zA-Z&.]+){1,3})\b"
_IDS = "list_distinct(list_filter(regexp_extract_all(coalesce(text, ''), '\\b[A-Z0-9-]{6,}\\b'), lambda x: regexp_matches(x, '[0-9]')))"
_DOMS = "list_distinct(regexp_extract_all(coalesce(text, ''), '@([A-Za-z0-9.-]+\\.[A-Za-z]{2,})', 1))"


def tokens(df):
    t = F.coalesce("text", F.lit(""))
    return df.withColumns({"ids": F.array_distinct(F.filter(F.regexp_extract_all(t, F.lit(ID), F.lit(0)), lambda x: x.rlike("[0-9]"))), "domains": F.array_distinct(F.regexp_extract_all(t, F.lit(MAIL), F.lit(1)))})


@query("f18_identifiers", f"SELECT doc_id, list_sort({_IDS}) AS ids, list_sort({_DOMS}) AS domains, len(regexp_extract_all(regexp_replace(coalesce(text, ''), '[^\x01-\x7F]', 'x', 'g'), '\\b([A-Z][a-zA-Z&.]+(?:\\s+[A-Z][a-zA-Z&.]+){{1,3}})\\b')) AS n_entities FROM documents")
def f18(spark, sf):
    d = tokens(base(spark, sf, "documents"))
    return d.select("doc_id", F.array_sort("ids").alias("ids"), F.array_sort("domains").alias("domains"), F.size(F.regexp_extract_all(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x01-\x7F]", "x"), F.lit(ENTITY), F.lit(1))).cast("bigint").alias("n_entities"))


#: Documents as sources with identifiers, domains and a date of their own.
_SIG = f"""t AS (SELECT doc_id, {_IDS} AS ids, {_DOMS} AS doms, DATE '2024-01-01' + cast(doc_id * 37 % 1000 AS INT) AS d FROM documents),
i AS (SELECT doc_id, unnest(ids) AS k FROM t), m AS (SELECT doc_id, unnest(doms) AS k FROM t),
ii AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_ids FROM i a JOIN i b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL), mm AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_domains FROM m a JOIN m b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
sg AS (SELECT coalesce(ii.a, mm.a) AS a, coalesce(ii.b, mm.b) AS b, coalesce(n_ids, 0) AS n_ids, coalesce(n_domains, 0) AS n_domains FROM ii FULL JOIN mm ON ii.a = mm.a AND ii.b = mm.b),
sig AS (SELECT sg.*, abs(date_diff('day', x.d, y.d)) <= 30 AS near_dates, round(least(1, least(1, n_ids / 2) * 0.45 + least(1, n_domains) * 0.1 + CASE WHEN abs(date_diff('day', x.d, y.d)) <= 30 THEN 0.1 ELSE 0 END), 4) AS confidence
  FROM sg JOIN t x ON x.doc_id = sg.a JOIN t y ON y.doc_id = sg.b)"""


def signal_rows(spark, sf):
    d = tokens(base(spark, sf, "documents"))
    d = d.select(F.col("doc_id").alias("source_id"), "ids", "domains", F.array(F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") * 37 % 1000).cast("int"))).alias("dates"))
    return R.signals(d)


@query("j13_link_signals", f"WITH {_SIG} SELECT * FROM sig")
def j13(spark, sf):
    return signal_rows(spark, sf)


@query("w11_best_link", f"WITH {_SIG} SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n_ids / 2 + n_domains + near_dates::INT DESC, a) AS r FROM sig) WHERE r = 1 AND confidence >= 0.3")
def w11(spark, sf):
    return R.best_link(signal_rows(spark, sf))


def _marked(column, kind):
    return F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("k")))


@query("t02_shared_sets", f"WITH t AS (SELECT doc_id, unnest({_IDS}) AS k, 'id' AS kind FROM documents UNION ALL SELECT doc_id, unnest({_DOMS}), 'domain' FROM documents) SELECT a.doc_id AS a, b.doc_id AS b, a.kind, string_agg(a.k, ',' ORDER BY a.k) AS shared FROM t a JOIN t b ON a.k = b.k AND a.kind = b.kind AND a.doc_id < b.doc_id GROUP BY ALL")
def t02(spark, sf):
    """The identifiers, and the domains, that two documents share, for every two that share any."""
    d = tokens(base(spark, sf, "documents"))
    t = written(d.select("doc_id", F.explode(F.concat(*[_marked(c, kind) for c, kind in (("ids", "id"), ("domains", "domain"))])).alias("t")).select("doc_id", "t.*"))
    both = t.withColumnRenamed("doc_id", "a").join(t.withColumnRenamed("doc_id", "b"), ["kind", "k"]).where("a < b")
    return both.groupBy("a", "b", "kind").agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("shared"))


_LINKS = """SELECT c_custkey AS seq, 'case-' || c_custkey % 50 AS case_id, 'src-' || c_custkey % 400 AS source_id, substr(sha256('case-' || c_custkey % 50 || '|src-' || c_custkey % 400), 1, 16) AS link_id, CASE c_custkey % 7 WHEN 0 THEN 'rejected' WHEN 1 THEN 'confirmed' ELSE 'suggested' END AS status, c_custkey % 7 < 2 AS decided FROM customer"""


def links(spark, sf):
    return spark.sql(_LINKS.replace("sha256(", "sha2(").replace("% 400), 1, 16)", "% 400, 256), 1, 16)").replace("FROM customer", "FROM {c}"), c=base(spark, sf, "customer"))


@query("j14_active_links", f"SELECT case_id, source_id, link_id, status FROM ({_LINKS}) WHERE status <> 'rejected'")
def j14(spark, sf):
    return links(spark, sf).where("status <> 'rejected'").select("case_id", "source_id", "link_id", "status")


@query("j26_link_upsert", f"SELECT link_id, case_id, source_id, status FROM (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY decided DESC, seq DESC) AS r FROM ({_LINKS})) WHERE r = 1")
def j26(spark, sf):
    l = links(spark, sf)
    return R.upsert_links(l.where("seq % 2 = 0"), l.where("seq % 2 = 1")).select("link_id", "case_id", "source_id", "status")
