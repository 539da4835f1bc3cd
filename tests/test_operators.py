"""Operators on micro-tables; registered queries against DuckDB on the smallest data."""

import datetime as dt
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from foliospark.derive import BASE
from foliospark.operators import pages, reasoning
from foliospark.plans.governed import analyse, approve, decide, gate, run_governed
from foliospark.registry import ORACLES, QUERIES
from foliospark.sources import documents as D
from foliospark.streaming import jobs

SF = "/root/testdata/sf0.001"
import foliospark.queries  # noqa: E402,F401


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    return str(v)[:19] if isinstance(v, (dt.date, dt.datetime)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in BASE:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a = sorted(repr([plain(r[c]) for c in cols]) for r in got.collect())
    b = sorted(repr([plain(x) for _, x in sorted(zip(want.columns, r, strict=True))]) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_have_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


def lines(spark, rows):
    return spark.createDataFrame([("c1", s, f"{s}-{n}", n, t, 0.9) for s, n, t in rows], "case_id string, source_id string, block_id string, line_no long, text string, block_confidence double")


def test_facts_and_findings(spark):
    f = reasoning.line_facts(lines(spark, [
        ("A", 0, "Employee: Jo Doe"), ("B", 0, "Employee: Jo Doe"), ("A", 1, "Monthly salary: Rs. 1,00,000"), ("B", 1, "Monthly salary: Rs. 80,000"), ("A", 2, "Bonus: 10-12k"),
        ("A", 3, "Rent: $ 5,000"), ("A", 4, "Joined on: 04/03/2025"), ("B", 4, "Joined on: 2025-03-06"), ("A", 5, "Zero tax: 0"), ("B", 5, "Zero tax: 0"),
    ]))
    by = {(r.source_id, r.metric): r for r in f.collect()}
    s = by["A", "monthly salary"]
    assert (s.normalized_value, s.currency, s.frequency, s.category, s.subject) == ("100000", "INR", "monthly", "income", "Jo Doe")
    assert by["A", "bonus"].normalized_value is None and by["A", "bonus"].rule == "RANGE_ABSTAIN"
    assert by["A", "rent"].currency is None and len(by["A", "rent"].notes) == 1 and by["A", "rent"].confidence == 0.72
    p = reasoning.pairs(f)
    found = {r.metric: r for r in reasoning.findings(p).collect()}
    assert (found["monthly salary"].abs_diff, found["monthly salary"].pct_diff, found["monthly salary"].severity) == ("20000", 20.0, "high")
    assert found["joined on"].abs_diff == "2" and "zero tax" not in found
    assert {r.metric for r in reasoning.differences(p).collect()} == {"monthly salary", "joined on", "zero tax"}


def test_currency_mismatch_is_not_comparable(spark):
    f = reasoning.line_facts(lines(spark, [("A", 1, "Income: INR 5"), ("B", 1, "Income: USD 5")]))
    assert [r.failed for r in reasoning.not_comparable(reasoning.pairs(f)).collect()] == [["same_currency"]]


def test_page_operators_do_not_depend_on_partitions(spark):
    from foliospark.derive import view

    r = view(spark, SF, "regions")
    for op in (pages.merge_regions, pages.reading_order):
        assert sorted(map(tuple, op(r).collect())) == sorted(map(tuple, op(r.repartition(7)).collect()))


def test_html_and_mail(spark):
    h = "<html><nav><p>menu</p></nav><h2>Head</h2><p>One <b>two</b></p><ul><li>x</li></ul><img alt='pic'><script>p()</script></html>"
    got = D.html_blocks(spark.createDataFrame([(1, h), (2, None)], "page_id long, html string")).orderBy("seq").collect()
    assert [(r.block_type, r.level, r.text) for r in got] == [("heading", 2, "Head"), ("paragraph", 0, "One two"), ("list_item", 0, "x"), ("figure", 0, "pic")]
    h = "<div class='Cookie-Banner'><div><p>ok?</p></div><p>more</p></div><p>kept</p><table><tr><th>a<td>b</td></tr><tr><td>1 <i>x</i></td></tr></table><p>open"
    got = D.html_blocks(spark.createDataFrame([(1, h)], "page_id long, html string")).orderBy("seq").collect()
    assert [(r.block_type, r.text) for r in got] == [("paragraph", "kept"), ("table", "a | b\n1 x"), ("paragraph", "open")]
    h = "<p>one<p>two<ul><li>a<p>b</p>c<li>d</ul><table><tr><td>1<br>2<tr><td>3</table>" + "<div>" * 3000 + "<pre>deep</pre>" + "<nav><p>x</p></nav>tail<blockquote>q <img title='t'> r</blockquote>"
    got = D.html_blocks(spark.createDataFrame([(1, h)], "page_id long, html string")).orderBy("seq").collect()
    assert [(r.block_type, r.text) for r in got] == [("paragraph", "one"), ("paragraph", "two"), ("list_item", "a"), ("paragraph", "b"), ("list_item", "c"), ("list_item", "d"), ("table", "1 2\n3"), ("paragraph", "deep"), ("figure", "t"), ("paragraph", "q r")]
    mime = "From: x@y.z\nSubject: S\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/html\n\n<p>one</p><p>two</p>\n--B\nContent-Disposition: attachment; filename=b.exe\n\nx\n--B\nContent-Disposition: attachment; filename=a.pdf\n\ny\n--B--\n"
    m = [(r.kind, r.text, r.child_id) for r in D.emails(spark.createDataFrame([("a", mime)], "id string, raw string"), "id", "raw").collect()]
    assert m == [("metadata", "x@y.z | S", None), ("body", "one", None), ("body", "two", None), ("attachment", "a.pdf", hashlib.sha256(b"a|a.pdf|0").hexdigest()[:16]), ("attachment", "b.exe", None)]
    m = D.emails(spark.createDataFrame([("a", "From: x@y.z\nSubject: Hi\n\nBody\n\nMore")], "id string, raw string"), "id", "raw").collect()
    assert [r.kind for r in m] == ["metadata", "body", "body"]


def test_text_blocks(spark):
    t = "# One\r\nfirst\nline\n\n- a\n2) b\n| x | y |\n|---|:---:|\n1|2\n```\ncode"
    df = spark.createDataFrame([(1, t), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.block_type, r.level, r.text) for r in D.text_blocks(df).orderBy("doc_id", "block").collect()]
    assert got == [("heading", 1, "One"), ("paragraph", 0, "first line"), ("list", 0, "• a\n• b"), ("table", 0, "x | y\n1 | 2"), ("code_fence", 0, "```"), ("paragraph", 0, "code")]
    got = [(r.block_type, r.text) for r in D.text_blocks(df, markdown=False).orderBy("doc_id", "block").collect()]
    assert got[:2] == [("paragraph", "# One first line"), ("list", "• a\n• b")]


def test_csv_delimiter(spark):
    got = D.csv_cells(spark.createDataFrame([(1, "a;b;c\n1;2;3\n4;5;6")], "id long, t string"), "id", "t").where("row = 2 and col = 2").collect()
    assert got[0].value == "6"
    got = D.csv_cells(spark.createDataFrame([(1, 'a,b\n"x, ""y""\nz",2\n\n3,'), (2, None), (3, "")], "id long, t string"), "id", "t").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, 'x, "y"\nz'), (1, 1, 1, "2"), (1, 3, 0, "3"), (1, 3, 1, "")]


ALLOWED = ["SELECT a FROM t", "select count(*) from t where a > 1", "WITH x AS (SELECT a FROM t) SELECT * FROM x", "SELECT a, count(*) FROM t GROUP BY a HAVING count(*) > 1 ORDER BY a LIMIT 3", "SELECT x.a FROM t x JOIN t y ON x.a = y.a"]
BLOCKED = ["DROP TABLE t", "SELECT a FROM t; SELECT a FROM t", "SELECT secret FROM t", "SELECT a FROM u", "SELECT a FROM t UNION SELECT a FROM t", "INSERT INTO t VALUES (1)", "SELECT a FROM main.t",
           "SELECT reflect('java.lang.System', 'exit', '0') FROM t", "SELECT * FROM parquet.`/etc`", "SELECT a FROM t EXCEPT SELECT 1", "SET x=1", "SHOW TABLES", "CREATE VIEW v AS SELECT 1", "nonsense",
           "SELECT 'hidden_tbl AS (select' AS z, a FROM hidden_tbl", "SELECT a /* hidden_tbl AS (SELECT */ FROM hidden_tbl", "SELECT `reflect`('java.util.UUID','randomUUID') FROM t", "SELECT a FROM t WHERE a IN (SELECT a FROM hidden_tbl)",
           "WITH hidden_tbl AS (SELECT * FROM hidden_tbl) SELECT * FROM hidden_tbl", "WITH h AS (SELECT a FROM t) SELECT h.a FROM h, hidden_tbl", "SELECT (SELECT max(a) FROM hidden_tbl) FROM t", "SELECT * FROM range(5)", "VALUES (1)", "SELECT explode(array(1)) FROM t", "SELECT 1",
           "SELECT a FROM global_temp.t", "SELECT a -- x\nFROM t", "SELECT a FROM IDENTIFIER('hidden_tbl')", "SELECT a FROM t, LATERAL (SELECT 1)", "SELECT session_user FROM t"]


def test_governed_sql(spark):
    t = {"t": spark.createDataFrame([(1,), (2,)], "a int")}
    spark.createDataFrame([(9,)], "a int").createOrReplaceTempView("hidden_tbl")
    spark.createDataFrame([(7,)], "a int").createOrReplaceTempView("t")
    for sql in ALLOWED:
        reason, rows = run_governed(spark, sql, t)
        assert reason is None and rows.count() >= 0, sql
    for sql in BLOCKED:
        assert run_governed(spark, sql, t)[0] is not None, sql
    assert gate(spark, "SELECT a FROM t", t) is None
    assert run_governed(spark, "SELECT a FROM t", t, cap=1)[1].count() == 1
    assert [r.a for r in spark.sql("SELECT a FROM t").collect()] == [7]  # the caller's own view is not touched


SCOPED = [
    "SELECT x.s FROM (WITH hidden_tbl AS (SELECT id FROM t) SELECT id FROM hidden_tbl) q JOIN hidden_tbl x ON true JOIN t ON true",
    "SELECT id FROM t WHERE id IN (WITH hidden_tbl AS (SELECT id FROM t) SELECT id FROM hidden_tbl) AND EXISTS (SELECT s FROM hidden_tbl)",
    "SELECT IDENTIFIER('reflect')('java.util.UUID','randomUUID') FROM t", "SELECT IDENTIFIER('current_user')() FROM t",
    "WITH a AS (SELECT s FROM b), b AS (SELECT id FROM t) SELECT * FROM a", "WITH RECURSIVE r AS (SELECT id FROM t UNION ALL SELECT id + 1 FROM r) SELECT id FROM r",
    "SELECT (WITH hidden_tbl AS (SELECT id FROM t) SELECT max(id) FROM hidden_tbl) FROM hidden_tbl JOIN t ON true", "SELECT s FROM hidden_stored", "WITH x AS (SELECT s FROM hidden_stored) SELECT s FROM x JOIN t ON true",
    "SELECT id FROM t WHERE EXISTS (SELECT 1 FROM hidden_stored)", "SELECT transform(array(1), x -> x) FROM t", "SELECT current_user FROM t", "SELECT id FROM t ORDER BY (SELECT max(s) FROM hidden_tbl)", "SELECT id FROM t HAVING max((SELECT max(s) FROM hidden_tbl)) > ''",
    "SELECT count(*) FILTER (WHERE id IN (SELECT id FROM hidden_tbl)) FROM t", "SELECT named_struct('a', id) FROM t", "SELECT :x FROM t", "SELECT id FROM parquet.`/root/testdata/sf0.001/region.parquet`", "SELECT id FROM spark_catalog.default.hidden_stored",
]
NESTED = [
    ("WITH hidden_tbl AS (SELECT id FROM t) SELECT id FROM hidden_tbl", ["t.id"]), ("WITH t AS (SELECT id FROM t) SELECT id FROM t", ["t.id"]), ("WITH a AS (SELECT id FROM t), b AS (SELECT id FROM a) SELECT b.id FROM b JOIN a ON a.id = b.id", ["t.id"]),
    ("SELECT q.id FROM (WITH c AS (SELECT id FROM t) SELECT id FROM c) q JOIN t ON q.id = t.id", ["t.id"]), ("SELECT id FROM t x WHERE EXISTS (SELECT 1 FROM t y WHERE y.note = x.note)", ["t.id", "t.note"]), ("SELECT count(*) AS n FROM t", []),
    ("SELECT id, rank() OVER (PARTITION BY note ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t".replace("rank()", "sum(id)"), ["t.id", "t.note"]), ("SELECT CASE WHEN id BETWEEN 1 AND 2 THEN 'a' || note ELSE trim(note) END AS z FROM t WHERE note LIKE 'n%' AND id NOT IN (7, 8)", ["t.id", "t.note"]),
]


def test_scopes_of_governed_sql(spark):
    """A name of a common table expression counts only where it is in scope; what the catalog stores stays closed."""
    t = {"t": spark.createDataFrame([(1, "n"), (2, "m")], "id int, note string")}
    spark.createDataFrame([(1, "SECRET")], "id int, s string").createOrReplaceTempView("hidden_tbl")
    spark.sql("DROP TABLE IF EXISTS hidden_stored")
    spark.createDataFrame([(1, "SECRET")], "id int, s string").write.mode("overwrite").saveAsTable("hidden_stored")
    try:
        for sql in SCOPED:
            reason, rows = run_governed(spark, sql, t)
            assert reason is not None and rows is None, sql
        for sql, columns in NESTED:
            a = analyse(spark, sql, t)
            assert (a.reason, a.columns) == (None, columns), (sql, a)
            assert a.rows.count() > 0
    finally:
        spark.sql("DROP TABLE hidden_stored")
    both = {"t": t["t"], "u": spark.createDataFrame([(1, 5)], "id int, n int")}
    known = {"t": ["id", "note", "pay"], "u": ["id", "n"]}
    say = lambda sql: analyse(spark, sql, both, None, known).reason
    assert say("SELECT u.* FROM t JOIN u ON t.id = u.id") is None and say("SELECT t.* FROM t JOIN u ON t.id = u.id") == say("SELECT * FROM t") == "* on t, which has locked columns"
    assert say("SELECT x.pay FROM t x") == say("SELECT id FROM u WHERE n > (SELECT max(pay) FROM t)") == "column is locked: t.pay" and say("SELECT id AS pay FROM t ORDER BY pay") is None
    assert say("SELECT nothing FROM t") == "unknown column: nothing" and say("WITH c AS (SELECT id FROM t) SELECT * FROM c") is None


def test_decisions_and_approvals(spark):
    rows = spark.createDataFrame([(k, "s") for k in range(5)], "a int, s string")
    t, known, secret = {"t": rows}, {"t": ["a", "s", "locked"]}, {"t": {"s"}}
    said = lambda sql, **k: decide(spark, sql, t, secret, known, **k)[:2]
    assert said("SELECT a FROM t") == ("ALLOW", None) and said("SELECT s FROM t") == ("CONFIRM", "sensitive columns") == said("SELECT a FROM t WHERE s = 'x'")
    assert said("SELECT a FROM t", large=4) == ("CONFIRM", "large scan") and said("SELECT a FROM t LIMIT 3", large=4)[0] == "ALLOW"
    assert said("SELECT locked FROM t") == ("BLOCK", "column is locked: t.locked") and said("SELECT * FROM t")[0] == "BLOCK" and said("SELECT count(*) FROM t")[0] == "ALLOW"
    a = analyse(spark, "SELECT x.a AS z FROM t x WHERE x.s > '' ORDER BY z LIMIT 7", t, secret, known)
    assert (a.tables, a.columns, a.sensitive, a.limit, a.reason) == (["t"], ["t.a", "t.s"], ["t.s"], 7, None)
    ask = {"user_id": "u", "sql": "SELECT s FROM t", "status": "pending"}
    assert approve(spark, ask | {"status": "approved"}, "v", "approve", t) == ("CONFLICT", None) and approve(spark, ask, "u", "approve", t) == ("SELF_APPROVAL", None)
    assert approve(spark, ask, "v", "reject", t)[0] == "REJECTED" and approve(spark, ask, "v", "approve", {"t": rows.drop("s")}, known)[0] == "BLOCKED_FOR_REQUESTER"
    done = approve(spark, ask, "v", "approve", t, known)
    assert done[0] == "EXECUTED" and done[1].count() == 5


def test_a_limit_below_common_table_expressions_is_the_statements_own(spark):
    t = {"t": spark.createDataFrame([(k,) for k in range(5)], "a int")}
    said = lambda sql: decide(spark, sql, t, {}, large=4)[0]
    assert said("WITH x AS (SELECT a FROM t) SELECT a, count(*) AS n FROM x GROUP BY a LIMIT 3") == "ALLOW"
    assert said("WITH x AS (SELECT a FROM t LIMIT 3) SELECT a FROM x") == "CONFIRM"  # not the statement's own


def test_only_statements_without_their_own_limit_or_with_locked_columns_need_approval(spark):
    from foliospark.qs.workers import ASKED

    t = {"findings": spark.createDataFrame([(k, "low", "s") for k in range(5)], "finding_id int, severity string, statement string")}
    asked = next(s for s in ASKED if s.startswith("WITH "))
    assert analyse(spark, asked, t).limit == 3
    assert decide(spark, asked, t, {"findings": {"statement"}}, large=4)[0] == "ALLOW" and decide(spark, asked.replace("severity", "statement"), t, {"findings": {"statement"}}, large=4)[0] == "CONFIRM"


def stream(spark, df, tmp_path, name):
    path = str(tmp_path / "in")
    df.write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path), str(tmp_path / f"ck-{name}")


def drained(df, name, checkpoint, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    hits = spark.createDataFrame([("h", i, t0 + dt.timedelta(seconds=2 * i)) for i in range(60)], "host string, event_id long, ts timestamp")
    batch = sorted(map(tuple, jobs.rate_limit(hits).collect()))
    assert [b[1] for b in batch if b[2]][:11] == [*range(10), 30]
    s, ck = stream(spark, hits.coalesce(1), tmp_path, "rate")
    assert sorted(map(tuple, drained(jobs.rate_limit_stream(s), "rate", ck).collect())) == batch


def test_streaks_and_windows(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("u", i, t0 + dt.timedelta(minutes=i), i in (3, 10)) for i in range(16)]
    logins = spark.createDataFrame(rows, "username string, seq long, ts timestamp, success boolean")
    s, ck = stream(spark, logins.coalesce(1), tmp_path, "streak")
    got = drained(jobs.login_streaks_stream(s), "streaks", ck).where("alert").select("seq").collect()
    assert sorted(r.seq for r in got) == [8, 9, 15]
    ev = spark.createDataFrame([(i, t0 + dt.timedelta(minutes=20 * i), "click", i) for i in range(9)], "event_id long, ts timestamp, event_type string, user_id long")
    ev.write.parquet(str(tmp_path / "ev"))
    s2 = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    got = drained(jobs.window_counts(s2), "win", str(tmp_path / "ck-w"), "complete").agg(F.sum("n"), F.count("*")).first()
    assert tuple(got) == (9, 3)


def test_chain_and_expiry_streams(spark, tmp_path):
    ev = spark.createDataFrame([("t", 1, "a"), ("t", 2, "b"), ("u", 3, "a")], "tenant_id string, seq long, event_type string")
    s, ck = stream(spark, ev.coalesce(1), tmp_path, "chain")
    got = {r.seq: r for r in drained(jobs.audit_chain_stream(s), "chain", ck).collect()}
    assert got[1].prev_hash == got[3].prev_hash == "0" * 64 and got[2].prev_hash == got[1].hash
    twin = {r.seq: r.hash for r in jobs.audit_chain(ev).collect()}
    assert twin == {k: r.hash for k, r in got.items()}
    t0 = dt.datetime(2024, 1, 1)
    day = dt.timedelta(days=1)
    grants = spark.createDataFrame([(1, t0, t0 + day), (2, t0, t0 + 9 * day), (3, t0 + 5 * day, t0 + 99 * day)], "grant_id long, ts timestamp, valid_until timestamp")
    grants.coalesce(1).write.parquet(str(tmp_path / "g"))
    s = spark.readStream.schema(grants.schema).parquet(str(tmp_path / "g"))
    got = drained(jobs.expired_grants_stream(s), "expired", str(tmp_path / "ck-g")).collect()
    assert [r.grant_id for r in got] == [1]


def test_state_survives_a_restart(spark, tmp_path):
    """Files that arrive one run after another, each run a new query from the checkpoint; rows behind the watermark are dropped."""
    t0 = dt.datetime(2024, 1, 1)
    hit = lambda i, s: ("h", i, t0 + dt.timedelta(seconds=s))
    parts = [[hit(i, i) for i in range(8)], [hit(100 + i, 30 + i) for i in range(6)], [hit(200, 5000)], [hit(300, 5001), hit(301, 20)]]
    kinds = "host string, event_id long, ts timestamp"
    for rows in parts:
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "hits"))
        s = spark.readStream.schema(kinds).parquet(str(tmp_path / "hits"))
        jobs.ingest(jobs.rate_limit_stream(s, late="60 seconds"), str(tmp_path / "admitted"), str(tmp_path / "ck-restart")).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "admitted")).collect()
    got = {r.event_id: r.admitted for r in rows}
    assert len(rows) == len(got)
    on_time = [r for rows in parts for r in rows if r[1] != 301]
    batch = {r.event_id: r.admitted for r in jobs.rate_limit(spark.createDataFrame(on_time, kinds)).collect()}
    assert got == batch and 301 not in got and not all(batch.values())


def test_pending_alerts(spark, tmp_path):
    """Types of one user apart, counted while pending, sent once; an event after that opens a new alert."""
    t0 = dt.datetime(2024, 1, 1)
    ev = lambda u, kind, m: (u, kind, t0 + dt.timedelta(minutes=m))
    kinds = "user_id long, event_type string, ts timestamp"
    parts = [[ev(1, "login", 0), ev(1, "error", 1), ev(1, "login", 5), ev(2, "login", 3)], [ev(1, "login", 50), ev(1, "error", 59)], [ev(9, "tick", 300)], [ev(1, "login", 310)], [ev(9, "tick", 900)], [ev(9, "tick", 901)]]
    for rows in parts:
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
        s = spark.readStream.schema(kinds).parquet(str(tmp_path / "ev"))
        jobs.ingest(jobs.pending_alerts_stream(s), str(tmp_path / "sent"), str(tmp_path / "ck-pending")).awaitTermination(120)
    got = [(r.user_id, r.event_type, r.n) for r in spark.read.parquet(str(tmp_path / "sent")).collect()]
    assert sorted(g for g in got if g[0] != 9) == [(1, "error", 2), (1, "login", 1), (1, "login", 3), (2, "login", 1)]


def test_ingest_twice_adds_nothing(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "src"))
    for _ in range(2):
        s = spark.readStream.schema("id long").parquet(str(tmp_path / "src"))
        jobs.ingest(s, str(tmp_path / "out"), str(tmp_path / "ck-i")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_chain_verify_reads_every_row(spark):
    """Tampered, relinked and missing rows of every tenant, at any seq, against a chain walked by hand."""
    ev = [(f"tenant{i % 3}", i, "ab"[i % 2]) for i in range(1, 301)]
    log = jobs.audit_log(spark.createDataFrame(ev, "tenant_id string, seq long, event_type string")).collect()
    kept = [r.asDict() for r in log if r.seq not in (1, 77, 153)]  # the first of a chain among them
    for r in kept:
        if r["seq"] in (13, 101):
            r["event_type"] = "changed"
        if r["seq"] == 50:
            r["hash"] = "tampered"
        if r["seq"] == 212:
            r["prev_hash"] = "relinked"
    want = {}
    for t in {r["tenant_id"] for r in kept}:
        prev, n = "0" * 64, 0
        for r in sorted((r for r in kept if r["tenant_id"] == t), key=lambda r: r["seq"]):
            own = hashlib.sha256(f"{r['prev_hash']}{r['seq']}|{r['event_type']}".encode()).hexdigest()
            want[r["seq"]] = (r["n"] != n + 1, r["prev_hash"] != prev, r["hash"] != own)
            prev, n = r["hash"], r["n"]
    got = {r.seq: r for r in jobs.verify_chain(spark.createDataFrame(kept, "tenant_id string, seq long, prev_hash string, hash string, n long, event_type string")).collect()}
    assert {k: (r.gap, r.broken_link, r.hash_mismatch) for k, r in got.items()} == want and len(got) == 297
    assert {k for k, r in got.items() if r.problem != "ok"} == {4, 80, 156, 13, 101, 50, 53, 212}
    assert got[4].problem == "gap,broken_link" and got[53].problem == "broken_link" and got[212].problem == "broken_link,hash_mismatch"


def test_chain_verify_query_keeps_every_tenant(spark):
    got = QUERIES["w03_chain_verify_all"](spark, SF)
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert got.count() == events.where("event_id % 307 <> 11").count()
    assert {"ok", "gap,broken_link", "broken_link,hash_mismatch"} <= {r.problem for r in got.select("problem").distinct().collect()}


def test_pairs_read_a_value_once_a_fact(spark):
    """Days, numbers and sorted digits are read before facts meet, not for each pair; findings filter on what was computed once."""
    from foliospark import derive as D
    from foliospark.operators import reasoning as R

    facts = R.line_facts(D.view(spark, "/root/testdata/sf0.001", "statements"))
    plan = R.findings(R.pairs(facts))._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join Inner")]
    assert "split(" not in above and "try_cast(a" not in above


def test_facts_are_united_in_one_pass(spark):
    """Every table is read once, nothing is sorted before ids are dealt, and parts of statements and cells are not drawn together."""
    from foliospark.operators import reasoning as R

    plan = QUERIES["t01_fact_union"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3 and "WindowGroupLimit" not in plan and plan.count("REPARTITION_BY_NUM") == 2
    old = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "x")], "fact_id string, unit string")
    new = spark.createDataFrame([("b", None), ("c", "y"), ("c", "y")], "fact_id string, unit string")
    assert sorted(map(tuple, R.union_facts(old, new).collect())) == [("a", "x"), ("b", None), ("c", "y")]


def test_comparisons_meet_their_findings_where_they_are_made(spark):
    """Repeated facts give every comparison with every finding, as a join on the pair would; facts are shuffled once for both sides."""
    from foliospark.operators import reasoning as R

    facts = [("f1", "c", "s1", "n", "m", "10", None), ("f1", "c", "s1", "n", "m", "10", None), ("f2", "c", "s2", "N", "m", "12", None), ("f2", "c", "s2", "N", "m", "10", None), ("f3", "c", "s3", "n", "m", "12", "USD"),
             ("f4", "c", "s4", "n", "m", "2020-01-02", None), ("f5", "c", "s5", "n", "m", None, None), ("f6", "d", "s2", "n", "m", "10", None)]
    df = spark.createDataFrame(facts, "fact_id string, case_id string, source_id string, subject string, metric string, normalized_value string, currency string")
    df = df.selectExpr("*", "if(normalized_value like '%-%', 'date', null) as unit", "cast(null as string) as frequency", "cast(null as date) as period_start", "cast(null as date) as period_end", "'net' as basis", "'x' as category", "0.9 as confidence")
    p = R.pairs(df)
    pair = lambda x, y: F.array_join(F.array_sort(F.array(x, y)), "|").alias("pair")
    c = R.checked(p).select(pair("a.fact_id", "b.fact_id"), (F.size("failed") == 0).alias("comparable"))
    f = R.findings(p).select(pair("fact_b", "fact_a"), "pct_diff", F.lit(True).alias("found"))
    want = c.join(f, "pair", "left").select("pair", "comparable", F.col("found").isNotNull().alias("has_finding"), "pct_diff")
    got = R.comparison_findings(p)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and not got.isEmpty()
    plan = R.comparison_findings(p)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Exchange hashpartitioning") == 2


def test_case_view_keeps_what_is_read_of_facts(spark):
    """What no comparison reads is not written with the facts of the case view and the comparisons."""
    from foliospark.operators import reasoning as R
    from foliospark.queries import QUERIES

    for name in ("j16_comparison_finding", "j25_case_view"):
        before = len(getattr(spark, "_foliospark_written", ()))
        QUERIES[name](spark, "/root/testdata/sf0.001")
        (path,) = spark._foliospark_written[before:]
        assert not set(spark.read.parquet(path).columns) & set(R.UNCOMPARED)
