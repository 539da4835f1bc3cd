"""Relational operators of governance, audit, review, intake and status tables; see `relational`."""

from __future__ import annotations

from foliospark.operators.relational import operator

# intake and routing of sources

_EXT = "lower(regexp_extract(display_name, RE'[.]([^.]*)$', 1))"
operator("s04_duplicates", "sources", "WITH f AS (SELECT sha256, min(source_id) AS first FROM sources GROUP BY sha256) SELECT s.source_id, CASE WHEN f.first <> s.source_id THEN f.first END AS duplicate_of FROM sources s JOIN f ON s.sha256 = f.sha256")
operator("s06_page_class", "spans", "WITH p AS (SELECT source_id, page_number, sum(length(text)) AS chars, (source_id * 7 + page_number * 3) % 10 / 10e0 AS image_ratio FROM spans GROUP BY source_id, page_number) SELECT source_id, page_number, CASE WHEN chars < 15 THEN CASE WHEN image_ratio > 0 THEN 'image_only' ELSE 'blank' END WHEN image_ratio >= 0.6 THEN 'scanned' WHEN image_ratio >= 0.3 THEN 'mixed' ELSE 'native_text' END AS class FROM p")
operator("a22_distinct_warnings", "blocks", "SELECT DISTINCT source_id, page_number, 'CHECK_' || upper(check_status) AS code FROM blocks WHERE check_status <> 'pass'")
operator("s14_resource_sources", "sources", "SELECT source_id, display_name, size_bytes, page_count, uploaded_by, tenant_id FROM sources")
operator("s17_export_manifest", "sources", "WITH i AS (SELECT tenant_id, source_id, SHA(cast(source_id AS string) || '|' || display_name || '|' || sha256) AS item_hash FROM sources) SELECT tenant_id, count(*) AS items, SHA(STRAGG(item_hash BY source_id SEP ',')) AS overall_hash FROM i GROUP BY tenant_id")
# scope, visibility, redaction

#: Users with a tenant and a role; columns hidden from viewers. Roles see all, what is not sensitive, that less what is
#: hidden from viewers, or nothing; a grant that is active at AS_OF adds its column to any of these.
AS_OF = 300
_USERS = """u AS (SELECT DISTINCT user_id, 'src' || cast(substr(user_id, 5) AS int) % 20 AS tenant_id, CASE cast(substr(user_id, 5) AS int) % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'viewer' WHEN 2 THEN 'none' ELSE 'editor' END AS role FROM grants)"""
_VIS = _USERS + f""", h AS (SELECT 'sources' AS resource, 'size_bytes' AS col UNION ALL SELECT 'facts', 'currency' UNION ALL SELECT 'findings', 'severity'),
c AS (SELECT c.resource, c.col, c.pos, c.sensitive, h.col IS NOT NULL AS hidden, array('admin', 'viewer', 'none', 'editor') AS roles FROM catalog c LEFT JOIN h ON c.resource = h.resource AND c.col = h.col),
r AS (SELECT resource, col, pos, sensitive, hidden, UNROLL(roles AS role) FROM c),
g AS (SELECT DISTINCT user_id, resource, col FROM grants WHERE valid_until > {AS_OF}),
vis AS (SELECT u.user_id, u.role, r.resource, r.col, r.pos, r.sensitive, r.hidden, coalesce(r.role = 'admin' OR (r.role = 'editor' AND NOT r.sensitive) OR (r.role = 'viewer' AND NOT r.sensitive AND NOT r.hidden) OR g.col IS NOT NULL, false) AS visible
  FROM u JOIN r ON u.role = r.role LEFT JOIN g ON g.user_id = u.user_id AND g.resource = r.resource AND g.col = r.col)"""
operator("p01_row_scope", "sources grants orders", f"WITH {_USERS}, k AS (SELECT DISTINCT o_orderkey % 97 AS k FROM orders) SELECT u.user_id, s.source_id, s.display_name FROM (SELECT * FROM sources s LEFT SEMI JOIN k ON s.source_id % 97 = k.k) s JOIN u ON s.tenant_id = u.tenant_id")
operator("p02_visible_columns", "grants catalog", f"WITH {_VIS} SELECT user_id, role, resource, STRAGG(col BY pos SEP ',') AS columns FROM vis WHERE visible GROUP BY user_id, role, resource")
operator("p03_masked_preview", "sources grants catalog", f"""WITH {_VIS}, v AS (SELECT u.tenant_id, bool_or(CASE WHEN col = 'display_name' THEN visible END) AS name_ok, bool_or(CASE WHEN col = 'size_bytes' THEN visible END) AS size_ok, bool_or(CASE WHEN col = 'uploaded_by' THEN visible END) AS by_ok FROM vis JOIN u ON vis.user_id = u.user_id WHERE vis.user_id = 'user16' AND resource = 'sources' GROUP BY u.tenant_id)
SELECT s.source_id, CASE WHEN v.name_ok THEN display_name END AS display_name, CASE WHEN v.size_ok THEN size_bytes END AS size_bytes, CASE WHEN v.by_ok THEN uploaded_by END AS uploaded_by FROM sources s JOIN v ON s.tenant_id = v.tenant_id ORDER BY s.source_id LIMIT 100""")
operator("p04_catalog_flags", "grants catalog", f"WITH {_VIS} SELECT user_id, resource, col, sensitive, hidden, NOT visible AS locked FROM vis")
operator("p05_redacted_facts", "statements grants catalog", f"""WITH {_VIS}, v AS (SELECT user_id, bool_or(CASE WHEN col = 'normalized_value' THEN visible END) AS value_ok, bool_or(CASE WHEN col = 'subject' THEN visible END) AS subject_ok, bool_or(CASE WHEN col = 'metric' THEN visible END) AS metric_ok, bool_or(CASE WHEN col = 'currency' THEN visible END) AS currency_ok,
  STRAGG(CASE WHEN NOT visible THEN col END BY col SEP ',') AS locked FROM vis WHERE resource = 'facts' GROUP BY user_id)
SELECT s.block_id, v.user_id, CASE WHEN value_ok THEN text ELSE '' END AS raw_value, CASE WHEN subject_ok THEN case_id ELSE 'Hidden content' END AS subject, CASE WHEN metric_ok THEN 'line ' || line_no ELSE 'Hidden content' END AS metric, CASE WHEN currency_ok THEN 'INR' END AS currency, coalesce(locked, '') AS locked_columns
FROM statements s JOIN v ON v.user_id = 'user' || 4 * (line_no % 15)""")
operator("t03_requested_minus_visible", "requests grants catalog", f"WITH {_VIS}, a AS (SELECT DISTINCT user_id, resource, col FROM requests), k AS (SELECT resource, col, true AS known FROM catalog) SELECT a.user_id, a.resource, a.col, k.known IS NULL AS is_unknown FROM a LEFT JOIN k ON a.resource = k.resource AND a.col = k.col LEFT ANTI JOIN (SELECT * FROM vis WHERE visible) v ON a.user_id = v.user_id AND a.resource = v.resource AND a.col = v.col")
_HOURS = "CASE WHEN regexp_like(duration, RE'^[0-9]+ ?(h)?$') THEN cast(regexp_extract(duration, RE'^([0-9]+)', 1) AS int) WHEN regexp_like(duration, RE'^[0-9]+ ?d(ays)?$') THEN 24 * cast(regexp_extract(duration, RE'^([0-9]+)', 1) AS int) WHEN regexp_like(duration, RE'^[0-9]+w$') THEN 168 * cast(regexp_extract(duration, RE'^([0-9]+)', 1) AS int) END"
# rules in order; an approval sets an end in hours from now, 48 h before to 720 h after
operator("g06_request_rules", "requests grants catalog", f"""WITH {_VIS}, q AS (SELECT *, {_HOURS} AS hours, request_id % 33 * 24 - 48 AS ends_in FROM requests),
p AS (SELECT user_id, resource, col, min(request_id) AS first_pending FROM requests WHERE status = 'pending' GROUP BY user_id, resource, col),
j AS (SELECT q.*, r.resource IS NOT NULL AS resource_ok, c.col IS NOT NULL AS column_ok, coalesce(v.visible, false) AS visible, coalesce(p.first_pending < q.request_id, false) AS covered FROM q LEFT JOIN (SELECT DISTINCT resource FROM catalog) r ON q.resource = r.resource LEFT JOIN catalog c ON q.resource = c.resource AND q.col = c.col
  LEFT JOIN vis v ON q.user_id = v.user_id AND q.resource = v.resource AND q.col = v.col LEFT JOIN p ON q.user_id = p.user_id AND q.resource = p.resource AND q.col = p.col)
SELECT request_id, hours, CASE WHEN trim(reason) = '' THEN 'REASON_REQUIRED' WHEN NOT resource_ok THEN 'UNKNOWN_RESOURCE' WHEN NOT column_ok THEN 'UNKNOWN_COLUMN' WHEN visible THEN 'ALREADY_VISIBLE' WHEN hours IS NULL THEN 'BAD_DURATION' WHEN hours > 720 THEN 'TOO_LONG' WHEN covered THEN 'PENDING_COVERS' ELSE 'OK' END AS request_code,
 CASE WHEN status <> 'pending' THEN 'ALREADY_DECIDED' WHEN approver = user_id THEN 'SELF_APPROVAL' WHEN ends_in <= 0 THEN 'NOT_IN_FUTURE' WHEN ends_in > 720 THEN 'BEYOND_MAXIMUM' ELSE 'GRANT' END AS decision_code FROM j""")
# whoever asked sees their own requests, admins see all
operator("g06_listing", "requests grants", f"WITH {_USERS} SELECT u.user_id AS viewer, u.role, r.request_id, r.user_id AS asked_by, r.status FROM requests r JOIN u ON r.user_id = u.user_id OR u.role = 'admin'".replace("r JOIN u ON r.user_id = u.user_id OR u.role = 'admin'", "r JOIN u ON r.user_id = u.user_id WHERE u.role <> 'admin' UNION ALL SELECT a.user_id, a.role, r.request_id, r.user_id, r.status FROM requests r JOIN (SELECT user_id, role, 1 AS one FROM u WHERE role = 'admin') a ON a.one = 1"))
# policies for viewers, a few requested columns each: one with a column that is unknown is refused, of the others the latest holds
operator("g06_viewer_policy", "requests catalog", """WITH p AS (SELECT DISTINCT resource, request_id div CASE resource WHEN 'facts' THEN 8 ELSE 4 END AS version, col FROM requests), k AS (SELECT resource, col, pos, sensitive, true AS known FROM catalog),
c AS (SELECT p.resource, p.version, bool_and(coalesce(k.known, false)) AS valid, STRAGG(p.col BY p.col SEP ',') AS hidden_columns FROM p LEFT JOIN k ON p.resource = k.resource AND p.col = k.col GROUP BY p.resource, p.version),
l AS (SELECT resource, max(version) AS version FROM c WHERE valid GROUP BY resource),
h AS (SELECT p.resource, p.col, true AS is_hidden FROM p JOIN l ON p.resource = l.resource AND p.version = l.version)
SELECT k.resource, l.version, c.hidden_columns, coalesce(STRAGG(CASE WHEN NOT k.sensitive AND h.is_hidden IS NULL THEN k.col END BY k.pos SEP ','), '') AS viewer_columns
FROM k JOIN l ON k.resource = l.resource JOIN c ON c.resource = l.resource AND c.version = l.version LEFT JOIN h ON h.resource = k.resource AND h.col = k.col GROUP BY k.resource, l.version, c.hidden_columns""")

operator("j23_pending_covers", "requests", "SELECT DISTINCT r.request_id FROM requests r LEFT SEMI JOIN (SELECT * FROM requests WHERE status = 'pending') p ON r.user_id = p.user_id AND r.resource = p.resource AND r.col = p.col AND p.request_id < r.request_id")
operator("t04_export_items", "sources cells", "WITH s AS (SELECT tenant_id, 'source' AS kind, cast(source_id AS string) AS item, source_id % 13 <> 0 AS owned FROM sources), t AS (SELECT 'src' || table_id % 20 AS tenant_id, 'table' AS kind, cast(table_id AS string) AS item, true AS owned FROM (SELECT DISTINCT table_id FROM cells) c), a AS (SELECT * FROM s UNION ALL SELECT * FROM t), k AS (SELECT tenant_id, bool_and(owned) AS ok FROM a GROUP BY tenant_id) SELECT a.tenant_id, a.kind, a.item FROM a JOIN k ON a.tenant_id = k.tenant_id WHERE k.ok OR a.kind = 'table'")
operator("f26_durations", "requests", "SELECT request_id, CASE WHEN regexp_like(duration, RE'^[0-9]+ ?(h)?$') THEN cast(regexp_extract(duration, RE'^([0-9]+)', 1) AS bigint) WHEN regexp_like(duration, RE'^[0-9]+ ?d(ays)?$') THEN 24 * cast(regexp_extract(duration, RE'^([0-9]+)', 1) AS bigint) WHEN regexp_like(duration, RE'^[0-9]+w$') THEN 168 * cast(regexp_extract(duration, RE'^([0-9]+)', 1) AS bigint) END AS hours FROM requests")

# a block is locked for a user who may not see the values of facts
operator("p07_locked_blocks", "blocks grants catalog", f"""WITH {_VIS}, v AS (SELECT user_id, NOT bool_or(visible AND resource = 'facts' AND col = 'normalized_value') AS locked FROM vis GROUP BY user_id),
b AS (SELECT b.block_id, v.user_id, v.locked, b.block_type, b.text, split(b.text, ' ') AS cells FROM blocks b JOIN v ON v.user_id = 'user' || 4 * (b.line_no % 15))
SELECT block_id, user_id, CASE WHEN locked THEN 'locked_content' ELSE block_type END AS block_type, CASE WHEN NOT locked THEN text END AS text, array_join(CASE WHEN locked THEN transform(cells, x -> '') ELSE cells END, '|') AS cells FROM b""")
operator("p11_audit_filter", "audit", "SELECT seq, actor_id, event_type, object_id FROM audit WHERE ts >= (SELECT min(ts) FROM audit) AND seq BETWEEN 100 AND 100000 AND event_type IN ('error', 'view') AND actor_id BETWEEN 1 AND 4000 AND case_id IN ('case-7', 'case-17') AND object_id LIKE 'obj-%7'")
operator("s18_export_history", "audit", "SELECT actor_id AS owner, seq, object_id, cast(row_number() OVER (PARTITION BY actor_id ORDER BY seq DESC) AS bigint) AS newest_first FROM audit WHERE event_type = 'view'")

# audit, streaks, review

_CH = "SHA(cast(seq AS string) || '|' || tenant_id || '|' || event_type || '|' || coalesce(props, ''))"
operator("j24_checkpoints", "audit", f"WITH h AS (SELECT seq, {_CH} AS hash FROM audit), c AS (SELECT seq, CASE WHEN seq % 700 = 0 THEN 'other' ELSE hash END AS anchor FROM h WHERE seq % 100 = 0 UNION ALL SELECT max(seq) + 100, 'x' FROM h) SELECT c.seq, CASE WHEN h.hash IS NULL THEN 'truncated' WHEN h.hash <> c.anchor THEN 'mismatch' ELSE 'ok' END AS result FROM c LEFT JOIN h ON c.seq = h.seq")
operator("o03_limit_cap", "audit", "SELECT seq, event_type FROM audit ORDER BY seq LIMIT 500")
operator("o04_keyset_page", "audit", "WITH n AS (SELECT seq, event_type FROM audit WHERE seq > 120 ORDER BY seq LIMIT 51), r AS (SELECT *, row_number() OVER (ORDER BY seq) AS r, count(*) OVER () AS n FROM n) SELECT seq, event_type, CASE WHEN n > 50 THEN max(CASE WHEN r = 50 THEN seq END) OVER () END AS next_cursor FROM r WHERE r <= 50".replace("max(CASE WHEN r = 50 THEN seq END) OVER () END", "max(seq) OVER () END"))
operator("w08_repeated_blocks", "audit", "SELECT seq, actor_id, sum(CASE WHEN outcome = 'denied' THEN 1 ELSE 0 END) OVER (PARTITION BY actor_id ORDER BY seq ROWS UNBOUNDED PRECEDING) >= 3 AS alert FROM audit")
operator("w09_login_streak", "logins", "WITH i AS (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY username ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS island FROM logins), f AS (SELECT username, seq, cast(row_number() OVER (PARTITION BY username, island ORDER BY ts, seq) AS bigint) AS streak FROM i WHERE NOT success) SELECT username, seq, streak, streak >= 5 AS alert FROM f")
operator("w10_latest_decision", "action_events", "SELECT action_id, max_by(decision, seq) AS last_decision, max_by(actor, seq) AS last_actor FROM action_events WHERE decision IN ('approve', 'reject', 'execute') GROUP BY action_id")
operator("r08_once_per_key", "action_events", "SELECT idempotency_key, min(seq) AS seq FROM action_events WHERE decision = 'execute' GROUP BY idempotency_key")
operator("a16_status_rollup", "pipeline_steps", "SELECT source_id, CASE WHEN bool_and(ok) THEN 'complete' WHEN bool_or(ok) THEN 'partial' ELSE 'failed' END AS status, STRAGG(CASE WHEN NOT ok THEN step END BY step SEP ',') AS failed_steps FROM pipeline_steps GROUP BY source_id")
operator("a17_counters", "events", "SELECT user_id % 20 AS name, count_if(event_type = 'click') AS calls, count_if(event_type = 'error') AS retries, round(coalesce(count_if(event_type = 'error') / nullif(DOUBLED(count_if(event_type = 'click')), 0), 0), 8) AS retry_rate FROM events GROUP BY user_id % 20")
operator("a18_risk_level", "blocks", "SELECT source_id, CASE WHEN bool_or(check_status = 'fail') THEN 'high' WHEN bool_or(check_status = 'warn') THEN 'medium' ELSE 'low' END AS risk FROM blocks GROUP BY source_id")
operator("j15_evidence", "blocks sources", "SELECT b.block_id, coalesce(s.display_name, 'unknown') AS filename, b.page_number, coalesce(b.engine, 0.5e0) AS confidence FROM blocks b LEFT JOIN sources s ON b.source_id = s.source_id")
operator("j27_source_summary", "sources blocks", "WITH b AS (SELECT source_id, count(DISTINCT page_number) AS pages, count_if(check_status = 'warn') AS warnings FROM blocks GROUP BY source_id) SELECT s.source_id, s.display_name, coalesce(b.pages, 0) AS pages, coalesce(b.warnings, 0) AS warnings, CASE WHEN b.source_id IS NULL THEN 'missing' ELSE 'extracted' END AS status FROM sources s LEFT JOIN b ON s.source_id = b.source_id")
operator("g09_drafts", "requests", "SELECT request_id, 'Please review ' || resource || '.' || col || ' for ' || user_id || '.' AS body, substr(SHA('draft|' || request_id || '|' || col), 1, 16) AS action_id FROM requests")
operator("r03_login_alerts", "logins", "WITH i AS (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY username ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS island FROM logins) SELECT username, cast(island AS bigint) AS island, count(*) AS failures FROM i WHERE NOT success GROUP BY username, island HAVING count(*) >= 5")
operator("r04_window_counters", "events", "SELECT cast(date_trunc('hour', ts) AS string) AS hour, event_type, count(*) AS n FROM events GROUP BY date_trunc('hour', ts), event_type")
operator("s05_route", "spans", """WITH p AS (SELECT source_id, page_number, sum(length(text)) AS chars, (source_id * 7 + page_number * 3) % 10 / 10e0 AS image_ratio FROM spans GROUP BY source_id, page_number),
c AS (SELECT source_id, CASE WHEN chars < 15 THEN CASE WHEN image_ratio > 0 THEN 'image_only' ELSE 'blank' END WHEN image_ratio >= 0.6 THEN 'scanned' WHEN image_ratio >= 0.3 THEN 'mixed' ELSE 'native_text' END AS cls FROM p)
SELECT source_id, CASE WHEN bool_and(cls = 'blank') THEN 'blank_pdf' WHEN count(DISTINCT CASE WHEN cls <> 'blank' THEN cls END) = 1 THEN max(CASE WHEN cls <> 'blank' THEN cls END) || '_pdf' ELSE 'mixed_pdf' END AS route FROM c GROUP BY source_id""")
operator("w01_virtual_pages", "blocks", """WITH d AS (SELECT DISTINCT source_id, page_number FROM blocks), i AS (SELECT source_id % 20 AS bundle, substr(SHA(STRAGG(cast(source_id AS string) BY source_id SEP '|')), 1, 16) AS merge_id FROM (SELECT DISTINCT source_id FROM d) x GROUP BY source_id % 20)
SELECT i.merge_id, source_id % 20 AS bundle, source_id, page_number, cast(row_number() OVER (PARTITION BY source_id % 20 ORDER BY source_id, page_number) AS bigint) AS virtual_page, page_number = 1 AS boundary_start FROM d JOIN i ON d.source_id % 20 = i.bundle""")
operator("w12_question_memory", "conversations", """SELECT conv_id, turn, coalesce(array_join(collect_list(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), ' | '), '') AS remembered, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS n FROM conversations WHERE role = 'user'""")
operator("j17_citations", "blocks ocr_spans", """WITH s AS (SELECT source_id, line_no, CASE WHEN line_no % 3 <> 0 THEN source_id || '-' || line_no END AS block_id, 'fact-' || source_id || '-' || line_no AS fact_id FROM ocr_spans), b AS (SELECT block_id FROM blocks WHERE block_type <> 'figure'), f AS (SELECT 'fact-' || block_id AS fact_id, block_id FROM blocks WHERE block_type = 'paragraph')
SELECT s.source_id, s.line_no, coalesce(b.block_id, f.block_id, 'source ' || s.source_id) AS citation FROM s LEFT JOIN b ON s.block_id = b.block_id LEFT JOIN f ON s.fact_id = f.fact_id""")
operator("g08_review_rules", "action_events", """WITH r AS (SELECT action_id, seq, decision, CASE seq % 3 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE 'looked at' END AS note FROM action_events WHERE decision IN ('approve', 'reject')), k AS (SELECT *, decision = 'reject' AND trim(note) = '' AS no_note FROM r),
d AS (SELECT *, sum(CASE WHEN no_note THEN 0 ELSE 1 END) OVER (PARTITION BY action_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k)
SELECT action_id, seq, CASE WHEN no_note THEN 'NOTE_REQUIRED' WHEN coalesce(before, 0) > 0 THEN 'ALREADY_REVIEWED' ELSE 'OK' END AS code, CASE WHEN NOT no_note AND coalesce(before, 0) = 0 THEN CASE decision WHEN 'approve' THEN 'acknowledged' ELSE 'dismissed' END END AS status FROM d""")
operator("g10_policy_checks", "documents labels", """SELECT d.doc_id, NOT regexp_like(lower(coalesce(text, '')), RE'\\b(fraud|false|deceptive|ineligible)\\b') AS banned_ok, NOT regexp_like(coalesce(text, ''), RE'[A-Za-z0-9.+-]+@[A-Za-z0-9-]+[.][A-Za-z]+|[0-9]{6,}') AS pii_ok, l.doc_id IS NOT NULL AS evidence_ok, length(coalesce(text, '')) <= 4000 AS length_ok FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
operator("f28_chart_or_figure", "regions spans", """WITH t AS (SELECT r.source_id, r.region_id, STRAGG(s.text BY s.line_no SEP ' ') AS text FROM regions r JOIN spans s ON s.source_id = r.source_id AND s.page_number = r.page_number AND s.line_no div 5 = r.region_id WHERE r.type = 'figure' GROUP BY r.source_id, r.region_id)
SELECT source_id, region_id, CASE WHEN size(array_distinct(regexp_extract_all(text, RE'[0-9]+', 0))) >= 4 OR regexp_like(lower(text), RE'chart|graph') THEN 'chart' ELSE 'figure' END AS kind FROM t""")
operator("r01_alert_dedup", "events", """WITH e AS (SELECT event_id, event_type || ':' || user_id % 10 AS k, date_trunc('hour', ts) AS hour, event_type IN ('signup', 'error') AS never FROM events), a AS (SELECT *, cast(row_number() OVER (PARTITION BY k, hour, never ORDER BY event_id) AS bigint) AS r, count(*) OVER (PARTITION BY k, hour, never) AS n FROM e)
SELECT event_id, k, cast(hour AS string) AS hour, CASE WHEN never THEN 1 ELSE n END AS times FROM a WHERE never OR r = 1""")
