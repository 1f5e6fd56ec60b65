"""Queries over joins, ranks, sets and status changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import scalars as S
from auditlake.operators import joins as J, lifecycle as L, ordering as O, review as RV, sampling as SA, sets as U, tuning as T
from auditlake.operators import predicates as P
from auditlake.plans.filters import _CANDIDATES, EXT, rank_sql
from auditlake.plans.registry import query



@query(
    "j1_range_chunk",
    """SELECT finding_id, f.file_id, line_number, arg_min(chunk_id, chunk_index) AS chunk_id FROM findings f JOIN chunks c
    ON f.file_id = c.file_id AND line_number BETWEEN start_line AND end_line GROUP BY ALL""",
)
def j1(t):
    return J.enclosing_chunk(t.findings, t.chunks)


@query(
    "j2_chain",
    """WITH d AS (SELECT draft_id, scan_id, file_id * 100000 + draft_id % 3 AS chunk_id, CASE WHEN draft_id % 4 = 0 THEN concat('own/', draft_id) END AS draft_path FROM drafts)
    SELECT draft_id, d.scan_id, d.chunk_id, start_line, target, coalesce(draft_path, file_path, 'unknown') AS path
    FROM d LEFT JOIN chunks c ON c.chunk_id = d.chunk_id LEFT JOIN files f ON f.file_id = c.file_id JOIN scans s ON s.scan_id = d.scan_id""",
)
def j2(t):
    drafts = t.drafts.selectExpr(
        "draft_id", "scan_id", "file_id * 100000 + draft_id % 3 AS chunk_id", "if(draft_id % 4 = 0, concat('own/', draft_id), null) AS draft_path"
    )
    return J.draft_chain(drafts, t.chunks, t.files, t.scans).select("draft_id", "scan_id", "chunk_id", "start_line", "target", "path")


_REVIEWS = "rv AS (SELECT c_custkey % 20 AS watcher_id, c_custkey % 500 AS iid, CASE c_nationkey % 3 WHEN 0 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN c_custkey % 2 = 0 THEN 1 END AS reviewed_at FROM customer)"


@query(
    "j5_unreviewed",
    f"WITH {_REVIEWS} SELECT change_id, watcher_id, iid FROM changes c ANTI JOIN (SELECT * FROM rv WHERE status = 'completed' AND reviewed_at IS NOT NULL) r USING (watcher_id, iid)",
)
def j5(t):
    reviews = t.customer.selectExpr(
        "c_custkey % 20 AS watcher_id", "c_custkey % 500 AS iid", "if(c_nationkey % 3 = 0, 'completed', 'failed') AS status",
        "if(c_custkey % 2 = 0, 1, null) AS reviewed_at",
    )
    return L.unreviewed(t.changes.select("change_id", "watcher_id", "iid"), reviews)


@query(
    "j6_import_new",
    "SELECT DISTINCT draft_id FROM votes ANTI JOIN (SELECT draft_id FROM verified) v USING (draft_id)",
)
def j6(t):
    return J.new_cases(t.votes.select("draft_id"), t.verified, "draft_id")


_VERDICT = "CASE status WHEN 'verified' THEN 'REAL' WHEN 'rejected' THEN 'FALSE_POSITIVE' WHEN 'weakness' THEN 'WEAKNESS' ELSE 'UNKNOWN' END"


@query(
    "j7_draft_verdict",
    f"SELECT d.draft_id, CASE WHEN v.draft_id IS NOT NULL THEN 'REAL' ELSE {_VERDICT.replace('status', 's')} END AS verdict FROM (SELECT draft_id, CASE WHEN status = 'verified' THEN 'pending' ELSE status END AS s FROM drafts) d LEFT JOIN verified v USING (draft_id)",
)
def j7(t):
    return J.draft_verdict(t.drafts.replace({"verified": "pending"}, subset=["status"]), t.verified).select("draft_id", "verdict")


@query("j7_verified_semi", "SELECT draft_id, title FROM drafts SEMI JOIN verified USING (draft_id)")
def j7_semi(t):
    return J.verified_drafts(t.drafts, t.verified).select("draft_id", "title")


_LOWER_LANG = f"CASE {EXT} WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'cpp' THEN 'cpp' WHEN 'hpp' THEN 'cpp' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' ELSE 'c' END"


@query(
    "j9_applicable_analyzers",
    rf"""WITH a AS (SELECT n_name AS analyzer, CASE n_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '^.*\.c$|^.*\.h$' ELSE '^f1.*$' END AS g,
      CASE n_regionkey WHEN 0 THEN 'python' WHEN 1 THEN 'c' ELSE NULL END AS l FROM nation)
    SELECT file_id, analyzer FROM files, a WHERE (g IS NULL OR regexp_matches(regexp_extract(file_path, '([^/]*)$', 1), g)) AND (l IS NULL OR l = {_LOWER_LANG})""",
)
def j9(t):
    c, h, f1 = (P.glob_regex(g) for g in ("*.c", "*.h", "f1*"))
    analyzers = t.nation.select(
        F.col("n_name").alias("analyzer"),
        F.when(F.col("n_nationkey") % 3 == 1, F.array(F.lit(c), F.lit(h))).when(F.col("n_nationkey") % 3 == 2, F.array(F.lit(f1))).alias("glob_regexes"),
        F.when(F.col("n_regionkey") == 0, F.array(F.lit("Python"))).when(F.col("n_regionkey") == 1, F.array(F.lit("C"))).alias("languages"),
    )
    return J.applicable_analyzers(t.files, analyzers)


_CATS = "cats AS (SELECT n_nationkey AS category_id, concat(n_name, ' category') AS name, CASE WHEN n_nationkey < 6 THEN concat('CWE-', n_nationkey) END AS cwe_id, CASE n_regionkey WHEN 0 THEN ['memory', 'leak', 'code'] WHEN 1 THEN ['sql', 'injection', 'cwe'] WHEN 2 THEN ['cross', 'scripting'] WHEN 3 THEN ['hardcoded', 'buffer'] ELSE ['leak', 'memory', 'handler'] END AS keywords FROM nation)"
_J11 = f"""{_CATS}, f AS (SELECT draft_id AS finding_id, CASE WHEN draft_id % 2 = 0 THEN vulnerability_type ELSE title END AS raw_category FROM drafts),
    tx AS (SELECT DISTINCT raw_category, CASE WHEN starts_with(raw_category, 'CWE-') THEN raw_category END AS cwe FROM f),
    ex AS (SELECT cwe_id, arg_min(name, category_id) AS exact FROM cats WHERE cwe_id IS NOT NULL GROUP BY cwe_id),
    o AS (SELECT raw_category, exact FROM tx LEFT JOIN ex ON cwe = cwe_id),
    sc AS (SELECT raw_category, name, category_id, len(list_filter(list_distinct(keywords), lambda k: contains(lower(raw_category), k) AND k NOT IN ('cwe', 'buffer', 'code', 'copy', 'size', 'check', 'related', 'also'))) AS score FROM o, cats WHERE exact IS NULL),
    fz AS (SELECT raw_category, arg_min(name, ROW(-score, category_id)) AS fuzzy FROM sc WHERE score >= 2 GROUP BY raw_category)"""


@query(
    "j11_category",
    f"WITH {_J11} SELECT finding_id, raw_category, coalesce(exact, fuzzy, raw_category) AS category, coalesce(exact, fuzzy) IS NULL AS is_new FROM f JOIN o USING (raw_category) LEFT JOIN fz USING (raw_category)",
)
def j11(t):
    return J.match_categories(_raw_categories(t), _categories(t))


def _raw_categories(t):
    return t.drafts.selectExpr("draft_id AS finding_id", "if(draft_id % 2 = 0, vulnerability_type, title) AS raw_category")


def _categories(t):
    return t.nation.selectExpr(
        "n_nationkey AS category_id", "concat(n_name, ' category') AS name", "if(n_nationkey < 6, concat('CWE-', n_nationkey), null) AS cwe_id",
        "CASE n_regionkey WHEN 0 THEN array('memory', 'leak', 'code') WHEN 1 THEN array('sql', 'injection', 'cwe') WHEN 2 THEN array('cross', 'scripting') "
        "WHEN 3 THEN array('hardcoded', 'buffer') ELSE array('leak', 'memory', 'handler') END AS keywords",
    )


@query(
    "j11_new_categories",
    f"""WITH {_J11}, m AS (SELECT raw_category AS category FROM f JOIN o USING (raw_category) LEFT JOIN fz USING (raw_category) WHERE coalesce(exact, fuzzy) IS NULL)
    SELECT category, CASE WHEN starts_with(category, 'CWE-') THEN category END AS cwe_id, nullif(regexp_extract(category, '\\b([A-Z]{{2,6}})\\b', 1), '') AS short_name, count(*) AS usage_count FROM m GROUP BY category""",
)
def j11_new(t):
    return J.new_categories(J.match_categories(_raw_categories(t), _categories(t))).drop("keywords")


@query(
    "j12_import_resolution",
    f"""WITH k AS (SELECT CASE WHEN {EXT} = 'py' THEN replace(regexp_replace(file_path, '\\.py$', ''), '/', '.') ELSE regexp_extract(file_path, '([^/]*)$', 1) END AS key, file_path FROM files
      UNION ALL SELECT regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.py$', ''), file_path FROM files WHERE {EXT} = 'py'),
    tg AS (SELECT key, min(file_path) AS resolved_file FROM k GROUP BY key),
    im AS (SELECT doc_id AS file_id, CASE doc_id % 4 WHEN 0 THEN concat('f', doc_id, '.helpers.x') WHEN 1 THEN concat('f', doc_id) WHEN 2 THEN concat('f', doc_id, '.cpp') ELSE concat('lib', doc_id) END AS module FROM documents),
    c AS (SELECT file_id, module, unnest(list_concat([module], list_transform(range(len(string_split(module, '.')), 0, -1), lambda n: array_to_string(string_split(module, '.')[1:n], '.')), [concat(module, '.h'), concat(module, '.hpp'), concat(module, '.c'), concat(module, '.cpp')])) AS key,
      generate_subscripts(list_concat([module], range(len(string_split(module, '.')), 0, -1)::VARCHAR[], ['', '', '', '']), 1) AS rk FROM im),
    b AS (SELECT file_id, arg_min(resolved_file, rk) AS resolved_file FROM c JOIN tg USING (key) GROUP BY file_id)
    SELECT file_id, module, resolved_file FROM im LEFT JOIN b USING (file_id)""",
)
def j12(t):
    imports = t.documents.selectExpr(
        "doc_id AS file_id",
        "CASE doc_id % 4 WHEN 0 THEN concat('f', doc_id, '.helpers.x') WHEN 1 THEN concat('f', doc_id) WHEN 2 THEN concat('f', doc_id, '.cpp') ELSE concat('lib', doc_id) END AS module",
    )
    return J.resolve_imports(imports, t.files).select("file_id", "module", "resolved_file")


_CASES_SQL = """cs AS (SELECT doc_id AS case_id, toxic = 1 OR doc_id % 3 = 0 AS is_vulnerable, CASE doc_id % 4 WHEN 0 THEN 'buffer overflow' WHEN 1 THEN 'injection' ELSE 'leak' END AS expected_type,
      CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(doc_id % 12 AS INT) END AS expected_line FROM labels),
    ff AS (SELECT file_id AS case_id, finding_id, title, description, line_number FROM findings QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY finding_id) = 1),
    mt AS (SELECT c.case_id, f.finding_id IS NOT NULL AS hasf, is_vulnerable, contains(lower(title), expected_type) OR contains(lower(description), expected_type) AS hit,
      expected_line IS NULL OR expected_line = 0 OR abs(expected_line - line_number) <= 5 AS near FROM cs c LEFT JOIN ff f USING (case_id)),
    matched AS (SELECT case_id, CASE WHEN NOT hasf THEN CASE WHEN is_vulnerable THEN 'FN' ELSE 'TN' END WHEN NOT is_vulnerable THEN 'FP' WHEN hit AND near THEN 'TP'
      WHEN hit THEN 'TP (Line Miss)' ELSE 'TP (Type Miss)' END AS verdict FROM mt)"""


def _matched(t):
    cases = t.labels.selectExpr(
        "doc_id AS case_id", "toxic = 1 OR doc_id % 3 = 0 AS is_vulnerable",
        "CASE doc_id % 4 WHEN 0 THEN 'Buffer Overflow' WHEN 1 THEN 'Injection' ELSE 'Leak' END AS expected_type",
        "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(doc_id % 12 AS INT) END AS expected_line", "doc_id * 10 AS latency_ms",
    )
    found = t.findings.select(F.col("file_id").alias("case_id"), "finding_id", "title", "description", "line_number")
    return J.case_matches(cases, found)


@query("j15_case_match", f"WITH {_CASES_SQL} SELECT case_id, verdict FROM matched")
def j15(t):
    return _matched(t).select("case_id", "verdict")


@query(
    "a36_benchmark_summary",
    f"""WITH {_CASES_SQL} SELECT count(*) AS total, count(*) FILTER (starts_with(verdict, 'TP') OR verdict = 'TN') AS passed,
      count(*) FILTER (NOT (starts_with(verdict, 'TP') OR verdict = 'TN')) AS failed, avg(case_id * 10) AS avg_latency_ms, CAST(sum(case_id * 10) AS BIGINT) AS total_latency_ms FROM matched""",
)
def a36(t):
    return T.benchmark_summary(_matched(t))


@query(
    "j16_chain_recursive",
    """WITH RECURSIVE r AS (SELECT scan_id, scan_id AS cur, [scan_id] AS seen, 0 AS hops FROM scans
      UNION ALL SELECT r.scan_id, s.source_scan_id, list_append(seen, s.source_scan_id), hops + 1 FROM r JOIN scans s ON s.scan_id = r.cur
        WHERE s.source_scan_id IN (SELECT scan_id FROM scans) AND NOT list_contains(seen, s.source_scan_id)),
    e AS (SELECT r.scan_id, cur, hops FROM r JOIN scans s ON s.scan_id = r.cur WHERE s.source_scan_id IS NULL OR s.source_scan_id NOT IN (SELECT scan_id FROM scans))
    SELECT s.scan_id, e.cur AS root_scan_id, CAST(e.hops AS BIGINT) AS hops FROM scans s LEFT JOIN e USING (scan_id)""",
)
def j16(t):
    return J.resolve_sources(t.scans).drop("circular")


@query(
    "j18_subscriptions",
    f"""WITH al AS (SELECT finding_id, severity, CASE WHEN finding_id % 10 = 0 THEN 'scan_complete' ELSE 'finding' END AS event FROM alert_findings)
    SELECT finding_id, event, webhook_id FROM al, subscriptions s WHERE enabled AND list_contains(events, event) AND (event <> 'finding' OR {rank_sql('severity')} >= {rank_sql('min_severity')})""",
)
def j18(t):
    alerts = t.alert_findings.selectExpr("finding_id", "severity", "if(finding_id % 10 = 0, 'scan_complete', 'finding') AS event")
    return J.matching_subscriptions(alerts, t.subscriptions).select("finding_id", "event", "webhook_id")


@query(
    "j19_fuzzy_paths",
    """WITH q AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN concat('wrong/f', c_custkey, '.c') WHEN 1 THEN concat('F', c_custkey, '.hpp') ELSE concat('x/', c_custkey % 10, '.cp') END AS query FROM customer),
    b AS (SELECT query, regexp_extract(query, '([^/]*)$', 1) AS base FROM q), n AS (SELECT file_path, regexp_extract(file_path, '([^/]*)$', 1) AS name FROM files),
    h AS (SELECT query, file_path, CASE WHEN name = base THEN 0 WHEN lower(name) = lower(base) THEN 1 ELSE 2 END AS tier FROM b JOIN n ON contains(lower(name), lower(base)))
    SELECT query, min(tier) AS tier, arg_min(file_path, ROW(tier, file_path)) AS file_path FROM h GROUP BY query""",
)
def j19(t):
    wanted = t.customer.selectExpr(
        "CASE c_custkey % 3 WHEN 0 THEN concat('wrong/f', c_custkey, '.c') WHEN 1 THEN concat('F', c_custkey, '.hpp') ELSE concat('x/', c_custkey % 10, '.cp') END AS query"
    )
    return J.fuzzy_paths(wanted, t.files)


@query(
    "j21_cached_results",
    "SELECT file_id, lang AS analyzer, md5(content) AS content_hash, CAST(length(content) AS INT) AS result FROM files",
)
def j21(t):
    requests = t.files.selectExpr("file_id", "lang AS analyzer", "content")
    return J.cached_results(requests, lambda once: once.withColumn("result", F.length("content"))).select(
        "file_id", "analyzer", "content_hash", "result"
    )


@query(
    "j22_result_details",
    """SELECT r.result_id, 'prompt ' || r_name AS prompt_name, coalesce(d.title, 'case ' || c.case_id) AS title, coalesce(d.severity, 'Medium') AS severity
    FROM tuning_results r LEFT JOIN region ON concat('p', r_regionkey) = r.prompt_id LEFT JOIN tuning_cases c USING (case_id)
    LEFT JOIN drafts d ON d.draft_id = CASE WHEN c.case_id % 2 = 0 THEN c.case_id END""",
)
def j22(t):
    prompts = t.region.selectExpr("concat('p', r_regionkey) AS prompt_id", "concat('prompt ', r_name) AS prompt_name")
    cases = t.tuning_cases.selectExpr(
        "case_id", "concat('case ', case_id) AS case_title", "'Medium' AS case_severity", "if(case_id % 2 = 0, case_id, null) AS linked_draft"
    )
    return J.result_details(t.tuning_results, prompts, cases, t.drafts).select("result_id", "prompt_name", "title", "severity")


@query(
    "j23_grid_fill",
    """SELECT c_custkey AS profile_id, n_name AS model_name, coalesce((SELECT r_name FROM region WHERE r_regionkey = c_nationkey % 7), 'none') AS enricher FROM customer, nation
    WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey AND s_nationkey = n_nationkey)""",
)
def j23(t):
    enricher = t.region.selectExpr("r_regionkey AS k", "r_name")
    profiles = (
        t.customer.withColumn("k", F.col("c_nationkey") % 7)
        .join(enricher, "k", "left")
        .select(F.col("c_custkey").alias("profile_id"), F.coalesce("r_name", F.lit("none")).alias("enricher"))
    )
    verifiers = t.nation.select(F.col("n_name").alias("model_name"))
    existing = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("s_suppkey AS profile_id", "n_name AS model_name")
    return J.missing_grid(profiles, verifiers, existing)


@query(
    "j24_suffix_match",
    """WITH c AS (SELECT o_orderkey AS case_id, concat('f', o_custkey, '.c', CASE WHEN o_orderkey % 2 = 0 THEN concat(':', o_orderkey % 90) ELSE '' END) AS raw_path, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 5 END AS l FROM orders),
    p AS (SELECT case_id, regexp_replace(raw_path, ':\\d+$', '') AS tail, coalesce(try_cast(nullif(regexp_extract(raw_path, ':(\\d+)$', 1), '') AS INT), l) AS line_number FROM c)
    SELECT case_id, line_number, scan_id, file_id, file_path FROM p JOIN files ON regexp_extract(file_path, '([^/]*)$', 1) = regexp_extract(tail, '([^/]*)$', 1) AND ends_with(file_path, tail)
    WHERE line_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY scan_id DESC, file_id) = 1""",
)
def j24(t):
    cases = t.orders.selectExpr(
        "o_orderkey AS case_id", "concat('f', o_custkey, '.c', if(o_orderkey % 2 = 0, concat(':', o_orderkey % 90), '')) AS raw_path",
        "if(o_orderkey % 3 = 0, null, 5) AS line_number",
    )
    return J.newest_suffix_match(cases, t.files)


@query(
    "j25_deliveries",
    """SELECT delivery_id, webhook_id, webhook_name FROM (SELECT event_id AS delivery_id, user_id % 30 AS webhook_id, ts AS created_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 40)
    LEFT JOIN subscriptions USING (webhook_id)""",
)
def j25(t):
    deliveries = t.events.selectExpr("event_id AS delivery_id", "user_id % 30 AS webhook_id", "user_id % 20 AS scan_id", "ts AS created_at")
    return J.recent_deliveries(deliveries, t.subscriptions, 40).select("delivery_id", "webhook_id", "webhook_name")


@query(
    "a38_review_summary",
    """WITH f AS (SELECT draft_id AS finding_id, file_id AS change_id, upper(severity) AS severity, title, concat('f', file_id) AS file_path, line_number FROM drafts),
    c AS (SELECT change_id, count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
      count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM f GROUP BY change_id),
    l AS (SELECT change_id, string_agg(concat('- [', severity, '] ', title, ': ', file_path, ' line ', line_number), chr(10) ORDER BY finding_id) AS lines
      FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY finding_id) <= 10) GROUP BY change_id)
    SELECT c.*, concat(lines, CASE WHEN total > 10 THEN concat(chr(10), '... and ', total - 10, ' more findings') ELSE '' END) AS summary,
      CASE WHEN critical + high > 0 THEN 'changes_requested' ELSE 'pending' END AS approval FROM c JOIN l USING (change_id)""",
)
def a38(t):
    found = t.drafts.selectExpr(
        "draft_id AS finding_id", "file_id AS change_id", "upper(severity) AS severity", "title", "concat('f', file_id) AS file_path", "line_number"
    )
    return RV.review_summary(found)


@query(
    "w1_latest_config",
    "SELECT scan_id, draft_id, title FROM drafts QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY created_at DESC, draft_id DESC) = 1",
)
def w1(t):
    return O.latest_per_key(t.drafts.select("scan_id", "draft_id", "title", "created_at"), ["scan_id"], ["created_at", "draft_id"]).drop("created_at")


@query(
    "w3_balanced",
    f"""WITH {_CANDIDATES}, p AS (SELECT draft_id FROM cand QUALIFY row_number() OVER (PARTITION BY status ORDER BY abs(0.5 - avg_confidence) DESC, draft_id) <= 33)
    SELECT c.draft_id, status, p.draft_id IS NOT NULL AS balanced FROM cand c LEFT JOIN p USING (draft_id) ORDER BY balanced DESC, c.draft_id LIMIT 100""",
)
def w3(t):
    return SA.balanced_sample(SA.candidates(t.drafts, t.votes), 100).select("draft_id", "status", "balanced")


@query(
    "w4_quota",
    f"SELECT draft_id, verdict FROM (SELECT draft_id, {_VERDICT} AS verdict FROM drafts) QUALIFY row_number() OVER (PARTITION BY verdict ORDER BY draft_id) <= 50",
)
def w4(t):
    cases = t.drafts.withColumn("verdict", S.lookup(S.STATUS_VERDICT, F.col("status"), "UNKNOWN"))
    return SA.first_come_quota(cases, 150).select("draft_id", "verdict")


_STREAK = """g AS (SELECT log_id, model_name, created_at, NOT parse_success AS failed, sum(CASE WHEN parse_success THEN 1 ELSE 0 END) OVER (PARTITION BY model_name ORDER BY created_at, log_id) AS isl FROM llm_log),
    st AS (SELECT log_id, model_name, CAST(CASE WHEN failed THEN sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY model_name, isl ORDER BY created_at, log_id) ELSE 0 END AS BIGINT) AS streak FROM g)"""


@query("w11_streak", f"WITH {_STREAK} SELECT log_id, model_name, streak, streak >= 5 AS paused FROM st")
def w11(t):
    log = t.llm_log.select("log_id", "model_name", "created_at", "parse_success")
    return O.error_streaks(log, ["model_name"], ["created_at", "log_id"], ~F.col("parse_success")).select(
        "log_id", "model_name", "streak", "paused"
    )


_RUNS = "SELECT scan_id, analyzer_name, CAST(substr(analyzer_name, 2) AS INT) AS run_order, count(*) FILTER (status = 'verified') AS found, CAST(substr(analyzer_name, 2) AS INT) IN (2, 5) AS stop_on_findings FROM drafts WHERE analyzer_name IS NOT NULL GROUP BY ALL"


@query(
    "w13_stop_on_findings",
    f"""WITH r AS ({_RUNS}), s AS (SELECT scan_id, min(run_order) AS stop FROM r WHERE stop_on_findings AND found > 0 GROUP BY scan_id)
    SELECT r.scan_id, analyzer_name, run_order, found FROM r LEFT JOIN s USING (scan_id) WHERE stop IS NULL OR run_order <= stop""",
)
def w13(t):
    runs = (
        t.drafts.where("analyzer_name is not null")
        .groupBy("scan_id", "analyzer_name")
        .agg(F.count_if(F.col("status") == "verified").alias("found"))
        .selectExpr("*", "cast(substr(analyzer_name, 2) as int) AS run_order", "cast(substr(analyzer_name, 2) as int) in (2, 5) AS stop_on_findings")
    )
    return O.stop_on_findings(runs).select("scan_id", "analyzer_name", "run_order", "found")


_NEW_NAMES = "CASE o_custkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'fresh' ELSE concat('n', o_custkey % 40) END"
# Stored names have gaps: BUILDING, BUILDING_2, fresh_1, fresh_4.
_STORED_NAMES = "SELECT c_mktsegment AS name FROM customer UNION ALL SELECT CASE n_nationkey % 3 WHEN 0 THEN 'BUILDING_2' WHEN 1 THEN 'fresh_1' ELSE 'fresh_4' END FROM nation"


@query(
    "w14_unique_names",
    f"""WITH n AS (SELECT o_orderkey AS draft_id, {_NEW_NAMES} AS name FROM orders), x AS ({_STORED_NAMES}),
    k AS (SELECT name, unnest(range(0, count(*) + 10)) AS g FROM n GROUP BY name),
    fr AS (SELECT name, g, row_number() OVER (PARTITION BY name ORDER BY g) AS i FROM k
      WHERE CASE WHEN g = 0 THEN name NOT IN (SELECT name FROM x) ELSE concat(name, '_', g) NOT IN (SELECT name FROM x UNION SELECT name FROM n) END),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY draft_id) AS i FROM n)
    SELECT draft_id, name, CASE WHEN g > 0 THEN concat(name, '_', g) ELSE name END AS unique_name FROM r JOIN fr USING (name, i)""",
)
def w14(t):
    new = t.orders.selectExpr("o_orderkey AS draft_id", f"{_NEW_NAMES} AS name")
    stored = t.customer.selectExpr("c_mktsegment AS name").unionAll(
        t.nation.selectExpr("CASE n_nationkey % 3 WHEN 0 THEN 'BUILDING_2' WHEN 1 THEN 'fresh_1' ELSE 'fresh_4' END AS name")
    )
    return SA.unique_names(new, stored)


@query(
    "w15_run_order",
    "SELECT s_nationkey AS profile_id, s_name AS model_name, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS INT) AS run_order FROM supplier",
)
def w15(t):
    return O.run_order(t.supplier.selectExpr("s_nationkey AS profile_id", "s_name AS model_name"))


@query(
    "o1_risk_batch",
    "SELECT chunk_id, risk FROM (SELECT chunk_id, CASE chunk_index % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'normal' END AS risk FROM chunks WHERE status = 'pending') ORDER BY CASE risk WHEN 'high' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END, chunk_id LIMIT 60",
)
def o1(t):
    chunks = t.chunks.where("status = 'pending'").selectExpr("chunk_id", "CASE chunk_index % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'normal' END AS risk")
    return O.risk_batch(chunks, 60)


_SEV_ORDER = "CASE lower(severity) WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


@query(
    "o2_verify_queue",
    f"SELECT draft_id, severity, initial_votes FROM drafts WHERE status = 'rejected' ORDER BY {_SEV_ORDER}, coalesce(initial_votes, 0) DESC, created_at, draft_id LIMIT 80",
)
def o2(t):
    return O.verify_queue(t.drafts.replace({"rejected": "pending"}, subset=["status"]), 80).select("draft_id", "severity", "initial_votes")


@query(
    "o3_remediation_order",
    f"SELECT finding_id, scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY {_SEV_ORDER}, finding_id) AS position FROM findings",
)
def o3(t):
    return O.remediation_order(t.findings.select("finding_id", "scan_id", "severity")).select("finding_id", "scan_id", "position")


@query(
    "o4_leaderboards",
    "SELECT source_model, count(*) AS n, count(*) FILTER (severity = 'Critical') AS critical FROM findings GROUP BY ALL ORDER BY critical DESC, n DESC",
)
def o4(t):
    return (
        t.findings.groupBy("source_model")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "Critical").alias("critical"))
        .orderBy(F.desc("critical"), F.desc("n"), "source_model")
    )


@query("o5_page", "SELECT log_id, model_name FROM llm_log ORDER BY created_at DESC, log_id OFFSET 100 LIMIT 50")
def o5(t):
    return P.page(t.llm_log, [F.desc("created_at"), F.col("log_id")], 100, 50).select("log_id", "model_name")


@query(
    "o7_listing",
    """WITH s AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY file_path) <= 15), c AS (SELECT scan_id, count(*) AS total FROM files GROUP BY scan_id)
    SELECT scan_id, total, concat(string_agg(file_path, chr(10) ORDER BY file_path), CASE WHEN total > 15 THEN concat(chr(10), '... and ', total - 15, ' more') ELSE '' END) AS listing FROM s JOIN c USING (scan_id) GROUP BY scan_id, total""",
)
def o7(t):
    return O.listing_with_tail(t.files, "scan_id", "file_path", 15)


@query(
    "u1_union_drafts",
    """SELECT scan_id, title, severity, line_number, NULL AS sink FROM drafts UNION ALL
    SELECT NULL, NULL, severity, line_number, NULL FROM raw_drafts UNION ALL SELECT NULL, NULL, NULL, NULL, record_id FROM pipe_records""",
)
def u1(t):
    return U.union_drafts(
        t.drafts.select("scan_id", "title", "severity", "line_number"),
        t.raw_drafts.select("severity", "line_number"),
        t.pipe_records.selectExpr("record_id AS sink"),
    )


@query(
    "u2_dashboard",
    "SELECT finding_id, severity, 'scan' AS origin FROM findings UNION ALL SELECT finding_id, severity, 'review' FROM alert_findings",
)
def u2(t):
    return U.tagged_union(scan=t.findings.select("finding_id", "severity"), review=t.alert_findings.select("finding_id", "severity"))


@query(
    "u3_glob_union",
    """WITH e AS (SELECT DISTINCT c_nationkey AS profile_id, trim(unnest(string_split(concat('*.c, *.h,', CASE c_custkey % 3 WHEN 0 THEN '*.py' WHEN 1 THEN ' ' ELSE c_mktsegment END), ','))) AS g FROM customer WHERE c_custkey % 5 <> 0)
    SELECT profile_id, g AS "glob" FROM e WHERE g <> ''""",
)
def u3(t):
    return U.glob_union(
        t.customer.selectExpr(
            "c_nationkey AS profile_id", "c_custkey % 5 <> 0 AS enabled",
            "concat('*.c, *.h,', CASE c_custkey % 3 WHEN 0 THEN '*.py' WHEN 1 THEN ' ' ELSE c_mktsegment END) AS file_filter",
        )
    )


@query("u4_except", "SELECT draft_id, status FROM drafts EXCEPT ALL SELECT draft_id, 'verified' FROM verified")
def u4(t):
    return U.not_picked(t.drafts.select("draft_id", "status"), t.verified.selectExpr("draft_id", "'verified' AS status"))


@query(
    "u5_valid_ids",
    """WITH a AS (SELECT c_custkey % 50 AS scan_id, concat('list', c_custkey) AS list_name, [c_custkey * 7, c_custkey + 50, c_custkey, c_custkey + 1] AS ids FROM customer),
    e AS (SELECT scan_id, list_name, unnest(ids) AS finding_id, generate_subscripts(ids, 1) AS pos FROM a)
    SELECT e.scan_id, list_name, list(finding_id ORDER BY pos) AS ids FROM e SEMI JOIN findings f ON f.finding_id = e.finding_id AND f.scan_id = e.scan_id GROUP BY ALL""",
)
def u5(t):
    answers = t.customer.selectExpr(
        "c_custkey % 50 AS scan_id", "concat('list', c_custkey) AS list_name", "array(c_custkey * 7, c_custkey + 50, c_custkey, c_custkey + 1) AS ids"
    )
    return U.existing_ids(answers, t.findings)


_FIELDS = P.REQUIRED_FIELDS


@query(
    "u6_fill_blanks",
    "SELECT e.draft_id, " + ", ".join(
        f"CASE WHEN trim(coalesce({f}, '')) = '' AND {v} <> '' THEN {v} ELSE {f} END AS {f}"
        for f, v in zip(_FIELDS, ["'x'", "'cat'", "'Low'", "''", "'retry poc'", "'retry fix'"])
    ) + " FROM enriched e",
)
def u6(t):
    retry = t.enriched.selectExpr(
        "draft_id", "'x' AS finding", "'cat' AS category", "'Low' AS severity", "'' AS vulnerability_details", "'retry poc' AS proof_of_concept", "'retry fix' AS remediation_steps"
    )
    return U.fill_blanks(t.enriched, retry, "draft_id")


@query(
    "k6_text_caps",
    """SELECT doc_id, md5(CASE WHEN length(text) > 5000 THEN concat(substr(text, 1, 2500), chr(10), chr(10), '... [TRUNCATED] ...', chr(10), chr(10), substr(text, length(text) - 2499)) ELSE text END) AS logged,
      left(text, 200) AS snippet, md5(left(text, 1000)) AS message FROM documents""",
)
def k6(t):
    return t.documents.select(
        "doc_id", F.md5(S.truncate_middle("text", 5000)).alias("logged"), F.left("text", F.lit(200)).alias("snippet"),
        F.md5(F.left("text", F.lit(1000))).alias("message"),
    )


@query(
    "k7_rerun_chunks",
    "SELECT chunk_id, CASE WHEN scan_id = 3 THEN 'pending' ELSE status END AS status, CASE WHEN scan_id = 3 THEN 0 ELSE retry_count END AS retry_count FROM chunks",
)
def k7(t):
    chunks, _ = L.rerun(F.lit(3), t.chunks, t.findings)
    return chunks.select("chunk_id", "status", "retry_count")


@query("k7_revalidate_votes", "SELECT vote_id FROM votes WHERE scan_id <> 3")
def k7_votes(t):
    _, votes, _ = L.revalidate(F.lit(3), t.drafts, t.votes, t.verified)
    return votes.select("vote_id")


@query("k7_revalidate_drafts", "SELECT draft_id, CASE WHEN scan_id = 3 THEN 'pending' ELSE status END AS status FROM drafts")
def k7_drafts(t):
    drafts, _, _ = L.revalidate(F.lit(3), t.drafts, t.votes, t.verified)
    return drafts.select("draft_id", "status")


@query(
    "k8_retention",
    "SELECT log_id FROM llm_log WHERE NOT (created_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY AND scan_id = 4)",
)
def k8(t):
    return L.retained(t.llm_log, F.expr("timestamp_ntz '2024-01-20 00:00:00'"), 7, scan_id=4).select("log_id")


@query(
    "s9_upsert",
    """WITH old AS (SELECT p_name AS name, min(p_size) AS v FROM part GROUP BY p_name), new AS (SELECT DISTINCT concat(split_part(p_name, ' ', 1), ' ', 'ring') AS name, -1 AS v FROM part)
    SELECT * FROM new UNION ALL SELECT * FROM old ANTI JOIN new USING (name)""",
)
def s9(t):
    old, new = _library(t)
    return L.upsert(old, new, "name")


@query(
    "s9_insert_absent",
    """WITH old AS (SELECT p_name AS name, min(p_size) AS v FROM part GROUP BY p_name), new AS (SELECT DISTINCT concat(split_part(p_name, ' ', 1), ' ', 'ring') AS name, -1 AS v FROM part)
    SELECT * FROM old UNION ALL SELECT * FROM new ANTI JOIN old USING (name)""",
)
def s9_insert(t):
    old, new = _library(t)
    return L.insert_absent(old, new, "name")


def _library(t):
    old = t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_size").alias("v"))
    new = t.part.selectExpr("concat(split_part(p_name, ' ', 1), ' ', 'ring') AS name", "-1 AS v").distinct()
    return old, new


@query(
    "x8_recovery",
    "SELECT chunk_id, CASE WHEN status = 'scanning' THEN 'pending' ELSE status END AS status FROM chunks",
)
def x8(t):
    return L.recovered(t.chunks).select("chunk_id", "status")


@query(
    "s4_table_scan",
    "SELECT draft_id, title FROM drafts WHERE scan_id = 7",
)
def s4(t):
    return t.drafts.where("scan_id = 7").select("draft_id", "title")
