"""Queries over sources, sinks, streams and extension points."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from auditlake.functions import sql_functions
from auditlake.operators import extraction as E, joins as J, models as M, predicates as P, tuning as T
from auditlake.plans.filters import _RAW_SEV, DECISION_SQL, MALICIOUS_SQL, SEV_SQL, rank_sql
from auditlake.plans.registry import query
from auditlake.plans.relations import _LOWER_LANG, _REVIEWS, _STREAK
from auditlake.plans.views import VIEWS
from auditlake.session import scratch_path
from auditlake.sources import files as SF, sinks as SK
from auditlake.streaming import jobs as SJ, sessions as SS

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
LINES = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
)
ORDERS = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
)


def _stream(t, view: str, schema: str):
    base = VIEWS[view].base
    return VIEWS[view].spark(SJ.file_stream(t.spark, f"{t.sf_dir}/{base}.parquet", schema))


@query(
    "s1_source_tree",
    "SELECT scan_id, CAST(sum(length(content) + 1) AS BIGINT) AS chars FROM files GROUP BY scan_id",
)
def s1(t):
    root = scratch_path(t.spark, "tree")
    t.files.select("scan_id", "content").write.partitionBy("scan_id").text(root)
    tree = SF.read_source_tree(t.spark, root, extensions=("txt",))
    return tree.groupBy(F.regexp_extract("path", r"scan_id=(\d+)", 1).cast("bigint").alias("scan_id")).agg(
        F.sum(F.length("content")).alias("chars")
    )


@query("s3_archive", "SELECT file_id, concat('src/f', file_id, '.c') AS member, md5(content) AS content FROM files")
def s3(t):
    @F.pandas_udf("binary")
    def zipped(file_id: pd.Series, content: pd.Series) -> pd.Series:
        def pack(i, text):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr(f"src/f{i}.c", text)
            return buffer.getvalue()

        return pd.Series([pack(i, c) for i, c in zip(file_id, content)])

    archives = t.files.select(
        F.concat(F.lit("a/"), F.col("file_id"), F.lit(".zip")).alias("path"), zipped("file_id", "content").alias("content")
    )
    return SF.extract_archives(archives).select(
        F.regexp_extract("path", r"a/(\d+)", 1).cast("bigint").alias("file_id"), "member", F.md5("content").alias("content")
    )


_RESULTS = "result_id string, prompt_id string, case_id bigint, predicted_vote string, confidence int"


@query(
    "s5_result_files",
    "SELECT model_name, count(*) AS n, count(DISTINCT case_id) AS cases, CAST(sum(confidence) AS BIGINT) AS confidence FROM tuning_results GROUP BY model_name",
)
def s5(t):
    root = scratch_path(t.spark, "results")
    SK.export_model_json(t.tuning_results.select("model_name", "result_id", "prompt_id", "case_id", "predicted_vote", "confidence"), root, "result_id")
    return (
        SF.read_results(t.spark, root, _RESULTS)
        .groupBy("model_name")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("case_id").alias("cases"), F.sum("confidence").alias("confidence"))
    )


@query("k9_model_json", "SELECT model_name, result_id, prompt_id, case_id, predicted_vote, confidence FROM tuning_results")
def k9(t):
    root = scratch_path(t.spark, "model-json")
    SK.export_model_json(t.tuning_results.select("model_name", "result_id", "prompt_id", "case_id", "predicted_vote", "confidence"), root, "result_id")
    return t.spark.read.schema(_RESULTS + ", model_name string").json(root)


_MARKDOWN = "concat('Intro', chr(10), '## 1. First ', doc_id, chr(10), chr(10), '**Template**:', chr(10), '```', chr(10), text, chr(10), '```', chr(10), chr(10), '**Rationale**: why', chr(10), '## 2. Second ', chr(10), 'no template')"


@query(
    "s6_markdown_templates",
    rf"""WITH s AS (SELECT doc_id, unnest(string_split_regex({_MARKDOWN}, '(?m)^## \d+\. ')[2:]) AS section,
      CAST(generate_subscripts(string_split_regex({_MARKDOWN}, '(?m)^## \d+\. ')[2:], 1) - 1 AS INT) AS section_no FROM documents)
    SELECT doc_id, section_no, trim(regexp_extract(section, '^([^\n]+)', 1)) AS name,
      md5(regexp_extract(section, '(?s)\*\*Template\*\*:\s*\n```\n(.*?)\n```\s*\n\s*\*\*Rationale\*\*:', 1)) AS template
    FROM s WHERE regexp_extract(section, '(?s)\*\*Template\*\*:\s*\n```\n(.*?)\n```\s*\n\s*\*\*Rationale\*\*:', 1) <> ''""",
)
def s6(t):
    docs = t.documents.selectExpr("doc_id", f"{_MARKDOWN} AS markdown")
    return SF.markdown_templates(docs).withColumn("template", F.md5("template"))


_HEADED = "CASE WHEN file_id % 3 = 0 THEN concat('// @benchmark_finding: Type ', file_id, chr(10), '// @benchmark_severity: Low', chr(10), '// @benchmark_line: ', file_id % 9, chr(10), content) ELSE content END"
_NAMED = "replace(file_path, '/f', CASE file_id % 5 WHEN 0 THEN '/overflow' WHEN 1 THEN '/xss' WHEN 2 THEN '/Leak' ELSE '/f' END)"


@query(
    "s7_header_metadata",
    "SELECT file_id, CASE WHEN file_id % 3 = 0 THEN concat('Type ', file_id) END AS finding, CASE WHEN file_id % 3 = 0 THEN 'Low' END AS severity FROM files",
)
def s7(t):
    headed = t.files.selectExpr("file_id", f"{_HEADED} AS content")
    return headed.withColumn("m", SF.header_metadata("content")).select(
        "file_id", F.col("m")["finding"].alias("finding"), F.col("m")["severity"].alias("severity")
    )


@query(
    "s8_labelled_cases",
    rf"""SELECT file_id, file_path, CASE WHEN file_id % 3 = 0 THEN concat('Type ', file_id) WHEN contains(n, 'overflow') THEN 'Buffer Overflow' WHEN contains(n, 'xss') THEN 'XSS' WHEN contains(n, 'leak') THEN 'Memory Leak' ELSE 'Unknown' END AS expected_type,
      CASE WHEN file_id % 3 = 0 THEN 'Low' ELSE 'Medium' END AS expected_severity, CASE WHEN file_id % 3 = 0 THEN CAST(file_id % 9 AS INT) END AS expected_line
    FROM (SELECT file_id, {_NAMED} AS file_path, lower(regexp_extract({_NAMED}, '([^/]*)$', 1)) AS n FROM files) WHERE regexp_matches(file_path, '\.(c|cpp|py|js|ts)$')""",
)
def s8(t):
    return SF.labelled_cases(t.files.selectExpr("file_id", f"{_NAMED} AS file_path", f"{_HEADED} AS content"))


@query("k1_append", "SELECT scan_id, count(*) AS n FROM (SELECT scan_id FROM drafts UNION ALL SELECT scan_id FROM drafts) GROUP BY scan_id")
def k1(t):
    path = scratch_path(t.spark, "facts")
    drafts = t.drafts.select("scan_id", "draft_id", "title", "severity")
    SK.append_facts(drafts, path)
    SK.append_facts(drafts, path)
    return t.spark.read.parquet(path).groupBy(F.col("scan_id").cast("bigint").alias("scan_id")).agg(F.count(F.lit(1)).alias("n"))


@query("k2_replace", "SELECT scan_id, draft_id, CASE WHEN scan_id = 3 THEN 'new' ELSE title END AS title FROM drafts WHERE scan_id <> 5")
def k2(t):
    path = scratch_path(t.spark, "replaced")
    drafts = t.drafts.select("scan_id", "draft_id", "title")
    SK.append_facts(drafts, path)
    # Scan 5 ran again and found nothing.
    SK.replace_scans(drafts.where("scan_id = 3").withColumn("title", F.lit("new")), path, [3, 5])
    return t.spark.read.parquet(path).select(F.col("scan_id").cast("bigint").alias("scan_id"), "draft_id", "title")


@query("k3_csv_export", "SELECT draft_id, title, severity FROM drafts")
def k3(t):
    path = scratch_path(t.spark, "csv")
    SK.export_csv(t.drafts.select("draft_id", "title", "severity"), path)
    return t.spark.read.option("header", "true").option("escape", '"').schema("draft_id bigint, title string, severity string").csv(path)


_ALERTS = f"""al AS (SELECT *, len({MALICIOUS_SQL}) > 0 AS is_malicious FROM (SELECT *, lower(concat_ws(' ', title, snippet)) AS s FROM alert_findings))
    SELECT finding_id, webhook_id, is_malicious FROM al, subscriptions b WHERE enabled AND list_contains(events, 'finding') AND {rank_sql('severity')} >= {rank_sql('min_severity')}"""


@query("k5_alert_payloads", f"WITH {_ALERTS}")
def k5(t):
    return SK.alert_payloads(t.alert_findings, t.subscriptions, "secret").where("signature like 'sha256=%'").select(
        "finding_id", "webhook_id", "is_malicious"
    )


@query("x1_intake", "SELECT log_id, model_name, status FROM llm_log")
def x1(t):
    out = SJ.intake(_stream(t, "llm_log", EVENTS), scratch_path(t.spark, "intake"))
    return SJ.stored(t.spark, out).select("log_id", "model_name", "status")


@query("x2_live_counts", "SELECT status, phase, count(*) AS n FROM llm_log GROUP BY ALL")
def x2(t):
    out = SJ.live_counts(_stream(t, "llm_log", EVENTS), ["status", "phase"], scratch_path(t.spark, "counts"))
    return SJ.newest_counts(t.spark, out, ["status", "phase"])


@query(
    "x3_recent_activity",
    """WITH w AS (SELECT model_name, date_trunc('minute', created_at) - to_minutes(CAST(unnest(range(0, 5)) AS INT)) AS ws FROM llm_log)
    SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, model_name, count(*) AS n FROM w GROUP BY ALL""",
)
def x3(t):
    log = _stream(t, "llm_log", EVENTS).withColumn("created_at", F.col("created_at").cast("timestamp"))
    out = SJ.recent_activity(log, scratch_path(t.spark, "activity"))
    newest = SJ.newest_counts(t.spark, out, ["window_start", "model_name"])
    return newest.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "x3_sessions",
    """WITH n AS (SELECT *, CASE WHEN created_at < lag(created_at) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM llm_log
        WINDOW w AS (PARTITION BY model_name ORDER BY created_at)),
      s AS (SELECT *, sum(first) OVER (PARTITION BY model_name ORDER BY created_at) AS no FROM n)
    SELECT model_name, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_seen,
      count(*) AS calls, max(status) AS highest FROM s GROUP BY model_name, no""",
)
def x3_sessions(t):
    """Runs of requests of a model without a break of half an hour; rows behind the watermark are in the side table."""
    log = _stream(t, "llm_log", EVENTS).withColumn("created_at", F.col("created_at").cast("timestamp"))
    measures = {"calls": ("count", "*"), "highest": ("max", "status")}
    state = SS.session_job(log, ["model_name"], "created_at", "30 minutes", "1 day", measures, scratch_path(t.spark, "sessions"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return SS.stored_sessions(t.spark, state).select("model_name", shown("session_start"), shown("last_seen"), "calls", "highest")


@query("x4_pause_signals", f"WITH {_STREAK} SELECT model_name, log_id, streak FROM st WHERE streak = 5")
def x4(t):
    log = _stream(t, "llm_log", EVENTS).select("log_id", "model_name", "created_at", "parse_success")
    return SJ.stored(t.spark, SJ.pause_signals(log, scratch_path(t.spark, "pause")))


@query("x5_stream_dedup", """SELECT DISTINCT md5(concat_ws(':', l_orderkey % 50, l_suppkey % 10, CAST(l_shipdate AS DATE))) AS dedup_key FROM lineitem""")
def x5(t):
    """Drafts of one place on one day: repeats come within a day; rows in any order are kept."""
    raw = SJ.file_stream(t.spark, f"{t.sf_dir}/lineitem.parquet", LINES).withColumn("seen_at", F.col("l_shipdate").cast("timestamp"))
    keyed = raw.selectExpr("md5(concat_ws(':', l_orderkey % 50, l_suppkey % 10, cast(l_shipdate as date))) AS dedup_key", "seen_at")
    out = SJ.deduplicated(keyed, "dedup_key", "seen_at", scratch_path(t.spark, "dedup"), late="1 day")
    return SJ.stored(t.spark, out).select("dedup_key")


@query(
    "x6_poll_changes",
    f"""WITH {_REVIEWS}, wt AS (SELECT n_nationkey AS watcher_id FROM nation WHERE n_nationkey % 4 = 0 OR (n_nationkey * 60) >= 300)
    SELECT change_id, watcher_id, iid FROM changes c SEMI JOIN wt USING (watcher_id) ANTI JOIN (SELECT * FROM rv WHERE status = 'completed' AND reviewed_at IS NOT NULL) r USING (watcher_id, iid)""",
)
def x6(t):
    reviews = t.customer.selectExpr(
        "c_custkey % 20 AS watcher_id", "c_custkey % 500 AS iid", "if(c_nationkey % 3 = 0, 'completed', 'failed') AS status",
        "if(c_custkey % 2 = 0, 1, null) AS reviewed_at",
    )
    as_of = F.expr("timestamp_ntz '2024-01-15 12:00:00'")
    watchers = t.nation.selectExpr(
        "n_nationkey AS watcher_id", "300 AS poll_interval",
        "if(n_nationkey % 4 = 0, null, timestamp_ntz '2024-01-15 12:00:00' - make_dt_interval(0, 0, 0, n_nationkey * 60)) AS last_check",
    )
    changes = _stream(t, "changes", ORDERS).select("change_id", "watcher_id", "iid")
    out = SJ.poll_changes(changes, watchers, reviews, as_of, scratch_path(t.spark, "poll"))
    return SJ.stored(t.spark, out).select("change_id", "watcher_id", "iid")


@query("x7_alerts", f"WITH {_ALERTS.replace('SELECT finding_id, webhook_id, is_malicious', 'SELECT finding_id, webhook_id')}")
def x7(t):
    out = SJ.alerts(_stream(t, "alert_findings", ORDERS), t.subscriptions, "secret", lambda payload, signature: 200, scratch_path(t.spark, "alerts"))
    return SJ.stored(t.spark, out).where("status = 'delivered'").selectExpr("finding_id", "cast(webhook_id as int) AS webhook_id")


@query("x9_replay", "SELECT log_id, model_name FROM llm_log")
def x9(t):
    """Existing results, then new ones: a second start of the same job adds nothing twice."""
    state = scratch_path(t.spark, "replay")
    stream = _stream(t, "llm_log", EVENTS).select("log_id", "model_name")
    SJ.intake(stream, state)
    return SJ.stored(t.spark, SJ.intake(stream, state))


_FILL = "concat('Check {file} in {language}: ', n_name)"


@query(
    "e2_user_analyzers",
    f"""WITH a AS (SELECT n_name AS analyzer, CASE n_regionkey WHEN 0 THEN 'python' WHEN 1 THEN 'c' ELSE NULL END AS l, {_FILL} AS template FROM nation)
    SELECT file_id, analyzer, replace(replace(template, '{{file}}', file_path), '{{language}}', {_LOWER_LANG}) AS prompt FROM files, a WHERE l IS NULL OR l = {_LOWER_LANG}""",
)
def e2(t):
    analyzers = t.nation.select(
        F.col("n_name").alias("analyzer"), F.lit(None).cast("array<string>").alias("glob_regexes"),
        F.when(F.col("n_regionkey") == 0, F.array(F.lit("python"))).when(F.col("n_regionkey") == 1, F.array(F.lit("c"))).alias("languages"),
        F.expr(_FILL).alias("template"),
    )
    pairs = J.applicable_analyzers(t.files, analyzers).join(analyzers.select("analyzer", "template"), "analyzer")
    with_file = pairs.join(t.files.select("file_id", "file_path"), "file_id").withColumn("language", P.language("file_path", "lower"))
    return with_file.select(
        "file_id", "analyzer", T.fill_template("template", {"file": "file_path", "language": "language"}).alias("prompt")
    )


@query(
    "e3_infer",
    "SELECT doc_id, CASE WHEN length(text) % 2 = 0 THEN 'REAL' ELSE 'FALSE_POSITIVE' END AS decision, CAST(length(text) % 101 AS INT) AS confidence FROM documents",
)
def e3(t):
    def fake_model(prompts):
        return [
            f"*VOTE: {'REAL' if len(p) % 2 == 0 else 'FALSE_POSITIVE'}\n*CONFIDENCE: {len(p) % 101}\n*END_VERIFIED" for p in prompts
        ]

    answers = M.infer(t.documents.select("doc_id", F.col("text").alias("prompt")), fake_model)
    return E.extract_votes(answers.select("doc_id", F.col("response").alias("text"))).select("doc_id", "decision", "confidence")


@query(
    "e4_output_formats",
    """WITH u AS (SELECT c_custkey AS profile_id, CASE c_custkey % 2 WHEN 0 THEN 'scanner' ELSE 'verifier' END AS role, CASE c_nationkey % 2 WHEN 0 THEN 'json' ELSE 'markers' END AS mode FROM customer),
    o AS (SELECT s_suppkey AS profile_id, 'scanner' AS role, 'json' AS mode, s_name AS template FROM supplier), d AS (SELECT CASE r_regionkey % 2 WHEN 0 THEN 'scanner' ELSE 'verifier' END AS role, CASE r_regionkey WHEN 0 THEN 'json' WHEN 1 THEN 'json' ELSE 'markers' END AS mode, min(r_name) AS template FROM region GROUP BY ALL)
    SELECT u.*, coalesce(o.template, d.template) AS template FROM u LEFT JOIN o USING (profile_id, role, mode) LEFT JOIN d USING (role, mode)""",
)
def e4(t):
    uses = t.customer.selectExpr(
        "c_custkey AS profile_id", "if(c_custkey % 2 = 0, 'scanner', 'verifier') AS role", "if(c_nationkey % 2 = 0, 'json', 'markers') AS mode"
    )
    overrides = t.supplier.selectExpr("s_suppkey AS profile_id", "'scanner' AS role", "'json' AS mode", "s_name AS template")
    defaults = (
        t.region.selectExpr(
            "if(r_regionkey % 2 = 0, 'scanner', 'verifier') AS role", "if(r_regionkey in (0, 1), 'json', 'markers') AS mode", "r_name"
        )
        .groupBy("role", "mode")
        .agg(F.min("r_name").alias("template"))
    )
    return M.output_formats(uses, overrides, defaults)


@query(
    "e5_sql_functions",
    f"""SELECT o_orderkey AS id, {SEV_SQL} AS severity, CASE WHEN o_custkey % 6 = 1 THEN CAST(3.1 AS DOUBLE) ELSE NULL END AS cvss,
      CASE WHEN o_custkey % 2 = 0 THEN 'timeout' ELSE 'unknown' END AS error_type, o_custkey % 3 <> 0 AS correct
    FROM (SELECT o_orderkey, o_custkey, {_RAW_SEV} AS v FROM orders)""",
)
def e5(t):
    sql_functions.register(t.spark)
    return t.orders.selectExpr(
        "o_orderkey AS id",
        f"normalize_severity({_RAW_SEV}) AS severity",
        "parse_cvss(if(o_custkey % 6 = 1, 'CVSS:3.1/AV:N', 'none')) AS cvss",
        "classify_error(if(o_custkey % 2 = 0, 'it timed out', 'odd')) AS error_type",
        "vote_correct('FP', if(o_custkey % 3 = 0, 'REAL', 'WEAKNESS')) AS correct",
    )


@query("e5_sql_vote_decision", f"SELECT vote_id, {DECISION_SQL} AS decision FROM (SELECT vote_id, text AS v FROM vote_texts)")
def e5_votes(t):
    sql_functions.register(t.spark)
    return t.vote_texts.selectExpr("vote_id", "vote_decision(text) AS decision")


@query(
    "e5_sql_malicious",
    f"SELECT finding_id, len({MALICIOUS_SQL}) > 0 AS malicious FROM (SELECT finding_id, lower(concat_ws(' ', title, snippet)) AS s FROM alert_findings)",
)
def e5_malicious(t):
    sql_functions.register(t.spark)
    return t.alert_findings.selectExpr("finding_id", "is_malicious(concat_ws(' ', title, snippet)) AS malicious")
