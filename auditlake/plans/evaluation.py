"""Queries over call logs, progress and labelled evaluation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import progress as P, tuning as T
from auditlake.plans.registry import query

_ERR = """CASE WHEN regexp_matches(lower(error_message), 'timeout|timed out') THEN 'timeout'
  WHEN regexp_matches(lower(error_message), 'rate limit|429') THEN 'rate_limit'
  WHEN regexp_matches(lower(error_message), 'model|inference') THEN 'model_error'
  WHEN regexp_matches(lower(error_message), 'parse|json') THEN 'parse_error'
  WHEN regexp_matches(lower(error_message), 'connection|network') THEN 'connection_error' ELSE 'unknown' END"""

JUDGED = """judged AS (SELECT r.*, verdict, coalesce(predicted_vote = verdict
    OR (predicted_vote IN ('FALSE_POSITIVE', 'FP', 'WEAKNESS') AND verdict IN ('FALSE_POSITIVE', 'FP', 'WEAKNESS')), false) AS correct
  FROM tuning_results r JOIN tuning_cases c USING (case_id))"""


def judged(t):
    return T.judged(t.tuning_results, t.tuning_cases)


def judged_by_case(t):
    return T.judged_by_case(t.tuning_results, t.tuning_cases)


@query(
    "a21_chunk_stats",
    """SELECT scan_id, count(DISTINCT file_id) AS files_scanned, count(*) AS total_chunks, avg(length(content) // 4) AS avg_tokens,
    min(length(content) // 4) AS min_tokens, max(length(content) // 4) AS max_tokens FROM chunks GROUP BY scan_id""",
)
def a21(t):
    return P.chunk_stats(t.chunks)


_CHUNKS = """SELECT f.scan_id, count(*) AS chunks_total, count(*) FILTER (status = 'scanned') AS chunks_scanned,
  count(*) FILTER (status = 'failed') AS chunks_failed, count(*) FILTER (status = 'pending' AND retry_count > 0) AS chunks_retrying
  FROM chunks c JOIN files f USING (file_id) GROUP BY f.scan_id"""


@query("j3_chunk_counts", _CHUNKS)
def j3(t):
    return P.chunk_counts(t.chunks, t.files)


_ERROR_CLASSES = ["timeout", "rate_limit", "model_error", "parse_error", "connection_error", "unknown"]
_PROGRESS_COLS = (
    ["chunks_total", "chunks_scanned", "chunks_failed", "chunks_retrying"]
    + ["drafts_total", "drafts_verified", "drafts_rejected", "drafts_pending", "findings_total"]
    + [f"findings_{s}" for s in ("critical", "high", "medium", "low", "weakness")]
    + ["errors_total"]
    + [f"errors_{c}" for c in _ERROR_CLASSES]
)


@query(
    "a22_progress",
    f"""WITH c AS ({_CHUNKS}),
    d AS (SELECT scan_id, count(*) AS drafts_total, count(*) FILTER (status = 'verified') AS drafts_verified,
      count(*) FILTER (status = 'rejected') AS drafts_rejected, count(*) FILTER (status = 'pending') AS drafts_pending FROM drafts GROUP BY scan_id),
    f AS (SELECT scan_id, count(*) AS findings_total, {', '.join(f"count(*) FILTER (severity = '{s.title()}') AS findings_{s}" for s in ('critical', 'high', 'medium', 'low', 'weakness'))}
      FROM findings GROUP BY scan_id),
    e AS (SELECT scan_id, count(*) AS errors_total, {', '.join(f"count(*) FILTER (kind = '{k}') AS errors_{k}" for k in _ERROR_CLASSES)}
      FROM (SELECT scan_id, {_ERR} AS kind FROM errors) GROUP BY scan_id)
    SELECT scan_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _PROGRESS_COLS)},
      CASE WHEN coalesce(chunks_total, 0) > 0 THEN chunks_scanned / chunks_total * 100 ELSE 0 END AS percent
    FROM c FULL JOIN d USING (scan_id) FULL JOIN f USING (scan_id) FULL JOIN e USING (scan_id)""",
)
def a22(t):
    return P.scan_progress(t.chunks, t.files, t.drafts, t.findings, t.errors)


@query(
    "a23_log_stats",
    """SELECT phase, model_name, CASE WHEN grouping(phase) = 0 THEN 'phase' WHEN grouping(model_name) = 0 THEN 'model' ELSE 'all' END AS level,
      count(*) AS total, count(*) FILTER (NOT parse_success) AS failed,
      (count(*) - count(*) FILTER (NOT parse_success)) / count(*) * 100 AS success_rate
    FROM llm_log GROUP BY GROUPING SETS ((), (phase), (model_name))""",
)
def a23(t):
    return P.log_stats(t.llm_log)


@query(
    "a23_recent_scans",
    """SELECT scan_id, log_count FROM (SELECT scan_id, count(*) AS log_count, max(created_at) AS m FROM llm_log GROUP BY scan_id)
    ORDER BY m DESC, scan_id LIMIT 20""",
)
def a23_recent(t):
    return P.recent_scans(t.llm_log)


@query(
    "a24_queue_state",
    """WITH models AS (SELECT concat('m', n_nationkey) AS model_name FROM nation),
    c AS (SELECT model_name, count(*) FILTER (status = 'pending') AS queued, count(*) FILTER (status = 'running') AS running,
      count(*) FILTER (status = 'completed' AND recent) AS recent_completed, count(*) FILTER (status = 'failed' AND recent) AS recent_failed
      FROM (SELECT *, created_at >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 5 MINUTE AS recent FROM llm_log) GROUP BY model_name)
    SELECT model_name, coalesce(queued, 0) AS queued, coalesce(running, 0) AS running,
      coalesce(recent_completed, 0) AS recent_completed, coalesce(recent_failed, 0) AS recent_failed
    FROM models LEFT JOIN c USING (model_name)""",
)
def a24(t):
    models = t.nation.selectExpr("concat('m', n_nationkey) AS model_name")
    return P.queue_state(t.llm_log, models, F.expr("timestamp_ntz '2024-01-15 12:00:00'"))


@query(
    "a25_phase_usage",
    """SELECT phase, model_name, count(*) AS calls, CAST(sum(duration_ms) AS BIGINT) AS time_ms,
      CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM llm_log GROUP BY ALL""",
)
def a25(t):
    return P.phase_usage(t.llm_log)


@query(
    "a26_call_estimates",
    """WITH c AS (SELECT scan_id, count(*) AS k FROM chunks GROUP BY scan_id), d AS (SELECT scan_id, count(*) AS k FROM drafts GROUP BY scan_id),
    v AS (SELECT scan_id, count(*) AS k FROM verified GROUP BY scan_id),
    j AS (SELECT scan_id, coalesce(c.k, 0) * 3 AS scanner_calls, coalesce(d.k, 0) * 2 AS verifier_calls, coalesce(v.k, 0) AS enricher_calls
      FROM c FULL JOIN d USING (scan_id) FULL JOIN v USING (scan_id))
    SELECT *, scanner_calls + verifier_calls + enricher_calls AS total_calls FROM j""",
)
def a26(t):
    return P.call_estimates(t.chunks, t.drafts, t.verified, analyzers=3, verifiers=2)


@query("a27_status_breakdown", "SELECT scan_id, status, count(*) AS n FROM drafts GROUP BY ALL")
def a27(t):
    return P.breakdown(t.drafts, "status")


@query("a27_severity_breakdown", "SELECT scan_id, severity, count(*) AS n FROM findings GROUP BY ALL")
def a27_severity(t):
    return P.breakdown(t.findings, "severity")


@query("a43_phase_counts", "SELECT model_name, count(*) AS n FROM llm_log WHERE phase = 'verify' GROUP BY ALL")
def a43(t):
    return P.counts_for_phase(t.llm_log, "verify")


@query(
    "a45_run_progress",
    f"""WITH {JUDGED} SELECT model_name, count(*) AS done, count(*) / 260 * 100 AS percent, count(*) FILTER (parse_success) AS successful,
      count(*) FILTER (correct) AS correct, count(*) FILTER (correct) / count(*) FILTER (parse_success) * 100 AS accuracy
    FROM judged GROUP BY model_name""",
)
def a45(t):
    return P.run_progress(judged(t), expected=260)


@query(
    "a46_nested_profiles",
    """SELECT n_nationkey AS profile_id, n_name AS profile, coalesce(list(concat(s_suppkey, ':', s_name, ':', coalesce(c_name, '-')) ORDER BY s_suppkey) FILTER (s_suppkey IS NOT NULL), []) AS analyzers
    FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_custkey = s_suppkey * 20 GROUP BY ALL""",
)
def a46(t):
    return P.nested_profiles(
        t.nation.selectExpr("n_nationkey AS profile_id", "n_name AS profile"),
        t.supplier.selectExpr(
            "s_nationkey AS profile_id", "s_suppkey AS run_order", "s_name AS analyzer", "s_suppkey * 20 AS model_id"
        ),
        t.customer.selectExpr("c_custkey AS model_id", "c_name AS model_name"),
    )


@query(
    "a37_triage",
    """WITH c AS (SELECT scan_id, count(*) AS n, count(*) FILTER (severity = 'Critical') AS a, count(*) FILTER (severity = 'High') AS b,
        count(*) FILTER (severity = 'Medium') AS m, count(*) FILTER (severity = 'Low') AS l FROM findings GROUP BY scan_id),
    u AS (SELECT scan_id, finding_id, severity, row_number() OVER (PARTITION BY scan_id ORDER BY finding_id) AS rn FROM findings
        WHERE severity IN ('Critical', 'High') AND confidence >= 80),
    p AS (SELECT scan_id, list(concat(finding_id, ':', CASE severity WHEN 'Critical' THEN '9.0' ELSE '7.5' END) ORDER BY rn) AS cp FROM u WHERE rn <= 5 GROUP BY scan_id)
    SELECT scan_id, concat(n, ' findings analyzed: ', concat_ws(', ', CASE WHEN a > 0 THEN concat(a, ' Critical') END, CASE WHEN b > 0 THEN concat(b, ' High') END,
      CASE WHEN m > 0 THEN concat(m, ' Medium') END, CASE WHEN l > 0 THEN concat(l, ' Low') END), '.') AS summary,
      coalesce(cp, []::VARCHAR[]) AS critical_priority FROM c LEFT JOIN p USING (scan_id)""",
)
def a37(t):
    return P.triage(t.findings)


@query(
    "f13_correctness",
    f"WITH {JUDGED} SELECT predicted_vote, verdict, correct, count(*) AS n FROM judged GROUP BY ALL",
)
def f13(t):
    return judged(t).groupBy("predicted_vote", "verdict", "correct").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a28_tuning_sets",
    f"""WITH {JUDGED} SELECT model_name, prompt_id, case_id,
      CASE WHEN grouping(case_id) = 0 THEN 'case' WHEN grouping(model_name) = 0 AND grouping(prompt_id) = 0 THEN 'model_prompt'
        WHEN grouping(model_name) = 0 THEN 'model' WHEN grouping(prompt_id) = 0 THEN 'prompt' ELSE 'all' END AS level,
      count(*) AS total, count(*) FILTER (correct) AS correct, count(*) FILTER (correct) / count(*) * 100 AS accuracy,
      count(*) FILTER (parse_success) / count(*) * 100 AS parse_rate, avg(confidence) AS avg_confidence, avg(duration_ms) AS avg_duration_ms
    FROM judged GROUP BY GROUPING SETS ((), (model_name), (prompt_id), (case_id), (model_name, prompt_id))""",
)
def a28(t):
    return T.run_analysis(judged(t))


@query(
    "a29_confusion",
    f"""WITH {JUDGED}, c AS (SELECT model_name, prompt_id,
      count(*) FILTER (verdict = 'REAL' AND coalesce(predicted_vote, '') = 'REAL') AS tp, count(*) FILTER (verdict <> 'REAL' AND coalesce(predicted_vote, '') = 'REAL') AS fp,
      count(*) FILTER (verdict = 'REAL' AND coalesce(predicted_vote, '') <> 'REAL') AS fn, count(*) FILTER (verdict <> 'REAL' AND coalesce(predicted_vote, '') <> 'REAL') AS tn
      FROM judged GROUP BY ALL),
    p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c)
    SELECT *, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM p""",
)
def a29(t):
    return T.confusion(judged(t))


@query(
    "a30_case_stats",
    """SELECT * FROM (SELECT verdict, cwe_type, scan_id, is_synthetic,
      CASE WHEN grouping(is_synthetic) = 0 THEN 'is_synthetic' WHEN grouping(scan_id) = 0 THEN 'scan_id' WHEN grouping(cwe_type) = 0 THEN 'cwe_type'
        WHEN grouping(verdict) = 0 THEN 'verdict' ELSE 'all' END AS level, count(*) AS n
    FROM tuning_cases GROUP BY GROUPING SETS ((), (verdict), (cwe_type), (scan_id), (is_synthetic))) WHERE NOT (level = 'cwe_type' AND cwe_type IS NULL)""",
)
def a30(t):
    return T.case_stats(t.tuning_cases)


@query(
    "a31_model_summary",
    f"""WITH {JUDGED} SELECT model_name, count(*) AS total, count(*) FILTER (parse_success) AS successful,
      count(*) FILTER (parse_success AND correct) AS correct, count(*) FILTER (parse_success AND correct) / count(*) FILTER (parse_success) * 100 AS accuracy,
      avg(confidence) FILTER (parse_success) AS avg_confidence FROM judged GROUP BY model_name""",
)
def a31(t):
    return T.model_summary(judged(t))


def _acc(keys: str) -> str:
    return (
        f"SELECT {keys}, count(*) FILTER (correct) AS correct, count(*) AS total, "
        f"count(*) FILTER (correct) / count(*) * 100 AS accuracy FROM judged WHERE parse_success GROUP BY {keys}"
    )


@query("a32_top_prompts", f"WITH {JUDGED} {_acc('prompt_id')} ORDER BY accuracy DESC, prompt_id LIMIT 10")
def a32(t):
    return T.top_prompts(judged(t))


@query(
    "a32_case_difficulty",
    f"""WITH {JUDGED}, a AS ({_acc('case_id')})
    SELECT *, CASE WHEN accuracy < 40 THEN 'HARD' WHEN accuracy < 70 THEN 'MEDIUM' ELSE 'EASY' END AS difficulty FROM a""",
)
def a32_cases(t):
    return T.case_difficulty(judged_by_case(t))


@query("a33_case_prompt_accuracy", f"WITH {JUDGED} {_acc('case_id, prompt_id')}")
def a33(t):
    return T.accuracy_by(judged_by_case(t), "case_id", "prompt_id")


@query(
    "a33_model_prompt_cube",
    f"""WITH {JUDGED} SELECT model_name, prompt_id, CAST(grouping(model_name) * 2 + grouping(prompt_id) AS BIGINT) AS margin,
      count(*) FILTER (correct) AS correct, count(*) AS total, count(*) FILTER (correct) / count(*) * 100 AS accuracy
    FROM judged WHERE parse_success GROUP BY CUBE (model_name, prompt_id)""",
)
def a33_cube(t):
    return T.accuracy_margins(judged(t))


@query(
    "a34_calibration",
    f"""WITH {JUDGED}, c AS (SELECT model_name, coalesce(avg(confidence) FILTER (correct), 0) AS avg_correct,
      coalesce(avg(confidence) FILTER (NOT correct), 0) AS avg_incorrect FROM judged WHERE parse_success AND confidence IS NOT NULL GROUP BY model_name)
    SELECT *, avg_correct - avg_incorrect AS gap, CASE WHEN avg_correct - avg_incorrect < 0 THEN 'overconfident'
      WHEN avg_correct - avg_incorrect > 10 THEN 'good' ELSE 'neutral' END AS judgement FROM c""",
)
def a34(t):
    return T.calibration(judged(t))


@query(
    "a35_sensitive",
    f"""WITH {JUDGED}, ok AS (SELECT * FROM judged WHERE parse_success),
    m AS (SELECT case_id, model_name FROM ok GROUP BY ALL HAVING count(DISTINCT predicted_vote) > 1)
    SELECT case_id, model_name, prompt_id, predicted_vote, verdict, confidence, correct, result_id FROM ok SEMI JOIN m USING (case_id, model_name)""",
)
def a35(t):
    return T.prompt_sensitive(judged(t)).select(
        "case_id", "model_name", "prompt_id", "predicted_vote", "verdict", "confidence", "correct", "result_id"
    )


@query(
    "w5_best_prompt",
    f"""WITH {JUDGED}, a AS ({_acc('model_name, prompt_id')})
    SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY accuracy DESC, prompt_id) = 1""",
)
def w5(t):
    return T.best_prompt_per_model(judged(t))


@query("w5_best_prompt_overall", f"WITH {JUDGED} {_acc('prompt_id')} ORDER BY accuracy DESC, prompt_id LIMIT 1")
def w5_overall(t):
    return T.best_prompt(judged(t))


@query(
    "j8_test_grid",
    "SELECT doc_id AS case_id, n_name AS model_name, r_name AS prompt_name FROM labels, nation, region",
)
def j8(t):
    return T.test_grid(
        t.nation.selectExpr("n_name AS model_name"),
        t.region.selectExpr("r_name AS prompt_name"),
        t.labels.selectExpr("doc_id AS case_id"),
    )


_TEMPLATE = (
    "concat(r_name, ': {{title}} ({{vuln_type}}, {{severity}}) at {{file_path}}:{{line}} - {{claim}} {{code}}')"
).replace("{{", "{").replace("}}", "}")


@query(
    "j14_template_fill",
    f"""WITH tp AS (SELECT r_regionkey AS template_id, {_TEMPLATE} AS template FROM region),
    c AS (SELECT draft_id, draft_id % 5 AS template_id, title, vulnerability_type, severity, line_number, f.file_path,
       concat('reason ', title) AS reason FROM drafts d LEFT JOIN files f ON f.file_id = d.file_id)
    SELECT draft_id, replace(replace(replace(replace(replace(replace(replace(template, '{{title}}', title), '{{vuln_type}}', vulnerability_type),
      '{{severity}}', severity), '{{file_path}}', coalesce(file_path, 'unknown')), '{{line}}', CAST(line_number AS VARCHAR)), '{{claim}}', reason), '{{code}}', '') AS prompt
    FROM c JOIN tp USING (template_id)""",
)
def j14(t):
    templates = t.region.selectExpr("r_regionkey AS template_id", f"{_TEMPLATE} AS template")
    context = t.drafts.join(t.files.select("file_id", "file_path"), "file_id", "left").selectExpr(
        "draft_id", "draft_id % 5 AS template_id", "title", "vulnerability_type", "severity", "line_number",
        "coalesce(file_path, 'unknown') AS file_path", "concat('reason ', title) AS reason",
        "cast(null AS string) AS snippet", "cast(null AS string) AS context",
        "cast(null AS string) AS language", "cast(null AS string) AS output_format",
    )
    return context.join(templates, "template_id").select("draft_id", T.fill_template("template").alias("prompt"))


@query(
    "a42_label_scores",
    """SELECT model, count(*) FILTER (label = 'TP') AS tp, count(*) FILTER (label = 'DEBATABLE') AS debatable,
      count(*) FILTER (label = 'FP') AS fp, count(*) FILTER (label = 'FP') / count(*) * 100 AS fp_rate
    FROM (SELECT file_id, source_model AS model FROM findings) f JOIN truth USING (file_id) GROUP BY model""",
)
def a42(t):
    return T.label_scores(t.findings.withColumnRenamed("source_model", "model"), t.truth)
