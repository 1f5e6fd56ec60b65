"""Queries for filters, gates and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import scalars as S, text as X
from auditlake.operators import predicates as P, report as R
from auditlake.plans.evaluation import _ERR
from auditlake.plans.registry import query
from auditlake.plans.reports import _SCORED

AS_OF = "timestamp_ntz '2024-01-15 12:00:00'"
AS_OF_SQL = "TIMESTAMP '2024-01-15 12:00:00'"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case_map(key: str, table: dict, default: str) -> str:
    arms = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items())
    return f"CASE {key} {arms} ELSE {default} END"


EXT = "lower(regexp_extract(file_path, '\\.([^./]+)$', 1))"
LANG = f"CASE {EXT} WHEN 'h' THEN 'c' WHEN 'hpp' THEN 'cpp' ELSE {EXT} END"
RISK = (
    f"CASE WHEN regexp_matches(lower(file_path), '{'|'.join(P.LOW_RISK)}') THEN 'low' "
    f"WHEN regexp_matches(lower(file_path), '{'|'.join(P.HIGH_RISK)}') THEN 'high' ELSE 'normal' END"
)


def rank_sql(c: str) -> str:
    return (
        f"CASE upper(coalesce({c}, 'LOW')) WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 "
        "WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
    )


@query(
    "p1_language",
    "SELECT file_id, " + ", ".join(
        f"{case_map(EXT, P.LANGUAGES[s], quote(P.LANGUAGE_DEFAULT[s]))} AS {s}_name" for s in ("display", "lower", "fix")
    ) + " FROM files",
)
def p1(t):
    return t.files.select(
        "file_id", *[P.language("file_path", s).alias(f"{s}_name") for s in ("display", "lower", "fix")]
    )


@query("p2_scannable", f"SELECT file_id, file_path FROM files WHERE {EXT} IN ({', '.join(map(quote, P.SCANNABLE))})")
def p2(t):
    return t.files.where(P.is_scannable("file_path")).select("file_id", "file_path")


@query(
    "p3_include_exclude",
    r"SELECT file_id, file_path FROM files WHERE regexp_matches(file_path, '/(auth|core|src)/') AND NOT regexp_matches(file_path, '\.md$')",
)
def p3(t):
    return P.filter_paths(t.files, "/(auth|core|src)/", r"\.md$").select("file_id", "file_path")


@query(
    "s2_glob_filter",
    r"""SELECT file_id, file_path FROM files WHERE regexp_matches(lower(regexp_extract(file_path, '([^/]*)$', 1)), '^(.*\.c|.*\.hpp)$')
      OR regexp_matches(lower(file_path), '^(.*\.c|.*\.hpp|.*/parse/f1.*\.py)$') OR regexp_matches(file_path, '(^|/)[^/]*/parse/f1[^/]*\.py$')""",
)
def s2(t):
    return P.glob_filter(t.files, "*.c, *.HPP, */parse/f1*.py").select("file_id", "file_path")


@query(
    "p4_branch",
    "SELECT change_id, target_branch FROM changes WHERE regexp_matches(target_branch, '^(?:main|release/.*)')",
)
def p4(t):
    return t.changes.where(P.branch_matches("target_branch", "main|release/.*")).select("change_id", "target_branch")


@query("p4_branch_glob", "SELECT change_id, target_branch FROM changes WHERE regexp_matches(target_branch, '^.*/.*$')")
def p4_glob(t):
    return t.changes.where(P.branch_matches("target_branch", "*/*")).select("change_id", "target_branch")


@query(
    "p5_labels",
    "SELECT change_id FROM changes WHERE list_has_any(list_transform(labels, lambda x: lower(x)), ['security', 'urgent'])",
)
def p5(t):
    return t.changes.where(P.has_label("labels", "security, Urgent")).select("change_id")


@query(
    "p6_lookback",
    "SELECT change_id FROM changes WHERE created_at >= TIMESTAMP '1999-01-01 00:00:00' - INTERVAL 7 DAY",
)
def p6(t):
    as_of = F.expr("timestamp_ntz '1999-01-01 00:00:00'")
    return t.changes.where(P.created_within("created_at", as_of, 0)).select("change_id")


@query("p7_risk", f"SELECT file_id, file_path, {RISK} AS risk FROM files")
def p7(t):
    return t.files.select("file_id", "file_path", P.risk_class("file_path").alias("risk"))


_DRAFT_CHUNK = "SELECT draft_id, title, CASE WHEN draft_id % 17 = 0 THEN 'x' ELSE CAST(line_number AS VARCHAR) END AS line, file_id * 100000 + draft_id % 3 AS chunk_id FROM drafts"


@query(
    "p8_valid_findings",
    f"""WITH d AS ({_DRAFT_CHUNK}) SELECT draft_id, chunk_id, CAST(line AS INT) AS line FROM d JOIN chunks USING (chunk_id)
    WHERE title <> '' AND try_cast(line AS INT) > 0 AND try_cast(line AS INT) BETWEEN start_line - 5 AND end_line + 5""",
)
def p8(t):
    found = t.drafts.selectExpr(
        "draft_id", "title", "if(draft_id % 17 = 0, 'x', cast(line_number as string)) AS line",
        "file_id * 100000 + draft_id % 3 AS chunk_id",
    )
    return P.valid_findings(found, t.chunks).selectExpr("draft_id", "chunk_id", "cast(line as int) AS line")


@query("p9_threshold", f"SELECT finding_id, severity FROM findings WHERE {rank_sql('severity')} >= 3")
def p9(t):
    return t.findings.where(P.meets_threshold("severity", F.lit("High"))).select("finding_id", "severity")


@query(
    "p10_min_votes",
    """SELECT draft_id, initial_votes, CASE WHEN s = 'pending' AND coalesce(initial_votes, 1) < 2 THEN 'skipped' ELSE s END AS status
    FROM (SELECT *, CASE WHEN status = 'rejected' THEN 'pending' ELSE status END AS s FROM drafts)""",
)
def p10(t):
    open_drafts = t.drafts.replace({"rejected": "pending"}, subset=["status"])
    return P.min_vote_gate(open_drafts, 2).select("draft_id", "initial_votes", "status")


_DANGER = " ".join(
    f"WHEN '{k}' THEN regexp_matches(lower(content), {quote('|'.join(w.replace('.', chr(92) + '.') for w in ws))})"
    for k, ws in P.DANGEROUS_WORDS.items()
)


@query(
    "p11_gate",
    f"""SELECT file_id, ({RISK}) = 'high' OR (CASE {LANG} {_DANGER} ELSE false END
      AND NOT (len(regexp_extract_all(content, {quote(P.LONG_STRING)})) > 5 AND len(regexp_extract_all(content, {quote(P.CONTROL_WORDS)})) < 2)) AS needs_model
    FROM code_files""",
)
def p11(t):
    return t.code_files.select("file_id", P.needs_model("file_path", "content").alias("needs_model"))


@query(
    "p12_retry_ready",
    f"""SELECT error_id FROM (SELECT *, CASE WHEN retry_count = 0 THEN NULL ELSE created_at + INTERVAL 2 SECOND END AS next_retry_at FROM errors)
    WHERE (next_retry_at IS NULL OR next_retry_at <= {AS_OF_SQL}) AND retry_count <= 3""",
)
def p12(t):
    chunks = t.errors.withColumn("next_retry_at", F.expr("if(retry_count = 0, null, created_at + interval 2 seconds)"))
    return P.retry_ready(chunks, F.expr(AS_OF)).select("error_id")


@query(
    "p13_log_search",
    "SELECT log_id, scan_id, duration_ms FROM llm_log WHERE phase = 'scan' AND parse_success = false AND model_name = 'm3' ORDER BY log_id DESC OFFSET 10 LIMIT 25",
)
def p13(t):
    hits = P.search_logs(t.llm_log, scan_id=None, phase="scan", model_name="m3", parse_success=False)
    return P.page(hits.select("log_id", "scan_id", "duration_ms"), [F.desc("log_id")], 10, 25)


@query(
    "p14_report_list",
    f"""WITH {_SCORED}, g AS (SELECT scan_id, max(created_at) AS generated_at FROM drafts GROUP BY scan_id)
    SELECT scan_id, grade, score FROM graded JOIN g USING (scan_id) WHERE grade IN ('A', 'B', 'C', 'D', 'F') ORDER BY generated_at DESC, scan_id LIMIT 50""",
)
def p14(t):
    reports = R.scan_metrics(t.drafts, t.votes, t.findings).join(
        t.drafts.groupBy("scan_id").agg(F.max("created_at").alias("generated_at")), "scan_id"
    )
    return P.list_reports(reports, "F").select("scan_id", "grade", "score")


@query(
    "p15_recent",
    f"SELECT log_id, model_name, status FROM llm_log WHERE status IN ('completed', 'failed') AND created_at >= {AS_OF_SQL} - INTERVAL 5 MINUTE",
)
def p15(t):
    return P.recent(t.llm_log, F.expr(AS_OF)).select("log_id", "model_name", "status")


_MISSING = "list_filter([" + ", ".join(
    f"CASE WHEN trim(coalesce({f}, '')) = '' THEN '{f}' END" for f in P.REQUIRED_FIELDS
) + "], lambda x: x IS NOT NULL)"


@query("p16_missing_fields", f"SELECT draft_id, {_MISSING} AS missing FROM enriched")
def p16(t):
    return t.enriched.select("draft_id", P.missing_fields().alias("missing"))


@query(
    "p17_skipped_dirs",
    f"SELECT file_id, file_path FROM files WHERE NOT regexp_matches(file_path, {quote(P.SKIPPED_DIRS)})",
)
def p17(t):
    return t.files.where(P.outside_skipped_dirs("file_path")).select("file_id", "file_path")


_TPL = "concat('{file} {language} {code} {context} {title} ', CASE WHEN p_partkey % 2 = 0 THEN '{vuln_type} {severity}' ELSE '{line}' END, ' {claim} ', p_name, CASE WHEN p_partkey % 3 = 0 THEN '{output_format}' ELSE '' END)"
_TPL_MISSING = "list_filter([" + ", ".join(
    "CASE WHEN NOT (" + " OR ".join(f"contains(template, '{n}')" for n in names) + f") THEN '{primary}' END"
    for primary, names in P.TEMPLATE_CHECKS
) + "], lambda x: x IS NOT NULL)"


@query("p18_template_check", f"SELECT p_partkey AS template_id, {_TPL_MISSING} AS missing FROM (SELECT p_partkey, {_TPL} AS template FROM part)")
def p18(t):
    templates = t.part.selectExpr("p_partkey AS template_id", f"{_TPL} AS template")
    return templates.select("template_id", P.missing_placeholders("template").alias("missing"))


@query(
    "p19_oversize",
    """WITH f AS (SELECT l_orderkey AS change_id, l_linenumber % 3 <> 0 AS ok, l_linestatus = 'O' AS deleted FROM lineitem),
    k AS (SELECT change_id, count(*) FILTER (ok) AS scannable, count(*) FILTER (ok AND NOT deleted) AS reviewed FROM f GROUP BY change_id)
    SELECT change_id, coalesce(scannable, 0) AS scannable, coalesce(reviewed, 0) AS reviewed, CASE WHEN coalesce(scannable, 0) > 4 THEN 'skipped' ELSE status END AS status
    FROM changes LEFT JOIN k USING (change_id)""",
)
def p19(t):
    touched = t.lineitem.selectExpr(
        "l_orderkey AS change_id",
        "concat('src/f', l_partkey, if(l_linenumber % 3 <> 0, '.py', '.txt')) AS file_path",
        "l_linestatus = 'O' AS deleted",
    )
    return P.oversize_gate(t.changes, touched, maximum=4).select("change_id", "scannable", "reviewed", "status")


_RAW_SEV = "CASE o_custkey % 9 WHEN 0 THEN '**High**' WHEN 1 THEN 'high (due to x)' WHEN 2 THEN 'Medium-High' WHEN 3 THEN 'CRIT' WHEN 4 THEN 'weird' WHEN 5 THEN '' WHEN 6 THEN 'a moderate one' WHEN 7 THEN 'Informational' ELSE NULL END"
_SEV_CLEAN = r"trim(regexp_replace(regexp_replace(trim(v), '[*#\-_]+', '', 'g'), '\s*\(.*\)$', '', 'g'))"
SEV_SQL = (
    "CASE WHEN v IS NULL OR v = '' THEN 'Medium' "
    + " ".join(f"WHEN lower({_SEV_CLEAN}) = '{w}' THEN '{n}'" for w, n in S.SEVERITY_WORDS.items())
    + " "
    + " ".join(f"WHEN contains(lower({_SEV_CLEAN}), '{w}') THEN '{n}'" for w, n in S.SEVERITY_WORDS.items())
    + " ELSE 'Medium' END"
)


@query("f1_severity", f"SELECT o_orderkey AS id, v AS raw, {SEV_SQL} AS severity FROM (SELECT o_orderkey, {_RAW_SEV} AS v FROM orders)")
def f1(t):
    raw = t.orders.selectExpr("o_orderkey AS id", f"{_RAW_SEV} AS raw")
    return raw.withColumn("severity", S.normalize_severity("raw"))


_RAW_CVSS = "CASE o_custkey % 6 WHEN 0 THEN concat(o_orderkey % 12, '.', o_custkey % 10) WHEN 1 THEN 'CVSS:3.1/AV:N' WHEN 2 THEN concat(o_orderkey % 10, '.5 (High)') WHEN 3 THEN 'n/a' WHEN 4 THEN '42' ELSE ' 7 ' END"


@query(
    "f2_cvss",
    rf"""SELECT id, CASE WHEN try_cast(trim(v) AS DOUBLE) BETWEEN 0 AND 10 THEN try_cast(trim(v) AS DOUBLE)
      WHEN try_cast(regexp_extract(v, '(\d+\.?\d*)', 1) AS DOUBLE) BETWEEN 0 AND 10 THEN try_cast(regexp_extract(v, '(\d+\.?\d*)', 1) AS DOUBLE) END AS cvss
    FROM (SELECT o_orderkey AS id, {_RAW_CVSS} AS v FROM orders)""",
)
def f2(t):
    return t.orders.selectExpr("o_orderkey AS id", f"{_RAW_CVSS} AS v").select("id", S.parse_cvss("v").alias("cvss"))


@query("f3_error_class", f"SELECT error_id, {_ERR} AS error_type FROM errors")
def f3(t):
    return t.errors.select("error_id", S.classify_error("error_message").alias("error_type"))


_DASHED = "concat('type CWE', CASE o_orderkey % 3 WHEN 0 THEN '-' WHEN 1 THEN '–' ELSE '—' END, o_custkey % 900, ' found')"


@query("f4_cwe", f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('CWE-', o_custkey % 900) END AS cwe FROM orders")
def f4(t):
    return t.orders.selectExpr(
        "o_orderkey AS id", f"if(o_orderkey % 5 = 0, 'none', {_DASHED}) AS v"
    ).select("id", S.cwe_id("v").alias("cwe"))


@query(
    "f5_tokens",
    "SELECT doc_id, length(text) // 3 AS chunk_tokens, length(text) // 4 AS metric_tokens, len(string_split(text, chr(10))) * 40 AS batch_tokens FROM documents",
)
def f5(t):
    return t.documents.selectExpr(
        "doc_id", "length(text) div 3 AS chunk_tokens", "length(text) div 4 AS metric_tokens",
        "cast(size(split(text, '\\n')) as bigint) * 40 AS batch_tokens",
    )


@query(
    "f6_hash",
    "SELECT f.file_id, md5(content) AS content_hash, md5(concat_ws(':', file_path, 7, 'CWE-1')) AS dedup_key FROM files f",
)
def f6(t):
    return t.files.select(
        "file_id", F.md5("content").alias("content_hash"),
        S.dedup_key("file_path", F.lit(7), F.lit("CWE-1")).alias("dedup_key"),
    )


@query(
    "f7_signature",
    "SELECT draft_id, concat_ws(':', line_number, replace(replace(lower(type_name), ' ', '_'), '-', '_')) AS signature FROM drafts",
)
def f7(t):
    return t.drafts.select("draft_id", S.finding_signature("line_number", "type_name").alias("signature"))


@query(
    "f8_numbered_code",
    """SELECT file_id, array_to_string(list_transform(string_split(content, chr(10)), lambda x, i:
      concat(CASE WHEN i + 9 >= 1000 THEN CAST(i + 9 AS VARCHAR) ELSE lpad(CAST(i + 9 AS VARCHAR), 4, ' ') END, ' | ', x)), chr(10)) AS numbered FROM code_files""",
)
def f8(t):
    return t.code_files.select("file_id", X.numbered_code("content", 10).alias("numbered"))


_THINK = "concat('<thinking>a ', lang, chr(10), 'b</thinking>', text, CASE doc_id % 3 WHEN 0 THEN '</THINK> tail' WHEN 1 THEN '<reasoning>r</reasoning><think>open end' ELSE '' END)"


@query(
    "f9_thinking",
    rf"""SELECT doc_id,
      md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '(?is)<thinking>.*?</thinking>', '', 'g'), '(?i)</?thinking>', '', 'g'),
        '(?is)<think>.*?</think>', '', 'g'), '(?i)</?think>', '', 'g'), '^\s+|\s+$', '', 'g')) AS parser_text,
      md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '(?is)<thinking>.*?</thinking>', '', 'g'),
        '(?is)<think>.*?</think>', '', 'g'), '(?is)<reasoning>.*?</reasoning>', '', 'g'), '(?is)<reflection>.*?</reflection>', '', 'g'),
        '(?is)<thinking>.*$', '', 'g'), '(?is)<think>.*$', '', 'g'), '(?i)</?(?:thinking|think|reasoning|reflection)>', '', 'g')) AS universal_text
    FROM (SELECT doc_id, {_THINK} AS v FROM documents)""",
)
def f9(t):
    raw = t.documents.selectExpr("doc_id", f"{_THINK} AS v")
    return raw.select(
        "doc_id", F.md5(X.strip_thinking("v")).alias("parser_text"), F.md5(X.strip_reasoning("v")).alias("universal_text")
    )


_FENCE = "CASE doc_id % 4 WHEN 0 THEN concat('```c', chr(10), text, chr(10), '```') WHEN 1 THEN concat('```', chr(10), text, chr(10), '```', chr(10), 'after') WHEN 2 THEN concat('```', text) ELSE text END"


@query(
    "f10_fences",
    rf"""WITH s AS (SELECT doc_id, regexp_replace({_FENCE}, '^\s+|\s+$', '', 'g') AS t FROM documents),
    l AS (SELECT *, string_split(t, chr(10)) AS lines, len(t) - len(replace(t, '```', '')) AS ticks FROM s),
    c AS (SELECT *, list_position(list_reverse(list_transform(lines, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))), '```') AS back FROM l)
    SELECT doc_id,
      md5(CASE WHEN starts_with(t, '```') AND ticks = 6 AND regexp_replace(lines[-1], '^\s+|\s+$', '', 'g') = '```' THEN array_to_string(lines[2:-2], chr(10)) ELSE t END) AS outer_text,
      md5(CASE WHEN starts_with(t, '```') AND back > 0 AND len(lines) - back > 0
        THEN regexp_replace(array_to_string(lines[2:len(lines) - back], chr(10)), '^\s+|\s+$', '', 'g') ELSE t END) AS inner_text FROM c""",
)
def f10(t):
    raw = t.documents.selectExpr("doc_id", f"{_FENCE} AS v")
    return raw.select(
        "doc_id", F.md5(X.strip_outer_fence("v")).alias("outer_text"),
        F.md5(X.strip_first_last_fence("v")).alias("inner_text"),
    )


_UNI = "concat('＊LINE：', doc_id, ' — “', text, '” – end')"


@query(
    "f11_unicode",
    f"SELECT doc_id, md5(translate({_UNI}, {quote(X.UNICODE_FROM)}, {quote(X.UNICODE_TO)})) AS plain FROM documents",
)
def f11(t):
    return t.documents.selectExpr("doc_id", f"{_UNI} AS v").select("doc_id", F.md5(X.normalize_unicode("v")).alias("plain"))


DECISION_SQL = """CASE WHEN contains(upper(v), 'FALSE_POSITIVE') OR contains(upper(v), 'FALSE POSITIVE') THEN 'FALSE_POSITIVE'
  WHEN contains(upper(v), 'REAL') THEN 'REAL' WHEN contains(upper(v), 'NEEDS_VERIFIED') OR contains(upper(v), 'NEEDS VERIFIED') THEN 'NEEDS_VERIFIED'
  WHEN contains(upper(v), 'WEAKNESS') THEN 'WEAKNESS' ELSE 'ABSTAIN' END"""


@query(
    "f12_vote",
    rf"""SELECT vote_id, {DECISION_SQL} AS decision,
      CASE WHEN tok IN ('FALSE_POSITIVE', 'FP') THEN 'FALSE_POSITIVE' WHEN tok IN ('REAL', 'WEAKNESS', 'NEEDS_VERIFIED') THEN tok END AS token,
      CAST(least(100, coalesce(try_cast(nullif(regexp_extract(v, '(\d+)', 1), '') AS BIGINT), 50)) AS INT) AS confidence
    FROM (SELECT vote_id, text AS v, upper(regexp_extract(text, '(?i)(?:vote|decision|verdict|verified)\s*:\s*(\w+)', 1)) AS tok FROM vote_texts)""",
)
def f12(t):
    return t.vote_texts.select(
        "vote_id", X.vote_decision("text").alias("decision"), X.vote_token("text").alias("token"),
        X.clamp_confidence("text").alias("confidence"),
    )


_TAGS_SQL = "list_filter([" + ", ".join(
    "CASE WHEN " + " OR ".join(f"contains(c, '{w}')" for w in ws) + f" THEN '{tag}' END" for tag, ws in X.TAG_WORDS
) + ", CASE WHEN difficulty > 0.7 THEN 'difficult' WHEN difficulty < 0.3 THEN 'easy' END, CASE WHEN num_votes >= 5 THEN 'high-agreement' WHEN num_votes >= 3 THEN 'medium-agreement' END], lambda x: x IS NOT NULL)"
_CANDIDATES = """per AS (SELECT draft_id, count(*) AS num_votes, sum(confidence) / count(*) / 100 AS avg_confidence FROM votes GROUP BY draft_id),
    cand AS (SELECT d.draft_id, d.scan_id, d.status, d.vulnerability_type, d.type_name, num_votes, avg_confidence, 1 - avg_confidence AS difficulty,
      lower(concat(d.type_name, ' ', d.title)) AS c FROM drafts d JOIN per USING (draft_id))"""


@query("f14_tags", f"WITH {_CANDIDATES} SELECT draft_id, {_TAGS_SQL} AS tags FROM cand")
def f14(t):
    from auditlake.operators.sampling import candidates

    c = candidates(t.drafts, t.votes)
    return c.select("draft_id", X.case_tags("type_name", "title", F.col("difficulty"), F.col("num_votes")).alias("tags"))


@query(
    "f15_case_fields",
    f"""WITH {_CANDIDATES}, v AS (SELECT *, CASE status WHEN 'verified' THEN 'REAL' WHEN 'rejected' THEN 'FALSE_POSITIVE' WHEN 'weakness' THEN 'WEAKNESS' ELSE 'UNKNOWN' END AS verdict FROM cand)
    SELECT draft_id, verdict, difficulty, concat('scan', scan_id, '_draft', draft_id, '_', vulnerability_type, '_', verdict) AS name FROM v""",
)
def f15(t):
    from auditlake.operators.sampling import candidates, case_fields

    return case_fields(candidates(t.drafts, t.votes)).select("draft_id", "verdict", "difficulty", "name")


def _malicious_sql() -> str:
    arms = []
    for name, patterns in X.MALICIOUS_PATTERNS.items():
        first = " ".join(f"WHEN regexp_matches(s, {quote('(?i)' + p)}) THEN {quote(p)}" for p in patterns)
        arms.append(f"CASE WHEN (CASE {first} END) IS NOT NULL THEN concat({quote(name + ': matched pattern ' + chr(39))}, CASE {first} END, '''') END")
    return "list_filter([" + ", ".join(arms) + "], lambda x: x IS NOT NULL)"


MALICIOUS_SQL = _malicious_sql()


@query(
    "f16_malicious",
    f"SELECT finding_id, {MALICIOUS_SQL} AS indicators FROM (SELECT finding_id, lower(concat_ws(' ', title, snippet)) AS s FROM alert_findings)",
)
def f16(t):
    return t.alert_findings.select("finding_id", X.malicious_categories("title", "snippet").alias("indicators"))


@query(
    "a39_scan_complete",
    f"""WITH h AS (SELECT *, len({MALICIOUS_SQL}) > 0 AS hit FROM (SELECT *, lower(concat_ws(' ', title, snippet)) AS s FROM alert_findings))
    SELECT scan_id, count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
      count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (hit) AS malicious FROM h GROUP BY scan_id""",
)
def a39(t):
    from auditlake.operators.progress import scan_completion

    return scan_completion(t.alert_findings.withColumn("description", F.col("snippet")))


_LIMIT = "CASE o_custkey % 5 WHEN 0 THEN concat('max_tokens is too large: ', o_orderkey % 9000 + 2000, '. This model''s maximum context length is 16384 tokens and your request has ', o_custkey * 3, ' input tokens') WHEN 1 THEN concat('maximum context length is 8192 tokens, however you requested ', o_orderkey, ' tokens (', o_custkey, ' in your prompt)') WHEN 2 THEN concat('context length is ', o_custkey, ' with ', o_orderkey % 900, ' input') WHEN 3 THEN concat('too large: ', o_orderkey) ELSE 'no limit here' END"
_E = lambda p, g: f"try_cast(regexp_extract(v, {quote(p)}, {g}) AS BIGINT)"


@query(
    "f17_token_limits",
    f"""WITH r AS (SELECT o_orderkey AS id, o_custkey, {_LIMIT} AS v FROM orders),
    p AS (SELECT *, CASE WHEN regexp_matches(v, {quote(X.LIMIT_FULL)}) THEN 1 WHEN regexp_matches(v, {quote(X.LIMIT_PROMPT)}) THEN 2 WHEN regexp_matches(v, {quote(X.LIMIT_PLAIN)}) THEN 3 ELSE 0 END AS k FROM r),
    q AS (SELECT *, CASE k WHEN 1 THEN {_E(X.LIMIT_FULL, 2)} WHEN 2 THEN {_E(X.LIMIT_PROMPT, 1)} WHEN 3 THEN {_E(X.LIMIT_PLAIN, 1)} END AS context,
      CASE k WHEN 1 THEN {_E(X.LIMIT_FULL, 3)} WHEN 2 THEN {_E(X.LIMIT_PROMPT, 3)} WHEN 3 THEN coalesce({_E('(?i)(' + chr(92) + 'd+)' + chr(92) + 's*input', 1)}, 0) END AS input_tokens FROM p)
    SELECT id, context, input_tokens, CASE WHEN (context - input_tokens) * 95 // 100 > 0 THEN (context - input_tokens) * 95 // 100
      ELSE try_cast(regexp_extract(v, 'too large:\\s*(\\d+)', 1) AS BIGINT) // 2 END AS retry_tokens,
      CASE WHEN 2000 - length(v) // 4 < 1950 THEN 1950 ELSE least(1980, 2000 - length(v) // 4) END AS budget FROM q""",
)
def f17(t):
    raw = t.orders.selectExpr("o_orderkey AS id", f"{_LIMIT.replace(chr(39) * 2, chr(92) + chr(39))} AS v")
    parsed = raw.withColumn("e", X.limit_error("v"))
    return parsed.select(
        "id", "e.context", "e.input_tokens", X.retry_tokens("v", F.col("e")).alias("retry_tokens"),
        X.max_output_tokens(F.col("v"), F.lit(1980), F.lit(2000), 1950).alias("budget"),
    )


@query(
    "f18_backoff",
    """SELECT error_id, retry_count + 1 AS retry_count, CASE WHEN retry_count + 1 <= 3 THEN 2 * pow(2, retry_count + 1) END AS delay,
      CASE WHEN retry_count + 1 <= 3 THEN strftime(created_at + to_seconds(CAST(2 * pow(2, retry_count + 1) AS BIGINT)), '%Y-%m-%d %H:%M:%S') END AS next_retry_at,
      CASE WHEN retry_count + 1 <= 3 THEN 'pending' ELSE 'failed' END AS status FROM errors""",
)
def f18(t):
    from auditlake.operators.lifecycle import schedule_retry

    return schedule_retry(t.errors).select(
        "error_id", "retry_count", "delay", F.date_format("next_retry_at", "yyyy-MM-dd HH:mm:ss").alias("next_retry_at"), "status"
    )


_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)$"
_DIFF_LINES = f"""l AS (SELECT change_id, unnest(string_split(diff, chr(10))) AS line, generate_subscripts(string_split(diff, chr(10)), 1) AS n FROM diffs),
    h AS (SELECT *, regexp_matches(line, '{_HEADER}') AS is_header, sum(CASE WHEN regexp_matches(line, '{_HEADER}') THEN 1 ELSE 0 END) OVER (PARTITION BY change_id ORDER BY n) AS hunk FROM l)"""


@query(
    "f19_diff_hunks",
    rf"""WITH {_DIFF_LINES}
    SELECT change_id, CAST(hunk AS BIGINT) AS hunk, max(CASE WHEN is_header THEN try_cast(regexp_extract(line, '{_HEADER}', 1) AS INT) END) AS old_start,
      max(CASE WHEN is_header THEN coalesce(try_cast(regexp_extract(line, '{_HEADER}', 2) AS INT), 1) END) AS old_lines,
      max(CASE WHEN is_header THEN try_cast(regexp_extract(line, '{_HEADER}', 3) AS INT) END) AS new_start,
      max(CASE WHEN is_header THEN coalesce(try_cast(regexp_extract(line, '{_HEADER}', 4) AS INT), 1) END) AS new_lines,
      max(CASE WHEN is_header THEN trim(regexp_extract(line, '{_HEADER}', 5)) END) AS header, count(*) - 1 AS content_lines
    FROM h WHERE hunk > 0 GROUP BY change_id, hunk""",
)
def f19(t):
    from auditlake.operators.diffs import diff_hunks

    return diff_hunks(t.diffs)


@query(
    "f19_added_lines",
    rf"""WITH {_DIFF_LINES},
    s AS (SELECT *, max(CASE WHEN is_header THEN try_cast(regexp_extract(line, '{_HEADER}', 3) AS INT) END) OVER (PARTITION BY change_id, hunk) AS new_start,
      CASE WHEN is_header OR (starts_with(line, '-') AND NOT starts_with(line, '---')) THEN 0 ELSE 1 END AS step FROM h WHERE hunk > 0),
    w AS (SELECT *, new_start + sum(step) OVER (PARTITION BY change_id, hunk ORDER BY n) - step AS line_number FROM s)
    SELECT change_id, CAST(line_number AS BIGINT) AS line_number, substr(line, 2) AS content FROM w WHERE NOT is_header AND starts_with(line, '+') AND NOT starts_with(line, '+++')""",
)
def f19_added(t):
    from auditlake.operators.diffs import added_lines

    return added_lines(t.diffs)


_PIPE = "string_split(line, '|')"
PIPE_SQL = f"""SELECT record_id, {_PIPE}[1] AS cwe, replace({_PIPE}[2], '/app/', '') AS file_path,
  try_cast({_PIPE}[3] AS INT) AS line_number, {_PIPE}[4] AS sink, array_to_string({_PIPE}[5:], '|') AS code FROM pipe_records WHERE try_cast({_PIPE}[3] AS INT) > 0"""


@query(
    "f20_cwe_lookup",
    f"""WITH r AS ({PIPE_SQL}), n AS (SELECT *, {case_map('cwe', X.CWE_NAMES, 'cwe')} AS name FROM r)
    SELECT record_id, cwe, concat(name, ' via ', sink, '()') AS title, {case_map('cwe', X.CWE_SEVERITY, quote('Medium'))} AS severity,
      replace({case_map('cwe', X.CWE_REASONS, "concat('Potential ', name, ' detected')")}, '{{sink}}', sink) AS reason FROM n""",
)
def f20(t):
    from auditlake.operators.extraction import pipe_findings

    return pipe_findings(t.pipe_records).select("record_id", "cwe", "title", "severity", "reason")


@query("t6_pipe_records", PIPE_SQL)
def t6(t):
    from auditlake.operators.extraction import pipe_findings

    return pipe_findings(t.pipe_records).select("record_id", "cwe", "file_path", "line_number", "sink", "code")


@query(
    "f22_keywords",
    r"""SELECT draft_id, list_filter(regexp_extract_all(regexp_replace(lower(v), 'cwe-\d+', '', 'g'), '([\p{L}\p{N}_]+)', 1),
      lambda w: length(w) > 2 AND w NOT IN ('a', 'an', 'the', 'of', 'in', 'to', 'and', 'or', 'via', 'through')) AS keywords,
      nullif(regexp_extract(v, '\b([A-Z]{2,6})\b', 1), '') AS short_name
    FROM (SELECT draft_id, concat(title, ' via ', vulnerability_type, ' the XSS über path') AS v FROM drafts)""",
)
def f22(t):
    raw = t.drafts.selectExpr("draft_id", "concat(title, ' via ', vulnerability_type, ' the XSS über path') AS v")
    return raw.select("draft_id", X.keywords("v").alias("keywords"), X.short_name("v").alias("short_name"))


@query(
    "f25_qualified_name",
    f"""SELECT file_id, CASE WHEN {EXT} = 'py' THEN concat(replace(substr(file_path, 1, length(file_path) - 3), '/', '.'), '.', 'main')
      ELSE concat(regexp_extract(file_path, '([^/]*)$', 1), '.', 'main') END AS qualified FROM files""",
)
def f25(t):
    from auditlake.operators.symbols import qualified_name

    return t.files.select("file_id", qualified_name("file_path", F.lit("main")).alias("qualified"))


_RISK_ARMS = " ".join(
    f"WHEN contains(lower(p), '{w}') THEN concat(fn, '(', p, ')|{s}|{r}')" for w, s, r in X.PARAMETER_RISKS
)


@query(
    "f26_param_risks",
    rf"""WITH m AS (SELECT file_id, unnest(regexp_extract_all(content, {quote(X.PARAM_LIST)}, 1)) AS fn, unnest(regexp_extract_all(content, {quote(X.PARAM_LIST)}, 2)) AS ps,
        generate_subscripts(regexp_extract_all(content, {quote(X.PARAM_LIST)}, 1), 1) AS k FROM code_files),
    p AS (SELECT file_id, fn, k, unnest(list_filter(list_transform(string_split(ps, ','), lambda x: trim(x)), lambda x: x <> '')) AS raw FROM m),
    q AS (SELECT file_id, regexp_replace(string_split_regex(raw, '\s+')[-1], '^[*& ]+|[*& ]+$', '', 'g') AS p, fn FROM p)
    SELECT file_id, risk, count(*) AS n FROM (SELECT file_id, CASE {_RISK_ARMS} END AS risk FROM q) WHERE risk IS NOT NULL GROUP BY ALL""",
)
def f26(t):
    return (
        t.code_files.select("file_id", F.explode(X.parameter_risks("content")).alias("risk"))
        .groupBy("file_id", "risk")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "f27_names",
    rf"""SELECT file_id, list_filter(regexp_extract_all(content, {quote(X.CALL_NAME)}, 1), lambda c: c NOT IN ({', '.join(map(quote, X.CALL_KEYWORDS))}) AND NOT starts_with(c, '__')) AS calls,
      list_concat(regexp_extract_all(content, {quote(X.PY_FUNCTION)}, 1), regexp_extract_all(content, {quote(X.C_FUNCTION)}, 1)) AS functions FROM code_files""",
)
def f27(t):
    return t.code_files.select("file_id", X.call_names("content").alias("calls"), X.function_names("content").alias("functions"))


@query(
    "f28_diff_names",
    "SELECT file_id, concat('f', file_id, '.c') AS fixed_file, file_id * 3 AS finding_id, concat('model-', lang, '.v1') AS model FROM files",
)
def f28(t):
    from auditlake.sources.files import parse_fix_name

    named = t.files.selectExpr(
        "file_id", "concat('out/f', file_id, '.c.fix.', file_id * 3, '.model-', lang, '.v1.diff') AS path"
    )
    return named.select("file_id", parse_fix_name("path").alias("p")).select("file_id", "p.*")


_ANSWER = "CASE o_custkey % 4 WHEN 0 THEN concat('Verdict: REAL', chr(10), 'CONFIDENCE: ', o_custkey % 150, chr(10), 'REASONING: reached from input', chr(10), 'ATTACK_PATH: a -> b', chr(10), '*END') WHEN 1 THEN concat('FALSE POSITIVE', chr(10), 'confidence: ', o_custkey % 90, chr(10), 'Reasoning: dead code') WHEN 2 THEN 'not sure, unreal' ELSE '' END"


@query(
    "f29_agent_verdict",
    rf"""SELECT id, contains(upper(v), 'REAL') AS verified, CAST(least(100, coalesce(try_cast(regexp_extract(v, '(?i)CONFIDENCE:\s*(\d+)', 1) AS BIGINT), 50)) AS INT) AS confidence,
      coalesce(nullif(trim(regexp_replace(regexp_extract(v, '(?is)REASONING:\s*(.+?)(?:ATTACK_PATH:|$)', 1), '\s+$', '')), ''), 'Analysis incomplete') AS reasoning,
      trim(regexp_replace(regexp_extract(v, '(?is)ATTACK_PATH:\s*(.+?)(?:\*END|$)', 1), '\s+$', '')) AS attack_path
    FROM (SELECT o_orderkey AS id, {_ANSWER} AS v FROM orders)""",
)
def f29(t):
    raw = t.orders.selectExpr("o_orderkey AS id", f"{_ANSWER} AS v")
    return raw.select("id", X.agent_verdict("v").alias("a")).select("id", "a.*")


@query(
    "f30_prompt_cap",
    "SELECT doc_id, md5(CASE WHEN length(text) > 500 * 4 THEN concat(substr(text, 1, 2000), chr(10), '... (context truncated)') ELSE text END) AS capped FROM documents",
)
def f30(t):
    from auditlake.operators.context import cap_context

    return t.documents.select("doc_id", F.md5(cap_context("text", 500)).alias("capped"))


_PROMPT = "concat('Please ', CASE o_custkey % 3 WHEN 0 THEN 'VERIFY or REJECT' WHEN 1 THEN 'verify or reject' ELSE 'judge' END, ' order ', o_orderkey)"


@query(
    "f31_template_rewrite",
    f"""WITH r AS (SELECT o_orderkey AS id, {_PROMPT} AS v FROM orders),
    n AS (SELECT *, replace(replace(replace(replace(v, 'VERIFY', 'REAL'), 'REJECT', 'FALSE_POSITIVE'), 'verify', 'REAL'), 'reject', 'FALSE_POSITIVE') AS template FROM r)
    SELECT id, template, CASE WHEN contains(template, 'REAL') OR contains(template, 'FALSE_POSITIVE') THEN 'UPDATED' ELSE 'NO CHANGE' END AS status FROM n""",
)
def f31(t):
    raw = t.orders.selectExpr("o_orderkey AS id", f"{_PROMPT} AS v")
    new = raw.select("id", X.rewrite_template("v").alias("template"))
    hit = F.col("template").contains("REAL") | F.col("template").contains("FALSE_POSITIVE")
    return new.withColumn("status", F.when(hit, "UPDATED").otherwise("NO CHANGE"))


@query(
    "f32_comment",
    """SELECT finding_id, concat(CASE upper(severity) WHEN 'CRITICAL' THEN ':rotating_light:' WHEN 'HIGH' THEN ':warning:' WHEN 'LOW' THEN ':information_source:' ELSE ':yellow_circle:' END,
      ' **Security Issue: ', title, '**', chr(10), chr(10), '**Severity:** ', upper(severity), chr(10), chr(10), description, chr(10), chr(10),
      '**Recommendation:** Review this code for security implications.') AS comment FROM findings""",
)
def f32(t):
    from auditlake.operators.review import inline_comment

    found = t.findings.withColumn("severity", F.upper("severity")).withColumn("recommendation", F.lit(None).cast("string"))
    return found.select("finding_id", inline_comment().alias("comment"))
