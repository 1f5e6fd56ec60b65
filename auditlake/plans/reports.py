"""Queries that report scan quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import dedup, report as R
from auditlake.plans.registry import query

_DRAFT = """SELECT scan_id, count(*) AS total_drafts,
  count(*) FILTER (status = 'verified') AS drafts_verified,
  count(*) FILTER (status = 'rejected') AS drafts_rejected,
  count(*) FILTER (status = 'weakness') AS drafts_weakness,
  count(*) FILTER (status = 'verified') / count(*) AS draft_precision
  FROM drafts GROUP BY scan_id"""
_VOTE = """SELECT scan_id, coalesce(total_votes, 0) AS total_votes, coalesce(avg_confidence, 0) AS avg_confidence, consensus_rate
  FROM (SELECT d.scan_id, count(*) FILTER (k = 1) / count(*) AS consensus_rate
        FROM drafts d LEFT JOIN (SELECT draft_id, count(DISTINCT decision) AS k FROM votes GROUP BY draft_id) v
        ON d.draft_id = v.draft_id GROUP BY d.scan_id) r
  LEFT JOIN (SELECT scan_id, count(*) AS total_votes, avg(confidence) AS avg_confidence FROM votes GROUP BY scan_id) t
  USING (scan_id)"""
_SEV = """SELECT scan_id, count(*) AS total_findings,
  count(*) FILTER (upper(severity) = 'CRITICAL') AS critical, count(*) FILTER (upper(severity) = 'HIGH') AS high,
  count(*) FILTER (upper(severity) = 'MEDIUM') AS medium, count(*) FILTER (upper(severity) = 'LOW') AS low
  FROM findings GROUP BY scan_id"""
_CWE = """SELECT scan_id, CAST(sum(n) AS BIGINT) AS cwe_total, max(n) AS top_cwe_count,
  arg_min(cwe, ROW(-n, first_id)) AS top_cwe, round(-sum(n / tot * log2(n / tot)), 6) AS diversity_score
  FROM (SELECT *, sum(n) OVER (PARTITION BY scan_id) AS tot FROM
    (SELECT scan_id, vulnerability_type AS cwe, count(*) AS n, min(draft_id) AS first_id FROM drafts GROUP BY ALL))
  GROUP BY scan_id"""
_VERIFIER = """SELECT v.scan_id, v.model_name,
  count(*) FILTER (decision = 'REAL') AS real, count(*) FILTER (decision = 'FALSE_POSITIVE') AS false_positive,
  count(*) FILTER (decision = 'WEAKNESS') AS weakness, count(*) FILTER (decision = 'NEEDS_VERIFIED') AS needs_verified,
  count(*) FILTER (decision = 'ABSTAIN') AS abstain, avg(confidence) AS avg_confidence, count(*) AS total_votes,
  count(*) FILTER (decision || status IN ('REALverified', 'FALSE_POSITIVErejected', 'WEAKNESSweakness')) AS agreements,
  count(*) FILTER (decision || status IN ('REALverified', 'FALSE_POSITIVErejected', 'WEAKNESSweakness')) / count(*) AS agreement_rate
  FROM votes v LEFT JOIN (SELECT draft_id, status FROM drafts) d ON v.draft_id = d.draft_id GROUP BY v.scan_id, v.model_name"""
_SCORED = f"""dm AS ({_DRAFT}), vm AS ({_VOTE}), sv AS ({_SEV}), cm AS ({_CWE}),
scored AS (SELECT dm.*, vm.total_votes, vm.avg_confidence, vm.consensus_rate, coalesce(total_findings, 0) AS total_findings,
   coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, cwe_total, top_cwe_count, top_cwe, diversity_score,
   round(draft_precision * 50 + consensus_rate * 20 + least(diversity_score / 2.5, 1) * 15
     + CASE WHEN coalesce(total_findings, 0) > 0 THEN (critical + high) / total_findings ELSE 0 END * 15, 6) AS score
  FROM dm LEFT JOIN vm USING (scan_id) LEFT JOIN sv USING (scan_id) LEFT JOIN cm USING (scan_id)),
graded AS (SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C'
   WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM scored)"""


def _pct(n: str, d: str) -> str:
    q = f"(1000 * {n}) // {d}"
    r2 = f"(2 * ((1000 * {n}) % {d}))"
    tenths = f"({q} + CASE WHEN {r2} > {d} OR ({r2} = {d} AND ({q}) % 2 = 1) THEN 1 ELSE 0 END)"
    return f"concat({tenths} // 10, '.', {tenths} % 10, '%')"


_FLAGGED = f"""vb AS ({_VERIFIER}),
flagged AS (SELECT *, list_filter([
   CASE WHEN real = total_votes THEN 'always_verifies' WHEN round(real / total_votes * 100, 1) >= 95 THEN 'heavily_biased_verify' END,
   CASE WHEN false_positive = total_votes THEN 'always_rejects' WHEN round(false_positive / total_votes * 100, 1) >= 95 THEN 'heavily_biased_reject' END,
   CASE WHEN round(needs_verified / total_votes * 100, 1) >= 50 OR round(abstain / total_votes * 100, 1) >= 50 THEN 'excessive_abstention' END
  ], lambda x: x IS NOT NULL) AS flags FROM vb)"""
_ISSUES = f"""issues AS (
  SELECT scan_id, 'low_precision' AS type, 'high' AS severity, concat('Low draft precision (', {_pct('drafts_verified', 'total_drafts')}, '). Over half of initial findings are false positives.') AS message FROM graded WHERE draft_precision < 0.5
  UNION ALL SELECT scan_id, 'cwe_spam', 'medium', concat('Potential CWE spam: ', top_cwe, ' represents ', {_pct('top_cwe_count', 'cwe_total')}, ' of all findings.') FROM graded WHERE top_cwe_count / cwe_total > 0.6
  UNION ALL SELECT scan_id, 'low_consensus', 'medium', 'Low verification consensus. Verifiers frequently disagree, indicating unclear findings.' FROM graded WHERE consensus_rate < 0.5
  UNION ALL SELECT scan_id, 'low_diversity', 'low', 'Low CWE diversity. Model may be biased toward certain vulnerability types.' FROM graded WHERE diversity_score < 1
  UNION ALL SELECT scan_id, 'biased_verifier', CASE WHEN list_contains(flags, 'always_verifies') OR list_contains(flags, 'always_rejects') THEN 'high' ELSE 'medium' END,
    concat('Model ', model_name, CASE WHEN list_contains(flags, 'always_verifies') THEN ' voted REAL 100% of the time - likely broken or misconfigured.'
      WHEN list_contains(flags, 'always_rejects') THEN ' voted FALSE_POSITIVE 100% of the time - likely broken or misconfigured.'
      WHEN list_contains(flags, 'heavily_biased_verify') THEN concat(' heavily biased toward REAL (', {_pct('real', 'total_votes')}, ') - check configuration.')
      ELSE concat(' heavily biased toward FALSE_POSITIVE (', {_pct('false_positive', 'total_votes')}, ') - check configuration.') END)
    FROM flagged WHERE list_has_any(flags, ['always_verifies', 'always_rejects', 'heavily_biased_verify', 'heavily_biased_reject'])
  UNION ALL SELECT scan_id, 'excessive_abstention', 'medium', concat('Model ', model_name, ' abstains ',
    CASE WHEN needs_verified > 0 THEN {_pct('needs_verified', 'total_votes')} ELSE {_pct('abstain', 'total_votes')} END, ' of the time - may need better prompting.')
    FROM flagged WHERE list_contains(flags, 'excessive_abstention'))"""
_MERGED = """merged AS (SELECT scan_id, arg_min(status, raw_id) AS status, list_sort(list(DISTINCT model)) AS source_models
  FROM raw_drafts GROUP BY scan_id, file_id, line_number, vulnerability_type)"""
_PRICED = """usage AS (SELECT scan_id, model_name, phase, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in,
    CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM llm_log GROUP BY ALL),
priced AS (SELECT u.*, coalesce(price_in, CAST(0.5 AS DOUBLE)) AS price_in, coalesce(price_out, CAST(0.5 AS DOUBLE)) AS price_out,
    (tokens_in * coalesce(price_in, CAST(0.5 AS DOUBLE)) + tokens_out * coalesce(price_out, CAST(0.5 AS DOUBLE))) / 1000000 AS cost
  FROM usage u LEFT JOIN prices USING (model_name))"""


@query("a1_draft_metrics", _DRAFT)
def a1(t):
    return R.draft_metrics(t.drafts)


@query("a2_vote_metrics", _VOTE)
def a2(t):
    return R.vote_metrics(t.votes, t.drafts)


@query("a3_severity", _SEV)
def a3(t):
    return R.severity_counts(t.findings)


@query("a4_cwe_entropy", _CWE)
def a4(t):
    return R.cwe_metrics(t.drafts).select(
        "scan_id", "cwe_total", "top_cwe_count", "top_cwe",
        F.round("diversity_score", 6).alias("diversity_score"),
    )


@query(
    "a5_throughput",
    """WITH tm AS (SELECT scan_id, CAST(sum(duration_ms) AS BIGINT) AS total_time_ms,
        CAST(sum(tokens_in) + sum(tokens_out) AS BIGINT) AS total_tokens FROM llm_log GROUP BY scan_id),
    f AS (SELECT scan_id, count(*) AS k FROM findings GROUP BY scan_id)
    SELECT scan_id, total_time_ms, total_tokens, coalesce(k, 0) AS findings_count,
      coalesce(coalesce(k, 0) / nullif(total_time_ms / 1000 / 60, 0), 0) AS findings_per_minute,
      coalesce(total_tokens // nullif(k, 0), 0) AS avg_tokens_per_finding FROM tm LEFT JOIN f USING (scan_id)""",
)
def a5(t):
    return R.throughput(t.llm_log, t.findings)


@query(
    "a6_scanner_breakdown",
    """WITH c AS (SELECT scan_id, analyzer_name, count(*) AS drafts_found, count(*) FILTER (status = 'verified') AS verified,
        count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'weakness') AS weakness
        FROM drafts WHERE analyzer_name IS NOT NULL GROUP BY ALL),
    w AS (SELECT scan_id, analyzer_name, vulnerability_type AS cwe, count(*) AS n, min(draft_id) AS f FROM drafts GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY scan_id, analyzer_name ORDER BY n DESC, f) AS rn FROM w),
    l AS (SELECT scan_id, analyzer_name, list(concat(cwe, ':', n) ORDER BY rn) AS top_cwes FROM top WHERE rn <= 3 GROUP BY ALL)
    SELECT c.*, top_cwes, verified / drafts_found AS precision FROM c LEFT JOIN l USING (scan_id, analyzer_name)""",
)
def a6(t):
    return R.scanner_breakdown(t.drafts)


@query(
    "w6_top_cwes",
    """WITH w AS (SELECT scan_id, analyzer_name, vulnerability_type AS cwe, count(*) AS n, min(draft_id) AS first_id
        FROM drafts WHERE analyzer_name IS NOT NULL GROUP BY ALL)
    SELECT *, CAST(row_number() OVER (PARTITION BY scan_id, analyzer_name ORDER BY n DESC, first_id) AS INT) AS rn
    FROM w QUALIFY rn <= 3""",
)
def w6(t):
    return R.top_cwes(t.drafts)


@query("a7_verifier_breakdown", _VERIFIER)
def a7(t):
    return R.verifier_breakdown(t.votes, t.drafts)


@query("a8_bias_flags", f"WITH {_FLAGGED} SELECT scan_id, model_name, total_votes, flags FROM flagged")
def a8(t):
    return R.bias_flags(R.verifier_breakdown(t.votes, t.drafts)).select(
        "scan_id", "model_name", "total_votes", "flags"
    )


@query(
    "a9_enricher",
    "SELECT scan_id, source_model, count(*) AS findings_enriched FROM findings GROUP BY scan_id, source_model",
)
def a9(t):
    return R.enricher_contribution(t.findings)


@query(
    "a10_grade",
    f"WITH {_SCORED} SELECT scan_id, draft_precision, consensus_rate, diversity_score, total_findings, score, grade FROM graded",
)
def a10(t):
    return R.scan_metrics(t.drafts, t.votes, t.findings).select(
        "scan_id", "draft_precision", "consensus_rate",
        F.round("diversity_score", 6).alias("diversity_score"), "total_findings", "score", "grade",
    )


@query("a11_issues", f"WITH {_SCORED}, {_FLAGGED}, {_ISSUES} SELECT * FROM issues")
def a11(t):
    metrics = R.scan_metrics(t.drafts, t.votes, t.findings)
    return R.quality_issues(metrics, R.bias_flags(R.verifier_breakdown(t.votes, t.drafts)))


@query(
    "a12_scan_report",
    f"""WITH {_SCORED}, {_FLAGGED}, {_ISSUES},
    by_type AS (SELECT scan_id, type, count(*) AS n FROM issues GROUP BY ALL),
    listed AS (SELECT scan_id, CAST(sum(n) AS BIGINT) AS k, string_agg(type, ', ' ORDER BY type) AS names FROM by_type GROUP BY scan_id)
    SELECT g.scan_id, grade, score, coalesce(k, 0) AS issue_count, drafts_rejected / total_drafts AS false_positive_rate,
      concat('Scan Quality Grade: ', grade, ' Found ', total_findings, ' vulnerabilities (', critical, ' critical, ', high,
        ' high). Draft precision: ', {_pct('drafts_verified', 'total_drafts')}, ' (', drafts_verified, ' verified out of ',
        total_drafts, ' initial findings). ', CASE WHEN k > 0 THEN concat('Detected ', k, ' quality issue(s): ', names)
        ELSE 'No major quality issues detected.' END) AS summary
    FROM graded g LEFT JOIN listed USING (scan_id)""",
)
def a12(t):
    return R.scan_reports(t.drafts, t.votes, t.findings).select(
        "scan_id", "grade", "score", "issue_count", "false_positive_rate", "summary"
    )


@query(
    "a13_cost",
    f"""WITH {_PRICED}, f AS (SELECT scan_id, count(*) AS k FROM findings GROUP BY scan_id),
    s AS (SELECT scan_id, sum(cost) AS c, CAST(sum(tokens_in) AS BIGINT) AS i, CAST(sum(tokens_out) AS BIGINT) AS o FROM priced GROUP BY scan_id),
    p AS (SELECT s.*, (i * CAST(2.5 AS DOUBLE) + o * CAST(10 AS DOUBLE)) / 1000000 AS pub, coalesce(k, 1) AS k FROM s LEFT JOIN f USING (scan_id))
    SELECT scan_id, round(c, 4) AS total_cost_usd_self_hosted, round(pub, 4) AS total_cost_usd_public_api,
      round(pub - c, 4) AS cost_savings, round(c / k, 4) AS cost_per_finding, i AS total_tokens_in, o AS total_tokens_out FROM p""",
)
def a13(t):
    return R.cost_metrics(R.priced_usage(t.llm_log, t.prices), t.findings)


@query(
    "a13_cost_by_model",
    f"""WITH {_PRICED} SELECT scan_id, model_name, round(sum(cost), 4) AS total, CAST(sum(tokens_in) AS BIGINT) AS tokens_in,
      CAST(sum(tokens_out) AS BIGINT) AS tokens_out, count(*) AS phases FROM priced GROUP BY scan_id, model_name""",
)
def a13_models(t):
    return R.cost_by_model(R.priced_usage(t.llm_log, t.prices)).withColumn(
        "phases", F.size("phases").cast("bigint")
    )


@query("j17_price_lookup", f"WITH {_PRICED} SELECT scan_id, model_name, phase, calls, tokens_in, tokens_out, price_in, price_out, round(cost, 6) AS cost FROM priced")
def j17(t):
    return R.priced_usage(t.llm_log, t.prices).withColumn("cost", F.round("cost", 6))


@query(
    "a14_comparative",
    f"""WITH {_SCORED}, s AS (SELECT count(*) AS scans, CAST(sum(total_drafts) AS BIGINT) AS total_drafts,
      CAST(sum(total_findings) AS BIGINT) AS total_findings, round(avg(score), 6) AS avg_score FROM graded)
    SELECT *, CASE WHEN avg_score >= 90 THEN 'A' WHEN avg_score >= 80 THEN 'B' WHEN avg_score >= 70 THEN 'C'
      WHEN avg_score >= 60 THEN 'D' ELSE 'F' END AS overall_grade FROM s""",
)
def a14(t):
    return R.compare_scans(R.scan_metrics(t.drafts, t.votes, t.findings))


@query(
    "a15_model_performance",
    f"""WITH {_MERGED}, e AS (SELECT status, unnest(source_models) AS model FROM merged)
    SELECT model, count(*) AS total_drafts, count(*) FILTER (status = 'verified') AS verified,
      count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'weakness') AS weakness,
      count(*) FILTER (status = 'verified') / count(*) AS draft_precision FROM e GROUP BY model""",
)
def a15(t):
    return R.model_performance(dedup.merge_drafts(t.raw_drafts))


_LEADERBOARD = f"""WITH {_MERGED}, e AS (SELECT status, len(source_models) AS k, unnest(source_models) AS model FROM merged),
    s AS (SELECT model, count(*) AS detected, count(*) FILTER (status = 'verified') AS verified,
      count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status NOT IN ('verified', 'rejected')) AS pending,
      count(*) FILTER (k = 1) AS unique_finds FROM e GROUP BY model),
    tm AS (SELECT model_name AS model, count(*) AS calls, CAST(sum(duration_ms) AS BIGINT) AS time_ms,
      CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM llm_log GROUP BY ALL)
    SELECT s.*, CASE WHEN verified + rejected > 0 THEN verified * 100 / (verified + rejected) ELSE 0 END AS precision,
      calls, time_ms, tokens_in, tokens_out FROM s LEFT JOIN tm USING (model)"""


@query("a16_leaderboard", _LEADERBOARD)
def a16(t):
    return R.leaderboard(dedup.merge_drafts(t.raw_drafts), t.llm_log)


@query(
    "j20_scan_overlap",
    """WITH k AS (SELECT DISTINCT scan_id, file_id, line_number, vulnerability_type FROM raw_drafts),
    n AS (SELECT scan_id, count(*) AS n FROM k GROUP BY scan_id),
    p AS (SELECT a.scan_id AS scan_a, b.scan_id AS scan_b, count(*) AS common FROM k a JOIN k b
      USING (file_id, line_number, vulnerability_type) WHERE a.scan_id < b.scan_id GROUP BY ALL)
    SELECT scan_a, scan_b, common, x.n + y.n - common AS either, common / (x.n + y.n - common) AS agreement
    FROM p JOIN n x ON x.scan_id = scan_a JOIN n y ON y.scan_id = scan_b""",
)
def j20(t):
    return R.scan_overlap(t.raw_drafts)


@query(
    "j20_common_files",
    "SELECT file_id, count(DISTINCT scan_id) AS scans FROM raw_drafts GROUP BY file_id HAVING count(DISTINCT scan_id) > 1",
)
def j20_files(t):
    return R.common_files(t.raw_drafts)
