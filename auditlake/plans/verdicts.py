"""Queries over drafts and votes: dedup, verdicts, agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import dedup, votes as V
from auditlake.plans.registry import query

_COUNTS = """
  SELECT draft_id,
    count(*) FILTER (decision = 'REAL') AS real_count,
    count(*) FILTER (decision = 'WEAKNESS') AS weakness_count,
    count(*) FILTER (decision = 'FALSE_POSITIVE') AS false_positive_count,
    count(*) FILTER (decision = 'NEEDS_VERIFIED') AS needs_verified_count,
    count(*) FILTER (decision = 'ABSTAIN') AS abstain_count,
    sum(CASE WHEN decision = 'REAL' THEN weight * CASE WHEN confidence > 0 THEN confidence ELSE 50 END ELSE 0 END) AS real_points,
    sum(CASE WHEN decision = 'FALSE_POSITIVE' THEN weight * CASE WHEN confidence > 0 THEN confidence ELSE 50 END ELSE 0 END) AS fp_points
  FROM votes GROUP BY draft_id"""

VERDICTS = f"""
counted AS ({_COUNTS}),
sized AS (SELECT *, real_count + weakness_count + false_positive_count + needs_verified_count AS total_votes FROM counted),
needed AS (SELECT *, CASE WHEN total_votes >= 3 THEN 2 ELSE (total_votes + 1) // 2 END AS need FROM sized),
flagged AS (SELECT *,
    total_votes > 0 AND real_count >= need AS verified,
    total_votes > 0 AND weakness_count >= need AND weakness_count > real_count AS is_weakness,
    total_votes > 0 AND needs_verified_count >= need AS needs_agentic FROM needed),
verdicts AS (SELECT *,
    total_votes > 0 AND (false_positive_count >= need OR NOT (verified OR is_weakness OR needs_agentic)) AS rejected,
    CASE WHEN total_votes = 0 THEN 0
         WHEN verified THEN CAST(floor(real_count / total_votes * 100) AS INT)
         WHEN is_weakness THEN CAST(floor(weakness_count / total_votes * 100) AS INT)
         WHEN needs_agentic THEN CAST(floor(needs_verified_count / total_votes * 100) AS INT)
         ELSE CAST(floor(false_positive_count / total_votes * 100) AS INT) END AS confidence,
    CASE WHEN verified THEN 'REAL' WHEN is_weakness THEN 'WEAKNESS'
         WHEN needs_agentic THEN 'NEEDS_VERIFIED' ELSE 'FALSE_POSITIVE' END AS winning_decision,
    CASE WHEN needs_agentic THEN 'needs_agentic' WHEN verified THEN 'verified'
         WHEN is_weakness THEN 'weakness' ELSE 'rejected' END AS status
  FROM flagged)"""

_FLAGS = (
    "draft_id real_count weakness_count false_positive_count needs_verified_count abstain_count "
    "total_votes verified is_weakness needs_agentic rejected confidence winning_decision status"
).split()


@query(
    "a18_vote_majority",
    f"""WITH {VERDICTS.strip()}
    SELECT {', '.join(_FLAGS)}, CAST(real_points AS BIGINT) AS real_points,
           CAST(fp_points AS BIGINT) AS fp_points FROM verdicts""",
)
def vote_majority(t):
    return V.majority(t.votes).select(
        *_FLAGS,
        F.round(F.col("real_score") * 100).cast("bigint").alias("real_points"),
        F.round(F.col("false_positive_score") * 100).cast("bigint").alias("fp_points"),
    )


@query(
    "w2_best_vote",
    f"""WITH {VERDICTS.strip()}
    SELECT v.draft_id, v.decision, d.status, v.confidence AS best_confidence, v.vote_id, v.model_name
    FROM votes v JOIN verdicts d ON v.draft_id = d.draft_id AND v.decision = d.winning_decision
    QUALIFY row_number() OVER (PARTITION BY v.draft_id ORDER BY v.confidence DESC, v.vote_id) = 1""",
)
def best_vote(t):
    return V.best_vote(t.votes, V.majority(t.votes))


@query(
    "a40_vote_pivot",
    """SELECT draft_id,
      count(*) FILTER (decision = 'REAL') AS real,
      count(*) FILTER (decision = 'FALSE_POSITIVE') AS false_positive,
      count(*) FILTER (decision = 'WEAKNESS') AS weakness,
      count(*) FILTER (decision = 'NEEDS_VERIFIED') AS needs_verified,
      count(*) FILTER (decision = 'ABSTAIN') AS abstain
    FROM votes GROUP BY draft_id""",
)
def vote_pivot(t):
    return V.vote_counts_by_decision(t.votes)


@query(
    "j4_vote_agreement",
    """SELECT v.scan_id, v.model_name, count(*) AS total_votes,
      count(*) FILTER ((decision = 'REAL' AND status = 'verified')
        OR (decision = 'FALSE_POSITIVE' AND status = 'rejected')
        OR (decision = 'WEAKNESS' AND status = 'weakness')) AS agreements,
      count(*) FILTER ((decision = 'REAL' AND status = 'verified')
        OR (decision = 'FALSE_POSITIVE' AND status = 'rejected')
        OR (decision = 'WEAKNESS' AND status = 'weakness')) / count(*) AS agreement_rate
    FROM votes v LEFT JOIN drafts d USING (draft_id) GROUP BY v.scan_id, v.model_name""",
)
def vote_agreement(t):
    return V.agreement(t.votes, t.drafts)


_CONSENSUS = """
  WITH per AS (SELECT draft_id, decision, count(*) AS n, min(vote_id) AS first_vote, sum(confidence) AS s
               FROM votes GROUP BY draft_id, decision),
  kept AS (SELECT draft_id, CAST(sum(n) AS BIGINT) AS num_votes, arg_min(decision, ROW(-n, first_vote)) AS consensus_vote,
                  sum(s) / sum(n) / 100 AS avg_confidence FROM per GROUP BY draft_id)
"""


@query(
    "a41_consensus_votes",
    _CONSENSUS
    + """SELECT v.draft_id, vote_id, model_name, decision, confidence, num_votes, consensus_vote, avg_confidence
    FROM votes v JOIN kept USING (draft_id) WHERE avg_confidence >= 0.4""",
)
def consensus_votes(t):
    return V.consensus_votes(t.votes, min_confidence=0.4)


@query(
    "t8_hybrid_recheck",
    f"""WITH {VERDICTS.strip()},
    picked AS (SELECT v.draft_id, v.verified, d.severity, v.confidence,
      abs(real_points - fp_points) < 50 AS is_close,
      NOT v.verified AND d.severity IN ('Critical', 'High') AND v.confidence < 80 AS is_high_severity_reject
      FROM verdicts v JOIN drafts d USING (draft_id)),
    second AS (SELECT draft_id, confidence AS agent_confidence, confidence % 2 = 0 AS agent_verified FROM verified)
    SELECT p.draft_id, severity, is_close, is_high_severity_reject, is_close OR is_high_severity_reject AS recheck,
      CASE WHEN (is_close OR is_high_severity_reject) AND agent_confidence >= 80 THEN agent_verified ELSE p.verified END AS final_verified
    FROM picked p LEFT JOIN second USING (draft_id)""",
)
def hybrid_recheck(t):
    second = t.verified.selectExpr(
        "draft_id", "confidence AS agent_confidence", "confidence % 2 = 0 AS agent_verified"
    )
    selected = V.recheck_selection(V.majority(t.votes), t.drafts)
    return V.apply_second_pass(selected, second).select(
        "draft_id", "severity", "is_close", "is_high_severity_reject", "recheck", "final_verified"
    )


@query(
    "a17_dedup_merge",
    """SELECT scan_id, md5(concat_ws(':', file_id, line_number, vulnerability_type)) AS dedup_key,
      min(raw_id) AS raw_id, arg_min(severity, raw_id) AS severity, arg_min(status, raw_id) AS status,
      CAST(sum(coalesce(votes, 1)) AS BIGINT) AS initial_votes, count(*) AS copies,
      list_sort(list(DISTINCT model)) AS source_models
    FROM raw_drafts GROUP BY scan_id, file_id, line_number, vulnerability_type""",
)
def dedup_merge(t):
    return dedup.merge_drafts(t.raw_drafts)


@query(
    "a19_vote_merge",
    """WITH signed AS (SELECT *, concat_ws(':', line_number, translate(lower(vulnerability_type), ' -', '__')) AS signature,
        CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END AS rk FROM raw_drafts),
    sev AS (SELECT file_id, signature, severity, rk, count(*) AS n FROM signed GROUP BY ALL),
    modal AS (SELECT file_id, signature, severity FROM sev
      QUALIFY row_number() OVER (PARTITION BY file_id, signature ORDER BY n DESC, rk DESC) = 1),
    tot AS (SELECT file_id, signature, count(*) AS votes, list_sort(list(DISTINCT model)) AS models FROM signed GROUP BY ALL)
    SELECT file_id, signature, votes, models, severity FROM tot JOIN modal USING (file_id, signature)""",
)
def vote_merge(t):
    return dedup.merge_model_findings(t.raw_drafts)


@query(
    "a20_signature_dedup",
    """SELECT file_id, line_number, vulnerability_type, raw_id, scan_id, severity, model FROM raw_drafts
    QUALIFY row_number() OVER (PARTITION BY file_id, line_number, vulnerability_type ORDER BY raw_id) = 1""",
)
def signature_dedup(t):
    return dedup.first_per_signature(t.raw_drafts)
