"""Verdicts from model votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECISIONS = ["REAL", "FALSE_POSITIVE", "WEAKNESS", "NEEDS_VERIFIED", "ABSTAIN"]

# The draft status a decision agrees with.
AGREES = {"REAL": "verified", "FALSE_POSITIVE": "rejected", "WEAKNESS": "weakness"}


def _count(decision: str) -> Column:
    return F.count_if(F.col("decision") == decision)


def _score(decision: str) -> Column:
    share = F.expr("weight * if(confidence > 0, confidence / 100, 0.5D)")
    return F.sum(F.when(F.col("decision") == decision, share).otherwise(F.lit(0.0)))


def _share(count: str) -> str:
    return f"cast(floor({count} / total_votes * 100) as int)"


def majority(
    votes: DataFrame,
    strict_majority: bool = False,
    min_confidence: int | None = None,
    unanimous_reject: bool = False,
) -> DataFrame:
    """One verdict per draft.

    From three votes on two suffice unless ``strict_majority``; abstentions do not count. The
    status tests needs_agentic first, so a draft may be ``verified`` and still need the agent.
    ``min_confidence`` and ``unanimous_reject`` are stored settings that are off by default.
    """
    if min_confidence is not None:
        votes = votes.where(F.col("confidence") >= min_confidence)
    need = "(total_votes + 1) div 2"
    if not strict_majority:
        need = f"if(total_votes >= 3, 2, {need})"
    counted = votes.groupBy("draft_id").agg(
        _count("REAL").alias("real_count"),
        _count("WEAKNESS").alias("weakness_count"),
        _count("FALSE_POSITIVE").alias("false_positive_count"),
        _count("NEEDS_VERIFIED").alias("needs_verified_count"),
        _count("ABSTAIN").alias("abstain_count"),
        _score("REAL").alias("real_score"),
        _score("WEAKNESS").alias("weakness_score"),
        _score("FALSE_POSITIVE").alias("false_positive_score"),
        _score("NEEDS_VERIFIED").alias("needs_verified_score"),
    )
    flagged = (
        counted.withColumn(
            "total_votes",
            F.expr("real_count + weakness_count + false_positive_count + needs_verified_count"),
        )
        .withColumn("_need", F.expr(need))
        .withColumn("verified", F.expr("total_votes > 0 and real_count >= _need"))
        .withColumn(
            "is_weakness",
            F.expr("total_votes > 0 and weakness_count >= _need and weakness_count > real_count"),
        )
        .withColumn(
            "needs_agentic", F.expr("total_votes > 0 and needs_verified_count >= _need")
        )
    )
    rejected = (
        "total_votes > 0 and (false_positive_count >= _need "
        "or not (verified or is_weakness or needs_agentic))"
    )
    if unanimous_reject:
        rejected = f"({rejected}) and false_positive_count = total_votes"
    return (
        flagged.withColumn("rejected", F.expr(rejected))
        .withColumn(
            "confidence",
            F.expr(
                f"""case when total_votes = 0 then 0
                         when verified then {_share('real_count')}
                         when is_weakness then {_share('weakness_count')}
                         when needs_agentic then {_share('needs_verified_count')}
                         when rejected then {_share('false_positive_count')}
                         else 0 end"""
            ),
        )
        .withColumn(
            "winning_decision",
            F.expr(
                """case when verified then 'REAL' when is_weakness then 'WEAKNESS'
                        when needs_agentic then 'NEEDS_VERIFIED' else 'FALSE_POSITIVE' end"""
            ),
        )
        .withColumn(
            "status",
            F.expr(
                """case when needs_agentic then 'needs_agentic' when verified then 'verified'
                        when is_weakness then 'weakness' else 'rejected' end"""
            ),
        )
        .drop("_need")
    )


def best_vote(votes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The most confident vote for each draft's winning decision; the lowest id wins ties."""
    ranked = votes.groupBy("draft_id", "decision").agg(
        F.max("confidence").alias("best_confidence"),
        F.min_by(
            F.struct("vote_id", "model_name"), F.struct(-F.col("confidence"), F.col("vote_id"))
        ).alias("best"),
    )
    winners = verdicts.select("draft_id", F.col("winning_decision").alias("decision"), "status")
    return winners.join(ranked, ["draft_id", "decision"]).select(
        "draft_id", "decision", "status", "best_confidence", "best.vote_id", "best.model_name"
    )


def vote_counts_by_decision(votes: DataFrame) -> DataFrame:
    """One row per draft with a count column per decision."""
    return (
        votes.groupBy("draft_id")
        .pivot("decision", DECISIONS)
        .count()
        .select("draft_id", *[F.coalesce(F.col(d), F.lit(0)).alias(d.lower()) for d in DECISIONS])
    )


def agreement(votes: DataFrame, drafts: DataFrame) -> DataFrame:
    """Share of all votes of a model, by scan, that match the final draft status."""
    lookup = F.create_map(*[F.lit(x) for pair in AGREES.items() for x in pair])
    joined = votes.select("scan_id", "draft_id", "model_name", "decision").join(
        drafts.select("draft_id", "status"), "draft_id", "left"
    )
    match = F.coalesce(lookup[F.col("decision")] == F.col("status"), F.lit(False))
    return joined.groupBy("scan_id", "model_name").agg(
        F.count(F.lit(1)).alias("total_votes"),
        F.count_if(match).alias("agreements"),
        (F.count_if(match) / F.count(F.lit(1))).alias("agreement_rate"),
    )


def consensus(votes: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Most frequent decision per draft (first seen on ties), mean confidence and vote count."""
    per_decision = votes.groupBy("draft_id", "decision").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("vote_id").alias("first_vote"),
        F.sum(F.coalesce("confidence", F.lit(0))).alias("confidence_sum"),
    )
    merged = per_decision.groupBy("draft_id").agg(
        F.sum("n").alias("num_votes"),
        F.min_by("decision", F.struct(-F.col("n"), F.col("first_vote"))).alias("consensus_vote"),
        (F.sum("confidence_sum") / F.sum("n") / 100).alias("avg_confidence"),
    )
    return merged.where(F.col("avg_confidence") >= min_confidence)


def consensus_votes(votes: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Every vote of the kept drafts beside the draft's consensus, one row a vote.

    The votes stay rows: a draft may hold too many of them for one array.
    """
    kept = consensus(votes, min_confidence)
    detail = votes.select("draft_id", "vote_id", "model_name", "decision", "confidence")
    return detail.join(kept, "draft_id")


def recheck_selection(verdicts: DataFrame, drafts: DataFrame, margin: float = 0.5) -> DataFrame:
    """Drafts that a second pass should look at: close scores, or a doubtful high-severity reject."""
    joined = verdicts.join(drafts.select("draft_id", "severity"), "draft_id")
    return (
        joined.withColumn(
            "is_close",
            F.round(F.abs(F.col("real_score") - F.col("false_positive_score")), 6) < margin,
        )
        .withColumn(
            "is_high_severity_reject",
            ~F.col("verified")
            & F.col("severity").isin("Critical", "High")
            & (F.col("confidence") < 80),
        )
        .withColumn("recheck", F.col("is_close") | F.col("is_high_severity_reject"))
    )


def apply_second_pass(selected: DataFrame, second: DataFrame, trust: int = 80) -> DataFrame:
    """Let a second-pass verdict (draft_id, agent_verified, agent_confidence) win from ``trust`` on."""
    joined = selected.join(second, "draft_id", "left")
    wins = F.col("recheck") & (F.col("agent_confidence") >= trust)
    return joined.withColumn(
        "final_verified",
        F.when(F.coalesce(wins, F.lit(False)), F.col("agent_verified")).otherwise(F.col("verified")),
    )
