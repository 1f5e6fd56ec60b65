"""Vote aggregation, its quirks, and a plain restatement over random votes."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from auditlake.functions import scalars as S, text as X
from auditlake.operators import report as R, votes as V

SCHEMA = "vote_id string, draft_id bigint, model_name string, decision string, confidence int, weight double"


def votes_frame(spark, votes):
    rows = [(f"{i:06d}", d, f"m{i % 3}", dec, conf, 1.0) for i, (d, dec, conf) in enumerate(votes)]
    return spark.createDataFrame(rows, SCHEMA)


def restated(decisions):
    n = {d: decisions.count(d) for d in V.DECISIONS}
    total = len(decisions) - n["ABSTAIN"]
    if total == 0:
        return (False, False, False, 0, "rejected")
    need = 2 if total >= 3 else (total + 1) // 2
    real = n["REAL"] >= need
    weak = n["WEAKNESS"] >= need and n["WEAKNESS"] > n["REAL"]
    more = n["NEEDS_VERIFIED"] >= need
    winner = "REAL" if real else "WEAKNESS" if weak else "NEEDS_VERIFIED" if more else "FALSE_POSITIVE"
    status = "needs_agentic" if more else "verified" if real else "weakness" if weak else "rejected"
    return (real, weak, more, int(n[winner] / total * 100), status)


def test_majority_matches_restatement(spark):
    rng = random.Random(7)
    drafts = {d: [rng.choice(V.DECISIONS) for _ in range(rng.randint(1, 7))] for d in range(300)}
    votes = [(d, dec, rng.randint(0, 100)) for d, decs in drafts.items() for dec in decs]
    got = {
        r.draft_id: (r.verified, r.is_weakness, r.needs_agentic, r.confidence, r.status)
        for r in V.majority(votes_frame(spark, votes)).collect()
    }
    assert got == {d: restated(decs) for d, decs in drafts.items()}


def verdict(spark, *decisions, **options):
    return V.majority(votes_frame(spark, [(1, d, 50) for d in decisions]), **options).first()


def test_split_of_one_is_real(spark):
    assert verdict(spark, "REAL", "FALSE_POSITIVE").status == "verified"


def test_needs_agentic_goes_before_verified(spark):
    row = verdict(spark, "REAL", "REAL", "NEEDS_VERIFIED", "NEEDS_VERIFIED")
    assert row.verified and row.status == "needs_agentic"


def test_two_votes_suffice_unless_strict(spark):
    decisions = ["REAL", "REAL", "FALSE_POSITIVE", "FALSE_POSITIVE", "FALSE_POSITIVE"]
    assert verdict(spark, *decisions).verified
    assert not verdict(spark, *decisions, strict_majority=True).verified


def test_best_vote_prefers_confidence_then_first(spark):
    votes = votes_frame(spark, [(1, "REAL", 80), (1, "REAL", 90), (1, "REAL", 90), (1, "WEAKNESS", 99)])
    row = V.best_vote(votes, V.majority(votes)).first()
    assert (row.vote_id, row.best_confidence) == ("000001", 90)


def test_consensus_counts_drafts_without_votes(spark):
    votes = votes_frame(spark, [(1, "REAL", 1), (1, "REAL", 2)]).withColumn("scan_id", F.lit(1))
    drafts = spark.createDataFrame([(1, 1), (1, 2)], "scan_id bigint, draft_id bigint")
    assert R.vote_metrics(votes, drafts).first().consensus_rate == 0.5


def test_severity_and_cvss(spark):
    cases = [
        ("**High**", "High"), ("HIGH", "High"), ("high (due to x)", "High"), ("CRIT", "Critical"), ("", "Medium"),
        (None, "Medium"), ("odd", "Medium"), ("Medium-High", "High"), ("Informational", "Low"),
    ]
    df = spark.createDataFrame(cases, "v string, want string")
    assert not df.where(S.normalize_severity("v") != F.col("want")).count()
    cvss = [("9.8 (Critical)", 9.8), ("CVSS:3.1/AV:N", 3.1), ("11", None), ("", None), ("7", 7.0), ("n/a", None)]
    df = spark.createDataFrame(cvss, "v string, want double")
    assert df.where(S.parse_cvss("v").eqNullSafe(F.col("want"))).count() == len(cvss)


def test_missing_confidence_is_fifty(spark):
    df = spark.createDataFrame([("none",), ("150 %",), (None,)], "v string")
    assert [r[0] for r in df.select(X.clamp_confidence("v")).collect()] == [50, 100, 50]


def test_percent_text_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, 16), (3, 16), (2, 3), (0, 5), (5, 5)], "n bigint, d bigint")
    assert [r[0] for r in df.select(R.percent_text("n", "d")).collect()] == [
        f"{n / d:.1%}" for n, d in [(1, 16), (3, 16), (2, 3), (0, 5), (5, 5)]
    ]
