"""Scan quality reports: every metric for all scans in one plan, joined on scan_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import scalars as S
from auditlake.operators import votes as V

# Weights of the quality score, the entropy that counts as fully diverse, grades.
SCORE_WEIGHTS = {"precision": 50, "consensus": 20, "diversity": 15, "severity": 15}
FULL_DIVERSITY = 2.5
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D")]

# Prices in USD per million tokens; models without one cost the default.
DEFAULT_PRICE = {"input": 0.50, "output": 0.50}
PUBLIC_PRICE = {"input": 2.50, "output": 10.00}


def ratio(n: Column | str, d: Column | str) -> Column:
    """n / d, 0 on an empty denominator."""
    n, d = S.col(n), S.col(d)
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def percent_text(n: Column | str, d: Column | str) -> Column:
    """n / d as a percentage with one decimal, rounded half to even in integers."""
    thousand, d = S.col(n) * 1000, S.col(d)
    whole = F.floor(thousand / d)
    rest = 2 * (thousand - whole * d)
    up = (rest > d) | ((rest == d) & (whole % 2 == 1))
    tenths = whole + up.cast("int")
    return F.when(
        d > 0, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))
    ).otherwise(F.lit("0.0%"))


def grade_of(score: Column | str) -> Column:
    out = F.when(F.lit(False), F.lit("F"))
    for floor, grade in GRADES:
        out = out.when(S.col(score) >= floor, F.lit(grade))
    return out.otherwise(F.lit("F"))


def draft_metrics(drafts: DataFrame) -> DataFrame:
    status = F.col("status")
    return (
        drafts.groupBy("scan_id")
        .agg(
            F.count(F.lit(1)).alias("total_drafts"),
            F.count_if(status == "verified").alias("drafts_verified"),
            F.count_if(status == "rejected").alias("drafts_rejected"),
            F.count_if(status == "weakness").alias("drafts_weakness"),
        )
        .withColumn("draft_precision", ratio("drafts_verified", "total_drafts"))
    )


def vote_metrics(votes: DataFrame, drafts: DataFrame) -> DataFrame:
    """Vote count, mean confidence and consensus: drafts with one distinct decision over all drafts."""
    totals = votes.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("total_votes"), F.avg("confidence").alias("avg_confidence")
    )
    per_draft = votes.groupBy("draft_id").agg(
        (F.min("decision") == F.max("decision")).alias("agreed")
    )
    rates = (
        drafts.select("scan_id", "draft_id")
        .join(per_draft, "draft_id", "left")
        .groupBy("scan_id")
        .agg((F.count_if("agreed") / F.count(F.lit(1))).alias("consensus_rate"))
    )
    return rates.join(totals, "scan_id", "full").select(
        "scan_id",
        F.coalesce("total_votes", F.lit(0)).alias("total_votes"),
        F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"),
        F.coalesce("consensus_rate", F.lit(0.0)).alias("consensus_rate"),
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    upper = F.upper("severity")
    return findings.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("total_findings"),
        *[F.count_if(upper == s.upper()).alias(s) for s in ("critical", "high", "medium", "low")],
    )


def cwe_counts(drafts: DataFrame, keys: list[str]) -> DataFrame:
    """Drafts per CWE number below ``keys``, with the first draft that named it."""
    return (
        drafts.withColumn("cwe", S.cwe_id("vulnerability_type"))
        .where(F.col("cwe").isNotNull())
        .groupBy(*keys, "cwe")
        .agg(F.count(F.lit(1)).alias("n"), F.min("draft_id").alias("first_id"))
    )


def cwe_metrics(drafts: DataFrame) -> DataFrame:
    """Distribution, top CWE (first seen on ties) and Shannon entropy in bits per scan."""
    counts = cwe_counts(drafts, ["scan_id"])
    totals = drafts.withColumn("cwe", S.cwe_id("vulnerability_type")).groupBy("scan_id").agg(
        F.count("cwe").alias("cwe_total")
    )
    p = F.col("n") / F.col("cwe_total")
    return (
        totals.join(counts, "scan_id", "left")
        .groupBy("scan_id")
        .agg(
            F.max("cwe_total").alias("cwe_total"),
            F.max("n").alias("top_cwe_count"),
            F.min_by("cwe", F.struct(-F.col("n"), F.col("first_id"))).alias("top_cwe"),
            F.coalesce(-F.sum(p * F.log2(p)), F.lit(0.0)).alias("diversity_score"),
            F.map_from_entries(
                F.filter(
                    F.array_sort(F.collect_list(F.struct("cwe", "n"))), lambda e: e["cwe"].isNotNull()
                )
            ).alias("distribution"),
        )
    )


def throughput(log: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings per minute of call time, and whole tokens per finding."""
    time = log.groupBy("scan_id").agg(
        F.sum("duration_ms").alias("total_time_ms"),
        (F.sum("tokens_in") + F.sum("tokens_out")).alias("total_tokens"),
    )
    found = findings.groupBy("scan_id").agg(F.count(F.lit(1)).alias("findings_count"))
    return (
        time.join(found, "scan_id", "left")
        .withColumn("findings_count", F.coalesce("findings_count", F.lit(0)))
        .withColumn(
            "findings_per_minute",
            F.expr("coalesce(findings_count / nullif(total_time_ms / 1000 / 60, 0), 0D)"),
        )
        .withColumn(
            "avg_tokens_per_finding",
            F.expr("coalesce(total_tokens div nullif(findings_count, 0), 0)"),
        )
    )


def scanner_breakdown(drafts: DataFrame) -> DataFrame:
    """Counts, precision and top-3 CWEs per scan and analyzer; drafts without analyzer drop out."""
    named = drafts.where(F.col("analyzer_name").isNotNull() & (F.col("analyzer_name") != ""))
    keys = ["scan_id", "analyzer_name"]
    status = F.col("status")
    counts = named.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("drafts_found"),
        F.count_if(status == "verified").alias("verified"),
        F.count_if(status == "rejected").alias("rejected"),
        F.count_if(status == "weakness").alias("weakness"),
    )
    tops = top_cwes(named).groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rn", "cwe", "n"))),
            lambda e: F.concat_ws(":", e["cwe"], e["n"]),
        ).alias("top_cwes")
    )
    return counts.join(tops, keys, "left").withColumn(
        "precision", ratio("verified", "drafts_found")
    )


def top_cwes(drafts: DataFrame, n: int = 3) -> DataFrame:
    """The most common CWEs per scan and analyzer, first seen on ties."""
    keys = ["scan_id", "analyzer_name"]
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "first_id")
    return (
        cwe_counts(drafts.where(F.col("analyzer_name").isNotNull()), keys)
        .withColumn("rn", F.row_number().over(order))
        .where(F.col("rn") <= n)
    )


def verifier_breakdown(votes: DataFrame, drafts: DataFrame) -> DataFrame:
    """Per scan and verifier: decision counts, mean confidence, agreement with the final status."""
    counts = votes.groupBy("scan_id", "model_name").agg(
        *[F.count_if(F.col("decision") == d).alias(d.lower()) for d in V.DECISIONS],
        F.avg("confidence").alias("avg_confidence"),
    )
    return counts.join(V.agreement(votes, drafts), ["scan_id", "model_name"])


def bias_flags(breakdown: DataFrame) -> DataFrame:
    """Flags for verifiers that nearly always vote one way or abstain; shares round to one decimal."""
    tenths = lambda c: F.bround(F.col(c) / F.col("total_votes") * 100, 1)
    flags = F.array_compact(
        F.array(
            F.when(tenths("real") == 100, F.lit("always_verifies")).when(
                tenths("real") >= 95, F.lit("heavily_biased_verify")
            ),
            F.when(tenths("false_positive") == 100, F.lit("always_rejects")).when(
                tenths("false_positive") >= 95, F.lit("heavily_biased_reject")
            ),
            F.when(
                (tenths("needs_verified") >= 50) | (tenths("abstain") >= 50),
                F.lit("excessive_abstention"),
            ),
        )
    )
    return breakdown.withColumn("flags", flags)


def enricher_contribution(findings: DataFrame) -> DataFrame:
    return findings.groupBy("scan_id", "source_model").agg(
        F.count(F.lit(1)).alias("findings_enriched")
    )


def scan_metrics(drafts: DataFrame, votes: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per scan with drafts: metrics, quality score and grade."""
    joined = (
        draft_metrics(drafts)
        .join(vote_metrics(votes, drafts), "scan_id", "left")
        .join(severity_counts(findings), "scan_id", "left")
        .join(cwe_metrics(drafts), "scan_id", "left")
        .na.fill(0, ["total_findings", "critical", "high", "medium", "low"])
    )
    w = SCORE_WEIGHTS
    score = (
        F.col("draft_precision") * w["precision"]
        + F.col("consensus_rate") * w["consensus"]
        + F.least(F.col("diversity_score") / FULL_DIVERSITY, F.lit(1.0)) * w["diversity"]
        + ratio(F.col("critical") + F.col("high"), "total_findings") * w["severity"]
    )
    return joined.withColumn("score", F.round(score, 6)).withColumn("grade", grade_of("score"))


def _issue(kind: str, severity: str, message: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), message.alias("message"))


def quality_issues(metrics: DataFrame, verifiers: DataFrame) -> DataFrame:
    """Issue rows per scan from its metrics and from the flags of its verifiers."""
    low_precision = F.concat(
        F.lit("Low draft precision ("),
        percent_text("drafts_verified", "total_drafts"),
        F.lit("). Over half of initial findings are false positives."),
    )
    spam = F.concat(
        F.lit("Potential CWE spam: "),
        F.col("top_cwe"),
        F.lit(" represents "),
        percent_text("top_cwe_count", "cwe_total"),
        F.lit(" of all findings."),
    )
    own = metrics.select(
        "scan_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("draft_precision") < 0.5, _issue("low_precision", "high", low_precision)),
                    F.when(
                        F.col("top_cwe_count") / F.col("cwe_total") > 0.6,
                        _issue("cwe_spam", "medium", spam),
                    ),
                    F.when(
                        F.col("consensus_rate") < 0.5,
                        _issue(
                            "low_consensus",
                            "medium",
                            F.lit(
                                "Low verification consensus. Verifiers frequently disagree, "
                                "indicating unclear findings."
                            ),
                        ),
                    ),
                    F.when(
                        F.col("diversity_score") < 1.0,
                        _issue(
                            "low_diversity",
                            "low",
                            F.lit(
                                "Low CWE diversity. Model may be biased toward certain vulnerability types."
                            ),
                        ),
                    ),
                )
            )
        ).alias("issue"),
    )
    has = lambda flag: F.array_contains("flags", flag)
    text = lambda *parts: F.concat(F.lit("Model "), F.col("model_name"), *parts)
    real, fp = percent_text("real", "total_votes"), percent_text("false_positive", "total_votes")
    abstain = F.when(
        F.col("needs_verified") > 0, percent_text("needs_verified", "total_votes")
    ).otherwise(percent_text("abstain", "total_votes"))
    broken = " 100% of the time - likely broken or misconfigured."
    biased = (
        F.when(has("always_verifies"), _issue("biased_verifier", "high", text(F.lit(" voted REAL" + broken))))
        .when(
            has("always_rejects"),
            _issue("biased_verifier", "high", text(F.lit(" voted FALSE_POSITIVE" + broken))),
        )
        .when(
            has("heavily_biased_verify"),
            _issue(
                "biased_verifier",
                "medium",
                text(F.lit(" heavily biased toward REAL ("), real, F.lit(") - check configuration.")),
            ),
        )
        .when(
            has("heavily_biased_reject"),
            _issue(
                "biased_verifier",
                "medium",
                text(
                    F.lit(" heavily biased toward FALSE_POSITIVE ("), fp, F.lit(") - check configuration.")
                ),
            ),
        )
    )
    idle = F.when(
        has("excessive_abstention"),
        _issue(
            "excessive_abstention",
            "medium",
            text(F.lit(" abstains "), abstain, F.lit(" of the time - may need better prompting.")),
        ),
    )
    theirs = verifiers.select(
        "scan_id", F.explode(F.array_compact(F.array(biased, idle))).alias("issue")
    )
    return own.unionByName(theirs).select("scan_id", "issue.*")


def scan_reports(
    drafts: DataFrame, votes: DataFrame, findings: DataFrame
) -> DataFrame:
    """Full report row per scan: metrics, grade, issue types, false-positive rate, summary text."""
    metrics = scan_metrics(drafts, votes, findings)
    flagged = bias_flags(verifier_breakdown(votes, drafts))
    issues = (
        quality_issues(metrics, flagged)
        .groupBy("scan_id", "type")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("scan_id")
        .agg(
            F.sum("n").alias("issue_count"),
            F.array_sort(F.collect_list(F.struct("type", "n"))).alias("issue_types"),
        )
    )
    joined = metrics.join(issues, "scan_id", "left").withColumn(
        "issue_count", F.coalesce("issue_count", F.lit(0))
    )
    names = F.array_join(F.transform("issue_types", lambda e: e["type"]), ", ")
    tail = F.when(
        F.col("issue_count") > 0,
        F.concat(
            F.lit("Detected "), F.col("issue_count"), F.lit(" quality issue(s): "), names
        ),
    ).otherwise(F.lit("No major quality issues detected."))
    summary = F.concat(
        F.lit("Scan Quality Grade: "), F.col("grade"),
        F.lit(" Found "), F.col("total_findings"), F.lit(" vulnerabilities ("),
        F.col("critical"), F.lit(" critical, "), F.col("high"), F.lit(" high). Draft precision: "),
        percent_text("drafts_verified", "total_drafts"),
        F.lit(" ("), F.col("drafts_verified"), F.lit(" verified out of "), F.col("total_drafts"),
        F.lit(" initial findings). "), tail,
    )
    return joined.withColumn("false_positive_rate", ratio("drafts_rejected", "total_drafts")).withColumn(
        "summary", summary
    )


def compare_scans(reports: DataFrame) -> DataFrame:
    """Totals over reports, with the mean score and its grade."""
    return reports.agg(
        F.count(F.lit(1)).alias("scans"),
        F.sum("total_drafts").alias("total_drafts"),
        F.sum("total_findings").alias("total_findings"),
        F.round(F.avg("score"), 6).alias("avg_score"),
    ).withColumn("overall_grade", grade_of("avg_score"))


def priced_usage(log: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens by scan, model and phase beside the price of the model or the default price."""
    usage = log.groupBy("scan_id", "model_name", "phase").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
    )
    return (
        usage.join(prices, "model_name", "left")
        .withColumn("price_in", F.coalesce("price_in", F.lit(DEFAULT_PRICE["input"])))
        .withColumn("price_out", F.coalesce("price_out", F.lit(DEFAULT_PRICE["output"])))
        .withColumn(
            "cost",
            (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out"))
            / 1_000_000,
        )
    )


def cost_by_model(priced: DataFrame) -> DataFrame:
    """Cost per scan and model, with a map of its phases."""
    return priced.groupBy("scan_id", "model_name").agg(
        F.round(F.sum("cost"), 4).alias("total"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.map_from_entries(
            F.collect_list(F.struct("phase", F.struct("tokens_in", "tokens_out", F.round("cost", 4).alias("cost_usd"))))
        ).alias("phases"),
    )


def cost_metrics(priced: DataFrame, findings: DataFrame) -> DataFrame:
    """Cost per scan, the same tokens at a public price, savings, and cost per finding."""
    found = findings.groupBy("scan_id").agg(F.count(F.lit(1)).alias("findings_count"))
    public = (
        F.col("total_tokens_in") * PUBLIC_PRICE["input"] + F.col("total_tokens_out") * PUBLIC_PRICE["output"]
    ) / 1_000_000
    return (
        priced.groupBy("scan_id")
        .agg(
            F.sum("cost").alias("self_hosted"),
            F.sum("tokens_in").alias("total_tokens_in"),
            F.sum("tokens_out").alias("total_tokens_out"),
        )
        .join(found, "scan_id", "left")
        .withColumn("public", public)
        .select(
            "scan_id",
            F.round("self_hosted", 4).alias("total_cost_usd_self_hosted"),
            F.round("public", 4).alias("total_cost_usd_public_api"),
            F.round(F.col("public") - F.col("self_hosted"), 4).alias("cost_savings"),
            F.round(F.col("self_hosted") / F.coalesce("findings_count", F.lit(1)), 4).alias("cost_per_finding"),
            "total_tokens_in",
            "total_tokens_out",
        )
    )


def model_performance(merged: DataFrame) -> DataFrame:
    """Counts and verified/total precision by member of source_models."""
    status = F.col("status")
    return (
        merged.select("status", F.explode("source_models").alias("model"))
        .groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("total_drafts"),
            F.count_if(status == "verified").alias("verified"),
            F.count_if(status == "rejected").alias("rejected"),
            F.count_if(status == "weakness").alias("weakness"),
        )
        .withColumn("draft_precision", ratio("verified", "total_drafts"))
    )


def leaderboard(merged: DataFrame, log: DataFrame) -> DataFrame:
    """Detection counts, verified/(verified+rejected) precision and call totals per model, best first."""
    status = F.col("status")
    stats = (
        merged.select("status", F.size("source_models").alias("k"), F.explode("source_models").alias("model"))
        .groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("detected"),
            F.count_if(status == "verified").alias("verified"),
            F.count_if(status == "rejected").alias("rejected"),
            F.count_if(~status.isin("verified", "rejected")).alias("pending"),
            F.count_if(F.col("k") == 1).alias("unique_finds"),
        )
        .withColumn("precision", ratio(F.col("verified") * 100, F.col("verified") + F.col("rejected")))
    )
    timing = log.groupBy(F.col("model_name").alias("model")).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("duration_ms").alias("time_ms"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
    )
    return stats.join(timing, "model", "left").orderBy(F.desc("precision"), F.desc("verified"), "model")


def scan_overlap(findings: DataFrame) -> DataFrame:
    """Per pair of scans: findings equal on (file, line, type) over findings of either scan.

    Keys are first grouped by the set of scans that hold them, so a pair is formed once per
    distinct set and not once per finding.
    """
    keys = ["file_id", "line_number", "vulnerability_type"]
    distinct = findings.select("scan_id", *keys).distinct()
    sizes = distinct.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))
    sets = (
        distinct.groupBy(*keys)
        .agg(F.array_sort(F.collect_set("scan_id")).alias("scans"))
        .where(F.size("scans") > 1)
        .groupBy("scans")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    pairs = (
        sets.select("n", "scans", F.posexplode("scans").alias("i", "scan_a"))
        .select("n", "scan_a", F.explode(F.slice("scans", F.col("i") + 2, F.size("scans"))).alias("scan_b"))
        .groupBy("scan_a", "scan_b")
        .agg(F.sum("n").alias("common"))
    )
    a = sizes.select(F.col("scan_id").alias("scan_a"), F.col("n").alias("n_a"))
    b = sizes.select(F.col("scan_id").alias("scan_b"), F.col("n").alias("n_b"))
    return (
        pairs.join(a, "scan_a")
        .join(b, "scan_b")
        .select(
            "scan_a",
            "scan_b",
            "common",
            (F.col("n_a") + F.col("n_b") - F.col("common")).alias("either"),
            (F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("agreement"),
        )
    )


def common_files(findings: DataFrame) -> DataFrame:
    """Number of scans that hold findings in each file, for files in more than one scan."""
    return (
        findings.select("scan_id", "file_id")
        .distinct()
        .groupBy("file_id")
        .agg(F.count(F.lit(1)).alias("scans"))
        .where("scans > 1")
    )
