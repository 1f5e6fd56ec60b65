"""Texts and status of change reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import scalars as S
from auditlake.operators.scale import first_n

# Comment labels by severity.
SEVERITY_LABELS = {
    "CRITICAL": ":rotating_light:",
    "HIGH": ":warning:",
    "MEDIUM": ":yellow_circle:",
    "LOW": ":information_source:",
}
LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def inline_comment() -> Column:
    """Comment text of one finding."""
    severity = F.coalesce("severity", F.lit("MEDIUM"))
    return F.concat(
        S.lookup(SEVERITY_LABELS, severity, ":yellow_circle:"),
        F.lit(" **Security Issue: "), F.coalesce("title", F.lit("Potential Vulnerability")),
        F.lit("**\n\n**Severity:** "), severity,
        F.lit("\n\n"), F.coalesce("description", F.lit("No description provided.")),
        F.lit("\n\n**Recommendation:** "),
        F.coalesce("recommendation", F.lit("Review this code for security implications.")),
    )


def review_summary(findings: DataFrame, n: int = 10) -> DataFrame:
    """Per change: severity counts, the first ``n`` findings as lines, approval status."""
    upper = F.upper(F.coalesce("severity", F.lit("MEDIUM")))
    counts = findings.groupBy("change_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(upper == level).alias(level.lower()) for level in LEVELS],
    )
    line = F.concat(
        F.lit("- ["), F.col("severity"), F.lit("] "), F.col("title"), F.lit(": "), F.col("file_path"),
        F.lit(" line "), F.col("line_number"),
    )
    listed = (
        first_n(findings, ["change_id"], [F.col("finding_id")], n)
        .groupBy("change_id")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("rn", line.alias("t")))), lambda e: e["t"]), "\n"
            ).alias("lines")
        )
    )
    approval = F.when(F.col("critical") + F.col("high") > 0, "changes_requested").when(
        F.col("total") > 0, "pending"
    ).otherwise("approved")
    more = F.when(
        F.col("total") > n, F.concat(F.lit("\n... and "), F.col("total") - n, F.lit(" more findings"))
    ).otherwise(F.lit(""))
    return counts.join(listed, "change_id").select(
        "change_id", "total", *[level.lower() for level in LEVELS],
        F.concat("lines", more).alias("summary"), approval.alias("approval"),
    )
