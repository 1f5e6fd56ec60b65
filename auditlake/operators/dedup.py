"""Merging of repeated drafts and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import scalars as S


def merge_drafts(drafts: DataFrame) -> DataFrame:
    """One draft per (scan, dedup key): lowest id stays, votes add up, models unite.

    One shuffle: copies are combined before it, and a key repeated a billion times still carries
    one draft, two sums and a set no larger than the number of models.
    """
    return (
        drafts.groupBy("scan_id", "file_id", "line_number", "vulnerability_type")
        .agg(
            F.min(F.struct("raw_id", "severity", "status")).alias("first"),
            F.sum(F.coalesce("votes", F.lit(1))).alias("initial_votes"),
            F.count(F.lit(1)).alias("copies"),
            F.array_sort(F.collect_set("model")).alias("source_models"),
        )
        .withColumn("dedup_key", S.dedup_key("file_id", "line_number", "vulnerability_type"))
        .select("scan_id", "dedup_key", "first.*", "initial_votes", "copies", "source_models")
    )


def merge_model_findings(findings: DataFrame) -> DataFrame:
    """Votes, models and the most common severity per (file, line:type) signature.

    Severity ties go to the more severe one.
    """
    signed = findings.withColumn("signature", S.finding_signature("line_number", "vulnerability_type"))
    rank = S.severity_rank(F.col("severity"))
    per_severity = signed.groupBy("file_id", "signature", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("model").alias("models")
    )
    return per_severity.groupBy("file_id", "signature").agg(
        F.sum("n").alias("votes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("models")))).alias("models"),
        F.max_by("severity", F.struct(F.col("n"), rank)).alias("severity"),
    )


def first_per_signature(findings: DataFrame) -> DataFrame:
    """Keep the first finding per file:line:type, in id order."""
    return (
        findings.groupBy("file_id", "line_number", "vulnerability_type")
        .agg(F.min_by(F.struct("raw_id", "scan_id", "severity", "model"), "raw_id").alias("first"))
        .select("file_id", "line_number", "vulnerability_type", "first.*")
    )
