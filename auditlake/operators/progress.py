"""Counts over scans, chunks, call logs and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import scalars as S
from auditlake.functions.text import malicious_categories
from auditlake.operators.scale import first_n

# Severities of the progress view.
PROGRESS_SEVERITIES = ["Critical", "High", "Medium", "Low", "Weakness"]


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Files, chunks and token statistics per scan; tokens are a fourth of the characters."""
    tokens = F.expr("length(content) div 4")
    return chunks.groupBy("scan_id").agg(
        F.count_distinct("file_id").alias("files_scanned"),
        F.count(F.lit(1)).alias("total_chunks"),
        F.avg(tokens).alias("avg_tokens"),
        F.min(tokens).alias("min_tokens"),
        F.max(tokens).alias("max_tokens"),
    )


def chunk_counts(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks by status per scan, the scan taken from the file."""
    owned = chunks.select("file_id", "status", "retry_count").join(
        files.select("file_id", "scan_id"), "file_id"
    )
    status = F.col("status")
    return owned.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("chunks_total"),
        F.count_if(status == "scanned").alias("chunks_scanned"),
        F.count_if(status == "failed").alias("chunks_failed"),
        F.count_if((status == "pending") & (F.col("retry_count") > 0)).alias("chunks_retrying"),
    )


def scan_progress(
    chunks: DataFrame, files: DataFrame, drafts: DataFrame, findings: DataFrame, errors: DataFrame
) -> DataFrame:
    """Chunk, draft, finding and error counts per scan, with error counts by class."""
    status = F.col("status")
    draft_counts = drafts.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("drafts_total"),
        F.count_if(status == "verified").alias("drafts_verified"),
        F.count_if(status == "rejected").alias("drafts_rejected"),
        F.count_if(status == "pending").alias("drafts_pending"),
    )
    finding_counts = findings.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("findings_total"),
        *[
            F.count_if(F.col("severity") == s).alias(f"findings_{s.lower()}")
            for s in PROGRESS_SEVERITIES
        ],
    )
    classes = [*(name for name, _ in S.ERROR_CLASSES), "unknown"]
    kind = S.classify_error("error_message")
    error_counts = errors.withColumn("kind", kind).groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("errors_total"),
        *[F.count_if(F.col("kind") == c).alias(f"errors_{c}") for c in classes],
    )
    joined = chunk_counts(chunks, files)
    for other in (draft_counts, finding_counts, error_counts):
        joined = joined.join(other, "scan_id", "full")
    counts = [c for c in joined.columns if c != "scan_id"]
    return joined.na.fill(0, counts).withColumn(
        "percent",
        F.when(
            F.col("chunks_total") > 0, F.col("chunks_scanned") / F.col("chunks_total") * 100
        ).otherwise(F.lit(0.0)),
    )


def log_stats(log: DataFrame) -> DataFrame:
    """Log and failure counts overall, by phase and by model in one grouping-sets pass."""
    return log.groupingSets([[], ["phase"], ["model_name"]], "phase", "model_name").agg(
        F.when(F.grouping("phase") == 0, F.lit("phase"))
        .when(F.grouping("model_name") == 0, F.lit("model"))
        .otherwise(F.lit("all"))
        .alias("level"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("parse_success")).alias("failed"),
        ((F.count(F.lit(1)) - F.count_if(~F.col("parse_success"))) / F.count(F.lit(1)) * 100).alias(
            "success_rate"
        ),
    )


def recent_scans(log: DataFrame, n: int = 20) -> DataFrame:
    """The scans with the newest log entries."""
    return (
        log.where("scan_id is not null")
        .groupBy("scan_id")
        .agg(F.count(F.lit(1)).alias("log_count"), F.max("created_at").alias("last_at"))
        .orderBy(F.desc("last_at"), "scan_id")
        .limit(n)
        .select("scan_id", "log_count")
    )


def queue_state(log: DataFrame, models: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    """Queued, running and recently finished requests per known model, also for idle models."""
    recent = F.col("created_at") >= as_of - F.expr(f"interval {minutes} minutes")
    status = F.col("status")
    counts = log.groupBy("model_name").agg(
        F.count_if(status == "pending").alias("queued"),
        F.count_if(status == "running").alias("running"),
        F.count_if((status == "completed") & recent).alias("recent_completed"),
        F.count_if((status == "failed") & recent).alias("recent_failed"),
    )
    return models.select("model_name").join(counts, "model_name", "left").na.fill(0)


def phase_usage(log: DataFrame) -> DataFrame:
    return log.groupBy("phase", "model_name").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("duration_ms").alias("time_ms"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
    )


def call_estimates(
    chunks: DataFrame, drafts: DataFrame, verified: DataFrame, analyzers: int, verifiers: int,
    multi_model: bool = True,
) -> DataFrame:
    """Expected model calls per scan and phase."""
    count = lambda df, name: df.groupBy("scan_id").agg(F.count(F.lit(1)).alias(name))
    joined = (
        count(chunks, "chunks")
        .join(count(drafts, "drafts"), "scan_id", "full")
        .join(count(verified, "verified"), "scan_id", "full")
        .na.fill(0)
    )
    return joined.select(
        "scan_id",
        (F.col("chunks") * (analyzers if multi_model else 1)).alias("scanner_calls"),
        (F.col("drafts") * verifiers).alias("verifier_calls"),
        F.col("verified").alias("enricher_calls"),
    ).withColumn("total_calls", F.expr("scanner_calls + verifier_calls + enricher_calls"))


def breakdown(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy("scan_id", column).agg(F.count(F.lit(1)).alias("n"))


def counts_for_phase(log: DataFrame, phase: str) -> DataFrame:
    return (
        log.where(F.col("phase") == phase).groupBy("model_name").agg(F.count(F.lit(1)).alias("n"))
    )


def run_progress(results: DataFrame, expected: int) -> DataFrame:
    """Done, successful and correct results per model against the expected number."""
    return results.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("done"),
        (F.count(F.lit(1)) / expected * 100).alias("percent"),
        F.count_if("parse_success").alias("successful"),
        F.count_if(F.col("correct")).alias("correct"),
        F.expr("coalesce(count_if(correct) / nullif(count_if(parse_success), 0) * 100, 0D)").alias("accuracy"),
    )


def nested_profiles(profiles: DataFrame, analyzers: DataFrame, models: DataFrame) -> DataFrame:
    """One row per profile with its analyzers and their model names, in order."""
    named = analyzers.join(models, "model_id", "left")
    nested = named.groupBy("profile_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("run_order", "analyzer", "model_name"))),
            lambda e: F.concat_ws(":", e["run_order"], e["analyzer"], F.coalesce(e["model_name"], F.lit("-"))),
        ).alias("analyzers")
    )
    return profiles.join(nested, "profile_id", "left").withColumn(
        "analyzers", F.coalesce("analyzers", F.array().cast("array<string>"))
    )


def scan_completion(findings: DataFrame) -> DataFrame:
    """Counts per scan for the completion message, with findings of malicious intent."""
    hit = F.size(malicious_categories("title", "description")) > 0
    severity = F.upper("severity")
    return findings.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(severity == s.upper()).alias(s.lower()) for s in ("Critical", "High", "Medium", "Low")],
        F.count_if(hit).alias("malicious"),
    )


def triage(findings: DataFrame, n: int = 5) -> DataFrame:
    """Per scan: severity text and the first ``n`` critical-priority findings with their scores."""
    counts = findings.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("Critical", "High", "Medium", "Low")],
    )
    parts = F.array_compact(
        F.array(
            *[
                F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}")))
                for s in ("Critical", "High", "Medium", "Low")
            ]
        )
    )
    text = F.concat(F.col("total"), F.lit(" findings analyzed: "), F.array_join(parts, ", "), F.lit("."))
    urgent = first_n(
        findings.where(F.col("severity").isin("Critical", "High") & (F.col("confidence") >= 80)),
        ["scan_id"], ["finding_id"], n,
    )
    score = F.when(F.col("severity") == "Critical", F.lit("9.0")).otherwise(F.lit("7.5"))
    listed = urgent.groupBy("scan_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rn", "finding_id", score.alias("cvss")))),
            lambda e: F.concat_ws(":", e["finding_id"], e["cvss"]),
        ).alias("critical_priority")
    )
    return (
        counts.select("scan_id", text.alias("summary"))
        .join(listed, "scan_id", "left")
        .withColumn("critical_priority", F.coalesce("critical_priority", F.array().cast("array<string>")))
    )
