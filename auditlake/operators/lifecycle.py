"""Status changes: retries, resets, retention, recovery, upserts, polling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Retry policy.
MAX_RETRIES = 3
BASE_DELAY = 2.0


def schedule_retry(chunks: DataFrame) -> DataFrame:
    """Count one more retry: pending with a doubled delay, failed after the third."""
    count = F.col("retry_count") + 1
    again = count <= MAX_RETRIES
    delay = F.when(again, F.lit(BASE_DELAY) * F.pow(F.lit(2.0), count))
    return chunks.select(
        *[c for c in chunks.columns if c not in ("retry_count", "status", "next_retry_at", "delay")],
        count.alias("retry_count"),
        delay.alias("delay"),
        F.when(again, F.col("created_at") + F.make_dt_interval(secs=delay)).alias("next_retry_at"),
        F.when(again, "pending").otherwise("failed").alias("status"),
    )


def rerun(scan_id: Column, chunks: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings of the scan go, its chunks are pending again."""
    mine = F.col("scan_id") == scan_id
    reset = chunks.withColumn("status", F.when(mine, "pending").otherwise(F.col("status"))).withColumn(
        "retry_count", F.when(mine, 0).otherwise(F.col("retry_count"))
    )
    return reset, findings.where(~mine)


def revalidate(
    scan_id: Column, drafts: DataFrame, votes: DataFrame, verified: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Votes and verdicts of the scan go, its drafts stay and are pending again."""
    mine = F.col("scan_id") == scan_id
    reset = drafts.withColumn("status", F.when(mine, "pending").otherwise(F.col("status")))
    return reset, votes.where(~mine), verified.where(~mine)


def retained(rows: DataFrame, as_of: Column, days: int, scan_id: int | None = None) -> DataFrame:
    """Rows that retention keeps: newer than ``days`` days, or of another scan."""
    old = F.col("created_at") < as_of - F.make_dt_interval(F.lit(days))
    if scan_id is not None:
        old = old & (F.col("scan_id") == scan_id)
    return rows.where(~old)


def recovered(chunks: DataFrame) -> DataFrame:
    """After a crash, what was in progress is pending."""
    back = F.col("status").isin("scanning", "verifying", "running")
    return chunks.withColumn("status", F.when(back, "pending").otherwise(F.col("status")))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` plus the rows of ``new`` whose key it lacks, one per key."""
    fresh = new.join(old.select(key).distinct(), key, "left_anti").dropDuplicates([key])
    return old.unionByName(fresh)


def due_watchers(watchers: DataFrame, as_of: Column) -> DataFrame:
    """Watchers never polled, or whose interval has passed."""
    waited = F.expr("timestampdiff(SECOND, last_check, _as_of)")
    return (
        watchers.withColumn("_as_of", as_of)
        .where(F.col("last_check").isNull() | (waited >= F.col("poll_interval")))
        .drop("_as_of")
    )


def unreviewed(changes: DataFrame, reviews: DataFrame) -> DataFrame:
    """Changes without a completed review."""
    done = reviews.where((F.col("status") == "completed") & F.col("reviewed_at").isNotNull())
    return changes.join(done.select("watcher_id", "iid"), ["watcher_id", "iid"], "left_anti")
