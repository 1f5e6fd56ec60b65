"""Ranks, streaks, orders and bounded lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import scalars as S
from auditlake.operators.scale import RANGE, exact_row_number, first_n, ordered_ranges

PAUSE_AFTER = 5  # fixed value: consecutive errors that pause a scan


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` columns per key, as an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def error_streaks(
    log: DataFrame, keys: list[str], order: list[str], failed: Column, before: DataFrame | None = None
) -> DataFrame:
    """Every row with its streak of consecutive errors, 0 on success.

    ``before`` (keys, tail) holds the streaks that were open when these rows began.

    A model may own a third of all rows: rows are spread over sampled ranges of (keys, order); each
    range counts for itself, and the errors that earlier ranges carry over are added. What a range
    carries is its trailing errors, plus those before it when it had no success.
    """
    ranged = ordered_ranges(log.withColumn("_failed", failed), keys, order)
    local = Window.partitionBy(*keys, RANGE).orderBy(*order)
    resets = F.sum((~F.col("_failed")).cast("bigint")).over(local)
    island = Window.partitionBy(*keys, RANGE, "_resets").orderBy(*order)
    counted = ranged.withColumn("_resets", resets).withColumn(
        "_local", F.sum(F.col("_failed").cast("bigint")).over(island)
    )
    last = F.struct(*order)
    summary = counted.groupBy(*keys, RANGE).agg(
        F.max("_resets").alias("_n_resets"), F.max_by("_local", last).alias("_tail")
    )
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    block = Window.partitionBy(*keys, "_block").orderBy(RANGE)
    carried = (
        summary.withColumn(
            "_block",
            F.coalesce(F.count_if(F.col("_n_resets") > 0).over(earlier), F.lit(0)),
        )
        # Ranges of a block follow the range whose success started it.
        .withColumn("_own", F.when(F.col("_n_resets") > 0, F.lit(0)).otherwise(F.col("_tail")))
    )
    start = summary.where("_n_resets > 0").select(
        *keys, F.col(RANGE).alias("_start"), F.col("_tail").alias("_start_tail")
    )
    starts = Window.partitionBy(*keys).orderBy("_start")
    start = start.withColumn("_block", F.row_number().over(starts).cast("bigint"))
    if before is not None:
        opening = before.select(*keys, F.lit(0).cast("bigint").alias("_block"), F.col("tail").alias("_start_tail"))
        start = start.select(*keys, "_block", "_start_tail").unionByName(opening)
    carry = (
        carried.join(start.select(*keys, "_block", "_start_tail"), [*keys, "_block"], "left")
        .withColumn(
            "_carry",
            F.coalesce("_start_tail", F.lit(0))
            + F.coalesce(F.sum("_own").over(block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .select(*keys, RANGE, "_carry")
    )
    return (
        counted.join(carry, [*keys, RANGE])
        .withColumn(
            "streak",
            F.when(~F.col("_failed"), F.lit(0)).otherwise(
                F.col("_local") + F.when(F.col("_resets") == 0, F.col("_carry")).otherwise(F.lit(0))
            ).cast("bigint"),
        )
        .withColumn("paused", F.col("streak") >= PAUSE_AFTER)
        .drop("_failed", "_resets", "_local", RANGE)
    )


def stop_on_findings(runs: DataFrame) -> DataFrame:
    """Drop analyzers that run after the first stopping analyzer with findings, per scan."""
    stop = runs.where(F.col("stop_on_findings") & (F.col("found") > 0)).groupBy("scan_id").agg(
        F.min("run_order").alias("_stop")
    )
    return (
        runs.join(stop, "scan_id", "left")
        .where(F.col("_stop").isNull() | (F.col("run_order") <= F.col("_stop")))
        .drop("_stop")
    )


def run_order(verifiers: DataFrame) -> DataFrame:
    return verifiers.withColumn(
        "run_order", F.row_number().over(Window.partitionBy("profile_id").orderBy("model_name"))
    )


def risk_batch(chunks: DataFrame, n: int) -> DataFrame:
    rank = S.lookup({"high": 0, "normal": 1, "low": 2}, F.col("risk"), 3)
    return chunks.orderBy(rank, "chunk_id").limit(n)


def verify_queue(drafts: DataFrame, n: int) -> DataFrame:
    """Pending drafts, most severe first, then most votes, then oldest."""
    votes = F.coalesce("initial_votes", F.lit(0))
    return (
        drafts.where("status = 'pending'")
        .orderBy(S.severity_order("severity"), votes.desc(), "created_at", "draft_id")
        .limit(n)
    )


def remediation_order(findings: DataFrame) -> DataFrame:
    """Position of each finding in its scan's remediation order; positions instead of one long array."""
    ranked = findings.withColumn("_rank", S.severity_order("severity"))
    return exact_row_number(ranked, ["scan_id"], ["_rank", "finding_id"], "position").drop("_rank")


def listing_with_tail(rows: DataFrame, key: str, item: str, n: int) -> DataFrame:
    """The first ``n`` items per key as text, with ``... and k more``; only ``n`` rows are gathered."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    listed = (
        first_n(rows.select(key, item), [key], [F.col(item)], n)
        .groupBy(key)
        .agg(F.array_join(F.array_sort(F.collect_list(item)), "\n").alias("shown"))
    )
    more = F.when(F.col("total") > n, F.concat(F.lit("\n... and "), F.col("total") - n, F.lit(" more"))).otherwise("")
    return counts.join(listed, key).select(key, "total", F.concat("shown", more).alias("listing"))
