"""Sessions of a stream by gaps, and a side table of the rows that come behind the watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.streaming.jobs import run_available

MERGES: dict[str, Callable] = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def _pieces(rows: DataFrame, keys: list[str], time: str, gap: str, measures: dict) -> DataFrame:
    """Rows of one stretch as long as the gap belong together, so they combine before the shuffle.

    What is left of a key grows with its time, not with its rows.
    """
    aggs = [getattr(F, kind)(source).alias(name) for name, (kind, source) in measures.items()]
    stretch = F.floor(F.unix_micros(F.col(time)) / _micros(gap))
    return (
        rows.groupBy(*keys, stretch.alias("_stretch"))
        .agg(F.min(time).alias("session_start"), F.max(time).alias("last_seen"), *aggs)
        .drop("_stretch")
    )


def _micros(length: str) -> Column:
    moment = F.timestamp_seconds(F.lit(0))
    return F.unix_micros(moment + F.expr(f"interval {length}"))


def _united(pieces: DataFrame, keys: list[str], gap: str, measures: dict) -> DataFrame:
    """Pieces less than a gap apart are one session."""
    order = Window.partitionBy(*keys).orderBy("session_start", "last_seen")
    reach = F.max("last_seen").over(order.rowsBetween(Window.unboundedPreceding, -1)) + F.expr(f"interval {gap}")
    first = F.when(F.col("session_start") < reach, 0).otherwise(1)
    numbered = pieces.withColumn("_first", first).withColumn("_no", F.sum("_first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = [MERGES[kind](name).alias(name) for name, (kind, _) in measures.items()]
    return (
        numbered.groupBy(*keys, "_no")
        .agg(F.min("session_start").alias("session_start"), F.max("last_seen").alias("last_seen"), *merged)
        .drop("_no")
    )


def sessions(rows: DataFrame, keys: list[str], time: str, gap: str, measures: dict) -> DataFrame:
    """Sessions of a table: a row belongs to the session whose last row is less than ``gap`` older.

    ``measures`` maps names to (count, sum, min or max; column); ``time`` is a timestamp. Null keys are a key; rows without a
    time are in no session. Only stretches of a key meet in one window, at most one for each gap of time.
    """
    timed = rows.where(F.col(time).isNotNull())
    return _united(_pieces(timed, keys, time, gap, measures), keys, gap, measures)


def session_job(stream: DataFrame, keys: list[str], time: str, gap: str, late: str, measures: dict, state_dir: str) -> str:
    """Sessions of a stream of rows in any order; what is behind the watermark goes to a side table.

    The watermark of a batch is the newest time of all earlier batches minus ``late``. Rows at or
    after it extend or join open sessions, so the sessions are those of a table of these rows. Older
    rows and rows without a time are kept whole in the side table: counts plus side rows are the input.
    A session is closed once the watermark has passed its last row by the gap. Each batch writes its
    open and newly closed sessions below its own number, from which a replayed batch starts again.
    """
    table, side, marks = f"{state_dir}/sessions", f"{state_dir}/late", f"{state_dir}/marks"

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{marks}/batch_id={batch_id - 1}").first().newest if batch_id > 0 else None
        on_time = F.col(time).isNotNull()
        if before is not None:
            on_time = on_time & (F.unix_micros(time) >= F.lit(before) - _micros(late))
        batch.where(~on_time).write.mode("overwrite").parquet(f"{side}/batch_id={batch_id}")
        pieces = _pieces(batch.where(on_time), keys, time, gap, measures)
        if batch_id > 0:
            pieces = pieces.unionByName(spark.read.parquet(f"{table}/batch_id={batch_id - 1}").where("NOT closed").drop("closed"))
        found = _united(pieces, keys, gap, measures).persist()
        newest = found.agg(F.greatest(F.unix_micros(F.max("last_seen")), F.lit(before).cast("bigint")).alias("newest"))
        mark = F.lit(newest.first().newest).cast("bigint") - _micros(late)
        closed = F.unix_micros("last_seen") + _micros(gap) <= mark
        found.withColumn("closed", F.coalesce(closed, F.lit(False))).write.mode("overwrite").parquet(
            f"{table}/batch_id={batch_id}"
        )
        newest.coalesce(1).write.mode("overwrite").parquet(f"{marks}/batch_id={batch_id}")
        found.unpersist()

    _prepare(stream, keys, time, gap, measures, state_dir)
    run_available(stream, each, state_dir)
    return state_dir


def _prepare(stream: DataFrame, keys: list[str], time: str, gap: str, measures: dict, state_dir: str) -> None:
    """Empty tables, for a job that has seen nothing."""
    none = stream.sparkSession.createDataFrame([], stream.schema)
    none.write.mode("overwrite").parquet(f"{state_dir}/late/batch_id=-1")
    found = sessions(none, keys, time, gap, measures)
    found.withColumn("closed", F.lit(False)).write.mode("overwrite").parquet(f"{state_dir}/sessions/batch_id=-1")
    found.select(F.unix_micros(F.max("last_seen")).alias("newest")).write.mode("overwrite").parquet(f"{state_dir}/marks/batch_id=-1")


def stored_sessions(spark: SparkSession, state_dir: str) -> DataFrame:
    """Closed sessions, and the open ones as the last batch left them."""
    marks = spark.read.option("basePath", f"{state_dir}/marks").parquet(f"{state_dir}/marks")
    last = marks.agg(F.max("batch_id")).first()[0]
    rows = spark.read.option("basePath", f"{state_dir}/sessions").parquet(f"{state_dir}/sessions")
    return rows.where(F.col("closed") | (F.col("batch_id") == last)).drop("batch_id")


def late_rows(spark: SparkSession, state_dir: str) -> DataFrame:
    return spark.read.option("basePath", f"{state_dir}/late").parquet(f"{state_dir}/late").drop("batch_id")
