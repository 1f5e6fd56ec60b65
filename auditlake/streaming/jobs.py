"""Streaming jobs over file streams; each has a batch twin among the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators.lifecycle import due_watchers, unreviewed
from auditlake.operators.ordering import error_streaks
from auditlake.sources.sinks import alert_payloads, deliver


def file_stream(spark: SparkSession, table: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """Stream of a table's files: ``table`` is a folder of part files or a single file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    # A stream's path must be a folder or a pattern.
    source = f"{table}*" if files.exists(path) and files.getFileStatus(path).isFile() else table
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "*.parquet")
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(source)
    )


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], state_dir: str, mode: str = "append") -> None:
    """Process what there is in micro-batches and stop; the checkpoint resumes after a crash."""
    (
        stream.writeStream.outputMode(mode)
        .foreachBatch(each)
        .option("checkpointLocation", f"{state_dir}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def _store(path: str, rows: DataFrame) -> Callable[[DataFrame, int], None]:
    """Write a batch below its own number: a replayed batch overwrites itself.

    An empty batch with the columns of ``rows`` comes first, so a job that has seen nothing leaves
    an empty table.
    """
    _empty(rows).write.mode("overwrite").parquet(f"{path}/batch_id=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def _empty(rows: DataFrame) -> DataFrame:
    return rows.sparkSession.createDataFrame([], rows.schema)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).drop("batch_id")


def intake(stream: DataFrame, state_dir: str) -> str:
    """Append arriving rows to a table; started again, it goes on where it stopped."""
    out = f"{state_dir}/rows"
    run_available(stream, _store(out, stream), state_dir)
    return out


def live_counts(stream: DataFrame, keys: list[str], state_dir: str) -> str:
    """Counts per key in update mode; readers take the newest batch of each key."""
    out = f"{state_dir}/counts"
    counts = stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    run_available(counts, _store(out, counts), state_dir, "update")
    return out


def newest_counts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.groupBy(*keys).agg(F.max_by("n", "batch_id").alias("n"))


def recent_activity(stream: DataFrame, state_dir: str, late: str = "10 minutes", width: str = "5 minutes", slide: str = "1 minute") -> str:
    """Requests per model in sliding windows, open ones included: every batch writes what it changed.

    Readers take the newest count of a window (``newest_counts``). State is kept until the watermark
    has passed a window.
    """
    out = f"{state_dir}/windows"
    counts = (
        stream.withWatermark("created_at", late)
        .groupBy(F.window("created_at", width, slide), "model_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), "model_name", "n")
    )
    run_available(counts, _store(out, counts), state_dir, "update")
    return out


def deduplicated(stream: DataFrame, key: str, time: str, state_dir: str, late: str = "1 day") -> str:
    """Drop repeats of a key, which lie within ``late`` of each other; rows of any age are taken.

    A batch is compared with the stored keys from ``late`` before its oldest row on: in a stream that is
    about in order these are the last ones, and rows out of order reach back as far as they need.
    """
    out = f"{state_dir}/distinct"
    _empty(stream).write.mode("overwrite").parquet(f"{out}/batch_id=-1")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = F.col(time)
        bounds = batch.agg(
            (F.min(at) - F.expr(f"interval {late}")).alias("low"), (F.max(at) + F.expr(f"interval {late}")).alias("high"),
            F.count_if(at.isNull()).alias("unknown"),
        ).first()
        # A replayed batch must not meet what it wrote itself.
        before = spark.read.option("basePath", out).parquet(out).where(F.col("batch_id") < batch_id)
        if not bounds.unknown and bounds.low is not None:
            before = before.where(at.isNull() | at.between(F.lit(bounds.low), F.lit(bounds.high)))
        new = batch.dropDuplicates([key]).alias("n").join(
            before.select(F.col(key).alias("_key")).distinct(), F.col(f"n.{key}").eqNullSafe(F.col("_key")), "left_anti"
        )
        new.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    run_available(stream, each, state_dir)
    return out


def pause_signals(stream: DataFrame, state_dir: str, limit: int = 5) -> str:
    """A signal for every row at which a model's error streak reaches ``limit``.

    The streak of a model may span batches: its open tail is kept as a table with one row a model,
    written per batch number. Inside a batch the rows are ranked range by range, so a model with a
    third of the traffic is not one task.
    """
    out, tails = f"{state_dir}/signals", f"{state_dir}/tails"

    marks = stream.select("model_name", "log_id", F.lit(0).cast("bigint").alias("streak"))
    _empty(marks).write.mode("overwrite").parquet(f"{out}/batch_id=-1")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        order = ["created_at", "log_id"]
        before = None
        if batch_id > 0:
            before = spark.read.parquet(f"{tails}/batch_id={batch_id - 1}")
        if batch.isEmpty():
            kept = batch.select("model_name", F.lit(0).cast("bigint").alias("tail")) if before is None else before
            kept.write.mode("overwrite").parquet(f"{tails}/batch_id={batch_id}")
            return
        streaks = error_streaks(batch, ["model_name"], order, ~F.col("parse_success"), before).cache()
        streaks.where(F.col("streak") == limit).select("model_name", "log_id", "streak").write.mode("overwrite").parquet(
            f"{out}/batch_id={batch_id}"
        )
        tail = streaks.groupBy("model_name").agg(F.max_by("streak", F.struct(*order)).alias("tail"))
        if before is not None:
            tail = tail.unionByName(before.join(tail, "model_name", "left_anti"))
        tail.write.mode("overwrite").parquet(f"{tails}/batch_id={batch_id}")
        streaks.unpersist()

    run_available(stream, each, state_dir)
    return out


def poll_changes(stream: DataFrame, watchers: DataFrame, reviews: DataFrame, as_of, state_dir: str) -> str:
    """Arriving changes of the watchers that are due, without those already reviewed."""
    out = f"{state_dir}/due"
    _empty(stream).write.mode("overwrite").parquet(f"{out}/batch_id=-1")
    due = due_watchers(watchers, as_of).select("watcher_id")

    def each(batch: DataFrame, batch_id: int) -> None:
        todo = unreviewed(batch.join(due, "watcher_id", "left_semi"), reviews)
        todo.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    run_available(stream, each, state_dir)
    return out


def alerts(stream: DataFrame, subscriptions: DataFrame, secret: str, transport: Callable[[str, str], int], state_dir: str) -> str:
    """Alerts on arrival: intent check, subscriptions, signed payload, delivery row."""
    out = f"{state_dir}/deliveries"

    def each(batch: DataFrame, batch_id: int) -> None:
        deliver(alert_payloads(batch, subscriptions, secret, str(batch_id)), transport, f"{out}/batch_id={batch_id}", "overwrite")

    run_available(stream, each, state_dir)
    return out
