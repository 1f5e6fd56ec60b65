"""Sinks: partitioned facts, replaced partitions, exports, alert payloads."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text as X
from auditlake.operators.joins import matching_subscriptions


def append_facts(df: DataFrame, path: str) -> None:
    """Append to a table kept by scan. Rows of a scan meet first, so a scan gets few files; AQE splits
    the scans that are too big for one task."""
    df.hint("rebalance", "scan_id").write.mode("append").partitionBy("scan_id").parquet(path)


def replace_scans(df: DataFrame, path: str, scan_ids: list) -> None:
    """Replace the rows of ``scan_ids`` by ``df``; a scan without rows in ``df`` is emptied.

    Partitions of the scans are removed first, then written; run again after a failure, it ends
    in the same state.
    """
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for scan_id in scan_ids:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"scan_id={scan_id}"), True)
    df = df.where(F.col("scan_id").isin(scan_ids))
    (
        df.hint("rebalance", "scan_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("scan_id")
        .parquet(path)
    )


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def export_model_json(results: DataFrame, path: str, order: str) -> None:
    """One folder of JSON lines per model, ordered by test number inside each file."""
    (
        results.repartitionByRange("model_name", order)
        .sortWithinPartitions("model_name", order)
        .write.mode("overwrite")
        .partitionBy("model_name")
        .json(path)
    )


def sign(secret: str) -> Callable[[Column | str], Column]:
    """HMAC-SHA256 of a text column from built-in hashes: the two padded keys are literals."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))

    def signed(payload: Column | str) -> Column:
        text = F.encode(F.col(payload) if isinstance(payload, str) else payload, "UTF-8")
        digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text), 256))), 256)
        return F.concat(F.lit("sha256="), digest)

    return signed


def alert_payloads(findings: DataFrame, subscriptions: DataFrame, secret: str, run: str = "") -> DataFrame:
    """One signed delivery row per finding and matching subscription.

    The payload names a ``delivery_id`` made from ``run``, webhook, event and finding: a task that is repeated
    sends the same id again, another run sends a new one.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("webhook_id", "event", "scan_id", "finding_id")]
    delivery = F.sha2(F.concat_ws(":", F.lit(run), *parts), 256)
    flagged = findings.withColumn("indicators", X.malicious_categories("title", "snippet")).withColumn(
        "event", F.lit("finding")
    )
    payload = F.to_json(
        F.struct(
            "event",
            F.struct("finding_id", "scan_id", "title", "severity").alias("finding"),
            (F.size("indicators") > 0).alias("is_malicious"),
            "indicators",
            "delivery_id",
        )
    )
    matched = matching_subscriptions(flagged, subscriptions).withColumn("delivery_id", delivery)
    return matched.select(
        "delivery_id", "finding_id", "scan_id", "webhook_id", "event", (F.size("indicators") > 0).alias("is_malicious"), payload.alias("payload")
    ).withColumn("signature", sign(secret)("payload"))


def deliver(payloads: DataFrame, transport: Callable[[str, str], int], path: str, mode: str = "append") -> None:
    """Hand payloads to ``transport(payload, signature) -> status code`` in tasks; record the outcome."""
    schema = "delivery_id string, finding_id bigint, scan_id bigint, webhook_id bigint, event string, status_code int, status string"

    def send(batches):
        for batch in batches:
            codes = [transport(p, s) for p, s in zip(batch["payload"], batch["signature"])]
            out = batch[["delivery_id", "finding_id", "scan_id", "webhook_id", "event"]].copy()
            out["status_code"] = codes
            out["status"] = ["delivered" if 200 <= c < 300 else "failed" for c in codes]
            yield out

    payloads.mapInPandas(send, schema).write.mode(mode).parquet(path)
