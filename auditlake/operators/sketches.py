"""Mergeable sketches kept per hour: distinct values, quantiles, frequencies of texts.

A stored row sums up one key and hour; any span of hours is united by sums and unions that combine before
the shuffle, so reports over months read the sketch tables and not the calls.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A quantile is off by at most this share of its value.
ACCURACY = 0.01
#: Rows and slots of a frequency sketch: over-counts exceed e / SLOTS of all texts with a chance of e ** -ROWS.
ROWS, SLOTS = 5, 2048
#: Distinct counts have 2 ** LG_K registers, for a standard error of about 1.04 / sqrt(2 ** LG_K).
LG_K = 12


def hour_of(time: str) -> Column:
    return F.date_trunc("hour", time).alias("hour")


def _growth(accuracy: float) -> float:
    return (1 + accuracy) / (1 - accuracy)


def bucket_of(value: Column, accuracy: float = ACCURACY) -> Column:
    """The bucket (growth ** (b - 1), growth ** b] of a value above zero; null for zero and less."""
    return F.when(value > 0, F.ceil(F.log(value) / math.log(_growth(accuracy))).cast("int"))


def quantile_sketch(rows: DataFrame, keys: list[str], time: str, value: str, accuracy: float = ACCURACY) -> DataFrame:
    """(keys, hour, bucket, n): values counted in buckets whose bounds grow by a fixed factor. Null values are left out."""
    known = rows.where(F.col(value).isNotNull())
    return known.groupBy(*keys, hour_of(time), bucket_of(F.col(value), accuracy).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], shares: dict[str, float], accuracy: float = ACCURACY) -> DataFrame:
    """(keys, n, one column a share) over all hours of ``sketch``: values at rank ceil(share * n), within ``accuracy``.

    A key has one row a bucket here, some thousand for 64-bit values, however many rows it stands for.
    Values of zero and less count as 0. Null keys are a key of their own.
    """
    held = sketch.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    growth = _growth(accuracy)
    middle = F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(2 * F.pow(F.lit(growth), F.col("bucket")) / (growth + 1))
    line = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = held.withColumn("_upto", F.sum("n").over(line)).withColumn("_all", F.sum("n").over(Window.partitionBy(*keys)))
    picks = [
        F.min_by(middle, F.col("_upto")).alias(name) if share <= 0 else
        F.min(F.when(F.col("_upto") >= F.ceil(F.lit(share) * F.col("_all")), middle)).alias(name)
        for name, share in shares.items()
    ]
    return ranked.groupBy(*keys).agg(F.sum("n").alias("n"), *picks)


def distinct_sketch(rows: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """(keys, hour, sketch): a HyperLogLog sketch of the values; nulls are left out."""
    return rows.groupBy(*keys, hour_of(time)).agg(F.hll_sketch_agg(value, LG_K).alias("sketch"))


def distinct_counts(sketch: DataFrame, keys: list[str], name: str = "n_distinct") -> DataFrame:
    """(keys, estimated distinct values) over all hours of ``sketch``."""
    return sketch.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))


def _slot(row: Column, text: Column, slots: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(row.cast("string"), F.lit(":"), text)), 1, 8), 16, 10).cast("bigint") % slots


def frequency_sketch(rows: DataFrame, keys: list[str], time: str, text: str, depth: int = ROWS, slots: int = SLOTS) -> DataFrame:
    """(keys, hour, row, slot, n): each text counted in one slot of each row; null texts are left out."""
    placed = rows.where(F.col(text).isNotNull()).groupBy(*keys, hour_of(time), text).agg(F.count(F.lit(1)).alias("_n"))
    rowed = placed.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    return rowed.groupBy(*keys, "hour", "row", _slot(F.col("row"), F.col(text), slots).alias("slot")).agg(F.sum("_n").alias("n"))


def frequencies(sketch: DataFrame, asked: DataFrame, keys: list[str], text: str, depth: int = ROWS, slots: int = SLOTS) -> DataFrame:
    """``asked`` (keys and a text) with ``estimate``: at least the text's count, over all hours of ``sketch``.

    A text that meets an empty slot has 0. ``depth`` and ``slots`` must be those of the sketch.
    """
    held = sketch.groupBy(*keys, "row", "slot").agg(F.sum("n").alias("n"))
    probes = asked.select(*keys, text).distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    probes = probes.withColumn("slot", _slot(F.col("row"), F.col(text), slots)).alias("p")
    same = (F.col("p.row") == F.col("h.row")) & (F.col("p.slot") == F.col("h.slot"))
    for k in keys:
        same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"h.{k}"))
    found = probes.join(held.alias("h"), same, "left")
    return found.groupBy(*[F.col(f"p.{c}").alias(c) for c in [*keys, text]]).agg(F.min(F.coalesce("h.n", F.lit(0))).alias("estimate"))
