"""Unified diffs to hunks and added lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: a hunk header.
HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)$"


def _part(group: int) -> Column:
    return F.regexp_extract("line", HEADER, group)


def _hunk_lines(diffs: DataFrame) -> DataFrame:
    """Lines with their hunk number; a group is one diff text, which was one row before."""
    lines = diffs.select("change_id", F.posexplode(F.split("diff", "\n")).alias("n", "line")).withColumn(
        "is_header", F.col("line").rlike(HEADER)
    )
    so_far = Window.partitionBy("change_id").orderBy("n")
    return lines.withColumn("hunk", F.sum(F.col("is_header").cast("bigint")).over(so_far)).where("hunk > 0")


def diff_hunks(diffs: DataFrame) -> DataFrame:
    head = F.col("is_header")
    number = lambda g, default=None: F.max(
        F.when(head, F.coalesce(_part(g).try_cast("int"), F.lit(default).cast("int")))
    )
    return _hunk_lines(diffs).groupBy("change_id", "hunk").agg(
        number(1).alias("old_start"),
        number(2, 1).alias("old_lines"),
        number(3).alias("new_start"),
        number(4, 1).alias("new_lines"),
        F.max(F.when(head, F.trim(_part(5)))).alias("header"),
        (F.count(F.lit(1)) - 1).alias("content_lines"),
    )


def added_lines(diffs: DataFrame) -> DataFrame:
    """Added lines with their line number in the new file."""
    whole = Window.partitionBy("change_id", "hunk")
    before = whole.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    removed = F.col("line").startswith("-") & ~F.col("line").startswith("---")
    step = F.when(F.col("is_header") | removed, 0).otherwise(1)
    start = F.max(F.when(F.col("is_header"), _part(3).try_cast("bigint"))).over(whole)
    return (
        _hunk_lines(diffs)
        .withColumn("line_number", start + F.coalesce(F.sum(step).over(before), F.lit(0)))
        .where(~F.col("is_header") & F.col("line").startswith("+") & ~F.col("line").startswith("+++"))
        .select("change_id", "line_number", F.substr("line", F.lit(2)).alias("content"))
    )
