"""Small helpers shared by the operators: text columns, Arrow batches, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.session import cut

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Words of a text as an array; none for null, empty and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """Number of words, without keeping them."""
    parts = F.split(F.coalesce(text, F.lit("")), BLANKS)
    # Only the first and the last part can be empty.
    return (
        F.size(parts)
        - (F.element_at(parts, 1) == "").cast("int")
        - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    ).cast("bigint")


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of ``column``, or of one longer row."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if size and size + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if start < len(lengths):
            yield batch.slice(start)


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node of the distinct ``edges`` (larger a, smaller b) has one smaller neighbour, or only larger ones."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e"))
    roles = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("least"))
    return roles.where("ups > 1 or ups = 1 and least = 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b longs): one row (node, component) per linked node.

    The component is the smallest node reachable. Alternates two star steps (every node hands its
    larger, then its smaller neighbours to the smallest one) until the links are stars around smallest
    nodes. Each step is one exchange; links are checkpointed in the shared folder,
    so no lost executor replays earlier rounds. Nulls and loops are ignored.
    """
    edges = cut(
        links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).repartition("a")
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = (
            both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b")
        ).repartition("a").distinct()
        # Now every link runs from a larger node to a smaller one.
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").select(
            F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")
        )
        edges = cut(small.select("e.a", "e.b").where("a != b").distinct())
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
