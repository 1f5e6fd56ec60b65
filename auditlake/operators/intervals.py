"""Joins on positions and spans: latest row as of a time, overlapping spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.operators.scale import RANGE, ordered_ranges

#: Positions are 64-bit numbers, so dyadic nodes have at most that many levels.
LEVELS = 63


def as_of_join(
    left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, take: list[str], tie: list[str] | None = None
) -> DataFrame:
    """``left`` with the columns ``take`` of the row of ``right`` that was the latest at its time.

    The latest is the one with the greatest ``since`` not after ``at`` among rows of equal ``keys``, of
    several the one with the greatest ``tie`` (by default ``take``). Rows without one get nulls, and so
    do null keys and times; rows of ``right`` with a null key or time are in force for nobody. Every
    left row is returned once.

    Both sides lie in one order of (keys, time). The last right row is carried forward inside sampled
    ranges of this order and, a row a key and range, across them: a key of any size fills many tasks.
    """
    clash = set(take) & set(left.columns)
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    picked = F.struct(*[F.col(c) for c in (tie or take)], *[F.col(c).alias(f"_take_{c}") for c in take])
    known = right.where(F.col(since).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    offers = known.groupBy(*keys, F.col(since).alias("_time")).agg(F.max(picked).alias("_offer"))
    whole = F.struct(*left.columns)
    asked = left.select(*keys, F.col(at).alias("_time"), F.lit(1).alias("_side"), whole.alias("_row"), F.xxhash64(whole).alias("_spread"))
    both = asked.unionByName(
        offers.select(*keys, "_time", F.lit(0).alias("_side"), "_offer", F.lit(0).cast("bigint").alias("_spread")), allowMissingColumns=True
    )
    # Of equal times the offer comes first; rows without a time come before all offers.
    order = [F.asc_nulls_first("_time"), F.col("_side"), F.col("_spread")]
    ranged = ordered_ranges(both, keys, order)
    inside = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = ranged.where("_side = 0").groupBy(*keys, RANGE).agg(F.max_by("_offer", "_time").alias("_last"))
    ends = ranged.select(*keys, RANGE).distinct().join(last, [*keys, RANGE], "left")
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier)).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(RANGE).alias("_of"), "_carried"
    )
    found = ranged.withColumn("_found", F.last("_offer", ignorenulls=True).over(inside)).where("_side = 1")
    same = F.col(RANGE) == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    offer = F.when(F.col("_time").isNotNull(), F.coalesce("_found", "_carried"))
    joined = found.join(carried, same, "left").withColumn("_offer", offer)
    return joined.select("_row.*", *[F.col(f"_offer._take_{c}").alias(c) for c in take])


def _nodes(first: Column, last: Column, top: int) -> Column:
    """The fewest dyadic nodes that cover [first, last]: array<struct<level, node>>, at most two a level."""

    def at(level: Column) -> Column:
        low = -F.call_function("shiftright", -first, level)  # rounded up
        high = F.call_function("shiftright", last + 1, level)
        node = lambda n: F.struct(level.alias("level"), n.alias("node"))
        odd = lambda n: n.bitwiseAND(F.lit(1)) == 1
        return F.array(F.when((low < high) & odd(low), node(low)), F.when((low < high) & odd(high), node(high - 1)))

    levels = F.array(*[F.lit(i) for i in range(top + 1)])
    return F.array_compact(F.flatten(F.transform(levels, at)))


def points_in_spans(points: DataFrame, spans: DataFrame, keys: list[str], at: str, first: str, last: str) -> DataFrame:
    """Every row of ``points`` with every row of ``spans`` of equal keys whose [first, last] holds ``at``, once.

    A span is cut into dyadic nodes, at most two a level whatever its length; a point offers the node of
    each level that any span uses. Of a span's nodes exactly one holds the point, so they meet by
    equality and each pair meets once. Empty spans and nulls meet nothing.
    """
    clash = (set(points.columns) & set(spans.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    whole = spans.where(F.col(first) <= F.col(last))
    longest = whole.agg(F.max(F.col(last).cast("bigint") - F.col(first).cast("bigint") + 1)).first()[0] or 1
    top = min(longest.bit_length(), LEVELS - 1)
    cut_up = whole.withColumn("_n", F.explode(_nodes(F.col(first).cast("bigint"), F.col(last).cast("bigint"), top)))
    cut_up = cut_up.withColumn("_level", F.col("_n.level")).withColumn("_node", F.col("_n.node")).drop("_n")
    used = sorted(r[0] for r in cut_up.select("_level").distinct().collect())  # at most one a level
    place = F.col(at).cast("bigint")
    offers = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(place, k).alias("node")) for k in used or [0]])
    offered = points.where(place.isNotNull()).withColumn("_n", F.explode(offers))
    offered = offered.withColumn("_level", F.col("_n.level")).withColumn("_node", F.col("_n.node")).drop("_n")
    return offered.join(cut_up, [*keys, "_level", "_node"]).drop("_level", "_node")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Every pair of rows of equal keys whose spans [first, last] share a position, once.

    Either the left span starts inside the right one, or the right one starts later and inside the left one:
    two joins of points with spans that have no pair in common. Columns of both sides must differ but for the
    keys. Empty spans (last before first) and null keys or ends meet nothing.
    """
    (a, b), (c, d) = left_span, right_span
    starts_in = points_in_spans(left.where(F.col(a) <= F.col(b)), right, keys, a, c, d)
    starts_later = points_in_spans(right.where(F.col(c) <= F.col(d)), left, keys, c, a, b).where(F.col(c) > F.col(a))
    return starts_in.unionByName(starts_later)
