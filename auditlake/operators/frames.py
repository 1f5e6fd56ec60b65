"""Window frames over groups of any size: RANGE frames from running aggregates of blocks, ranks from counts before, tiles."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.operators.scale import RANGE, exact_row_number, offsets_before, ordered_ranges

KEY = "_key"  # the keys as one struct, in which nulls are equal to each other


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(F.struct(*[F.col(k) for k in keys] or [F.lit(0).alias("all")]).alias(KEY), F.struct(*df.columns).alias("_row"))


def _position(df: DataFrame, at: str, inside: str = "") -> Column:
    """Times as microseconds (without a zone: read in the session's), dates as days, whole numbers as they are."""
    kind, value = df.schema[at].dataType.simpleString(), F.col(inside + at)
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(value.cast("timestamp"))
    if kind == "date":
        return F.unix_date(value).cast("bigint")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return value.cast("bigint")
    raise ValueError(f"{at} is {kind}; a frame needs times, dates or whole numbers")


def _reach(df: DataFrame, at: str, reach: int | timedelta) -> int:
    if isinstance(reach, timedelta):
        unit = timedelta(days=1) if df.schema[at].dataType.simpleString() == "date" else timedelta(microseconds=1)
        reach = reach // unit
    if reach < 0:
        raise ValueError("a frame reaches back and ahead by zero or more")
    return reach


#: Aggregates of a frame: within a position, and of positions.
MERGED = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def range_frame(
    df: DataFrame, keys: list[str], at: str, before: int | timedelta, after: int | timedelta, aggs: dict[str, tuple[str, str | Column]]
) -> DataFrame:
    """``df`` with ``aggs`` over the rows of equal keys whose ``at`` lies in [at - before, at + after].

    ``aggs`` maps a name to (count, sum, min or max; a column or expression). Rows are first added up to
    one a position, so a position that most rows share is one row. Positions are cut into blocks as long as a
    frame, so a frame is the end of one block and the start of the next one, or a whole block. A position asks for both ends of its
    frame; all ends are answered by running aggregates inside blocks, so the work does not grow with what a frame holds.
    Positions and ends are dealt to sampled ranges of (keys, at), and blocks that lie in several ranges are carried across them.
    Null keys are equal to each other. Rows without a position frame each other, as in SQL. Rows may repeat;
    an empty table gives an empty one. Names of ``aggs`` that ``df`` has already are refused.
    """
    clash = set(aggs) & set(df.columns)
    if clash:
        raise ValueError(f"columns that are there already: {sorted(clash)}")
    back, ahead = _reach(df, at, before), _reach(df, at, after)
    rows = _keyed(df, keys)
    measured = df.select(
        F.struct(*[F.col(k) for k in keys] or [F.lit(0).alias("all")]).alias(KEY), _position(df, at).alias("_at"),
        *[(F.col(c) if isinstance(c, str) else c).alias(f"_m{i}") for i, (_, c) in enumerate(aggs.values())],
    )
    parts = {f"_m{i}": MERGED[kind] for i, (kind, _) in enumerate(aggs.values())}
    summed = measured.groupBy(KEY, "_at").agg(*[within(m).alias(m) for m, (within, _) in parts.items()])
    # A position comes three times: as the start of its frame (_side 0), with its values (1) and as the end of its frame (2).
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("_side"), (F.col("_at") + d).alias("_place")) for k, d in enumerate((-back, 0, ahead))]))
    placed = summed.where("_at IS NOT NULL").select(KEY, "_at", *parts, sides.alias("_s")).select(
        KEY, "_at", "_s.*", *[F.when(F.col("_s._side") == 1, F.col(m)).alias(m) for m in parts]
    )
    length = back + ahead + 1
    block = F.expr(f"_place div {length}L - if(_place % {length}L < 0, 1, 0)")
    ranged = ordered_ranges(placed.withColumn("_block", block), [KEY], ["_place", "_side", "_at"])
    own = {m: over(m) for m, (_, over) in parts.items()}
    totals = ranged.where("_side = 1").groupBy(KEY, "_block", RANGE).agg(*[c.alias(m) for m, c in own.items()])
    spans = ranged.select(KEY, "_block", RANGE).distinct().join(totals, [KEY, "_block", RANGE], "left")
    inside, across = Window.partitionBy(KEY, "_block", RANGE), Window.partitionBy(KEY, "_block")
    upto = {  # running aggregates of a block, from its start up to an end of a frame and from a start of one to its end
        2: (inside.orderBy("_place", "_side"), across.orderBy(RANGE)),
        0: (inside.orderBy(F.desc("_place"), F.desc("_side")), across.orderBy(F.desc(RANGE))),
    }
    answers = None
    for side, (near, far) in upto.items():
        running = ranged.select("*", *[over(m).over(near.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_r{m}") for m, (_, over) in parts.items()])
        running = running.where(F.col("_side") == side)
        if side == 0:  # a frame that is a whole block is answered by its end
            running = running.where(F.col("_place") % length != 0)
        carried = spans.select(
            KEY, "_block", RANGE, *[over(m).over(far.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_c{m}") for m, (_, over) in parts.items()]
        )
        found = running.join(carried, [KEY, "_block", RANGE])
        for label in ("_r", "_c"):
            one = found.select(KEY, "_at", *[F.col(f"{label}{m}").alias(m) for m in parts])
            answers = one if answers is None else answers.unionByName(one)
    frames = answers.groupBy(KEY, "_at").agg(*[c.alias(m) for m, c in own.items()]).unionByName(summed.where("_at IS NULL"))
    held = F.struct("_at").alias("_held")  # null positions are equal to each other
    placed = rows.select(KEY, "_row", F.struct(_position(df, at, "_row.").alias("_at")).alias("_held"))
    return placed.join(frames.select(KEY, held, *parts), [KEY, "_held"]).select(
        "_row.*", *[F.col(m).alias(n) for m, n in zip(parts, aggs)]
    )


def value_ranks(df: DataFrame, keys: list[str], by: str, descending: bool = False) -> DataFrame:
    """``df`` with ``rank``, ``dense_rank``, ``percent_rank`` and ``cume_dist`` of ``by`` among rows of equal keys.

    Values are counted before anything is ordered, so a value on most rows is one row of the ordered pass;
    ranks are the counts before it, inside sampled ranges and across them. Nulls are a value of their own, last
    in ascending and first in descending order. Null keys are equal to each other. One row has a
    ``percent_rank`` of 0.
    """
    order = F.desc_nulls_first("_value") if descending else F.asc_nulls_last("_value")
    rows = _keyed(df, keys).select(KEY, "_row", F.struct(F.col(f"_row.{by}").alias("v")).alias("_held"))
    counted = rows.groupBy(KEY, "_held").agg(F.count(F.lit(1)).alias("_n")).withColumn("_value", F.col("_held.v"))
    ranged = ordered_ranges(counted, [KEY], [order])
    inside = Window.partitionBy(KEY, RANGE).orderBy(order)
    sums = (
        ranged.withColumn("_upto", F.sum("_n").over(inside)).withColumn("_nth", F.row_number().over(inside).cast("bigint"))
        .join(offsets_before(ranged, [KEY], F.sum("_n"), "_rows_before"), [KEY, RANGE])
        .join(offsets_before(ranged, [KEY], F.count(F.lit(1)), "_values_before"), [KEY, RANGE])
        .join(counted.groupBy(KEY).agg(F.sum("_n").alias("_all")), KEY)
    )
    upto = F.col("_rows_before") + F.col("_upto")
    rank = upto - F.col("_n") + 1
    ranks = sums.select(
        KEY, "_held", rank.alias("rank"), (F.col("_values_before") + F.col("_nth")).alias("dense_rank"),
        F.when(F.col("_all") > 1, (rank - 1) / (F.col("_all") - 1)).otherwise(F.lit(0.0)).alias("percent_rank"),
        (upto / F.col("_all")).alias("cume_dist"),
    )
    return rows.join(ranks, [KEY, "_held"]).select("_row.*", "rank", "dense_rank", "percent_rank", "cume_dist")


def tiles(df: DataFrame, keys: list[str], order: list[str], n: int, name: str = "tile") -> DataFrame:
    """``df`` with the tile 1..n of each row: ``ntile`` over groups of any size.

    The first tiles get one row more where n does not divide the rows. ``order`` should end with columns that
    tell rows apart; equal rows may swap tiles. Null keys are equal to each other, null values come first.
    """
    if n < 1:
        raise ValueError("at least one tile")
    rows = _keyed(df, keys)
    numbered = exact_row_number(rows, [KEY], [F.asc_nulls_first(f"_row.{c}") for c in order], "_rn")
    sized = numbered.join(rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("_all")), KEY)
    small, larger = F.expr(f"_all div {n}"), F.col("_all") % n
    at = F.col("_rn") - 1
    edge = larger * (small + 1)
    tile = F.when(at < edge, F.floor(at / (small + 1))).otherwise(larger + F.floor((at - edge) / F.greatest(small, F.lit(1))))
    return sized.select("_row.*", (tile + 1).cast("int").alias(name))
