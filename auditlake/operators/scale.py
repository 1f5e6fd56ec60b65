"""Helpers that keep hot groups, ordered passes and products distributed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.session import cut

RANGE = "_range"
#: Rows that a task groups or sorts at a time.
ROWS_A_TASK = 1 << 19
#: Rows of either side of a join that meet in one block, so that a block makes about the square of them; most partitions blocks are dealt to.
BLOCK, MOST_PARTS = 1 << 12, 1 << 15


def spread_by_rows(keys: list[str], *frames: DataFrame) -> list[DataFrame]:
    """The frames dealt by ``keys`` to as many partitions as the rows of the longest ask for.

    A later join or grouping on ``keys`` (and more) stays in these partitions, so what a task holds does not
    grow with the input, whatever the number of shuffle partitions. For keys without hot groups.
    """
    most = max(frame.count() for frame in frames)
    parts = max(-(-most // ROWS_A_TASK), frames[0].sparkSession.sparkContext.defaultParallelism)
    return [frame.repartition(parts, *keys) for frame in frames]


def ordered_ranges(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Spread rows over sampled ranges of (keys, order) and tag each with its range number.

    A group of any size is split over as many ranges as it fills, so a later window on
    ``keys + [RANGE]`` never holds more than one range. The tagged rows are checkpointed: every
    branch that reads them, and every retry after a lost executor, sees the same ranges.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cut(
        df.repartitionByRange(parts, *keys, *order).withColumn(RANGE, F.spark_partition_id())
    )


def offsets_before(
    ranged: DataFrame, keys: list[str], total: Column, name: str, start: object = 0
) -> DataFrame:
    """Per (keys, range): the sum of ``total`` over all earlier ranges of the same keys.

    One row per key and range reaches the window, at most the number of shuffle partitions a key.
    """
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(
        Window.unboundedPreceding, -1
    )
    sums = ranged.groupBy(*keys, RANGE).agg(total.alias("_total"))
    return sums.select(
        *keys, RANGE, F.coalesce(F.sum("_total").over(earlier), F.lit(start)).alias(name)
    )


def exact_row_number(
    df: DataFrame, keys: list[str], order: list[Column | str], name: str = "rn"
) -> DataFrame:
    """``row_number`` over groups of any size: number inside a range, add the earlier ranges."""
    ranged = ordered_ranges(df, keys, order)
    local = Window.partitionBy(*keys, RANGE).orderBy(*order)
    numbered = ranged.withColumn("_local", F.row_number().over(local))
    before = offsets_before(ranged, keys, F.count(F.lit(1)), "_before")
    return (
        numbered.join(before, [*keys, RANGE])
        .withColumn(name, (F.col("_local") + F.col("_before")).cast("bigint"))
        .drop("_local", "_before", RANGE)
    )


def first_n(df: DataFrame, keys: list[str], order: list[Column | str], n: int, name: str = "rn") -> DataFrame:
    """The first ``n`` rows per key; Spark cuts each group to ``n`` before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) <= n)


def paired_with_each(
    large: DataFrame,
    small: DataFrame,
    alias: str,
    limit: int = 4096,
    where: Callable[[Column], Column] = lambda row: F.lit(True),
) -> DataFrame:
    """Every row of ``large`` with every row of ``small`` as struct ``alias`` that passes ``where``.

    A small side whose row count is checked to be within ``limit`` becomes one literal array, which
    every row unfolds where it is: no join, no shuffle. A larger one is cut into numbered blocks
    that are joined by block number.
    """
    fields = small.columns
    rows = small.select(F.to_json(F.struct(*fields)).alias("row")).limit(limit + 1).collect()
    if len(rows) <= limit:
        block = F.from_json(F.lit("[" + ",".join(r.row for r in rows) + "]"), f"array<{small.schema.simpleString()}>")
        return large.select(*large.columns, F.explode(F.filter(block, lambda row: where(row))).alias(alias))
    numbered = exact_row_number(small, [], [F.col(c) for c in fields], "_n")
    blocks = numbered.groupBy(F.expr(f"(_n - 1) div {limit}").alias("_block")).agg(
        F.collect_list(F.struct(*fields)).alias("block")
    )
    blocks = cut(blocks)
    count = blocks.count()
    # Few block numbers would mean few tasks: both sides also carry a salt.
    salts = int(small.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.hash(*large.columns), F.lit(salts))
    salted = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        large.withColumn("_salt", salt)
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))))
        .join(salted, ["_block", "_salt"])
        .select(*large.columns, F.explode(F.filter("block", lambda row: where(row))).alias(alias))
    )


def joined_in_blocks(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join on ``key``, dealt to tasks by the rows it makes rather than by the rows it reads.

    Spark sizes the tasks of a join by what it shuffles, and a key's pairs are all made in one of them. Here the rows of a
    key are cut into blocks of about BLOCK on either side, and each block of one side meets each of the other in a place of its own.
    A side is shuffled once for each block of the other. Both sides are checkpointed: they are counted first, and a row's
    block must not change when a task runs again. Null keys meet nothing; the sides share no other column.
    """
    left, right = cut(left), cut(right)
    count = F.count(F.lit(1))
    sizes = left.groupBy(key).agg(count.alias("_rows")).join(right.groupBy(key).agg(count.alias("_others")), key)
    sizes = cut(
        sizes.select(
            key, F.ceil(F.col("_rows") / BLOCK).alias("_ways"), F.ceil(F.col("_others") / BLOCK).alias("_other_ways"),
            (F.col("_rows").cast("double") * F.col("_others")).alias("_made"),
        )
    )
    made = sizes.agg(F.sum("_made").alias("made")).first().made or 0
    parts = max(min(int(made // BLOCK**2) + 1, MOST_PARTS), 4 * left.sparkSession.sparkContext.defaultParallelism)
    # At most a row for every BLOCK rows of a side.
    many = F.broadcast(sizes.where("_ways > 1 or _other_ways > 1").select(key, "_ways", "_other_ways"))

    def placed(side: DataFrame, own: str, ways: str, other: str, other_ways: str) -> DataFrame:
        one = F.lit(1).cast("bigint")
        numbered = side.withColumn("_id", F.monotonically_increasing_id()).join(many, key, "left")
        place = F.pmod("_id", F.coalesce(ways, one)).alias(own)
        others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(other_ways, one) - 1)).alias(other)
        return numbered.select(*side.columns, place, others).repartition(parts, key, "_block", "_other_block")

    rows = placed(left, "_block", "_ways", "_other_block", "_other_ways")
    others = placed(right, "_other_block", "_other_ways", "_block", "_ways")
    return rows.join(others, [key, "_block", "_other_block"]).drop("_block", "_other_block")
