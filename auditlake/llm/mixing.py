"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import n_words_of
from auditlake.llm.registry import query, table
from auditlake.operators.scale import exact_row_number
from auditlake.session import cut

WEIGHTS, MOST = (5, 2, 1), 3
#: Words of a block; words of a shard, at about which a source is cut into one more.
BLOCK, SHARD = 64, 1_000_000
#: Divisors tried in one pass over the cells.
TRIES = 48
#: Equal rows that are unfolded at a time.
COPIES = 4096


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``target`` to rows (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes; a
    target stops at ``most`` times its source's size and the excess is shared again by weight until
    none is above. Only two sums a round reach the driver.
    """
    numbered = exact_row_number(sources, [], [F.col("source").asc_nulls_last()], "place")
    turn = F.array(*(F.lit(float(w)) for w in weights))
    rows = cut(numbered.withColumn("weight", F.element_at(turn, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))))
    cap = F.col("source_size") * float(most)
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    rate = 0.0
    while True:
        # Shares only grow from round to round, so a source once full stays full.
        full = F.col("weight") * rate >= cap
        held, free = rows.agg(
            F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        new = (total - (held or 0.0)) / free if free else rate
        if new <= rate:
            break
        rate = new
    return rows.select("source", "source_size", F.least(F.col("weight") * rate, cap).alias("target"))


def seats(weight: Column, divisor: float) -> Column:
    """Seats of a weight at one divisor: quotients weight/1, weight/3, ... in halves."""
    return F.floor(weight / divisor + 0.5)


def sainte_lague(cells: DataFrame, weight: str, total: int, order: list[str]) -> DataFrame:
    """Add ``quota``: ``total`` seats dealt to ``cells`` by the highest quotients weight/(2k-1).

    The divisor at which the seats add up is searched for with ``TRIES`` candidates in one
    aggregate a round. Seats that tie at the last quotient go by ``order``. ``cells`` must be
    stored: it is read once a round.
    """
    w = F.col(weight)
    size = cells.agg(F.sum(w)).first()[0] or 0.0
    if not size or total <= 0:
        return cells.withColumn("quota", F.lit(0).cast("bigint"))
    low, high = size / (total + cells.count() + 1), 2 * size + 1.0  # too many seats, none
    while True:
        tried = [low + (high - low) * i / (TRIES + 1) for i in range(1, TRIES + 1)]
        counts = cells.agg(*(F.sum(seats(w, d)) for d in tried)).first()
        above = max([low, *(d for d, n in zip(tried, counts) if n >= total)])
        below = min([high, *(d for d, n in zip(tried, counts) if n < total)])
        if any(n == total for n in counts):
            exact = next(d for d, n in zip(tried, counts) if n == total)
            return cells.withColumn("quota", seats(w, exact).cast("bigint"))
        if (above, below) == (low, high) or below - above <= 1e-13 * below:
            break
        low, high = above, below
    # Between the two divisors lie only seats with one and the same quotient: a tie.
    sure, more = seats(w, high).cast("bigint"), (seats(w, low) - seats(w, high)).cast("bigint")
    left = total - (cells.agg(F.sum(sure)).first()[0] or 0)
    tied = exact_row_number(cells.where(more > 0).select(*order), [], [F.col(c) for c in order], "_n")
    extra = tied.select(*order, (F.col("_n") <= left).cast("bigint").alias("_extra"))
    on = [F.col("c." + c).eqNullSafe(F.col("e." + c)) for c in order]
    return (
        cells.withColumn("_sure", sure).alias("c").join(extra.alias("e"), on, "left")
        .select("c.*", (F.col("_sure") + F.coalesce("_extra", F.lit(0))).alias("quota")).drop("_sure")
    )


def taken_before(x: Column, cell: Column, quota: Column, draw: Column, block: int) -> Column:
    """Words taken from the first ``x`` words of a cell that got ``quota`` blocks' worth of words.

    The cell is one line of n equal blocks of about ``block`` words. It is passed whole as often as
    the quota allows; what is left is worth r blocks, and those at which (j*r + start) div n steps up
    are chosen: a seeded systematic draw of r blocks, rounded up or down without bias, that needs no
    list of blocks. Nothing is taken more than ``MOST`` times.
    """
    words = F.least(quota * float(block), cell * float(MOST))
    blocks = F.greatest(F.ceil(cell / block), F.lit(1))
    width = F.greatest(cell, F.lit(1)) / blocks
    rounds = F.floor(words / F.greatest(cell, F.lit(1)))
    rest = (words - rounds * cell) / width
    at = F.floor(x / width)
    steps = lambda j: F.floor((j * rest + draw * blocks) / blocks)
    done = rounds * x + (steps(at) - steps(F.lit(0))) * width + (steps(at + 1) - steps(at)) * (x - at * width)
    return F.floor(done + 0.5)


def mix(docs: DataFrame, seed: int = 7, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs``.

    Rows are dealt to shards by a seeded hash, so that a hot source fills as many shards as its
    words need; blocks of ``block`` words are apportioned to sources by their targets, then to the
    shards of each source; inside a shard rows lie in seeded order and the chosen blocks say how
    many words of each row the mix takes, at most three times its size. Null texts have size 0 and
    take nothing; a null source is a source of its own, last in order. The hash is of id and text, so rows without an
    id, or with one id, lie in as many shards as others. Rows equal in all of this are one row with a count until the end, where
    they lie side by side (equal rows may swap what they take). ``draw`` is the hash. Empty input gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sized = cut(
        docs.select(
            F.col("doc_id").cast(kind), F.col("source").cast("string").alias("source"), n_words_of(F.col("text")).alias("size"),
            F.xxhash64(F.lit(seed), "doc_id", F.col("text").cast("string")).alias("_draw"),
        ).groupBy("doc_id", "source", "size", "_draw").agg(F.count(F.lit(1)).alias("_times"))
    ).withColumn("_words", F.col("size") * F.col("_times"))
    words = sized.agg(F.sum("_words")).first()[0] or 0
    shards = max(1, -(-words // shard))
    placed = sized.withColumn("_shard", F.pmod("_draw", F.lit(shards)))
    cells = cut(placed.groupBy("source", "_shard").agg(F.sum("_words").alias("_cell")))
    sources = cells.groupBy("source").agg(F.sum("_cell").alias("source_size"))
    aimed = targets(sources)
    dealt = cut(sainte_lague(cut(aimed), "target", round(words / block), ["source"]))
    on = F.col("c.source").eqNullSafe(F.col("s.source"))
    shares = cut(
        cells.alias("c").join(dealt.withColumnRenamed("quota", "_seats").alias("s"), on)
        .select("c.*", "s.source_size", "s.target", "s._seats")
    )
    quotas = shard_quotas(shares, block)
    at = [F.col("d.source").eqNullSafe(F.col("q.source")), F.col("d._shard") == F.col("q._shard")]
    laid = placed.alias("d").join(quotas.alias("q"), at).select(
        "d.doc_id", "d.source", "d._shard", "d._draw", "d.size", "d._times", "d._words", "q.source_size", "q.target", "q._cell", "q.quota"
    )
    line = Window.partitionBy("source", "_shard").orderBy("_draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    starts = laid.withColumn("_from", F.sum("_words").over(line) - F.col("_words"))
    # Copies are numbered in parts, so that no array of all of them is made.
    parts = starts.withColumn("_part", F.explode(F.expr(f"sequence(0L, (_times - 1) div {COPIES})")))
    copies = parts.withColumn("_copy", F.explode(F.expr(f"sequence(_part * {COPIES} + 1, least((_part + 1) * {COPIES}, _times))")))
    ends = copies.withColumn("_end", F.col("_from") + F.col("size") * F.col("_copy"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "source", "_shard"), F.lit(1 << 20)) / float(1 << 20)
    until = lambda x: taken_before(x, F.col("_cell"), F.col("quota"), draw, block)
    taken = until(F.col("_end")) - until(F.col("_end") - F.col("size"))
    return ends.select(
        "doc_id", "source", "size", "source_size", "target", F.least(taken, MOST * F.col("size")).cast("bigint").alias("taken"),
        F.col("_draw").alias("draw"),
    )


def whole_copies(mixed: DataFrame, seed: int = 7, shard: int = SHARD) -> DataFrame:
    """Add ``times`` to rows of ``mix``: whole copies whose words add up to the words taken.

    A row is kept floor(taken / size) times, and once more with the chance of what is left over its
    size. These chances are drawn systematically inside (source, shard) with the rows in order of
    size, so neighbours in the draw have about the same size and the words kept differ from the words
    taken by at most about the largest row of each shard.
    """
    rows = cut(mixed)
    shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // shard))
    size = F.greatest("size", F.lit(1))
    split = rows.withColumn("_shard", F.pmod("draw", F.lit(shards)))
    split = split.withColumn("_chance", (F.col("taken") % size) / size)
    line = Window.partitionBy("source", "_shard").orderBy("size", F.xxhash64(F.lit(seed + 1), "draw"), "doc_id", "taken")
    start = F.pmod(F.xxhash64(F.lit(seed), "source", "_shard"), F.lit(1 << 20)) / float(1 << 20)
    until = lambda last: start + F.coalesce(F.sum("_chance").over(line.rowsBetween(Window.unboundedPreceding, last)), F.lit(0.0))
    times = F.floor(F.col("taken") / size) + F.floor(until(0)) - F.floor(until(-1))
    return split.withColumn("times", times.cast("int")).drop("_shard", "_chance")


def shard_quotas(shares: DataFrame, block: int) -> DataFrame:
    """Add ``quota`` to the cells: each source's ``_seats`` by highest quotients of its cells' sizes.

    The whole part of a cell's exact share less two is sure; the seats still open go to the highest
    of the next quotients. Their window is a source's cells only: some rows per million words.
    """
    exact = F.col("_seats") * F.col("_cell") / F.greatest(F.col("source_size"), F.lit(1))
    sure = F.greatest(F.floor(exact) - 2, F.lit(0)).cast("bigint")
    based = shares.withColumn("_sure", sure).withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    open_seats = based.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn(
        "_quotient", F.col("_cell") / (2 * (F.col("_sure") + F.col("_k")) - 1)
    )
    per_source = based.groupBy("_key").agg(F.sum("_sure").alias("_all_sure"))
    ranked = exact_row_number(
        open_seats.select("_key", "_shard", "_seats", "_quotient", "_k"), ["_key"],
        [F.col("_quotient").desc(), F.col("_shard"), F.col("_k")], "_n",
    )
    won = (
        ranked.join(per_source, "_key").where(F.col("_n") <= F.col("_seats") - F.col("_all_sure"))
        .groupBy("_key", "_shard").agg(F.count(F.lit(1)).alias("_won"))
    )
    return based.join(won, ["_key", "_shard"], "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0)))


@query("op8_sainte_lague_mix")
def op8_sainte_lague_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
