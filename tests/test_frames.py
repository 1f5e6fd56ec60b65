"""RANGE frames, ranks and tiles against plain loops and Spark's own windows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from auditlake.operators.frames import range_frame, tiles, value_ranks

START = datetime(2024, 1, 1)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def calls(spark):
    rng = random.Random(2)
    rows = [
        (i, rng.choice(["hot"] * 9 + ["b", None]), rng.choice([None] + [rng.randint(-60, 400)] * 15), rng.choice([None, *range(6)]))
        for i in range(900)
    ]
    rows += rows[:4] + [(1000, "alone", 5, 5), (1001, "blank", None, 3)]
    return spark.createDataFrame(rows, "id int, model string, at bigint, tokens int")


@pytest.mark.parametrize("before, after", [(0, 0), (7, 0), (3, 11), (10_000, 10_000)])
def test_range_frame(calls, before, after):
    got = range_frame(calls, ["model"], "at", before, after, {"n": ("count", F.lit(1)), "s": ("sum", "tokens"), "m": ("max", "id")})
    assert got.columns == ["id", "model", "at", "tokens", "n", "s", "m"]
    frame = Window.partitionBy("model").orderBy("at").rangeBetween(-before, after)
    want = calls.select("*", F.count(F.lit(1)).over(frame), F.sum("tokens").over(frame), F.max("id").over(frame))
    assert rows_of(got) == rows_of(want)


def test_range_frame_of_times_and_edges(spark):
    rows = [(i, START + timedelta(minutes=i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, ts timestamp")
    got = range_frame(df, [], "ts", timedelta(minutes=5), timedelta(0), {"n": ("count", F.lit(1))})
    assert sorted((r.id, r.n) for r in got.collect()) == [(i, min(i, 5) + 1) for i in range(200)]
    days = df.selectExpr("id", "date_add(date'2024-01-01', id) AS ts")
    got = range_frame(days, [], "ts", timedelta(days=2), timedelta(days=1), {"n": ("count", F.lit(1))})
    assert sum(r.n for r in got.collect()) == 200 + 199 + 198 + 199
    assert range_frame(df.limit(0), [], "ts", timedelta(1), timedelta(1), {"n": ("count", F.lit(1))}).count() == 0
    with pytest.raises(ValueError):
        range_frame(df, [], "ts", timedelta(1), timedelta(1), {"id": ("count", F.lit(1))})
    with pytest.raises(ValueError):
        range_frame(df.selectExpr("id", "0.5D AS ts"), [], "ts", 1, 1, {"n": ("count", F.lit(1))})


def test_one_key_and_one_position_fill_several_ranges(spark):
    many = spark.range(20_000).selectExpr("id", "'hot' AS model", "id AS at")
    assert range_frame(many, ["model"], "at", 99, 0, {"n": ("count", F.lit(1))}).where("n = least(id, 99) + 1").count() == 20_000
    tied = spark.range(4_000).selectExpr("id", "'hot' AS model", "7 AS at")
    assert range_frame(tied, ["model"], "at", 1, 1, {"n": ("count", "id")}).where("n = 4000").count() == 4_000


@pytest.mark.parametrize("descending", [False, True])
def test_ranks(calls, descending):
    got = value_ranks(calls, ["model"], "tokens", descending)
    by = F.desc_nulls_first("tokens") if descending else F.asc_nulls_last("tokens")
    w = Window.partitionBy("model").orderBy(by)
    want = calls.select(
        "*", F.rank().over(w).cast("bigint"), F.dense_rank().over(w).cast("bigint"), F.percent_rank().over(w), F.cume_dist().over(w)
    )
    assert got.columns[4:] == ["rank", "dense_rank", "percent_rank", "cume_dist"]
    assert rows_of(got) == rows_of(want)
    assert value_ranks(calls.limit(0), ["model"], "tokens").count() == 0


@pytest.mark.parametrize("n", [1, 7, 1000])
def test_tiles(calls, n):
    got = tiles(calls.dropDuplicates(), ["model"], ["tokens", "id"], n)
    w = Window.partitionBy("model").orderBy(F.asc_nulls_first("tokens"), "id")
    assert rows_of(got) == rows_of(calls.dropDuplicates().select("*", F.ntile(n).over(w)))
    with pytest.raises(ValueError):
        tiles(calls, ["model"], ["id"], 0)


def test_work_of_a_frame_does_not_grow_with_what_it_holds(spark):
    """Frames are made of running aggregates; a sliding window would add up every frame anew."""
    many = spark.range(3_000).selectExpr("id", "id % 2 AS model", "id - 1500 AS at", "cast(null AS bigint) AS none")
    aggs = {"n": ("count", F.lit(1)), "s": ("sum", "id"), "low": ("min", "id"), "high": ("max", "id"), "e": ("sum", "none")}
    got = range_frame(many, ["model"], "at", 700, 300, aggs)
    assert "RangeFrame, -" not in got._jdf.queryExecution().optimizedPlan().toString()
    frame = Window.partitionBy("model").orderBy("at").rangeBetween(-700, 300)
    kinds = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    want = many.select("*", *[kinds[k](c).over(frame).alias(n) for n, (k, c) in aggs.items()])
    assert rows_of(got) == rows_of(want)
