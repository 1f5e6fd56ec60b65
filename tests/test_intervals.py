"""As-of and overlap joins against plain loops."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from auditlake.operators.intervals import as_of_join, overlap_join, points_in_spans

START = datetime(2024, 1, 1)


def plain_as_of(left, right):
    out = []
    for row_id, key, at in left:
        best = [(since, price) for k, since, price in right if None not in (k, since, at) and k == key and since <= at]
        top = max(best, key=lambda r: (r[0], (r[1] is not None, r[1]))) if best else (None, None)
        out.append((row_id, *top))
    return out


def test_as_of(spark):
    rng = random.Random(4)
    when = lambda: rng.choice([None, *[START + timedelta(minutes=rng.randint(0, 300))] * 9])
    key = lambda: rng.choice(["hot"] * 18 + ["b", None])
    left = [(i, key(), when()) for i in range(1500)] + [(9000, "none", START), (1, "hot", START)]
    right = [(key(), when(), rng.choice([None, rng.randint(0, 9)])) for _ in range(120)]
    right += right[:5]
    calls = spark.createDataFrame(left, "row_id bigint, model string, at timestamp")
    prices = spark.createDataFrame(right, "model string, since timestamp, price bigint")
    got = as_of_join(calls, prices, ["model"], "at", "since", ["since", "price"], ["price"])
    assert got.columns == ["row_id", "model", "at", "since", "price"]
    order = lambda r: (r[0], str(r[1:]))
    assert sorted([(r.row_id, r.since, r.price) for r in got.collect()], key=order) == sorted(plain_as_of(left, right), key=order)
    assert as_of_join(calls, prices.limit(0), ["model"], "at", "since", ["price"]).where("price is not null").count() == 0
    assert as_of_join(calls.limit(0), prices, ["model"], "at", "since", ["price"]).count() == 0
    with pytest.raises(ValueError):
        as_of_join(calls, calls, ["model"], "at", "at", ["row_id"])


def test_a_hot_key_fills_several_ranges(spark):
    calls = spark.range(20_000).selectExpr("id", "'hot' AS model", "id AS at")
    prices = spark.range(0, 20_000, 50).selectExpr("'hot' AS model", "id AS since")
    got = as_of_join(calls, prices, ["model"], "at", "since", ["since"])
    assert got.where("since = at - at % 50").count() == 20_000


def test_overlap(spark):
    rng = random.Random(6)

    def spans(n, longest):
        out = []
        for i in range(n):
            first = rng.randint(-40, 400)
            out.append((i, rng.choice(["a", "a", "b", None]), rng.choice([first] * 20 + [None]), first + rng.randint(-2, longest)))
        return out

    left, right = spans(200, 9), spans(150, 120) + [(900, "a", -10**9, 10**9), (901, "a", 7, 7), (902, "b", 7, None)]
    got = overlap_join(
        spark.createDataFrame(left, "i bigint, file string, a bigint, b bigint"),
        spark.createDataFrame(right, "j bigint, file string, c bigint, d bigint"), ["file"], ("a", "b"), ("c", "d"),
    )
    want = [
        (i, j) for i, f, a, b in left for j, g, c, d in right
        if f is not None and f == g and None not in (a, b, c, d) and a <= b and c <= d and a <= d and c <= b
    ]
    rows = [(r.i, r.j) for r in got.collect()]
    assert sorted(rows) == sorted(want) and len(set(rows)) == len(rows)


def test_a_long_span_costs_few_nodes(spark):
    points = spark.createDataFrame([(i, 1, 10**12 + i) for i in range(50)], "p int, file int, at bigint")
    span = spark.createDataFrame([(1, 5, 10**15)], "file int, first bigint, last bigint")
    joined = points_in_spans(points, span, ["file"], "at", "first", "last")
    assert joined.count() == 50
    assert points_in_spans(points, span.limit(0), ["file"], "at", "first", "last").count() == 0
