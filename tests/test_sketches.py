"""Sketches against exact results: bounds hold, and hours unite to the whole."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from auditlake.operators import sketches as K

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(7)
    rows = [
        (
            rng.choice(["hot"] * 9 + ["b", None]), START + timedelta(minutes=rng.randint(0, 3000)),
            rng.choice([None, 0, -3, *[int(rng.lognormvariate(5, 2)) for _ in range(20)]]), f"u{int(rng.paretovariate(0.4)) % 3000}",
            rng.choice([None, f"error {int(rng.paretovariate(0.7)) % 500}"]),
        )
        for _ in range(6000)
    ]
    return rows, spark.createDataFrame(rows, "model string, at timestamp, ms bigint, user string, error string")


def test_quantiles(log):
    rows, df = log
    sketch = K.quantile_sketch(df, ["model"], "at", "ms")
    assert sketch.columns == ["model", "hour", "bucket", "n"] and sketch.select("hour").distinct().count() > 40
    shares = {"p1": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    values = defaultdict(list)
    for model, _, ms, *_ in rows:
        if ms is not None:
            values[model].append(max(ms, 0))
    got = {r.model: r for r in K.quantiles(sketch, ["model"], shares).collect()}
    assert got.keys() == values.keys()
    for model, own in values.items():
        own.sort()
        assert got[model].n == len(own)
        for name, share in shares.items():
            exact = own[math.ceil(share * len(own)) - 1]
            assert abs(got[model][name] - exact) <= K.ACCURACY * exact + 1e-9
    assert K.quantiles(sketch.limit(0), ["model"], shares).count() == 0


def test_distinct(log):
    rows, df = log
    users = defaultdict(set)
    for model, _, _, user, _ in rows:
        users[model].add(user)
    got = {r.model: r.n_distinct for r in K.distinct_counts(K.distinct_sketch(df, ["model"], "at", "user"), ["model"]).collect()}
    assert all(abs(got[m] - len(u)) <= max(1, 0.05 * len(u)) for m, u in users.items()) and got.keys() == users.keys()


def test_frequencies(log):
    rows, df = log
    counts = Counter((r[0], r[4]) for r in rows if r[4] is not None)
    asked = df.select("model", "error").where("error IS NOT NULL").unionByName(df.selectExpr("model", "'never seen' AS error"))
    for depth, slots in [(K.ROWS, K.SLOTS), (2, 16)]:
        sketch = K.frequency_sketch(df, ["model"], "at", "error", depth, slots)
        got = {(r.model, r.error): r.estimate for r in K.frequencies(sketch, asked, ["model"], "error", depth, slots).collect()}
        assert counts.keys() <= got.keys() and all(got[k] >= n for k, n in counts.items())
        assert sketch.where("row = 0").agg(F.sum("n")).first()[0] == sum(counts.values())
    wide = K.frequency_sketch(df, ["model"], "at", "error")
    close = K.frequencies(wide, asked, ["model"], "error").collect()
    assert sum(r.estimate - counts[(r.model, r.error)] for r in close) <= 0.02 * sum(counts.values())
