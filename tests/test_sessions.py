"""Sessions of a stream against a plain pass over the rows, one unordered file a trigger."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

from auditlake.streaming import jobs as SJ
from auditlake.streaming import sessions as SS

START = datetime(2024, 3, 1)
SCHEMA = "model string, at timestamp, ms bigint"
GAP, LATE = timedelta(minutes=10), timedelta(minutes=45)
MEASURES = {"calls": ("count", "*"), "ms": ("sum", "ms"), "slowest": ("max", "ms")}


def plain(rows):
    by_key = defaultdict(list)
    for model, at, ms in rows:
        if at is not None:
            by_key[model].append((at, ms))
    out = []
    for model, own in by_key.items():
        own.sort(key=lambda r: r[0])
        group = []
        for at, ms in [*own, (datetime.max, None)]:
            if group and at - group[-1][0] >= GAP:
                known = [m for _, m in group if m is not None]
                out.append((model, group[0][0], group[-1][0], len(group), sum(known) if known else None, max(known, default=None)))
                group = []
            group.append((at, ms))
    return sorted(out, key=repr)


def told(df):
    return sorted(map(tuple, df.select("model", "session_start", "last_seen", "calls", "ms", "slowest").collect()), key=repr)


def batches(rng):
    out = []
    for b in range(7):
        rows = []
        for _ in range(rng.randint(0, 60) if b != 3 else 0):
            minute = b * 40 + rng.choice([rng.uniform(-90, 40), rng.uniform(-30, 40), 0, 10])
            model = rng.choice(["hot"] * 4 + ["b", "c", None])
            rows.append((model, None if rng.random() < 0.03 else START + timedelta(seconds=round(minute * 60)), rng.choice([None, 1, 50])))
        out.append(rows + rows[:2])
    return out


def test_table(spark):
    rows = [r for b in batches(random.Random(3)) for r in b]
    rows += [("edge", START + timedelta(minutes=m), 1) for m in (0, 10, 19, 28, 40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert told(SS.sessions(df, ["model"], "at", "10 minutes", MEASURES)) == plain(rows)
    assert SS.sessions(df.limit(0), ["model"], "at", "10 minutes", MEASURES).count() == 0


def test_stream_with_late_rows(spark, tmp_path):
    parts = batches(random.Random(11))
    table, state = str(tmp_path / "table"), str(tmp_path / "state")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(table)
        # A second and a third start go on with the state of the first.
        if i in (1, 4, 6):
            stream = SJ.file_stream(spark, table, SCHEMA, files_per_trigger=1)
            SS.session_job(stream, ["model"], "at", "10 minutes", "45 minutes", MEASURES, state)
    marks = {r.batch_id: r.newest and datetime(1970, 1, 1) + timedelta(microseconds=r.newest) for r in spark.read.parquet(f"{state}/marks").collect()}
    side = [tuple(r) for r in SS.late_rows(spark, state).collect()]
    everything = [r for rows in parts for r in rows]
    rest = list(everything)
    for r in side:
        rest.remove(r)
    found = SS.stored_sessions(spark, state)
    assert told(found) == plain(rest)
    assert sum(r.calls for r in found.collect()) + len(side) == len(everything)
    assert len(side) > 5 and any(at is not None for _, at, _ in side) and found.where("closed").count() > 5
    by_batch = spark.read.option("basePath", f"{state}/late").parquet(f"{state}/late").collect()
    for r in by_batch:
        assert r.at is None or r.at < marks[r.batch_id - 1] - LATE
    assert max(m for m in marks.values() if m) == max(at for _, at, _ in rest if at)


def test_nothing_seen(spark, tmp_path):
    table, state = str(tmp_path / "table"), str(tmp_path / "state")
    spark.createDataFrame([], SCHEMA).write.parquet(table)
    SS.session_job(SJ.file_stream(spark, table, SCHEMA), ["model"], "at", "10 minutes", "45 minutes", MEASURES, state)
    assert SS.stored_sessions(spark, state).count() == 0 and SS.late_rows(spark, state).count() == 0
