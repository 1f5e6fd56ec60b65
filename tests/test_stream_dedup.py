"""Stream dedup over unordered files that take several triggers."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from auditlake.streaming import jobs as SJ


def test_rows_behind_the_newest_date_are_kept(spark, tmp_path):
    source = str(tmp_path / "in.parquet")
    rng = random.Random(4)
    rows = [(f"{d}:{k}", d * 86400 + rng.randrange(80000)) for d in (rng.randrange(2000) for _ in range(300)) for k in range(2)]
    rows += [(key, sec + 1) for key, sec in rows[::3]] + [(None, 5), (None, 6)]
    rng.shuffle(rows)
    for i in range(4):
        part = spark.createDataFrame(rows[i::4], "key string, sec long")
        part.select("key", F.timestamp_seconds("sec").alias("seen_at")).coalesce(1).write.mode("append").parquet(source)
    stream = SJ.file_stream(spark, source, "key string, seen_at timestamp", 1)
    out = SJ.deduplicated(stream, "key", "seen_at", str(tmp_path / "state"))
    got = [r.key for r in SJ.stored(spark, out).collect()]
    assert len(got) == len(set(got)) and set(got) == {key for key, _ in rows}
