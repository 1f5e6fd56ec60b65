"""Sources, sinks and streams over small files."""

from __future__ import annotations

import hashlib
import hmac
import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from auditlake.sources import files as SF, sinks as SK
from auditlake.streaming import jobs as SJ

LOG = "log_id bigint, model_name string, created_at timestamp, parse_success boolean"


def test_source_tree_keeps_known_extensions(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.PY").write_bytes(b"x = '\xff'\n")
    (tmp_path / "b.c").write_text("int a;")
    (tmp_path / "c.md").write_text("no")
    got = {r.path.rsplit("/", 1)[1]: r.content for r in SF.read_source_tree(spark, str(tmp_path)).collect()}
    assert got == {"a.PY": "x = ''\n", "b.c": "int a;"}


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.c", "one")
        z.writestr("y.c", "two")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("z.py")
        info.size = 5
        t.addfile(info, io.BytesIO(b"three"))
    got = {(r.member, r.content) for r in SF.read_archives(spark, str(tmp_path)).collect()}
    assert got == {("d/x.c", "one"), ("y.c", "two"), ("z.py", "three")}


def test_header_metadata_reads_twenty_lines(spark):
    text = "// @benchmark_finding: Overflow \n" + "x\n" * 19 + "// @benchmark_line: 3"
    df = spark.createDataFrame([(text,)], "content string")
    assert df.select(SF.header_metadata("content").alias("m")).first().m == {"finding": "Overflow"}


def test_replace_touches_its_scans_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "scan_id bigint, v string")
    SK.append_facts(rows, path)
    SK.append_facts(spark.createDataFrame([(3, "d")], "scan_id bigint, v string"), path)
    SK.replace_scans(spark.createDataFrame([(2, "c")], "scan_id bigint, v string"), path, [2, 3, 9])
    assert {(r.scan_id, r.v) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}


def test_signature(spark):
    df = spark.createDataFrame([("{}",), ("é" * 100,)], "p string")
    for key in ("k", "K" * 64, "long é " * 30):
        want = ["sha256=" + hmac.new(key.encode(), p.encode(), hashlib.sha256).hexdigest() for p in ("{}", "é" * 100)]
        assert [r[0] for r in df.select(SK.sign(key)("p")).collect()] == want


def write_log(spark, path, rows):
    spark.createDataFrame(rows, "log_id bigint, model_name string, sec int, parse_success boolean").select(
        "log_id", "model_name", F.timestamp_seconds(F.col("sec")).alias("created_at"), "parse_success"
    ).coalesce(1).write.mode("append").parquet(path)


def test_pause_signals_span_batches(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    write_log(spark, source, [(i, "m", i, False) for i in range(3)])
    stream = SJ.file_stream(spark, source, LOG)
    out = SJ.pause_signals(stream, state)
    write_log(spark, source, [(i, "m", i, False) for i in range(3, 6)] + [(6, "m", 6, True), (7, "n", 7, False)])
    SJ.pause_signals(SJ.file_stream(spark, source, LOG), state)
    assert [(r.log_id, r.streak) for r in SJ.stored(spark, out).collect()] == [(4, 5)]


def test_intake_resumes(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    write_log(spark, source, [(1, "m", 1, True)])
    SJ.intake(SJ.file_stream(spark, source, LOG), state)
    write_log(spark, source, [(2, "m", 2, True)])
    out = SJ.intake(SJ.file_stream(spark, source, LOG), state)
    assert sorted(r.log_id for r in SJ.stored(spark, out).collect()) == [1, 2]


def test_streams_over_part_files_with_an_empty_one(spark, tmp_path):
    parts, single = str(tmp_path / "in.parquet"), tmp_path / "one.parquet"
    rows = [(i, "mn"[i % 2], i, i % 7 == 0) for i in range(60)]
    for part in (rows[:20], [], rows[20:45], rows[45:]):
        write_log(spark, parts, part)
    import pandas as pd

    frame = pd.DataFrame(rows, columns=["log_id", "model_name", "sec", "parse_success"])
    frame["created_at"] = pd.to_datetime(frame.pop("sec"), unit="s", utc=True).astype("datetime64[us, UTC]")
    frame.to_parquet(single)
    found = {}
    for name, source, per_trigger in (("parts", parts, 1), ("single", str(single), 64)):
        stream = lambda: SJ.file_stream(spark, source, LOG, per_trigger)  # noqa: B023, E731
        state = lambda job: str(tmp_path / name / job)  # noqa: B023, E731
        intake = SJ.stored(spark, SJ.intake(stream(), state("intake")))
        counts = SJ.newest_counts(spark, SJ.live_counts(stream(), ["model_name"], state("counts")), ["model_name"])
        windows = SJ.newest_counts(spark, SJ.recent_activity(stream(), state("windows")), ["window_start", "model_name"])
        pauses = SJ.stored(spark, SJ.pause_signals(stream(), state("pauses")))
        distinct = SJ.stored(spark, SJ.deduplicated(stream(), "model_name", "created_at", state("distinct")))
        found[name] = [
            sorted(r.log_id for r in intake.collect()), sorted(map(tuple, counts.collect())), sorted(map(tuple, windows.collect())),
            sorted(map(tuple, pauses.select("model_name", "log_id").collect())), sorted(r.model_name for r in distinct.collect()),
        ]
    assert found["parts"] == found["single"]
    assert found["parts"][0] == list(range(60)) and found["parts"][1] == [("m", 30), ("n", 30)]
    # The newest windows are open and still counted.
    assert max(w for w, _, _ in found["parts"][2]).minute == 0 and len(found["parts"][2]) == 10


def test_a_stream_that_saw_nothing_leaves_an_empty_table(spark, tmp_path):
    source = str(tmp_path / "in.parquet")
    write_log(spark, source, [])
    for job in (SJ.intake, SJ.pause_signals):
        out = job(SJ.file_stream(spark, source, LOG), str(tmp_path / job.__name__))
        assert SJ.stored(spark, out).collect() == []


def test_result_files(spark, tmp_path):
    (tmp_path / "gpt_results.json").write_text('[\n  {"id": 1, "vote": "REAL"},\n  {\n    "id": 2,\n    "vote": null\n  }\n]\n')
    (tmp_path / "phi.json").write_text('{"id": 3, "vote": "x"}\nnot json\n\n{"id": 4}\n')
    got = {tuple(r) for r in SF.read_results(spark, str(tmp_path), "id bigint, vote string").collect()}
    assert got == {(1, "REAL", "gpt"), (2, None, "gpt"), (3, "x", "phi"), (4, None, "phi")}
    assert SF.read_results(spark, str(tmp_path / "none"), "id bigint, vote string").collect() == []


def test_result_lines_are_read_by_blocks(spark, tmp_path):
    """A file of JSON lines is cut into blocks and lines; files that begin with a bracket are arrays, odd names included."""
    folder = tmp_path / "model_name=a b%3Ac+d"
    folder.mkdir()
    (folder / "part-[0] 1.json").write_text("\r\n \t\n" + "".join(f'{{"id": {i}, "vote": "v"}}\r\n' for i in range(5000)) + '[1]\n{"id": 5000}')
    (tmp_path / "x{y}*_results.json").write_text('\n \n [{"id": 1},\n{"id": 2, "vote": "w"}]')
    (tmp_path / "skipped.txt").write_text('{"id": 9}')
    blocks = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        found = SF.read_results(spark, str(tmp_path), "id bigint, vote string")
        got = list(map(tuple, found.collect()))
        tasks = found.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", blocks)
    want = [(i, "v", "a b%3Ac+d") for i in range(5000)] + [(5000, None, "a b%3Ac+d"), (1, None, "x{y}*"), (2, "w", "x{y}*")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert tasks > 5  # the one file of 5,001 lines alone
