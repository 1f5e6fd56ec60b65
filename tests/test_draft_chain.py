"""Drafts with their chunk, file and scan."""

from __future__ import annotations

from auditlake.operators.joins import draft_chain


def test_drafts_without_a_chunk_do_not_meet_on_null(spark):
    drafts = spark.createDataFrame(
        [(i, 1, i if i % 3 else None, "own" if i == 4 else None) for i in range(1, 9)], "draft_id int, scan_id int, chunk_id int, draft_path string"
    )
    chunks = spark.createDataFrame([(1, 10, 1, 4), (2, 11, 5, 8), (2, 11, 9, 9), (4, None, 1, 2), (5, 12, 3, 4)], "chunk_id int, file_id int, start_line int, end_line int")
    files = spark.createDataFrame([(10, "a"), (11, "b"), (11, "c"), (None, "none")], "file_id int, file_path string")
    scans = spark.createDataFrame([(1, "t"), (2, "u")], "scan_id int, target string")
    found = draft_chain(drafts, chunks, files, scans)
    got = sorted((r.draft_id, r.start_line or 0, r.path, r.target) for r in found.collect())
    assert got == [
        (1, 1, "a", "t"), (2, 5, "b", "t"), (2, 5, "c", "t"), (2, 9, "b", "t"), (2, 9, "c", "t"), (3, 0, "unknown", "t"), (4, 1, "own", "t"),
        (5, 3, "unknown", "t"), (6, 0, "unknown", "t"), (7, 0, "unknown", "t"), (8, 0, "unknown", "t"),
    ]
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.index("LeftOuter, (chunk_id") < plan.index("LeftOuter, (chunk_file")  # files are looked up below the drafts
