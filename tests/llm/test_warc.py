from __future__ import annotations

import hashlib

import zstandard

from auditlake.llm import warc


def plain(rows):
    last, count = {}, {}
    for i, _, html in rows:
        data = (html or "").encode()
        count[data] = count.get(data, 0) + 1
        if i is not None:
            last[data] = max(i, last.get(data, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        other = len(data) >= 1000 and data in last and last[data] != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if other else "response", last[data] if other else None))
    return sorted(out, key=repr)


def test_archive_round_trip(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}/é {i}", f"<p>{'é' * (i % 900)}{i % 40}</p>") for i in range(800)]
    rows += [(2000, "u", None), (2001, None, ""), (None, "u", "z" * 1500), (2002, "u", "z" * 1500), (2002, "u", "z" * 1500), (2003, "u", "z" * 1500)]
    rows += [(2004, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 100), (2005, "u", "long " * 500_000), (2006, "u\r\nX: y", "é" * 499), (2007, "u", "é" * 499)]
    rows += [(None, None, "only null ids" * 200), (None, None, "only null ids" * 200)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, digest string, payload string")
    found = warc.archive_pages(pages.repartition(3), str(tmp_path / "a"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in found.select(columns).collect()), key=repr) == plain(rows)
    bundles = spark.read.parquet(str(tmp_path / "a"))
    (tmp_path / "files").mkdir()
    warc.export_files(bundles, str(tmp_path / "files"))
    index = {b["bundle"]: b["index"] for b in bundles.collect()}
    seen = 0
    for file in (tmp_path / "files").iterdir():
        data = file.read_bytes()
        # Any Zstandard reader sees one stream and skips the seek table.
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        frames = [warc.read_frame(data, k) for k in range(len(warc.seek_table(data)))]
        assert whole == b"".join(frames)
        for entry in index[file.name.split(".")[0]]:
            piece = frames[entry["frame"]][entry["offset"] : entry["offset"] + entry["length"]]
            assert piece.startswith(b"WARC/1.1\r\n") and piece.endswith(b"\r\n\r\n")
            seen += 1
    assert seen == len(rows)
    assert warc.archive_pages(pages.limit(0), str(tmp_path / "b")).collect() == []
