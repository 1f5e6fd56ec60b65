from __future__ import annotations

import hashlib
import random
import zlib

from auditlake.llm import media


def test_chunks_join_and_follow_content():
    rng = random.Random(1)
    for n in (0, 1, 255, 256, 575, 576, 5000, 3_000_000):
        data = rng.randbytes(n)
        parts = media.chunks_of(data)
        assert b"".join(parts) == data
        assert all(media.SHORTEST <= len(p) <= media.LONGEST for p in parts[:-1])
    data = rng.randbytes(200_000)
    moved = set(media.chunks_of(b"some new head" + data))
    assert len(moved & set(media.chunks_of(data))) > 0.9 * len(moved)
    assert media.cut_points(b"\0" * 20_000)[-1] == 20_000


def plain_chunks(data):
    """The rolling gear hash byte by byte, from the start of the payload."""
    gear = media.GEAR.tolist()
    out, start, h = [], 0, 0
    for i, byte in enumerate(data):
        h = (2 * h + gear[byte]) % 2**32
        hit = h >> (32 - media.TOP_BITS) == 0
        if i + 1 - start == media.LONGEST and i + 1 < len(data) or hit and i + 1 - start >= media.SHORTEST:
            out.append(data[start : i + 1])
            start = i + 1
    return out + ([data[start:]] if start < len(data) else [])


def test_cuts_equal_a_plain_gear_hash():
    rng = random.Random(6)
    for n in (1, 300, 8192, 8193, 100_000, (1 << 20) + 3000):
        for data in (rng.randbytes(n), bytes(rng.choices(b"abc ", k=n))):
            assert media.chunks_of(data) == plain_chunks(data)
    assert media.chunks_of(b"z" * 30_000) == plain_chunks(b"z" * 30_000)


def test_round_trip(spark, make_docs, tmp_path):
    rng = random.Random(2)
    base = [" ".join(rng.choices([f"w{k}é" for k in range(500)], k=1500)) for _ in range(6)]
    texts = [None, "", "a", "x" * 576, "é" * 288, *base, *base, *[f"{rng.random()} {t}" for t in base for _ in range(5)], "ab" * 400_000]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, base[0], None, None), (3, "x" * 576, "en", "s")]
    docs = make_docs(rows).repartition(5)
    got = media.store_texts(docs, str(tmp_path / "m")).collect()
    assert len(got) == len(rows)
    want = {(i, t) for i, t, *_ in rows}
    seen = {}
    for r in got:
        options = [t for i, t in want if i == r.doc_id and len((t or "").encode()) == r.n_bytes]
        data = media.payload_of(options[0])
        assert len(data) % 576 == 0 and data and data[r.n_bytes :] == b"\xff" * (len(data) - r.n_bytes)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        parts = plain_chunks(data)
        form = media.manifest_of(len(data), [hashlib.sha256(p).digest() for p in parts], list(map(len, parts))) + data
        assert (r.media_bytes, r.media_sha256) == (len(form), hashlib.sha256(form).hexdigest())
        counts = [data.count(bytes([v])) for v in range(256)]
        values = sum(c > 0 for c in counts)
        assert r.feature == f"chunks={len(parts)};sum={sum(data)};values={values};mode={counts.index(max(counts))}"
        assert seen.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    stored = spark.read.parquet(str(tmp_path / "m/chunks"))
    assert stored.count() == stored.select("digest").distinct().count() > 0
    inline = spark.read.parquet(str(tmp_path / "m/media")).selectExpr("sum(length(own))").first()[0]
    total = sum(len(media.payload_of(t)) for _, t, *_ in rows)
    assert inline + stored.selectExpr("sum(length(bytes))").first()[0] < 0.6 * total
    assert media.store_texts(docs.limit(0), str(tmp_path / "e")).collect() == []


def test_bits_hold_every_repeated_digest(spark, make_docs):
    texts = [str(i) * 400 for i in range(60)]
    bits = media.repeated_digests(make_docs([(i, t, None, None) for i, t in enumerate(texts + texts[:20])]))
    inside = [all(media.in_set(bits, hashlib.sha256(c).digest()) for c in media.chunks_of(media.payload_of(t))) for t in texts]
    assert all(inside[:20])


def test_damage_is_found():
    import pytest

    data = media.payload_of("hello world " * 500)
    parts = media.chunks_of(data)
    manifest = media.manifest_of(len(data), [hashlib.sha256(p).digest() for p in parts], list(map(len, parts)))
    assert media.rebuild(manifest, data, {}) == data
    for own in (data[:-1], b"x" + data[1:], data + b"x"):
        with pytest.raises(ValueError):
            media.rebuild(manifest, own, {})


def test_a_damaged_copy_fails(spark, make_docs, tmp_path):
    import pytest
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    text = " ".join(random.Random(8).choices([f"w{k}" for k in range(900)], k=3000))
    media.write_media(make_docs([(i, text, "en", "s") for i in range(4)]), str(tmp_path / "m"))
    assert media.read_media(spark, str(tmp_path / "m")).count() == 4
    rows = spark.read.parquet(str(tmp_path / "m/media"))
    for n, (name, new) in enumerate({"manifest": F.expr("overlay(manifest placing X'00' from 20)"), "own": F.expr("concat(own, X'00')"), "shared": F.expr("slice(shared, 2, 99999)")}.items()):
        bad = str(tmp_path / f"bad{n}")
        rows.withColumn(name, F.when(F.col("doc_id") == 2, new).otherwise(F.col(name))).write.parquet(f"{bad}/media")
        spark.read.parquet(str(tmp_path / "m/chunks")).write.parquet(f"{bad}/chunks")
        with pytest.raises(PySparkException):
            media.read_media(spark, bad).collect()
