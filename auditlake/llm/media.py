"""Media columns stored as content-defined chunks, each distinct shared chunk once."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import by_bytes
from auditlake.llm.registry import query, table
from auditlake.session import scratch_path

#: Chunks end where the top bits of the gear hash are zero: 1 KiB on average, within these lengths.
TOP_BITS, SHORTEST, LONGEST = 10, 256, 8192
WINDOW = 32
GEAR = np.random.RandomState(20240131).randint(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
#: Bits of the set of digests that occur twice or more: 4 MiB at any size of the input.
BITS = 1 << 25
PAD, FRAME = 255, 576
MAGIC = b"CDC1"
ROWS = 4 << 20


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes of a text, padded to a positive multiple of 576 bytes."""
    data = (text or "").encode()
    return data + bytes([PAD]) * (FRAME - len(data) % FRAME if not data or len(data) % FRAME else 0)


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks. The rolling gear hash looks at 32 bytes, wherever they lie."""
    found = []
    for at in range(0, len(data), 1 << 20):
        start = max(0, at - WINDOW + 1)
        h = GEAR[np.frombuffer(data, np.uint8, min(len(data), at + (1 << 20)) - start, start)]
        step = 1
        while step < WINDOW:  # sums over windows of 2, 4, ... bytes
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
            step *= 2
        hits = np.flatnonzero(h >> np.uint32(32 - TOP_BITS) == 0) + start + 1
        found.extend(hits[hits > at].tolist())
    ends, last = [], 0
    for end in [*found, len(data)]:
        while end - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if end - last >= SHORTEST or end == len(data):
            if end > last:
                ends.append(end)
            last = end
    return ends


def chunks_of(data: bytes) -> list[bytes]:
    ends = cut_points(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def manifest_of(size: int, digests: list[bytes], lengths: list[int]) -> bytes:
    """The stored form of a payload: its length and its chunks' lengths and digests in order."""
    return MAGIC + struct.pack("<Q", size) + b"".join(struct.pack("<I", n) + d for n, d in zip(lengths, digests))


def read_manifest(manifest: bytes) -> tuple[int, list[tuple[int, bytes]]]:
    if manifest[:4] != MAGIC:
        raise ValueError("not a chunk list")
    entries = manifest[12:]
    chunks = [(struct.unpack_from("<I", entries, i)[0], entries[i + 4 : i + 36]) for i in range(0, len(entries), 36)]
    return struct.unpack_from("<Q", manifest, 4)[0], chunks


def place_of(digest: bytes) -> int:
    """Bit of a digest in the set of repeated digests."""
    return int.from_bytes(digest[:8], "little") % BITS


def repeated_digests(docs: DataFrame) -> bytes:
    """A bit set of the digests that occur twice or more in all payloads.

    Its size is fixed; two digests may share a bit, which only makes a chunk count as repeated that
    is not, and stores it in the shared table. As the set fills up, more chunks are shared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", ROWS):
            heads = [
                int.from_bytes(hashlib.sha256(c).digest()[:8], "little", signed=True)
                for t in batch.column("text").to_pylist() for c in chunks_of(payload_of(t))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.int64())], names=["head"])

    heads = docs.select("text").mapInArrow(run, "head bigint")
    again = heads.groupBy("head").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    place = again.select((F.col("head").bitwiseAND(F.lit(BITS - 1)) + 1).alias("place"))
    maps = place.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    out = bytearray(BITS // 8)
    for row in maps.collect():  # at most 1024 rows of 4 KiB
        out[(row.bucket - 1) * 4096 : row.bucket * 4096] = row.bits
    return bytes(out)


def in_set(bits: bytes, digest: bytes) -> bool:
    place = place_of(digest)
    return bool(bits[place >> 3] >> (place & 7) & 1)


def write_media(docs: DataFrame, path: str) -> None:
    """Write the payloads of ``docs`` (doc_id, text) as two tables under ``path``.

    ``media``: one row a document with its chunk list and the bytes of the chunks that occur nowhere
    else; ``chunks``: the other chunks, each digest once. Payloads stay where they are read; only
    repeated chunks are shuffled, by digest, after each task has dropped those it has seen.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    bits = repeated_digests(rows)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", ROWS):
            out = []
            for text in batch.column("text").to_pylist():
                data = payload_of(text)
                parts = chunks_of(data)
                digests = [hashlib.sha256(c).digest() for c in parts]
                shared = [k for k, d in enumerate(digests) if in_set(bits, d)]
                own = b"".join(c for c, d in zip(parts, digests) if not in_set(bits, d))
                out.append((
                    len((text or "").encode()), hashlib.sha256(data).digest(), manifest_of(len(data), digests, list(map(len, parts))),
                    own, [{"seq": k, "digest": digests[k]} for k in shared],
                ))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.struct([("seq", pa.int32()), ("digest", pa.binary())]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_bytes", "payload", "manifest", "own", "shared"],
            )

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", ROWS):
            seen: dict[bytes, bytes] = {}
            for text in batch.column("text").to_pylist():
                for chunk in chunks_of(payload_of(text)):
                    digest = hashlib.sha256(chunk).digest()
                    if digest not in seen and in_set(bits, digest):
                        seen[digest] = chunk
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], names=["digest", "bytes"])

    schema = f"doc_id {kind}, n_bytes bigint, payload binary, manifest binary, own binary, shared array<struct<seq int, digest binary>>"
    to = lambda df, name: df.write.option("compression", "zstd").mode("overwrite").parquet(f"{path}/{name}")
    to(rows.mapInArrow(media, schema), "media")
    to(rows.select("text").mapInArrow(repeated, "digest binary, bytes binary").dropDuplicates(["digest"]), "chunks")


def rebuild(manifest: bytes, own: bytes, parts: dict[int, bytes]) -> bytes:
    """A payload from its chunk list, its own bytes and the shared chunks by position; verified."""
    size, chunks = read_manifest(manifest)
    out, at = [], 0
    for seq, (length, digest) in enumerate(chunks):
        if seq in parts:
            chunk = parts[seq]
        else:
            chunk = own[at : at + length]
            at += length
        if len(chunk) != length or hashlib.sha256(chunk).digest() != digest:
            raise ValueError("a chunk is missing or damaged")
        out.append(chunk)
    data = b"".join(out)
    if len(data) != size or at != len(own):
        raise ValueError("the chunks do not add up to the payload")
    return data


FEATURES = (
    "payload binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
)


def features_of(rows: DataFrame, extra: str = "") -> DataFrame:
    """Rebuild rows (payload, manifest, own, parts) and compute the features of what was read back."""
    carried = [c.split()[0] for c in extra.split(", ") if c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "manifest", ROWS // 16):
            out = []
            for row in batch.select(["payload", "manifest", "own", "parts"]).to_pylist():
                data = rebuild(row["manifest"], row["own"], {p["seq"]: p["bytes"] for p in row["parts"] or []})
                digest, form = hashlib.sha256(data), hashlib.sha256(row["manifest"])
                form.update(data)  # the stored form: the chunk list, then its chunks in order
                if digest.digest() != row["payload"]:
                    raise ValueError("a payload differs from what was written")
                samples = np.frombuffer(data, np.uint8)
                counts = np.bincount(samples, minlength=256)
                feature = f"chunks={(len(row['manifest']) - 12) // 36};sum={int(samples.sum(dtype=np.int64))};values={int((counts > 0).sum())};mode={int(counts.argmax())}"
                out.append((row["payload"], len(data), digest.hexdigest(), zlib.crc32(data[-32:]), len(row["manifest"]) + len(data), form.hexdigest(), feature))
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [c.split()[0] for c in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*carried, *names]
            )

    return rows.mapInArrow(run, f"{extra}, {FEATURES}" if extra else FEATURES)


def read_media(spark, path: str) -> DataFrame:
    """doc_id, n_bytes and the features of every stored payload, rebuilt from its chunk list.

    Payloads without shared chunks are rebuilt where they are read. Of the others, each row's own stored
    bytes (chunk list, own chunks, shared places, digest) are read and hashed, and rows of equal bytes
    are rebuilt once: their chunk lists meet the chunk table by digest, the chunks meet their list
    by that hash, and the copies get the result by it. A damaged copy has a hash of its own, so it is
    rebuilt by itself and fails. A hot digest or hash is a row on one side, so an adaptive skew join
    splits the other. ``media_bytes`` and ``media_sha256`` are of the chunk list and its chunks.
    """
    media, chunks = spark.read.parquet(f"{path}/media"), spark.read.parquet(f"{path}/chunks")
    kind = media.schema["doc_id"].dataType.simpleString()
    empty = F.array().cast("array<struct<seq int, bytes binary>>")
    single = media.where(F.size("shared") == 0).withColumn("parts", empty)
    places = F.hex(F.xxhash64("shared"))
    stored = F.concat_ws(":", F.hex("payload"), F.sha2("manifest", 256), F.sha2("own", 256), places)
    mixed = media.where(F.size("shared") > 0).withColumn("stored", stored)
    once = mixed.select("stored", "payload", "manifest", "own", "shared").dropDuplicates(["stored"])
    wanted = once.select("stored", F.explode("shared").alias("c")).select("stored", "c.seq", "c.digest")
    parts = wanted.join(chunks, "digest").groupBy("stored").agg(F.collect_list(F.struct("seq", "bytes")).alias("parts"))
    rebuilt = features_of(once.drop("shared").join(parts, "stored"), "stored string")
    names = [c.split()[0] for c in FEATURES.split(", ")]
    ours = features_of(single.drop("shared"), f"doc_id {kind}, n_bytes bigint").select("doc_id", "n_bytes", *names)
    theirs = mixed.select("doc_id", "n_bytes", "stored").join(rebuilt, "stored", "left").select("doc_id", "n_bytes", *names)
    # A payload that no chunks were found for fails the job and is not left out.
    proven = theirs.withColumn("payload_sha256", F.coalesce("payload_sha256", F.raise_error(F.lit("a payload was not rebuilt"))))
    return ours.unionByName(proven).drop("payload")


def store_texts(docs: DataFrame, path: str) -> DataFrame:
    """Store the texts of ``docs`` as media under ``path`` and return what reading them back gives.

    A null or empty text is one frame of padding. A null id stays null; repeated rows are each
    returned and share their chunks; an empty table gives no rows; other columns are not read.
    """
    write_media(docs, path)
    return read_media(docs.sparkSession, path)


@query("op6_content_defined_media")
def op6_content_defined_media(spark, sf_dir):
    return store_texts(table(spark, sf_dir, "documents"), scratch_path(spark, "media"))
