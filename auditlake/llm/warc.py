"""WARC archives as seekable Zstandard bundles, written and read by Spark."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import by_bytes
from auditlake.llm.registry import query, table
from auditlake.session import scratch_path

#: Uncompressed bytes at which a frame, and compressed bytes at which a bundle is closed.
FRAME, BUNDLE = 256 << 10, 4 << 20
#: Payloads below this many bytes are never stored as revisits.
SMALLEST = 1000
#: Fixed values of the seekable format: skippable frame of the seek table, footer mark.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Every record carries the same date, so that equal input gives equal archives.
DATE = "2000-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit carries the full payload's digest and length but not its bytes."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    uri = "".join(c for c in url or "" if c.isprintable() and c not in "<>").strip() or "urn:page:unknown"
    block = HTTP if revisit else HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head.insert(6, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.insert(7, f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """Frames of whole records under one seek table, in memory until it is full."""

    def __init__(self) -> None:
        self.done, self.sizes, self.frame, self.frame_size, self.index = [], [], [], 0, []
        self.size = 0

    def add(self, key: int | None, data: bytes) -> None:
        self.index.append((key, len(self.sizes), self.frame_size, len(data)))
        self.frame.append(data)
        self.frame_size += len(data)
        if self.frame_size >= FRAME:
            self.close_frame()

    def close_frame(self) -> None:
        if self.frame:
            packed = zstandard.ZstdCompressor(level=3, write_content_size=True).compress(b"".join(self.frame))
            self.done.append(packed)
            self.sizes.append((len(packed), self.frame_size))
            self.size += len(packed)
            self.frame, self.frame_size = [], 0

    def close(self) -> bytes:
        """The file's bytes: frames, then the seek table as a skippable frame."""
        self.close_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        body = entries + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.done) + struct.pack("<II", SKIPPABLE, len(body)) + body


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of every frame, read from the end of the file."""
    count, flags, mark = struct.unpack("<IBI", data[-9:])
    if mark != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at, out = len(data) - 9 - count * width, []
    offset = 0
    for i in range(count):
        packed, size = struct.unpack_from("<II", data, at + i * width)
        out.append((offset, packed, size))
        offset += packed
    if struct.unpack_from("<II", data, offset) != (SKIPPABLE, count * width + 9):
        raise ValueError("the seek table does not follow the frames")
    return out


def read_frame(data: bytes, number: int) -> bytes:
    """Decompress one frame and nothing else."""
    offset, packed, size = seek_table(data)[number]
    return zstandard.ZstdDecompressor().decompress(data[offset : offset + packed], max_output_size=size)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records in a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        n = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + n]
        at = end + 8 + n


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses) of every page.

    Of equal payloads of at least ``SMALLEST`` bytes the largest page_id is the response. Only
    groups of two or more meet the pages again, by digest; a hot digest is one row of that side, so
    an adaptive skew join splits the pages' side.
    """
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn(
        "digest", F.sha1("payload")
    )
    groups = (
        rows.where(F.octet_length("payload") >= SMALLEST).groupBy("digest")
        .agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    )
    refers = F.when(F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last"))
    return rows.join(groups, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def pack(pages: DataFrame) -> DataFrame:
    """Bundles of ``planned`` rows: body (a whole .warc.zst file) and its index, one row a bundle.

    The index maps page_id to frame number, offset inside the decompressed frame, and length. Each
    task packs its own rows, so nothing is shuffled and memory is bounded by one bundle and one
    record. A lost task packs the same rows again; Spark's writer commits them once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(bundle: Bundle) -> pa.RecordBatch:
            body = bundle.close()
            names = ("page_id", "frame", "offset", "length")
            index = [dict(zip(names, entry)) for entry in bundle.index]
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in names]))
            return pa.RecordBatch.from_arrays(
                [pa.array([hashlib.sha1(body).hexdigest()]), pa.array([body], pa.binary()), pa.array([index], kind)],
                names=["bundle", "body", "index"],
            )

        bundle = Bundle()
        for batch in by_bytes(batches, "payload", 4 << 20):
            for row in batch.to_pylist():
                revisit = row["refers_to"] is not None
                bundle.add(row["page_id"], record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], revisit))
                if bundle.size >= BUNDLE:
                    yield closed(bundle)
                    bundle = Bundle()
        if bundle.index:
            yield closed(bundle)

    return pages.mapInArrow(
        run, "bundle string, body binary, index array<struct<page_id bigint, frame bigint, offset bigint, length bigint>>"
    )


def write_archive(pages: DataFrame, path: str) -> None:
    """Write the pages as bundles under ``path``, any file system that Spark writes to."""
    pack(planned(pages)).write.option("parquet.block.size", 32 << 20).mode("overwrite").parquet(path)


def read_archive(bundles: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, frame, offset of every record.

    Frames are decompressed one at a time through the seek table; every record must lie where the
    index says, and a response's bytes must have the digest and length of its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                body, index = batch.column("body")[i].as_py(), batch.column("index")[i].as_py()
                out = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "frame", "offset")}
                data, loaded = b"", -1
                for entry in index:
                    if entry["frame"] != loaded:
                        data, loaded = read_frame(body, entry["frame"]), entry["frame"]
                    head, block = next(parse(data[entry["offset"] : entry["offset"] + entry["length"]]))
                    key = head["WARC-Record-ID"][len("<urn:page:") : -1]
                    if key != ("none" if entry["page_id"] is None else str(entry["page_id"])):
                        raise ValueError(f"record {key} is not where the index says")
                    digest = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex()
                    length, refers = int(head["X-Payload-Length"]), None
                    if head["WARC-Type"] == "revisit":
                        refers = int(head["WARC-Refers-To"][len("<urn:page:") : -1])
                    else:
                        payload = block[len(HTTP) :]
                        if len(payload) != length or hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"record {key} is damaged")
                    for name, value in zip(out, (entry["page_id"], length, digest, head["WARC-Type"], refers, entry["frame"], entry["offset"])):
                        out[name].append(value)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    return bundles.select("body", "index").mapInArrow(
        run,
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, frame bigint, offset bigint",
    )


def export_files(bundles: DataFrame, folder: str) -> None:
    """Write each bundle as <bundle>.warc.zst into ``folder``, which all executors must have mounted.

    Names come from contents and files are moved into place whole, so a repeated task does no harm.
    """

    def run(rows) -> None:
        import os
        import tempfile

        for row in rows:
            handle, part = tempfile.mkstemp(dir=folder)
            with os.fdopen(handle, "wb") as out:
                out.write(bytes(row.body))
            os.replace(part, f"{folder}/{row.bundle}.warc.zst")

    bundles.select("bundle", "body").foreachPartition(run)


def archive_pages(pages: DataFrame, path: str) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) and return what reading back finds.

    A null html is an empty payload; null ids are stored as "none" and never referred to; repeated
    rows with the largest id are all responses; an empty table gives no records; columns other than
    these three are not read. ``path`` must lie in a folder that all executors share.
    """
    write_archive(pages, path)
    return read_archive(pages.sparkSession.read.parquet(path))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS last FROM p WHERE octet_length(encode(html)) >= 1000 GROUP BY html)
SELECT p.page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN g.last <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.last <> p.page_id THEN g.last END AS refers_to
FROM p LEFT JOIN g ON g.html = p.html
"""


@query("op2_warc_seekable_zstd", SQL)
def op2_warc_seekable_zstd(spark, sf_dir):
    found = archive_pages(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
