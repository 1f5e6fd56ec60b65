"""SimHash near-duplicates: pigeonring candidates, Hamming check, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import by_bytes, components
from auditlake.llm.registry import query, table
from auditlake.session import cut

SEED, BITS = 42, 64
#: Shingles hashed at a time; a longer text is folded in pieces of this many.
FOLD = 1 << 16


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of a text as a signed 64-bit integer; zero for a text without words."""
    words = (text or "").encode().lower().split()  # both look at ASCII only
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(size)))))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(shingles), FOLD):
        part = shingles[i : i + FOLD]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), np.uint64, len(part))
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(shingles)).tobytes()
    return int.from_bytes(packed, "big", signed=True)


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (signed 64-bit SimHash over word shingles, repeats included); map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 4 << 20):
            prints = [fingerprint(t, size) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "fp"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, fp bigint"
    )


def segments(parts: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of consecutive segments that cover 64 bits."""
    ends = [BITS * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def segment(fp: Column, at: tuple[int, int]) -> Column:
    low, width = at
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def chain_holds(x: Column, start: int, parts: int, limit: int) -> Column:
    """Pigeonring: from ``start`` around the ring, the first l segments differ in at most l*limit/parts bits."""
    spans, total, holds = segments(parts), F.lit(0), F.lit(True)
    for length in range(1, parts + 1):
        total = total + F.bit_count(segment(x, spans[(start + length - 1) % parts]))
        holds = holds & (total <= length * limit // parts)
    return holds


def near_links(prints: DataFrame, limit: int = 2, parts: int = 7, bucket: int = 64) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all pairs within ``limit`` bits.

    If two fingerprints differ in at most ``limit`` bits, some segment of the ring starts a chain
    whose every prefix of l segments differs in at most l*limit/parts bits. The prefix with budget
    zero is an equality key: fingerprints meet on it, the longer chains prune what met, and only
    then the whole distance is counted. A key shared by more than ``bucket`` fingerprints pairs
    nothing: its members are linked through every value that is at most limit/2 bits away, which
    connects exactly the pairs within ``limit`` bits (for an even limit) in linear size.
    """
    if limit % 2:
        raise ValueError("limit must be even")
    zero = next(n for n in range(parts, 0, -1) if n * limit < parts)  # segments with no budget
    spans = segments(parts)
    keys = F.array(
        *(
            F.struct(
                F.lit(start).alias("start"),
                F.concat_ws("-", *(segment(F.col("fp"), spans[(start + i) % parts]) for i in range(zero))).alias("key"),
            )
            for start in range(parts)
        )
    )
    keyed = prints.select("fp", F.explode(keys).alias("k")).select("fp", F.xxhash64("k.start", "k.key").alias("key"), "k.start")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut(keyed.join(sizes, "key"))
    few = met.where(F.col("n") <= bucket).groupBy("key", "start").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = few.select(
        "start", "fps", F.posexplode("fps").alias("i", "a")
    ).select("start", "a", F.explode(F.slice("fps", F.col("i") + 2, F.lit(bucket))).alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    chained = F.lit(False)
    for start in range(parts):
        chained = chained | ((F.col("start") == start) & chain_holds(x, start, parts, limit))
    checked = pairs.where(chained).where(F.bit_count(x) <= limit).select("a", "b")
    crowded = met.where(F.col("n") > bucket).select("fp").distinct()
    masks = [0]
    for _ in range(limit // 2):
        masks = sorted({m ^ (1 << i) for m in masks for i in range(BITS)} | set(masks))
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    near = crowded.select("fp", F.explode(F.array(*map(F.lit, signed))).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("value")
    )
    lowest = near.groupBy("value").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = near.join(lowest, "value").where("fp != low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    return checked.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, limit: int = 2, size: int = 3) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id linked, itself included) of every row.

    Rows with equal fingerprints are one node, so a group of copies of any size costs one row
    after a combined minimum. Null and blank texts have fingerprint zero and are linked like any
    other. A null doc_id is never a component's smallest unless all its ids are null; repeated rows
    are each returned.
    """
    marked = cut(fingerprints(docs, size))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = components(near_links(nodes.select("fp"), limit))
    labels = nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    lowest = labels.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = labels.join(lowest, "component").select("fp", "component_id")
    return marked.join(named, "fp", "left")


@query("op10_simhash_pigeonring")
def op10_simhash_pigeonring(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
