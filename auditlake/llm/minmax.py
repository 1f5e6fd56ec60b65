"""Near copies by min-max hashing: bands of smallest and largest hashes, exact check, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from auditlake.llm.common import by_bytes, components
from auditlake.llm.registry import query, table
from auditlake.session import cut

#: Words of a shingle; texts are linked that share PART of the WHOLE of their distinct shingles.
SIZE, PART, WHOLE = 2, 80, 100
#: Each permutation gives its smallest and its largest hash, so 36 give 72 values: 24 bands of 3. A pair at a
#: similarity of 0.8 shares no band with a probability of (1 - 0.8^3)^24 = 3 in 10^8.
PERMUTATIONS, BANDS, ROWS = 36, 24, 3
#: Shingles hashed under all permutations at a time.
FOLD = 1 << 14
#: Words (64 bits each) of a parity sketch.
WORDS = 8
#: Members of a set from which on it has wide parities beside its sketch.
WIDE = 512
#: Jobs that fetch a bit set, so that the driver holds a part of it at a time, but needs no job for each partition.
FETCHES = 8
#: Members that are checked against one copy of their pivot; bits of a set for each of its contents, and of the largest set (32 MiB).
SHARE, SPARSE, MOST_BITS = 512, 64, 1 << 28
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64 over all others."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SEEDS = _mixed(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles, A-Z lower-cased; a shorter text is one, a blank one none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    count = max(len(own) - size + 1, 1)
    found = np.full(count, len(own) if len(own) < size else size, np.uint64)
    for i in range(min(size, len(own))):
        found = _mixed(found + own[i : i + count])
    return np.unique(found)


def min_max(hashes: np.ndarray) -> np.ndarray:
    """Smallest and largest value under every permutation, side by side."""
    low, high = np.full(PERMUTATIONS, _MASK), np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(hashes), FOLD):
        x = (hashes[i : i + FOLD, None] ^ _SEEDS) * (_SEEDS | np.uint64(1))
        x ^= x >> np.uint64(32)
        low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
    return np.stack([low, high], axis=1).ravel()


def parity_sketch(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Bit i tells whether an odd number of hashes falls on it: two sketches differ in no more bits than the sets do in members."""
    bits = np.bincount((hashes & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def wide_parity(hashes: np.ndarray) -> np.ndarray:
    """Parities of a set that is too large for the fixed sketches: about a bit for each member; none of a smaller set."""
    return parity_sketch(hashes, 1 << (len(hashes) // 64).bit_length()) if len(hashes) > WIDE else np.empty(0, np.int64)


def wide_apart(one: np.ndarray, two: np.ndarray) -> int:
    """Differing bits of two wide parities, at most as many as their sets differ in members: the longer one is folded to the shorter."""
    words = min(len(one), len(two))
    if not words:
        return 0
    folded = [np.bitwise_xor.reduce(x.reshape(-1, words), axis=0) for x in (one, two)]
    return int(np.bitwise_count((folded[0] ^ folded[1]).view(np.uint64)).sum())


@F.pandas_udf(LongType())
def wide_apart_of(one: pd.Series, two: pd.Series) -> pd.Series:
    return pd.Series([wide_apart(np.asarray(x, np.int64), np.asarray(y, np.int64)) for x, y in zip(one, two)], dtype="int64")


def signatures(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, digest (of the shingle set; null if empty), content (of the text), n, keys (a band each), sketch, wide; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 4 << 20):
            sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
            keys, sketches = [], []
            for s in sets:
                bands = min_max(s).reshape(BANDS, ROWS)
                key = np.arange(1, BANDS + 1, dtype=np.uint64)
                for column in bands.T:
                    key = _mixed(key + column)
                keys.append(key.view(np.int64) if len(s) else [])
                sketches.append(parity_sketch(s))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    batch.column("content"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())),
                    pa.array(map(wide_parity, sets), pa.list_(pa.int64())),
                ],
                names=["doc_id", "digest", "content", "n", "keys", "sketch", "wide"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("content")).mapInArrow(run, f"doc_id {kind}, digest binary, content bigint, n bigint, keys array<bigint>, sketch array<bigint>, wide array<bigint>")


def _bit_set(contents: DataFrame, bits: int) -> bytes:
    """A set of ``bits`` bits with the contents' own; it errs only towards holding one more."""
    place = contents.select((F.col("content").bitwiseAND(F.lit(bits - 1)) + 1).alias("place"))
    maps = place.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    out = bytearray(bits // 8)
    for row in maps.coalesce(FETCHES).toLocalIterator():  # at most bits / 32768 rows of 4 KiB
        out[(row.bucket - 1) * 4096 : row.bucket * 4096] = row.bits[: len(out)]
    return bytes(out)


def set_bits(count: int) -> int:
    """Bits of a set of ``count`` contents: so many that few others seem to be in it, up to MOST_BITS."""
    return 1 << min(max((SPARSE * count).bit_length(), 15), MOST_BITS.bit_length() - 1)


def may_hold(contents: DataFrame, content: Column, count: int | None = None) -> Column:
    """False only where ``content`` is not among the ``contents`` (content; ``count`` rows at most), told without a shuffle."""
    bits = set_bits(contents.count() if count is None else count)
    shared = contents.sparkSession.sparkContext.broadcast(_bit_set(contents, bits))

    @F.pandas_udf("boolean")
    def held(own: pd.Series) -> pd.Series:
        place = own.to_numpy() & (bits - 1)
        return pd.Series((np.frombuffer(shared.value, np.uint8)[place >> 3] >> (place & 7) & 1).astype(bool))

    return held(content)


def one_of_each(marked: DataFrame) -> DataFrame:
    """A row of each digest; only rows whose digest may come again are shuffled."""
    own = F.xxhash64("digest").alias("content")
    again = cut(marked.groupBy("digest").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(own))
    held = may_hold(again, own)
    return marked.where(~held).unionByName(marked.where(held).dropDuplicates(["digest"]))


def sets_of(nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """node, hashes (the shingle set) of ``nodes`` (node, digest, content), read from the texts again.

    Only texts whose content may be wanted are cut into shingles; the join with ``nodes`` tells for sure.
    """
    bits = set_bits(nodes.count())
    shared = docs.sparkSession.sparkContext.broadcast(_bit_set(nodes.select("content"), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, before = np.frombuffer(shared.value, np.uint8), set()
        for batch in by_bytes(batches, "text", 4 << 20):
            digests, sets = [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("content").to_pylist()):
                place = own & (bits - 1)
                if own not in before and there[place >> 3] >> (place & 7) & 1:
                    before.add(own)
                    hashes = shingle_set(text, size)
                    digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    sets.append(hashes.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["digest", "hashes"]
            )

    found = docs.select("text", F.xxhash64("text").alias("content")).mapInArrow(run, "digest binary, hashes array<bigint>").dropDuplicates(["digest"])
    return found.join(nodes.select("node", "digest"), "digest").select("node", "hashes")


def wanted_sets(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, known: DataFrame | None) -> DataFrame:
    """The shingle sets of all nodes in ``pairs``, and those ``known``; sets not yet known are read from the texts."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if known is None:
        return cut(sets_of(cut(nodes.select("node", "digest", "content").join(used, "node")), docs, size))
    fresh = cut(nodes.select("node", "digest", "content").join(used.join(known.select("node"), "node", "left_anti"), "node"))
    return known if fresh.isEmpty() else known.unionByName(cut(sets_of(fresh, docs, size)))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets (node, hashes) are alike enough.

    Members ``a`` meet the set of their pivot ``b``, one row at a time; a pivot of many members is copied,
    one copy for every SHARE of them. Sets of nodes that are no member, or no pivot, are not shuffled to there.
    """

    count = pairs.count()

    def sets_in(name: str) -> DataFrame:
        return sets.where(may_hold(pairs.select(F.xxhash64(name).alias("content")), F.xxhash64("node"), count))

    # At most a row for every SHARE pairs.
    many = F.broadcast(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("copies")).where("copies > 1"))
    copies = F.coalesce("copies", F.lit(1).cast("bigint"))
    members = (
        pairs.join(many, "b", "left").withColumn("copy", F.pmod(F.xxhash64("a"), copies)).drop("copies")
        .join(sets_in("a").withColumnRenamed("node", "a"), "a")
    )
    pivots = sets_in("b").toDF("b", "others").join(many, "b", "left").select(
        "b", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)).alias("copy"), "others"
    )
    both = F.size(F.array_intersect("hashes", "others"))
    alike = WHOLE * both >= PART * (F.size("hashes") + F.size("others") - both)
    return members.join(pivots, ["b", "copy"]).where(alike).select(pairs.columns)


def may_link(n: Column, sketch: list[Column], n2: Column, sketch2: list[Column]) -> Column:
    """False only for sets that cannot be alike enough: too different in size, or in more bits than linked sets are in members."""
    apart = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(sketch, sketch2)), F.lit(0))
    return (WHOLE * F.least(n, n2) >= PART * F.greatest(n, n2)) & (apart * (WHOLE + PART) <= (WHOLE - PART) * (n + n2))


def linked(
    nodes: DataFrame, docs: DataFrame, size: int, sketch: list[Column], may: Callable[[Column, list[Column], Column, list[Column]], Column],
    proposed: DataFrame | None = None,
) -> DataFrame:
    """node, component of the nodes (node, digest, content, n, keys, wide) that are linked with others.

    ``may(n, sketch, n2, sketch2)`` tells pairs that cannot be linked from their sizes and sketches, or from
    any first words of these. All pairs
    that meet in a band are checked, or known to be in one component, or shown by ``may`` to be too
    different. First a band's members are checked against one of them, so a group of copies costs its
    size: the one whose bands are shared most, which is what copies were made from, as each of
    them lacks other parts of it; beside them the pairs (a, b) ``proposed``. Members of bands of three or more that do not stand under the
    same text as most of their band then meet the band's members under others. Rows that meet the best of their band carry
    the first word of their sketch only; the others follow for the pairs that it leaves. Where members meet members, one
    word would leave about the square of a crowd, so there rows carry whole sketches.
    """
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    met = cut(keyed.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("members > 1"))
    mine, other = ["n", *(f"s{i}" for i in range(len(sketch)))], ["n2", *(f"t{i}" for i in range(len(sketch)))]
    listed = met.groupBy("node").agg(F.sum("members").alias("score"), F.collect_list(F.struct("key", "members")).alias("bands"))
    sketched = cut(nodes.drop("keys").join(listed, "node").select("node", "n", *[x.alias(f"s{i}") for i, x in enumerate(sketch)], "wide", "score", "bands"))
    met = sketched.select("node", "n", "s0", "score", F.inline("bands")).repartition("key")
    fits = may(F.col("n"), [F.col(c) for c in mine[1:]], F.col("n2"), [F.col(c) for c in other[1:]])
    alike = may(F.col("n"), [F.col("s0")], F.col("n2"), [F.col("t0")])
    sketched = sketched.drop("bands")

    def fitting(pairs: DataFrame) -> DataFrame:
        """The distinct pairs (a, b) whose whole sketches and wide parities fit; rank is the score of b."""
        near = pairs.repartition("a").dropDuplicates(["a", "b"]).join(sketched.drop("score").toDF("a", *mine, "wide"), "a")
        met_both = near.join(sketched.toDF("b", *other, "wide2", "rank"), "b").where(fits)
        return met_both.where(wide_apart_of("wide", "wide2") * (WHOLE + PART) <= (WHOLE - PART) * (F.col("n") + F.col("n2"))).select("a", "b", "rank")

    # Against the best of each band: linear in its members.
    by_key = Window.partitionBy("key")
    best = met.select(F.col("node").alias("a"), "n", "s0", F.max(F.struct("score", "node", "n", "s0")).over(by_key).alias("p"))
    near = best.select("a", "n", "s0", F.col("p.node").alias("b"), F.col("p.n").alias("n2"), F.col("p.s0").alias("t0")).where("a != b").where(alike)
    near = near.select("a", "b")
    tested = cut(fitting(near if proposed is None else near.unionByName(proposed)))
    sets = wanted_sets(tested, nodes, docs, size, None)
    links = cut(confirmed(tested, sets))

    # Each member stands under the best that it is linked with, or the best that this one is linked with.
    above = links.groupBy("a").agg(F.max(F.struct("rank", "b"))["b"].alias("b"))
    labels = above.join(above.toDF("b", "c"), "b", "left").select(F.col("a").alias("node"), F.coalesce("c", "b").alias("label"))
    # Of a band with two members the one pair was met above.
    crowd = met.where("members > 2").select("key", "node")
    tagged = crowd.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).repartition("key")
    shared = tagged.withColumn("share", F.count(F.lit(1)).over(Window.partitionBy("key", "label")))
    ruled = shared.select(
        "key", "node", "label", F.max(F.struct("share", "label")).over(by_key)["label"].alias("main"),
        F.min("label").over(by_key).alias("low"), F.max("label").over(by_key).alias("high"),
    )
    open_ = cut(ruled.where("low < high").select("key", "node", "label", "main").join(sketched.select("node", *mine), "node"))
    left = open_.where("label != main").select("key", F.col("node").alias("a"), F.col("label").alias("own"), *mine)
    right = open_.select("key", F.col("node").alias("b"), "label", *[F.col(x).alias(y) for x, y in zip(mine, other)]).withColumnRenamed("key", "key2")
    left_out = left.join(right, (F.col("key") == F.col("key2")) & (F.col("own") != F.col("label")) & fits)
    fresh = left_out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    both_ways = tested.select("a", "b").unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
    fresh = cut(fitting(fresh).select("a", "b").join(both_ways, ["a", "b"], "left_anti"))
    sets = wanted_sets(fresh, nodes, docs, size, sets)
    return components(links.select("a", "b").unionByName(confirmed(fresh, sets)))


def near_copies(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id linked, itself included), kept of every row.

    Texts are linked whose sets of word shingles share at least PART of the WHOLE of their union; texts
    with equal sets are one node. Null, empty and blank texts have no shingle and are linked with
    nothing. A null doc_id is smallest only where all ids of a component are null; ``kept`` is true
    for rows whose id is their component's, so repeated rows are all kept or all not. An empty table gives no
    row; other columns are not read.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    marked = cut(signatures(texts, size))
    one = one_of_each(marked.where("digest is not null")).drop("doc_id")
    nodes = cut(one.withColumn("node", F.monotonically_increasing_id()))
    labels = linked(nodes, texts, size, [F.get("sketch", F.lit(i)) for i in range(WORDS)], may_link)
    placed = nodes.select("digest", "node").join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    first = marked.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id")).join(placed, "digest")
    lowest = first.groupBy("component").agg(F.min("first_id").alias("lowest"))
    named = first.join(lowest, "component").select("digest", "lowest")
    out = marked.join(named, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("lowest")).alias("component_id")
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@query("op11_minmax_hash")
def op11_minmax_hash(spark, sf_dir):
    return near_copies(table(spark, sf_dir, "documents"))
