"""SentencePiece encoding and decoding over a relational lattice."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.ipc  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.registry import query, table

#: Before a space that follows another character no piece continues, so texts are cut there.
BOUNDARY = re.compile(r"(?<=[^ ])(?= )")
#: Marks that are cut off the letter before them at the end of a word.
ENDS = (",", ".")
#: Longer units, such as texts without spaces, are cut between characters that no piece joins; a part
#: that is longer still has no such place, and is folded where its text is, not over the lattice.
LONGEST_UNIT = 1024
#: Text bytes of a block, whose documents and distinct units meet in one task; bytes that a packing task holds.
BLOCK_BYTES, HELD = 8 << 20, 12 << 20
PENALTY = 10.0


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[tuple[tuple[str, int, float], ...], tuple[int, ...]]:
    """(piece, id, score) of the ordinary pieces with spaces for their space marks, and the byte ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary, byte_ids = [], {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            if "▁" in piece.lstrip("▁") or "\n" in piece[1:] or piece[:1] == "\n" != piece or any(
                a.isalpha() and b in ENDS for a, b in zip(piece, piece[1:])
            ):
                raise ValueError("a piece spans a boundary of units")
            ordinary.append((piece.replace("▁", " "), i, float(model.get_score(i))))
    if len(byte_ids) != 256:
        raise ValueError("the model has no bytes to fall back on")
    return tuple(ordinary), tuple(byte_ids[b] for b in range(256))


@lru_cache(maxsize=2)
def joined(path: str) -> frozenset[str]:
    """Every two characters that stand side by side in a piece."""
    return frozenset(p[i : i + 2] for p, _, _ in vocabulary(path)[0] for i in range(len(p) - 1))


def cut_apart(unit: str, pairs: frozenset[str]) -> list[str]:
    """The unit cut wherever two characters meet that no piece joins: no merge and no piece crosses that."""
    ends = [i + 1 for i in range(len(unit) - 1) if unit[i : i + 2] not in pairs]
    return [unit[a:b] for a, b in zip([0, *ends], [*ends, len(unit)])]


def units(text: str, pairs: frozenset[str]) -> list[str]:
    """The text behind a space, cut into units whose encodings are independent.

    Cuts lie before a space behind another character, around line feeds, and between a letter and
    the comma or full stop that ends a word; ``vocabulary`` proves that no piece spans them. Units that are
    still long are cut between characters that stand side by side in none of the ``pairs`` of the pieces. A
    literal U+2581 is a space, as the model has it.
    """
    out, lead = [], " "
    text = text.replace("▁", " ")
    for line in text.split("\n"):
        if not lead:
            out.append("\n")
        words = line.split(" ")
        if "" in words and line:  # spaces in a row or at an end
            out = BOUNDARY.split(" " + text)
            break
        first = len(out)
        for word in words:
            if word[-1:] in ENDS and word[-2:-1].isalpha():
                out += (" " + word[:-1], word[-1])
            else:
                out.append(" " + word)
        if not lead:
            out[first] = out[first][1:]
            if not out[first]:
                del out[first]
        lead = ""
    if max(map(len, out)) > LONGEST_UNIT:
        out = [part for u in out for part in (cut_apart(u, pairs) if len(u) > LONGEST_UNIT else (u,))]
    return out


#: An edge of the lattice is one long: rank of its score (20 bits), 2047 less its start (11), its end
#: (11), and the piece's id (20; all ones for a character that is no piece).
UNKNOWN = (1 << 20) - 1


@lru_cache(maxsize=2)
def ranked(path: str) -> tuple[tuple[tuple[str, int, int], ...], tuple[float, ...]]:
    """(piece, id, rank) and the score of each rank; rank 0 is ``PENALTY`` below the worst piece."""
    ordinary, _ = vocabulary(path)
    scores = sorted({score for _, _, score in ordinary})
    rank = {score: k + 1 for k, score in enumerate(scores)}
    if len(scores) >= 1 << 20 or max(i for _, i, _ in ordinary) >= UNKNOWN:
        raise ValueError("too many pieces")
    return tuple((p, i, rank[score]) for p, i, score in ordinary), (scores[0] - PENALTY, *scores)


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """piece, id, rank; its size is that of the model's vocabulary, whatever the input."""
    return spark.createDataFrame(list(ranked(path)[0]), "piece string, id int, rank int")


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """The columns of ``words`` and edges (array<bigint>, best rank last) of rows with a distinct ``unit`` (and ``part``).

    Substrings of up to ``longest`` characters are exploded and meet the piece table by equality;
    the edges are grouped by unit, and with the rows lying by unit that needs no shuffle.
    """
    n = F.char_length("unit")
    keep = words.columns
    by = [c for c in ("unit", "part") if c in keep]
    spans = words.select(*keep, F.explode(F.sequence(F.lit(0), n - 1)).alias("s")).select(
        *keep, "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("s")))).alias("len")
    ).select(*keep, "s", "len", F.substring("unit", F.col("s") + 1, F.col("len")).alias("piece"))
    met = spans.join(F.broadcast(pieces), "piece", "left").where("id is not null or len = 1")
    edge = F.expr(f"(coalesce(rank, 0) * 1L << 42) | ((2047L - s) << 31) | ((s + len) * 1L << 20) | coalesce(id, {UNKNOWN})")
    carried = [c for c in keep if c not in by]
    return met.groupBy(*by).agg(*(F.first(c).alias(c) for c in carried), F.sort_array(F.collect_list(edge)).alias("edges"))


def start_of(edge: Column) -> Column:
    return (F.lit(2047) - F.shiftright(edge, 31).bitwiseAND(F.lit(2047))).cast("int")


def end_of(edge: Column) -> Column:
    return F.shiftright(edge, 20).bitwiseAND(F.lit(2047)).cast("int")


def id_of(edge: Column) -> Column:
    return edge.bitwiseAND(F.lit(UNKNOWN)).cast("int")


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def viterbi(edges: Column, unit: Column, scores: Column) -> Column:
    """Edges of the best path: the largest sum of scores, ties to the shorter last piece."""
    parsed = F.transform(
        edges, lambda x: F.struct(F.get(scores, F.shiftright(x, 42).cast("int")).alias("score"), start_of(x).alias("s"), end_of(x).alias("e"), x.alias("edge"))
    )
    state = "array<struct<score:double,s:int,edge:bigint>>"
    origin = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("s"), F.lit(0).cast("bigint").alias("edge"))).cast(state)

    def solved(arcs: Column) -> Column:
        def extend(best: Column, e: Column) -> Column:
            reached = F.transform(
                F.filter(arcs, lambda x: x["e"] == e),
                lambda x: F.struct((F.get(best, x["s"])["score"] + x["score"]).alias("score"), x["s"].alias("s"), x["edge"].alias("edge")),
            )
            return F.concat(best, F.array(F.array_max(reached)))

        return F.aggregate(F.sequence(F.lit(1), F.char_length(unit)), origin, extend)

    def back(best: Column) -> Column:
        start = F.struct(F.char_length(unit).alias("at"), F.array().cast("array<bigint>").alias("out"))

        def step(acc: Column, _: Column) -> Column:
            at = F.get(best, acc["at"])
            return F.when(
                acc["at"] > 0, F.struct(at["s"].alias("at"), F.concat(acc["out"], F.array(at["edge"])).alias("out"))
            ).otherwise(acc)

        return F.reverse(F.aggregate(F.sequence(F.lit(1), F.char_length(unit)), start, step)["out"])

    return let(let(parsed, solved), back)


def merges(edges: Column, unit: Column, scores: Column) -> Column:
    """Edges that a byte-pair model's merges end with: again and again the best-ranked two neighbours.

    Ties go to the left. The fold keeps the boundaries of the current symbols, as bits where the unit
    is short enough; an edge can be merged if exactly one boundary lies inside it.
    """
    length = F.char_length(unit)
    rounds = F.sequence(F.lit(1), length)

    def fold(arcs: Column, state: Column, ready, merge) -> Column:
        """Each round merges the last ready edge; edges come by rank, so that is the best one."""

        def step(bounds: Column, _: Column) -> Column:
            best = F.aggregate(arcs, F.lit(None).cast(arc), lambda m, x: F.when(ready(bounds, x), x).otherwise(m))
            return let(best, lambda m: F.when(m.isNull(), bounds).otherwise(merge(bounds, m)))

        return F.aggregate(rounds, state, step)

    arc = "struct<s:int,e:int,ends:bigint,inner:bigint>"
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k)

    def masks(x: Column) -> Column:
        s, e = start_of(x), end_of(x)
        return F.struct(
            s.alias("s"), e.alias("e"), F.when(length <= 60, bit(s).bitwiseOR(bit(e))).alias("ends"),
            F.when(length <= 60, bit(e) - bit(s + 1)).alias("inner"),
        )

    def boundaries(arcs: Column) -> Column:
        short = fold(
            arcs,
            bit(F.least(length, F.lit(60)) + 1) - 1,
            lambda b, x: (b.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(b.bitwiseAND(x["inner"])) == 1),
            lambda b, m: b.bitwiseAND(F.bitwise_not(m["inner"])),
        )
        at = lambda b, v: F.array_position(b, v)
        long = fold(
            arcs,
            F.sequence(F.lit(0), length),
            lambda b, x: (at(b, x["s"]) > 0) & (at(b, x["e"]) - at(b, x["s"]) == 2),
            lambda b, m: F.filter(b, lambda v: (v <= m["s"]) | (v >= m["e"])),
        )
        listed = let(short, lambda b: F.filter(F.sequence(F.lit(0), length), lambda k: F.getbit(b, k) == 1))
        return F.when(length <= 60, listed).otherwise(long)

    def spell(bounds: Column) -> Column:
        # The symbols that are left are edges between neighbouring boundaries.
        def final(x: Column) -> Column:
            at = F.array_position(bounds, start_of(x))
            return (at > 0) & (F.get(bounds, at.cast("int")) == end_of(x))

        return F.array_sort(F.filter(edges, final), lambda a, b: start_of(a) - start_of(b))

    wide = F.filter(edges, lambda x: end_of(x) - start_of(x) > 1)
    return let(let(F.transform(wide, masks), boundaries), spell)


FOLDS = {"viterbi": viterbi, "merges": merges}


def encode_units(words: DataFrame, path: str, fold: str = "viterbi") -> DataFrame:
    """The columns of ``words`` and ids of rows with a distinct ``unit``."""
    ordinary, byte_ids = vocabulary(path)
    scores = F.split(F.lit(",".join(map(repr, ranked(path)[1]))), ",").cast("array<double>")
    found = lattice(words, piece_table(words.sparkSession, path), max(len(p) for p, _, _ in ordinary))
    spelled = found.select(*words.columns, FOLDS[fold](F.col("edges"), F.col("unit"), scores).alias("_path"))
    table_ = F.array(*map(F.lit, byte_ids))

    def as_bytes(edge: Column) -> Column:
        digits = F.hex(F.encode(F.substring("unit", start_of(edge) + 1, F.lit(1)), "UTF-8"))
        values = F.transform(
            F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2)), lambda k: F.conv(F.substring(digits, k, F.lit(2)), 16, 10).cast("int")
        )
        return F.transform(values, lambda b: F.get(table_, b))

    plain = F.transform("_path", id_of)
    mixed = F.flatten(F.transform("_path", lambda x: F.when(id_of(x) == UNKNOWN, as_bytes(x)).otherwise(F.array(id_of(x)))))
    return spelled.select(*words.columns, F.when(F.array_contains(plain, UNKNOWN), mixed).otherwise(plain).alias("ids"))


@lru_cache(maxsize=2)
def by_piece(path: str) -> tuple[dict[str, tuple[int, float]], int, float]:
    """Piece to (id, score), the longest piece's length, and the score of a character that is no piece."""
    ordinary, _ = vocabulary(path)
    return {p: (i, score) for p, i, score in ordinary}, max(len(p) for p, _, _ in ordinary), ranked(path)[1][0]


def long_merges(unit: str, path: str) -> list[str]:
    """The symbols that ``merges`` ends with, for a unit of any length: n log n by a heap of neighbours."""
    known, longest, _ = by_piece(path)
    ends = list(range(1, len(unit) + 1))  # end of the symbol that starts here; 0 where none does
    left = list(range(-1, len(unit) - 1))
    heap: list[tuple[float, int, int]] = []

    def offer(start: int) -> None:
        middle = ends[start]
        if middle < len(unit) and ends[middle] - start <= longest:
            found = known.get(unit[start : ends[middle]])
            if found:
                heapq.heappush(heap, (-found[1], start, ends[middle]))

    for start in range(len(unit)):
        offer(start)
    while heap:
        _, start, end = heapq.heappop(heap)
        middle = ends[start]
        if not middle or middle >= end or ends[middle] != end:
            continue  # one of the two was merged otherwise
        ends[start], ends[middle] = end, 0
        if end < len(unit):
            left[end] = start
            offer(start)
        if left[start] >= 0:
            offer(left[start])
    return [unit[s:e] for s, e in enumerate(ends) if e]


def long_viterbi(unit: str, path: str) -> list[str]:
    """The pieces of ``viterbi``'s best path, for a unit of any length."""
    known, longest, unknown = by_piece(path)
    best, back = [0.0], [0]
    for end in range(1, len(unit) + 1):
        options = [
            (best[s] + known[unit[s:end]][1] if unit[s:end] in known else best[s] + unknown, s)
            for s in range(max(0, end - longest), end) if end - s == 1 or unit[s:end] in known
        ]
        score, start = max(options)
        best.append(score)
        back.append(start)
    out, at = [], len(unit)
    while at:
        out.append(unit[back[at] : at])
        at = back[at]
    return out[::-1]


LONG_FOLDS = {"viterbi": long_viterbi, "merges": long_merges}


def long_ids(unit: str, path: str, fold: str) -> list[int]:
    """Ids of a unit that is too long for the lattice's packed edges."""
    known, byte_ids = by_piece(path)[0], vocabulary(path)[1]
    return [i for p in LONG_FOLDS[fold](unit, path) for i in ((known[p][0],) if p in known else (byte_ids[b] for b in p.encode()))]


@lru_cache(maxsize=2)
def piece_bytes(path: str) -> dict[int, bytes]:
    ordinary, byte_ids = vocabulary(path)
    return {i: p.encode() for p, i, _ in ordinary} | {i: bytes([b]) for b, i in enumerate(byte_ids)}


def decode(ids, path: str) -> str:
    """The text of encoded ids: pieces and bytes in order, without the leading space."""
    return b"".join(map(piece_bytes(path).__getitem__, ids)).decode()[1:]


def encode_documents(docs: DataFrame, path: str, fold: str = "viterbi", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_pieces, ids (array<int>), decoded (string) of every row of ``docs``.

    Rows are dealt to blocks of about ``block_bytes`` of text by a hash. Distinct (block, unit) pairs
    come out of a block; distinct units are encoded once, over the lattice; their ids return to the
    blocks that have them, where texts are put together and decoded again. So what is shuffled is
    the compressed text once and the distinct units of a block twice, never single occurrences.

    ``fold`` "viterbi" gives the segmentation with the best sum of scores, as unigram models mean it;
    "merges" gives what a byte-pair model's library gives, which no sum of scores does. Both run over the same
    lattice; only runs of over ``LONGEST_UNIT`` characters in which pieces join all neighbours are folded
    in the task that holds their text. A null text is encoded as empty: no pieces, decoded as an empty text. A literal
    U+2581 is encoded as the space that it is to the model, and so decoded as one. Null ids, repeated rows, an empty table and other columns
    are no special cases.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block")
    placed = rows.select(block, "doc_id", "text").mapInArrow(pack_by_block, "block int, blob binary").repartition(blocks, "block")

    def distinct_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set[str]] = {}
        pairs = joined(path)
        for batch in batches:
            for b, blob in zip(batch.column("block").to_pylist(), batch.column("blob")):
                own = seen.setdefault(b, set())
                for text in unpack(blob).column("text").to_pylist():
                    own.update(u for u in (units(text, pairs) if text else ()) if len(u) <= LONGEST_UNIT)
        pa.default_memory_pool().release_unused()
        for b, found in seen.items():
            listed = list(found)
            for i in range(0, len(listed), 50_000):
                part = listed[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([b] * len(part), pa.int32()), pa.array(part)], names=["block", "unit"])

    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One shuffle by unit; the blocks of a unit go with it, in lists of at most 1024.
    group = F.expr("block div 1024").alias("part")
    uses = placed.mapInArrow(distinct_units, "block int, unit string").repartition(parts, "unit")
    grouped = uses.groupBy("unit", group).agg(F.collect_list("block").alias("blocks"))
    met = encode_units(grouped, path, fold).select(F.explode("blocks").alias("block"), "unit", "ids")
    known = met.mapInArrow(pack_by_block, "block int, blob binary")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        packed: dict[str, bytes] = {}
        pairs = joined(path)

        def of(unit: str) -> bytes:
            if len(unit) > LONGEST_UNIT and unit not in packed:
                packed[unit] = np.array(long_ids(unit, path, fold), np.int32).tobytes()
            return packed[unit]

        for blob in right.column("blob"):
            table_ = unpack(blob)
            ids = table_.column("ids").combine_chunks()
            values, ends = ids.flatten().to_numpy().astype(np.int32).tobytes(), ids.offsets.to_numpy() * 4
            ends = (ends - ends[0]).tolist()
            packed.update(zip(table_.column("unit").to_pylist(), (values[a:b] for a, b in zip(ends, ends[1:]))))
        out = []
        for blob in left.column("blob"):
            table_ = unpack(blob)
            counts, ids, texts = [], [], []
            for text in table_.column("text").to_pylist():
                own = np.frombuffer(b"".join(map(of, units(text, pairs))) if text else b"", np.int32)
                counts.append(len(own))
                ids.append(own)
                texts.append(decode(own.tolist(), path) if text else "")
            out.append(pa.table({
                "doc_id": table_.column("doc_id"), "n_pieces": pa.array(counts, pa.int64()),
                "ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(texts, pa.string()),
            }))
        packed.clear()
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(out)

    return placed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        assemble, f"doc_id {kind}, n_pieces bigint, ids array<int>, decoded string"
    )


def pack_by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a ``block`` as compressed tables, one or more a block, of up to ``HELD`` bytes in memory."""
    held, size = [], 0

    def packed() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        rows = rows.take(pa.compute.sort_indices(rows, [("block", "ascending")]))
        blocks = rows.column("block").to_numpy()
        starts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])).tolist()
        blobs = []
        for a, b in zip(starts, [*starts[1:], len(blocks)]):
            sink = pa.BufferOutputStream()
            part = rows.slice(a, b - a).drop_columns(["block"]).combine_chunks()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as writer:
                writer.write_table(part)
            blobs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(blocks[starts], pa.int32()), pa.array(blobs, pa.binary())], names=["block", "blob"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= HELD:
            yield packed()
            held, size = [], 0
    if held:
        yield packed()


def unpack(blob: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(blob.as_buffer()).read_all()


def encoded_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_pieces, ids_hash (XXH64 of the ids in order), decoded_sha256."""
    return found.select("doc_id", "n_pieces", F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_sentencepiece_lattice")
def op7_sentencepiece_lattice(spark, sf_dir):
    import public_tokenizers

    return encoded_digest(encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), "merges"))
