"""Source divergence audit: how far the word use of each source is from other sources and its language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import by_bytes
from auditlake.llm.registry import query, table
from auditlake.session import cut

#: Bytes of a term (A-Z, a-z and all of code points from U+0080 on) and their lower case (A-Z only).
TERM = np.zeros(256, bool)
TERM[65:91] = TERM[97:123] = TERM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Text bytes of a sorted shard; slices up to SMALL pointers are sorted together; bytes compared at a time.
SHARD_BYTES, SMALL, WIDTH = 12 << 20, 1 << 14, 8
#: A smoothed share is 1 + floor(UNIT * (count + PSEUDO) / (N + PSEUDO * V)).
UNIT, PSEUDO = 1_000_000_000, 5
#: (term, source) rows of a block of terms that one task compares, and cells of its dense matrix.
BLOCK_ROWS, CELLS = 200_000, 1 << 21


def token_starts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' lower-cased bytes, and pointer, length and row of every term in them."""
    whole = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = TERM[raw]
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < len(raw)]] = False  # terms never cross rows
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    at = np.flatnonzero(inside & ~before)
    length = np.flatnonzero(inside & ~after) + 1 - at
    row = np.searchsorted(offsets, at, side="right") - 1
    return np.concatenate([LOWER[raw], np.zeros(WIDTH, np.uint8)]), at, length, row


def sorted_pointers(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of term pointers: (their order by UTF-8, where runs of equal terms begin).

    A slice of pointers that agree on their first bytes is parted into less, equal and more by the
    next eight bytes against a pivot; the equal part goes on with the bytes after them, unless the
    term ends there, which makes it a finished run. Slices that have become small are finished together,
    eight bytes further at a time. Every step keeps the order of equal pointers.
    """
    bytes8 = np.ndarray((len(data) - WIDTH + 1,), ">u8", data, strides=(1,))
    order, heads = np.arange(len(at)), np.zeros(len(at), bool)

    def chars(part: np.ndarray, depth: int) -> np.ndarray:
        # Past the end of a term there are zeros, which no term holds.
        spare = np.minimum(np.maximum(depth + WIDTH - length[part], 0), WIDTH).astype(np.uint64) << np.uint64(3)
        found = bytes8[np.minimum(at[part] + depth, len(bytes8) - 1)].astype(np.uint64)
        whole = np.minimum(spare, np.uint64(56))
        return np.where(spare < 64, found >> whole << whole, np.uint64(0))

    # Large slices are parted one by one; the small ones of a depth wait for each other.
    stack, small = [(0, len(at), 0)], {}
    while stack:
        low, high, depth = stack.pop()
        if high - low <= SMALL:
            small.setdefault(depth, []).append((low, high))
            continue
        part = order[low:high]
        char = chars(part, depth)
        pivot = np.sort(char[[0, len(char) // 2, -1]])[1]
        less, more = char < pivot, char > pivot
        parts = part[less], part[~(less | more)], part[more]
        part[:] = np.concatenate(parts)
        first, last = low + len(parts[0]), high - len(parts[2])
        if first > low:
            stack.append((low, first, depth))
        if last < high:
            stack.append((last, high, depth))
        if int(pivot) & 255:
            stack.append((first, last, depth + WIDTH))
        else:
            heads[first] = True
    while small:
        depth = min(small)
        lows, highs = np.array(small.pop(depth), np.int64).reshape(-1, 2).T
        by = np.argsort(lows)
        lows, sizes = lows[by], (highs - lows)[by]
        slot = np.arange(sizes.sum()) + np.repeat(lows - np.cumsum(sizes) + sizes, sizes)
        part, own = order[slot], np.repeat(np.arange(len(lows)), sizes)
        char = chars(part, depth)
        by = np.lexsort((char, own))
        order[slot], char = part[by], char[by]
        fresh = np.ones(len(slot), bool)
        fresh[1:] = (char[1:] != char[:-1]) | (own[1:] != own[:-1])
        begin = np.flatnonzero(fresh)
        count = np.diff(np.append(begin, len(slot)))
        done = (count == 1) | (char[begin] & np.uint64(255) == 0)
        heads[slot[begin[done]]] = True
        if not done.all():
            low = slot[begin[~done]]
            small.setdefault(depth + WIDTH, []).extend(zip(low.tolist(), (low + count[~done]).tolist()))
    return order, heads


def shard_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """lang, source, term, n (occurrences), df (rows) of one shard, from the equal runs of its sorted pointers."""
    data, at, length, row = token_starts(batch.column("text"))
    order, heads = sorted_pointers(data, at, length)
    pairs = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], names=["lang", "source"])
    names: dict = {}
    group = np.fromiter((names.setdefault((p["lang"], p["source"]), len(names)) for p in pairs.to_pylist()), np.int64, len(pairs))
    run, row = np.cumsum(heads) - 1, row[order]
    fresh = heads.copy()
    fresh[1:] |= row[1:] != row[:-1]  # rows ascend inside a run
    keys, inverse = np.unique(run * max(len(names), 1) + group[row], return_inverse=True)
    n, df = np.bincount(inverse, minlength=len(keys)), np.bincount(inverse[fresh], minlength=len(keys))
    first = order[heads]
    raw = data.tobytes()
    terms = [raw[a : a + m].decode("utf-8", "replace") for a, m in zip(at[first].tolist(), length[first].tolist())]
    langs, sources = [x for x, _ in names], [y for _, y in names]
    which = pa.array(keys % max(len(names), 1))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(langs, pa.string()).take(which), pa.array(sources, pa.string()).take(which),
            pa.array(terms, pa.string()).take(pa.array(keys // max(len(names), 1))),
            pa.array(n.astype(np.int64)), pa.array(df.astype(np.int64)),
        ],
        names=["lang", "source", "term", "n", "df"],
    )


def term_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """lang, source, term, n of terms in at least ``least_docs`` rows of their language, and lang_n, their count there.

    Shards are added up behind one exchange by (lang, term), where all sources of a term lie together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SHARD_BYTES):
            yield shard_counts(batch)

    shards = docs.mapInArrow(run, "lang string, source string, term string, n bigint, df bigint").repartition("lang", "term")
    counts = shards.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    whole = Window.partitionBy("lang", "term")
    both = counts.withColumn("lang_df", F.sum("df").over(whole)).withColumn("lang_n", F.sum("n").over(whole))
    return both.where(F.col("lang_df") >= least_docs).drop("df", "lang_df")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + PSEUDO) / (total + PSEUDO * terms)) in whole numbers."""
    wide = (count.cast("decimal(27,0)") + PSEUDO) * F.lit(UNIT).cast("decimal(10,0)")
    below = (total + F.lit(PSEUDO) * terms).cast("decimal(19,0)")
    return F.call_function("div", wide, below) + 1


def block_distances(block: pa.Table) -> pa.Table:
    """Distances of all sources of a language over one block of its terms.

    Rows without a term give each source (``at``) its share of terms that it lacks; the others are
    the shares of those it has. Terms are laid out dense a few at a time.
    """
    bare = pc.is_null(block["term"])
    bases = block.filter(bare).sort_by("at")
    base = bases["p"].to_numpy().astype(np.int64)
    held = block.filter(pc.invert(bare)).combine_chunks()
    size = len(base)
    sums = np.zeros((size, size), np.int64)
    if len(held):
        code = pc.dictionary_encode(held["term"]).combine_chunks().indices.to_numpy().astype(np.int64)
        by = np.argsort(code, kind="stable")
        code, at, p = code[by], held["at"].to_numpy()[by], held["p"].to_numpy()[by]
        step = max(1, CELLS // size)
        for low in range(0, int(code[-1]) + 1, step):
            a, b = np.searchsorted(code, [low, low + step])
            dense = np.repeat(base[None, :], min(step, int(code[-1]) + 1 - low), axis=0)
            dense[code[a:b] - low, at[a:b]] = p[a:b]
            for i in range(size - 1):
                sums[i, i + 1 :] += np.abs(dense[:, i + 1 :] - dense[:, i : i + 1]).sum(axis=0)
    a, b = np.triu_indices(size, 1)
    lang = pa.repeat(block["lang"][0], len(a)) if len(block) else pa.array([], pa.string())
    return pa.table({"lang": lang, "a": a.astype(np.int64), "b": b.astype(np.int64), "f": sums[a, b]})


def source_divergence(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) group of ``docs``.

    Part ``pair``: the other sources of the language with the summed distance of smoothed shares over
    the language's terms (those in ``least_docs`` rows or more), all ranks. Part ``term``: the terms
    that the group has and uses more than its language, the first ``top``. Shares are whole numbers,
    so results are exact. Ties rank by item.

    Null texts, languages and sources count as empty strings and repeated rows count each; an empty
    table gives no row, a language without kept terms distances of zero; other columns are not read.
    Terms and their counts meet by equality; sources are compared inside blocks of terms, so no task
    holds more than a block of a language's (term, source) rows, whichever language is hot.
    """
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    used = cut(term_counts(texts, least_docs))
    vocab = used.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("vocab"))
    sizes = vocab.join(used.groupBy("lang").agg(F.sum("n").alias("lang_total")), "lang")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("cells"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    groups = cut(
        texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select(
            "lang", "source", zero(F.col("total")).alias("total"), zero(F.col("vocab")).alias("vocab"), "lang_total",
            F.ceil(F.sum("cells").over(Window.partitionBy("lang")) / BLOCK_ROWS).alias("blocks"),
            (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("bigint").alias("at"),
        )
    )
    shares = used.join(groups, ["lang", "source"]).select(
        "lang", "source", "at", "term", "blocks", share(F.col("n"), F.col("total"), F.col("vocab")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("vocab")).alias("q"),
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")
    )
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    # Each block of a language also needs what every source has of terms that it lacks (none kept: one block, all zero).
    bases = groups.select(
        "lang", "at", F.lit(None).cast("string").alias("term"),
        F.when(F.col("vocab") > 0, share(F.lit(0), F.col("total"), F.col("vocab"))).otherwise(F.lit(0)).cast("bigint").alias("p"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(zero(F.col("blocks")), F.lit(1)) - 1)).alias("block"),
    )
    cells = shares.select("lang", "at", "term", "p", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"))
    near = cells.unionByName(bases).groupBy("lang", "block").applyInArrow(block_distances, "lang string, a bigint, b bigint, f bigint")
    sums = near.groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = (
        both.join(groups.select("lang", F.col("at").alias("a"), "source"), ["lang", "a"])
        .join(groups.select("lang", F.col("at").alias("b"), F.col("source").alias("item")), ["lang", "b"])
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
        .withColumn("rank", F.row_number().over(by_value))
    )
    return pairs.unionByName(terms)


_TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SQL = f"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    o AS (SELECT lang, source, r, unnest(regexp_extract_all(t, '{_TERMS}')) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 30),
    v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY ALL),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
    s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
    p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n,
      CAST(1 + 1000000000 * (coalesce(c.n, 0) + 5) // CAST(coalesce(s.n, 0) + 5 * v.v AS BIGINT) AS BIGINT) AS p,
      CAST(1 + 1000000000 * (k.n + 5) // CAST(v.n + 5 * v.v AS BIGINT) AS BIGINT) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
    f AS (SELECT a.lang, a.source, b.source AS other, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term
      AND a.source <> b.source GROUP BY ALL),
    u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.f, 0) AS BIGINT) AS value FROM g a
      JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.other = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM u)
    SELECT * FROM r WHERE part = 'pair' OR rank <= 50"""


@query("op12_source_divergence", SQL)
def op12_source_divergence(spark, sf_dir):
    return source_divergence(table(spark, sf_dir, "documents"))
