"""A stored index of three-letter grams, so that a search reads the texts that can match only.

The index is a folder of tables: ``texts`` (the files, dealt to parts by id), ``postings``
(gram, file_id, part; below folders by hash of the gram, sorted by gram) ``counts`` (files of
a gram), and ``shape`` (the number of those folders, and schemas). A pattern gives the grams that every match must hold; files with the rarest of them are met
by id, and the regex decides on their lines. A pattern without such a gram is searched in all texts.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditlake.operators.search import search_code

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 65536


def _bucket(gram: Column | str, buckets: int) -> Column:
    return F.pmod(F.crc32(gram), F.lit(buckets)).cast("int")


def _grams(files: DataFrame) -> DataFrame:
    """Distinct (file_id, gram). The grams of a text of one block are distinct in its row, and where no other row has its
    id there is nothing more to do; only longer texts and repeated ids are made distinct across rows. Blocks of a
    text are read apart, so a long text is many short lists."""
    low = F.translate("content", UPPER, LOWER)
    starts = F.sequence(F.lit(0), F.floor(F.length("low") / BLOCK).cast("int"))
    block = F.substring("low", F.col("b") * BLOCK + 1, F.lit(BLOCK + 2))
    # A look-ahead gives the three characters at every place in one pass.
    listed = lambda text: F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?=([^\n]{3}))"), F.lit(1)))).alias("gram")
    texts = files.where(F.col("content").isNotNull())
    again = texts.groupBy("file_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("file_id").alias("_id"), F.lit(True).alias("_again"))
    told = texts.join(again, F.col("file_id").eqNullSafe(F.col("_id")), "left").withColumn("_single", F.col("_again").isNull() & (F.length("content") < BLOCK))
    short = told.where("_single").select("file_id", listed(low))
    blocks = told.where("not _single").select("file_id", low.alias("low")).select("file_id", "low", F.explode(starts).alias("b"))
    return short.unionByName(blocks.select("file_id", block.alias("block")).select("file_id", listed("block")).distinct())


def build_index(files: DataFrame, path: str, parts: int = 64, buckets: int = 64) -> str:
    """Store ``files`` (file_id, content and others) with postings; null ids and repeated ids are kept.

    Files of a null content are stored but hold no line. Both tables are written in the splits that
    adaptive execution makes of a folder, so a frequent gram is not one task.
    """
    spark = files.sparkSession
    part = F.pmod(F.xxhash64("file_id"), F.lit(parts)).cast("int")
    texts = files.withColumn("part", part).hint("rebalance", "part")
    texts.sortWithinPartitions("part").write.partitionBy("part").parquet(f"{path}/texts")
    stored = _read(spark, path, "texts", texts.schema)
    postings = _grams(stored).withColumn("part", part).withColumn("bucket", _bucket("gram", buckets)).hint("rebalance", "bucket")
    postings.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
    counts = _read(spark, path, "postings", postings.schema).groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("n"))
    counts.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/counts")
    shape = {"buckets": buckets, "texts": texts.schema.json(), "postings": postings.schema.json(), "counts": counts.schema.json()}
    spark.createDataFrame([shape], "buckets int, texts string, postings string, counts string").write.json(f"{path}/shape")
    return path


def _read(spark: SparkSession, path: str, table: str, schema: StructType) -> DataFrame:
    """A table of the index; one that holds no file has no schema of its own."""
    return spark.read.schema(schema).parquet(f"{path}/{table}")


def _shape(spark: SparkSession, path: str) -> dict:
    return spark.read.json(f"{path}/shape").first().asDict()


def _schema(shape: dict, table: str) -> StructType:
    return StructType.fromJson(json.loads(shape[table]))


def required_grams(pattern: str) -> list[str]:
    """Grams in every match of a pattern, lower case; none where that cannot be told simply.

    Only literals outside of groups and classes count, and none of a pattern with a choice at the top.
    Escapes that take arguments, quotations and flags other than i, m and s give no grams at all.
    """
    groups = re.findall(r"\(\?(?![:=!>]|<[=!])([^:)]*)", pattern)
    if re.search(r"\\[xuc0pPNkQER]", pattern) or any(set(flags) - set("ims") for flags in groups):
        return []
    runs, run, depth, i = [], "", 0, 0

    def close(keep: str) -> None:
        nonlocal run
        runs.append(keep)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if depth == 0 and pattern[i + 1 : i + 2] and not pattern[i + 1].isalnum():
                run += pattern[i + 1]
            else:
                close(run)
            i += 2
            continue
        if c == "[":
            end = re.compile(r"\[\^?\]?(?:\\.|[^\]\\\[])*\]", re.S).match(pattern, i)
            if not end:
                return []  # nested classes
            close(run)
            i = end.end()
            continue
        if c in "()":
            depth += 1 if c == "(" else -1
            close(run)
        elif depth == 0 and c == "|":
            return []
        elif depth == 0:
            if c in "*?{":
                close(run[:-1])
                if c == "{":
                    i = max(pattern.find("}", i), i)
            elif c in "+.^$":
                close(run)
            else:
                run += c
        i += 1
    close(run)
    low = [r.translate(str.maketrans(UPPER, LOWER)) for r in runs]
    return sorted({r[k : k + 3] for r in low for k in range(len(r) - 2) if "\n" not in r[k : k + 3]})


def candidates(spark: SparkSession, path: str, grams: list[str], most: int = 4) -> DataFrame:
    """Ids and parts of the files that hold the rarest ``most`` of the grams; more grams prune little more.

    Counts of the pattern's grams come to the driver, at most one a character of the pattern.
    """
    shape = _shape(spark, path)
    counts = _read(spark, path, "counts", _schema(shape, "counts"))
    asked = spark.createDataFrame([(g,) for g in grams], "gram string").select("gram", _bucket("gram", shape["buckets"]).alias("bucket"))
    keys = [(r.gram, r.bucket) for r in asked.collect()]
    found = {r.gram: r.n for r in counts.where(_any_of(keys)).select("gram", "n").collect()}
    rarest = sorted(keys, key=lambda k: (found.get(k[0], 0), k))[:most]
    hits = _read(spark, path, "postings", _schema(shape, "postings")).where(_any_of(rarest))
    return hits.groupBy("part", "file_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(rarest)).drop("_n")


def _any_of(keys: list[tuple[str, int]]) -> Column:
    return F.col("bucket").isin(sorted({b for _, b in keys})) & F.col("gram").isin([g for g, _ in keys])


def search_index(spark: SparkSession, path: str, pattern: str, limit: int | None = None) -> DataFrame:
    """The lines that ``search_code`` finds in the indexed files, in the same columns."""
    texts = _read(spark, path, "texts", _schema(_shape(spark, path), "texts"))
    grams = required_grams(pattern)
    if not grams:
        return search_code(texts, pattern, limit)
    few = candidates(spark, path, grams).select(F.col("part").alias("_part"), F.col("file_id").alias("_id"))
    same = (F.col("part") == F.col("_part")) & F.col("file_id").eqNullSafe(F.col("_id"))
    return search_code(texts.join(few, same, "left_semi"), pattern, limit)
