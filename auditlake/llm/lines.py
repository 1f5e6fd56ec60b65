"""Quality rules on words and lines, and cross-document line frequency; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import BLANKS, words_of
from auditlake.llm.registry import query, table

#: A line is boilerplate in a host where more documents than this have it; a document is depleted
#: when less than this share of its words is outside such lines.
MOST_DOCS, LEAST_LEFT = 20, 0.5
SALTS = 8


def base_features(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed to the rows.

    Counts look at the whole text (null: none). Repeated windows are found by sorting the hashed
    windows of a text inside its row, only where a distinct count shows that there are any, so the
    work is n log n and nothing is shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    listed = docs.select("*", words_of(F.col("text").cast("string")).alias("_words"), lines.alias("_lines"))
    windows = F.transform(
        F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    hashed = listed.select(
        "*",
        F.size("_words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        windows.alias("_windows"),
    ).drop("_words", "_lines")
    ordered = hashed.select(
        "*",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_sorted"),
    ).drop("_windows")
    same = lambda x, k: F.coalesce(F.get("_sorted", k)["h"] == x["h"], F.lit(False))
    again = F.filter("_sorted", lambda x, k: F.when(k > 0, same(x, k - 1)).otherwise(False) | same(x, k + 1))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    counted = ordered.select("*", F.coalesce(F.size(covered), F.lit(0)).cast("bigint").alias("n_repeat_words")).drop("_sorted")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("n_repeat_words", F.greatest("n_repeat_words", F.lit(0).cast("bigint"))).withColumn("base_failed", failed)


def normalised_lines(docs: DataFrame) -> DataFrame:
    """_key (of the document), _line (hash of host and normalised line), _pos, _n (words) of every line.

    Normalised: lower case, runs of digits as one 0, runs of blanks as one space, trimmed. Lines
    without a word are left out. A null host is a host of its own.
    """
    plain = F.lower(F.coalesce(F.col("text"), F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(plain, r"[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " ")
    host = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    split = docs.select("_key", host.alias("_host"), F.posexplode(F.split(plain, "\n")).alias("_pos", "_text"))
    trimmed = split.select("_key", "_host", "_pos", F.trim("_text").alias("_text")).where("_text != ''")
    return trimmed.select(
        "_key", F.xxhash64("_host", "_text").alias("_line"), "_pos", F.size(F.split("_text", BLANKS)).alias("_n")
    )


def boilerplate(lines: DataFrame, most_docs: int) -> DataFrame:
    """_line of the lines that more than ``most_docs`` documents of their host have.

    Two combined aggregates: distinct (line, document), then documents a line, so a line that a
    third of all documents share is one row a task in the second shuffle.
    """
    return lines.groupBy("_line").agg(F.count_distinct("_key").alias("_docs")).where(F.col("_docs") > most_docs).select("_line")


def line_quality(docs: DataFrame, most_docs: int = MOST_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """doc_id, the base features, n_boilerplate_words, kept of every row of ``docs`` (doc_id, text, source).

    ``kept`` is false if the base rules fail or if, without boilerplate lines, less than
    ``least_left`` of the words is left. Null and blank texts have no words, so they fail. Rows
    equal in id, source and text are one document in the counts and each get the result; a null id
    or source is a value like any other; empty input gives no rows; other columns are not read.
    Texts never leave their row: hashes of lines are shuffled, then one row a document.
    """
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    keyed = narrow.withColumn("_key", F.xxhash64("doc_id", F.col("source").isNull(), "source", F.col("text").isNull(), "text"))
    lines = normalised_lines(keyed)
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    common = boilerplate(lines, most_docs).select("_line", salt.alias("_salt"))
    salted = lines.withColumn("_salt", F.pmod("_key", F.lit(SALTS)).cast("int"))
    lost = (
        salted.join(common, ["_line", "_salt"]).select("_key", "_pos", "_n").distinct()
        .groupBy("_key").agg(F.sum("_n").cast("bigint").alias("n_boilerplate_words"))
    )
    rated = base_features(keyed).drop("text", "source").join(lost, "_key", "left")
    gone = F.coalesce("n_boilerplate_words", F.lit(0).cast("bigint"))
    left = (F.col("n_words") - gone) >= least_left * F.col("n_words")
    return rated.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        gone.alias("n_boilerplate_words"), (~F.col("base_failed") & left).alias("kept"),
    )


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s
  FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 1)) AS i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
raw AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
norm AS (SELECT r, doc_id, source, text, trim(unnest(string_split(regexp_replace(regexp_replace(lower(text), '[0-9]+', '0', 'g'),
  '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)))) AS line FROM d),
freq AS (SELECT source, line, count(DISTINCT (doc_id, text)) AS n FROM norm WHERE line <> '' GROUP BY source, line),
lost AS (SELECT r, sum(len(string_split(n.line, ' '))) AS n FROM norm n JOIN freq f
  ON f.line = n.line AND f.source IS NOT DISTINCT FROM n.source WHERE f.n > {MOST_DOCS} GROUP BY r),
b AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  coalesce(lost.n, 0)::BIGINT AS n_boilerplate_words
  FROM d JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_boilerplate_words,
  NOT base_failed AND n_words - n_boilerplate_words >= {LEAST_LEFT} * n_words AS kept FROM f
"""


@query("op1_line_frequency", SQL)
def op1_line_frequency(spark, sf_dir):
    return line_quality(table(spark, sf_dir, "documents"))
