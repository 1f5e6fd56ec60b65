"""Scalar rules as column expressions: all JVM-side, no Python workers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severity words in matching order, their normal form, and severity ranks.
SEVERITY_WORDS = {
    "critical": "Critical",
    "crit": "Critical",
    "high": "High",
    "medium": "Medium",
    "med": "Medium",
    "moderate": "Medium",
    "low": "Low",
    "info": "Low",
    "informational": "Low",
    "weakness": "Low",
}
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "INFO": 0}

# Error classes and the words that select them, first class wins.
ERROR_CLASSES = [
    ("timeout", ["timeout", "timed out"]),
    ("rate_limit", ["rate limit", "429"]),
    ("model_error", ["model", "inference"]),
    ("parse_error", ["parse", "json"]),
    ("connection_error", ["connection", "network"]),
]

# Status of a draft to verdict of a test case.
STATUS_VERDICT = {
    "verified": "REAL",
    "rejected": "FALSE_POSITIVE",
    "weakness": "WEAKNESS",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` reads it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def computed(df: DataFrame, *values: Column) -> DataFrame:
    """``df`` with further columns that later expressions read and never compute again.

    Spark puts the expression of a column wherever the column is read, inside lambdas too, once per
    element there. A generator is not moved: what it makes is made once a row.
    """
    return df.select("*", F.inline(F.array(F.struct(*values))))


def totals_before(values: Column, block: int = 256) -> Column:
    """Sums of the earlier elements, for each element of an array; by blocks, so that long arrays stay near linear."""
    zero = F.lit(0).cast("bigint")

    def running(array: Column) -> Column:
        start = F.struct(zero.alias("sum"), F.array().cast("array<bigint>").alias("before"))
        step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["before"], F.array(s["sum"])).alias("before"))
        return F.aggregate(array, start, step)["before"]

    def in_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda s, x: s + x))
        return F.flatten(F.zip_with(F.transform(blocks, running), running(sums), lambda inner, o: F.transform(inner, lambda v: v + o)))

    def split(array: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(array), F.lit(1)), F.lit(block))
        return let(F.transform(starts, lambda at: F.slice(array, at, F.lit(block))), in_blocks)

    return let(values, split)


def lookup(table: dict, key: Column, default: object = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = pairs[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def contains_any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def normalize_severity(value: Column | str) -> Column:
    """Strip markdown and a trailing (...), map the word, else the first word contained; Medium else."""
    raw = col(value)
    cleaned = F.trim(
        F.regexp_replace(F.regexp_replace(F.trim(raw), r"[*#\-_]+", ""), r"\s*\(.*\)$", "")
    )
    low = F.lower(cleaned)
    result = lookup(SEVERITY_WORDS, low)
    partial = F.when(F.lit(False), F.lit("Medium"))
    for word, normal in SEVERITY_WORDS.items():
        partial = partial.when(low.contains(word), F.lit(normal))
    return F.when(raw.isNull() | (raw == ""), F.lit("Medium")).otherwise(
        F.coalesce(result, partial.otherwise(F.lit("Medium")))
    )


def parse_cvss(value: Column | str) -> Column:
    """The value itself when it is a number in 0..10, else the first number in it."""
    text = F.trim(col(value))
    direct = text.try_cast("double")
    found = F.regexp_extract(text, r"(\d+\.?\d*)", 1).try_cast("double")
    in_range = lambda c: (c >= 0.0) & (c <= 10.0)
    return F.when(in_range(direct), direct).when(in_range(found), found)


def classify_error(message: Column | str) -> Column:
    low = F.lower(col(message))
    out = F.when(F.lit(False), F.lit("unknown"))
    for name, words in ERROR_CLASSES:
        out = out.when(contains_any(low, words), F.lit(name))
    return out.otherwise(F.lit("unknown"))


def severity_rank(severity: Column | str) -> Column:
    """CRITICAL 4 down to INFO 0; a missing severity counts as LOW, an unknown one as 0."""
    upper = F.upper(F.coalesce(col(severity), F.lit("LOW")))
    return lookup(SEVERITY_RANK, upper, 0)


def severity_order(severity: Column | str) -> Column:
    """Sort position of a severity: Critical first, unknown last."""
    return lookup({"critical": 0, "high": 1, "medium": 2, "low": 3}, F.lower(col(severity)), 4)


def cwe_id(text: Column | str) -> Column:
    """``CWE-n`` in a text, with Unicode dashes read as hyphens; null when absent."""
    plain = F.translate(col(text), "‐‑‒–—―−", "-------")
    digits = F.regexp_extract(plain, r"CWE-(\d+)", 1)
    return F.when(digits != "", F.concat(F.lit("CWE-"), digits))


def dedup_key(file: Column | str, line: Column | str, kind: Column | str) -> Column:
    return F.md5(F.concat_ws(":", col(file), col(line), col(kind)))


def finding_signature(line: Column | str, kind: Column | str) -> Column:
    return F.concat_ws(":", col(line), F.translate(F.lower(col(kind)), " -", "__"))


def truncate_middle(text: Column | str, limit: int) -> Column:
    """Texts over ``limit`` keep their first and last half around a marker."""
    c = col(text)
    half = limit // 2
    marker = F.lit("\n\n... [TRUNCATED] ...\n\n")
    return F.when(
        F.length(c) > limit, F.concat(F.left(c, F.lit(half)), marker, F.right(c, F.lit(half)))
    ).otherwise(c)
