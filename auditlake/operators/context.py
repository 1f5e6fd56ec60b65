"""Code context around lines: slices of the file's line array, no window over lines needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.scalars import col


def lines_of(content: Column | str) -> Column:
    return F.split(col(content), "\n")


def line_slice(lines: Column, first: Column, last: Column) -> Column:
    """Lines ``first..last``, both clipped to the file."""
    lo = F.greatest(first, F.lit(1))
    hi = F.least(last, F.size(lines))
    return F.slice(lines, lo, F.greatest(hi - lo + 1, F.lit(0)))


def marked_context(content: Column | str, start: Column, end: Column, around: int = 20) -> Column:
    """Lines around ``start..end``, numbered, the range itself marked with >>>."""
    lines = lines_of(content)
    lo = F.greatest(start - around, F.lit(1))
    body = F.transform(
        line_slice(lines, start - around, end + around),
        lambda x, i: F.concat(
            F.when((i + lo).between(start, end), F.lit(">>> ")).otherwise(F.lit("    ")),
            (i + lo).cast("string"),
            F.lit(": "),
            F.rtrim(x),
        ),
    )
    return F.array_join(body, "\n")


def file_context(
    content: Column | str, line: Column, around: int = 50, whole_lines: int = 200, whole_chars: int = 15000
) -> Column:
    """The whole file when it is small, else the marked lines around ``line``."""
    small = (F.size(lines_of(content)) <= whole_lines) & (F.length(col(content)) <= whole_chars)
    return F.when(small, col(content)).otherwise(marked_context(content, line, line, around))


def snippet(content: Column | str, line: Column) -> Column:
    """The line and its neighbours."""
    return F.array_join(line_slice(lines_of(content), line - 1, line + 1), "\n")


def cap_context(text: Column | str, max_tokens: int) -> Column:
    """Four characters a token; what is cut gets a marker."""
    c = col(text)
    return F.when(
        F.length(c) > max_tokens * 4,
        F.concat(F.left(c, F.lit(max_tokens * 4)), F.lit("\n... (context truncated)")),
    ).otherwise(c)


def chunk_context(chunks: DataFrame, files: DataFrame, around: int = 20) -> DataFrame:
    """Marked context per chunk: the file joins its chunks, text is read once per chunk."""
    joined = chunks.select("chunk_id", "file_id", "start_line", "end_line").join(
        files.select("file_id", F.col("content").alias("file_content")), "file_id"
    )
    return joined.select(
        "chunk_id", marked_context("file_content", F.col("start_line"), F.col("end_line"), around).alias("context")
    )
