"""Symbol, import and call tables from code texts by regex spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.scalars import col, computed, let
from auditlake.operators.predicates import extension, file_name


def module_name(path: Column | str) -> Column:
    """Dotted module of a Python path, file name of anything else."""
    p = col(path)
    dotted = F.replace(F.regexp_replace(p, r"\.py$", ""), F.lit("/"), F.lit("."))
    return F.when(extension(p) == "py", dotted).otherwise(file_name(p))


def qualified_name(path: Column | str, name: Column | str) -> Column:
    return F.concat(module_name(path), F.lit("."), col(name))


# Definition lines, tried in this order. No group repeats, so a line of any length needs no stack.
DEFINITIONS = [
    r"^[\w\*][\w\*\s]*\s(\w+)\s*\([^)]*\)\s*\{?\s*$",
    r"^def\s+(\w+)\s*\([^)]*\)\s*:",
    r"^(?:VOID|EFI_STATUS|BOOLEAN|UINTN|UINT\d+)\s*\n?(\w+)\s*\(",
]
PY_IMPORT = r"^\s*(?:import|from)\s+([\w.]+)"
C_INCLUDE = r"^\s*#include\s*[<\"]([^>\"]+)[>\"]"
CALL = r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\("
# Words before a parenthesis that are no callees in a call graph.
NO_CALLEES = ["if", "for", "while", "switch", "return", "sizeof", "printf", "fprintf"]


def code_lines(files: DataFrame) -> DataFrame:
    """One row per line; the text itself is not carried along."""
    keep = [c for c in files.columns if c != "content"]
    return files.select(*keep, F.posexplode(F.split("content", "\n")).alias("_pos", "line")).select(
        *keep, (F.col("_pos") + 1).alias("line_number"), "line"
    )


def _definition(line: Column) -> Column:
    """The name a line defines; null for other lines, most of which hold no parenthesis or start with a blank."""
    names = F.array(*[F.regexp_extract(line, p, 1) for p in DEFINITIONS])
    return F.when(line.contains("(") & ~line.startswith(" ") & ~line.startswith("\t"), F.get(F.filter(names, lambda n: n != ""), F.lit(0)))


def function_spans(files: DataFrame) -> DataFrame:
    """``files`` with its lines as ``_lines`` and ``_spans``: array<struct<name, start, end>>, in order.

    A function starts at its definition line and ends where its braces balance, or before the next
    definition. All of it happens inside the file's row: nothing is exploded or shuffled. Lines,
    definitions and spans are each computed once a file; the folds are linear in its lines.
    """
    braces = lambda line, c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))

    def span(lines: Column, marks: Column, mark: Column, i: Column) -> Column:
        last = F.coalesce(F.get(marks, i + 1)["start"] - 1, F.size(lines))
        start = F.struct(
            F.lit(0).alias("depth"), F.lit(False).alias("opened"), (mark["start"] - 1).alias("at"), F.lit(False).alias("closed")
        )

        def step(s: Column, line: Column) -> Column:
            opens, closes = braces(line, "{"), braces(line, "}")
            depth = s["depth"] + opens - closes
            opened = s["opened"] | (opens > 0)
            return F.when(s["closed"], s).otherwise(
                F.struct(depth.alias("depth"), opened.alias("opened"), (s["at"] + 1).alias("at"), (opened & (depth <= 0)).alias("closed"))
            )

        body = F.slice(lines, mark["start"], last - mark["start"] + 1)
        return F.struct(mark["name"].alias("name"), mark["start"].alias("start"), F.aggregate(body, start, step)["at"].alias("end"))

    def spans(lines: Column) -> Column:
        marks = F.transform(lines, lambda line, i: F.struct(_definition(line).alias("name"), (i + 1).alias("start")))
        named = F.filter(marks, lambda m: m["name"].isNotNull())
        return let(named, lambda ms: F.transform(ms, lambda mark, i: span(lines, ms, mark, i)))

    lined = computed(files, F.split("content", "\n").alias("_lines"))
    return computed(lined, spans(F.col("_lines")).alias("_spans"))


def _lines_of(span: Column, each) -> Column:
    """``each(line, number)`` for the lines of a span."""
    return F.transform(F.slice("_lines", span["start"], span["end"] - span["start"] + 1), lambda line, i: each(line, span["start"] + i))


def enclosing_functions(files: DataFrame) -> DataFrame:
    """Lines inside functions with the function that encloses them; map-only."""
    keep = [c for c in files.columns if c != "content"]
    lines = F.flatten(
        F.transform(
            "_spans",
            lambda s: _lines_of(
                s, lambda line, n: F.struct(n.alias("line_number"), line.alias("line"), s["name"].alias("function"), s["start"].alias("start_line"))
            ),
        )
    )
    return function_spans(files).select(*keep, lines.alias("_in")).select(*keep, F.inline("_in"))


def symbol_table(files: DataFrame) -> DataFrame:
    """Functions with their first and last line; map-only."""
    spans = F.transform(
        "_spans", lambda s: F.struct(s["name"].alias("name"), s["start"].alias("start_line"), s["end"].alias("end_line"))
    )
    return (
        function_spans(files).select("file_id", "file_path", spans.alias("_s"))
        .select("file_id", "file_path", F.inline("_s"))
        .withColumn("qualified_name", qualified_name("file_path", "name"))
    )


def import_table(files: DataFrame) -> DataFrame:
    lines = code_lines(files)
    module = F.coalesce(
        *[F.nullif(F.regexp_extract("line", p, 1), F.lit("")) for p in (PY_IMPORT, C_INCLUDE)]
    )
    return lines.select("file_id", "file_path", "line_number", module.alias("module")).where("module is not null")


def call_table(files: DataFrame) -> DataFrame:
    """Call sites (file, line, callee) with the function around them, null outside of functions.

    Calls of a function inside itself, its definition line among them, drop out. Map-only.
    """
    none, none_called = F.lit(None).cast("string"), F.array().cast("array<string>")
    gaps = F.transform(
        F.sequence(F.lit(0), F.size("_spans")),
        lambda i: F.struct(
            none.alias("name"), (F.coalesce(F.get("_spans", i - 1)["end"], F.lit(0)) + 1).alias("start"),
            F.coalesce(F.get("_spans", i)["start"] - 1, F.size("_lines")).alias("end"),
        ),
    )
    ranges = F.concat("_spans", F.filter(gaps, lambda g: g["end"] >= g["start"]))

    def calls(s: Column) -> Column:
        return F.flatten(
            _lines_of(
                s,
                lambda line, n: F.transform(
                    F.when(line.contains("("), F.regexp_extract_all(line, F.lit(CALL), F.lit(1))).otherwise(none_called),
                    lambda c: F.struct(
                        s["name"].alias("function"), F.when(s["name"].isNotNull(), s["start"]).alias("start_line"),
                        n.alias("line_number"), c.alias("callee"),
                    ),
                ),
            )
        )

    found = function_spans(files).select("file_id", F.flatten(F.transform(ranges, calls)).alias("_c"))
    return found.select("file_id", F.inline("_c")).where(~F.col("callee").eqNullSafe(F.col("function")))
