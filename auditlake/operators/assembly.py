"""Prompt context per draft from the sections other operators build."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators import search as Q
from auditlake.operators import symbols as S
from auditlake.operators.context import cap_context, marked_context


def draft_contexts(drafts: DataFrame, files: DataFrame, max_tokens: int, around: int = 20) -> DataFrame:
    """Application type, imports, entry points and marked code per draft, joined file by file.

    The section texts are built once per file; what a file gathers comes from its own lines.
    """
    imports = S.import_table(files).join(files.select("file_id", "scan_id"), "file_id")
    app = Q.application_types(files, imports)
    import_text = imports.groupBy("file_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("# "), F.col("module")))), "\n").alias("imports")
    )
    entry_text = (
        Q.entry_points(files)
        .groupBy("file_id")
        .agg(
            F.array_join(
                F.array_sort(F.collect_set(F.concat(F.col("type"), F.lit(" at line "), F.format_string("%06d", "line_number")))), "\n"
            ).alias("entries")
        )
    )
    per_file = (
        files.select("file_id", "scan_id", "content")
        .join(app, "scan_id")
        .join(import_text, "file_id", "left")
        .join(entry_text, "file_id", "left")
        .drop("scan_id")
    )
    section = lambda title, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"=== {title} ===\n"), F.col(c)))
    line = F.col("line_number")
    text = F.concat_ws(
        "\n",
        section("Application", "app_type"),
        section("Threat model", "threat_model"),
        section("Imports", "imports"),
        section("Entry points", "entries"),
        F.lit("=== Code ==="),
        marked_context("content", line, line, around),
    )
    return drafts.select("draft_id", "file_id", "line_number").join(per_file, "file_id").select(
        "draft_id", "file_id", cap_context(text, max_tokens).alias("context")
    )
