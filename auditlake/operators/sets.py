"""Unions, differences and intersections of findings and id lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text as X
from auditlake.operators.predicates import REQUIRED_FIELDS


def union_drafts(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def tagged_union(**sources: DataFrame) -> DataFrame:
    return union_drafts(*[df.withColumn("origin", F.lit(name)) for name, df in sources.items()])


def glob_union(analyzers: DataFrame) -> DataFrame:
    """Distinct globs of enabled analyzers per profile, one row a glob."""
    each = analyzers.where("enabled").select(
        "profile_id", F.explode(F.transform(F.split("file_filter", ","), lambda g: F.trim(g))).alias("glob")
    )
    return each.where("glob <> ''").distinct()


def not_picked(candidates: DataFrame, picked: DataFrame) -> DataFrame:
    return candidates.exceptAll(picked)


def existing_ids(answers: DataFrame, known: DataFrame) -> DataFrame:
    """Id lists (list_name, ids) kept to the ids that exist, in order; empty lists drop out."""
    each = answers.select("scan_id", "list_name", F.posexplode("ids").alias("pos", "finding_id"))
    kept = each.join(known.select("scan_id", "finding_id"), ["scan_id", "finding_id"], "left_semi")
    return kept.groupBy("scan_id", "list_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "finding_id"))), lambda e: e["finding_id"]).alias("ids")
    )


def fill_blanks(original: DataFrame, retry: DataFrame, key: str, fields: list[str] = REQUIRED_FIELDS) -> DataFrame:
    """Retry values where the original is null or blank."""
    other = retry.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    blank = lambda c: F.coalesce(X.strip_spaces(F.col(c)), F.lit("")) == ""
    merged = {
        f: F.when(blank(f) & ~blank(f"_{f}"), F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields
    }
    rest = [c for c in original.columns if c not in fields]
    return original.join(other, key, "left").select(*rest, *merged.values())
