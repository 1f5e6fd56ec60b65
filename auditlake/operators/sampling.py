"""Test-case candidates and class-balanced samples of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import scalars as S
from auditlake.operators import votes as V
from auditlake.operators.scale import RANGE, exact_row_number, first_n, offsets_before, ordered_ranges


def candidates(drafts: DataFrame, votes: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Drafts with votes, their consensus, mean confidence and difficulty."""
    return drafts.join(V.consensus(votes, min_confidence), "draft_id").withColumn(
        "difficulty", 1 - F.col("avg_confidence")
    )


def case_fields(cands: DataFrame) -> DataFrame:
    """Verdict from the status and the case name."""
    verdict = S.lookup(S.STATUS_VERDICT, F.col("status"), "UNKNOWN")
    cwe = F.coalesce(S.cwe_id("vulnerability_type"), F.lit("unknown"))
    return cands.withColumn("verdict", verdict).withColumn(
        "name",
        F.concat(
            F.lit("scan"), F.col("scan_id"), F.lit("_draft"), F.col("draft_id"), F.lit("_"), cwe, F.lit("_"), F.col("verdict")
        ),
    )


def balanced_sample(cands: DataFrame, target: int) -> DataFrame:
    """A third of ``target`` per class, most decided first, then the first of the rest."""
    decided = F.abs(F.lit(0.5) - F.col("avg_confidence"))
    picked = first_n(
        cands.where(F.col("status").isin(list(S.STATUS_VERDICT))),
        ["status"], [F.desc(decided), F.col("draft_id")], target // 3,
    ).select("draft_id", F.lit(True).alias("_picked"))
    return (
        cands.join(picked, "draft_id", "left")
        .withColumn("balanced", F.coalesce("_picked", F.lit(False)))
        .orderBy(F.desc("balanced"), "draft_id")
        .limit(target)
        .drop("_picked")
    )


def first_come_quota(cases: DataFrame, limit: int) -> DataFrame:
    """The first ``limit // 3`` cases of every verdict, in id order."""
    return first_n(cases, ["verdict"], [F.col("draft_id")], limit // 3)


def unique_names(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Suffix ``_1, _2 ...`` to names that occur before in the batch or in ``existing``.

    A name takes the free numbers in turn (0: no suffix): a number is taken if ``existing`` or a row
    of the batch already spells it out. The r-th free number is r plus the taken numbers before it,
    so taken numbers, each moved back by those before it, and new rows are put in one order and
    the taken ones counted. A name may be on any share of the rows: rows are numbered range by range.
    """
    stem, suffix = F.regexp_extract("name", r"^(.*)_([1-9][0-9]{0,17})$", 1), F.regexp_extract("name", r"_([1-9][0-9]{0,17})$", 1)
    spelled = existing.select("name").unionByName(new.select("name")).distinct()
    taken = (
        existing.select("name", F.lit(0).cast("bigint").alias("_number"))
        .unionByName(spelled.where(suffix != "").select(stem.alias("name"), suffix.cast("bigint").alias("_number")))
        .distinct()
        .join(new.select("name").distinct(), "name", "left_semi")
    )
    moved = exact_row_number(taken, ["name"], [F.col("_number")], "_rn").select(
        "name", (F.col("_number") - F.col("_rn") + 1).alias("_at"), F.lit(0).alias("_new"), F.lit(None).cast("bigint").alias("draft_id")
    )
    ranked = exact_row_number(new, ["name"], [F.col("draft_id")], "_rn")
    wanted = ranked.select("name", (F.col("_rn") - 1).alias("_at"), F.lit(1).alias("_new"), F.col("_rn").alias("draft_id"))
    events = ordered_ranges(moved.unionByName(wanted), ["name"], [F.col("_at"), F.col("_new")])
    local = Window.partitionBy("name", RANGE).orderBy("_at", "_new").rowsBetween(Window.unboundedPreceding, 0)
    counted = events.withColumn("_local", F.sum(1 - F.col("_new")).over(local))
    before = offsets_before(events, ["name"], F.sum(1 - F.col("_new")), "_before")
    numbers = counted.where("_new = 1").join(before, ["name", RANGE]).select(
        "name", F.col("draft_id").alias("_rn"), (F.col("_at") + F.col("_local") + F.col("_before")).alias("_number")
    )
    unique = F.when(F.col("_number") > 0, F.concat(F.col("name"), F.lit("_"), F.col("_number"))).otherwise(F.col("name"))
    return ranked.join(numbers, ["name", "_rn"]).withColumn("unique_name", unique).drop("_rn", "_number")
