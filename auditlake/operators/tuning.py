"""Model and prompt evaluation over labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import scalars as S
from auditlake.operators.scale import first_n, paired_with_each, spread_by_rows

# Votes that all mean "not exploitable".
NOT_EXPLOITABLE = ["FALSE_POSITIVE", "FP", "WEAKNESS"]

# Placeholders of a prompt template and the context column each is filled from.
PLACEHOLDERS = {
    "file_path": "file_path",
    "language": "language",
    "finding_title": "title",
    "finding_type": "vulnerability_type",
    "finding_severity": "severity",
    "finding_line": "line_number",
    "finding_reason": "reason",
    "code_snippet": "snippet",
    "code_context": "context",
    "output_format": "output_format",
    "title": "title",
    "vuln_type": "vulnerability_type",
    "vulnerability_type": "vulnerability_type",
    "severity": "severity",
    "line": "line_number",
    "line_number": "line_number",
    "snippet": "snippet",
    "reason": "reason",
    "details": "reason",
    "context": "context",
    "code": "snippet",
    "claim": "reason",
    "issue": "title",
    "file": "file_path",
}


def is_correct(predicted: Column | str, truth: Column | str) -> Column:
    """Equal, or both mean not exploitable; a missing prediction is wrong."""
    p, t = F.upper(F.trim(S.col(predicted))), F.upper(F.trim(S.col(truth)))
    both = p.isin(NOT_EXPLOITABLE) & t.isin(NOT_EXPLOITABLE)
    return F.coalesce((p == t) | both, F.lit(False))


def judged(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Results beside the verdict of their case, with the ``correct`` flag."""
    return results.join(cases.select("case_id", "verdict"), "case_id").withColumn(
        "correct", is_correct("predicted_vote", "verdict")
    )


def judged_by_case(results: DataFrame, cases: DataFrame) -> DataFrame:
    """As ``judged``, dealt by case to partitions of bounded size, for groups of a case."""
    return judged(*spread_by_rows(["case_id"], results, cases.select("case_id", "verdict")))


def test_grid(models: DataFrame, prompts: DataFrame, cases: DataFrame) -> DataFrame:
    """Every model with every prompt and case: cases stay partitioned, the short lists ride along."""
    with_model = paired_with_each(cases, models, "model")
    return paired_with_each(with_model, prompts, "prompt").select(
        *cases.columns, "model.*", "prompt.*"
    )


def fill_template(template: Column | str, contexts: dict[str, str] = PLACEHOLDERS) -> Column:
    """Put context columns into the ``{name}`` placeholders, missing values as empty text."""
    out = S.col(template)
    for name, column in contexts.items():
        value = F.coalesce(F.col(column).cast("string"), F.lit(""))
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def run_analysis(results: DataFrame) -> DataFrame:
    """Overall, per model, per prompt, per case and model x prompt in one grouping-sets pass."""
    sets = [[], ["model_name"], ["prompt_id"], ["case_id"], ["model_name", "prompt_id"]]
    level = (
        F.when(F.grouping("case_id") == 0, F.lit("case"))
        .when((F.grouping("model_name") == 0) & (F.grouping("prompt_id") == 0), F.lit("model_prompt"))
        .when(F.grouping("model_name") == 0, F.lit("model"))
        .when(F.grouping("prompt_id") == 0, F.lit("prompt"))
        .otherwise(F.lit("all"))
    )
    total = F.count(F.lit(1))
    return results.groupingSets(sets, "model_name", "prompt_id", "case_id").agg(
        level.alias("level"),
        total.alias("total"),
        F.count_if("correct").alias("correct"),
        (F.count_if("correct") / total * 100).alias("accuracy"),
        (F.count_if("parse_success") / total * 100).alias("parse_rate"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("duration_ms").alias("avg_duration_ms"),
    )


def confusion(results: DataFrame) -> DataFrame:
    """Confusion counts per model and prompt with REAL as positive; 0 on empty denominators."""
    truth = F.upper("verdict") == "REAL"
    said = F.upper(F.coalesce("predicted_vote", F.lit(""))) == "REAL"
    counts = results.groupBy("model_name", "prompt_id").agg(
        F.count_if(truth & said).alias("tp"),
        F.count_if(~truth & said).alias("fp"),
        F.count_if(truth & ~said).alias("fn"),
        F.count_if(~truth & ~said).alias("tn"),
    )
    div = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        counts.withColumn("precision", div(tp, tp + fp))
        .withColumn("recall", div(tp, tp + fn))
        .withColumn("f1", F.round(div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 6))
        .orderBy(F.desc("f1"), "model_name", "prompt_id")
    )


def case_stats(cases: DataFrame) -> DataFrame:
    """Case counts by verdict, CWE, scan and origin in one grouping-sets pass."""
    sets = [[], ["verdict"], ["cwe_type"], ["scan_id"], ["is_synthetic"]]
    level = F.lit("all")
    for c in ("verdict", "cwe_type", "scan_id", "is_synthetic"):
        level = F.when(F.grouping(c) == 0, F.lit(c)).otherwise(level)
    return (
        cases.groupingSets(sets, "verdict", "cwe_type", "scan_id", "is_synthetic")
        .agg(level.alias("level"), F.count(F.lit(1)).alias("n"))
        .where(~((F.col("level") == "cwe_type") & F.col("cwe_type").isNull()))
    )


def model_summary(results: DataFrame) -> DataFrame:
    """Accuracy over successful results and mean confidence per model."""
    ok = F.col("parse_success")
    return results.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("successful"),
        F.count_if(ok & F.col("correct")).alias("correct"),
        F.expr("coalesce(count_if(parse_success and correct) / nullif(count_if(parse_success), 0) * 100, 0D)").alias("accuracy"),
        F.coalesce(F.avg(F.when(ok, F.col("confidence"))), F.lit(0.0)).alias("avg_confidence"),
    )


def accuracy_by(results: DataFrame, *keys: str) -> DataFrame:
    return (
        results.where("parse_success")
        .groupBy(*keys)
        .agg(
            F.count_if("correct").alias("correct"),
            F.count(F.lit(1)).alias("total"),
            (F.count_if("correct") / F.count(F.lit(1)) * 100).alias("accuracy"),
        )
    )


def top_prompts(results: DataFrame, n: int = 10) -> DataFrame:
    return accuracy_by(results, "prompt_id").orderBy(F.desc("accuracy"), "prompt_id").limit(n)


def case_difficulty(results: DataFrame) -> DataFrame:
    """Hardest cases first: HARD below 40 % accuracy, MEDIUM below 70, else EASY."""
    return (
        accuracy_by(results, "case_id")
        .withColumn(
            "difficulty",
            F.when(F.col("accuracy") < 40, "HARD").when(F.col("accuracy") < 70, "MEDIUM").otherwise("EASY"),
        )
        .orderBy("accuracy", "case_id")
    )


def accuracy_margins(results: DataFrame) -> DataFrame:
    """Accuracy per model x prompt with both margins and the total."""
    return (
        results.where("parse_success")
        .cube("model_name", "prompt_id")
        .agg(
            F.grouping_id().alias("margin"),
            F.count_if("correct").alias("correct"),
            F.count(F.lit(1)).alias("total"),
            (F.count_if("correct") / F.count(F.lit(1)) * 100).alias("accuracy"),
        )
    )


def calibration(results: DataFrame) -> DataFrame:
    """Mean confidence when right minus when wrong; overconfident below 0, good above 10."""
    conf = F.col("confidence")
    ok = results.where("parse_success and confidence is not null")
    return (
        ok.groupBy("model_name")
        .agg(
            F.coalesce(F.avg(F.when(F.col("correct"), conf)), F.lit(0.0)).alias("avg_correct"),
            F.coalesce(F.avg(F.when(~F.col("correct"), conf)), F.lit(0.0)).alias("avg_incorrect"),
        )
        .withColumn("gap", F.col("avg_correct") - F.col("avg_incorrect"))
        .withColumn(
            "judgement",
            F.when(F.col("gap") < 0, "overconfident").when(F.col("gap") > 10, "good").otherwise("neutral"),
        )
    )


def prompt_sensitive(results: DataFrame) -> DataFrame:
    """Results of the (case, model) pairs whose prompts led to different votes."""
    ok = results.where("parse_success")
    mixed = (
        ok.where("predicted_vote is not null")
        .groupBy("case_id", "model_name")
        .agg(F.min("predicted_vote").alias("lo"), F.max("predicted_vote").alias("hi"))
        .where("lo <> hi")
        .select("case_id", "model_name")
    )
    return ok.join(mixed, ["case_id", "model_name"], "left_semi")


def best_prompt_per_model(results: DataFrame) -> DataFrame:
    scored = accuracy_by(results, "model_name", "prompt_id")
    return first_n(scored, ["model_name"], [F.desc("accuracy"), F.col("prompt_id")], 1).drop("rn")


def best_prompt(results: DataFrame) -> DataFrame:
    return accuracy_by(results, "prompt_id").orderBy(F.desc("accuracy"), "prompt_id").limit(1)


def benchmark_summary(matched: DataFrame) -> DataFrame:
    """Passes (true positives and true negatives), fails and latency of a benchmark run."""
    ok = F.col("verdict").startswith("TP") | (F.col("verdict") == "TN")
    return matched.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("passed"),
        F.count_if(~ok).alias("failed"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.sum("latency_ms").alias("total_latency_ms"),
    )


def label_scores(found: DataFrame, labels: DataFrame) -> DataFrame:
    """TP, debatable and FP counts per model from hand labels, with the FP share."""
    joined = found.select("file_id", "model").join(labels.select("file_id", "label"), "file_id")
    label = F.col("label")
    return joined.groupBy("model").agg(
        F.count_if(label == "TP").alias("tp"),
        F.count_if(label == "DEBATABLE").alias("debatable"),
        F.count_if(label == "FP").alias("fp"),
        (F.count_if(label == "FP") / F.count(F.lit(1)) * 100).alias("fp_rate"),
    )
