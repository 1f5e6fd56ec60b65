"""Model calls as an injected function, and output formats with overrides."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def infer(prompts: DataFrame, fn: Callable[[list[str]], list[str]], batch_size: int = 256) -> DataFrame:
    """Add ``response`` = fn(prompt), ``batch_size`` prompts a call; ``fn`` runs in the tasks."""
    fields = T.StructType([*prompts.schema.fields, T.StructField("response", T.StringType())])

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start : start + batch_size].copy()
                part["response"] = pd.Series(fn(part["prompt"].tolist()), index=part.index)
                yield part

    return prompts.mapInPandas(run, fields)


def output_formats(uses: DataFrame, overrides: DataFrame, defaults: DataFrame) -> DataFrame:
    """Template per role and mode: the profile's own, else the default of role and mode."""
    return (
        uses.join(overrides.withColumnRenamed("template", "_own"), ["profile_id", "role", "mode"], "left")
        .join(defaults.withColumnRenamed("template", "_default"), ["role", "mode"], "left")
        .withColumn("template", F.coalesce("_own", "_default"))
        .drop("_own", "_default")
    )
