"""Keep failing records, with their reasons, beside the good ones."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_verdict(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Add ``ok`` and ``error``; ``checks`` maps a message to the condition that makes a record fail."""
    reasons = [F.when(F.coalesce(failed, F.lit(True)), F.lit(text)) for text, failed in checks.items()]
    return (df.withColumn("error", F.nullif(F.concat_ws("; ", *reasons), F.lit("")))
              .withColumn("ok", F.col("error").isNull()))


def with_rejects(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(records that pass every check, failing records with ``error``)."""
    judged = with_verdict(df, checks)
    return judged.where("ok").drop("ok", "error"), judged.where("not ok").drop("ok")
