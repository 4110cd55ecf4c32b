"""How often and how much files change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percentile, rounded


def counts(files: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """files with churn_commits (rows of changes) and churn_lines (added + deleted; binary rows, which have null, add none)."""
    lines = F.coalesce(F.col("added") + F.col("deleted"), F.lit(0))
    per_file = changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("churn_commits"), F.sum(lines).cast("long").alias("churn_lines"))
    return files.join(per_file, keys, "left").fillna(0, ["churn_commits", "churn_lines"])


def composite(commits: Column | str, lines: Column | str, *group: str) -> tuple[Column, Column, Column]:
    """(percentile of commits, of lines, their mean). The churn percentile ranks the mean, rounded so that equal means tie."""
    by_commits, by_lines = percentile(commits, *group), percentile(lines, *group)
    return by_commits, by_lines, rounded(F.lit(0.5) * by_commits + F.lit(0.5) * by_lines, 10)


def with_churn_pct(files: DataFrame, *group: str) -> DataFrame:
    mean = composite("churn_commits", "churn_lines", *group)[2]
    return files.withColumn("churn_signal", mean).withColumn("churn_pct", percentile("churn_signal", *group)).drop("churn_signal")


def zero_inflation(files: DataFrame, *group: str) -> DataFrame:
    """Whether more than half of a group's files have no churn, and how many percent."""
    zeros = F.count_if(F.col("churn_commits") == 0)
    out = files.groupBy(*group).agg(F.count(F.lit(1)).alias("n_files"), zeros.alias("zero_files"))
    return out.select(
        *group, "n_files", "zero_files",
        F.floor(F.col("zero_files") * 100.0 / F.col("n_files") + 0.5).cast("long").alias("zero_percentage"),
        (F.col("zero_files") > 0.5 * F.col("n_files")).alias("zero_inflated"),
    )
