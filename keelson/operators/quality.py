"""Complexity, length and test coverage of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percentile

RUBY_MESSAGE, JS_MESSAGE = r"\[(\d+)/0\]", r"complexity of (\d+)"


def readable(files: DataFrame, messages: DataFrame, keys: list[str]) -> DataFrame:
    """files without those that the linter couldn't read."""
    return files.join(messages.filter("skipped").select(*keys).distinct(), keys, "left_anti")


def max_complexity(files: DataFrame, messages: DataFrame, pattern: str, keys: list[str]) -> DataFrame:
    """files with complexity: the greatest number that the pattern finds in a file's messages, 0 if none."""
    found = messages.groupBy(*keys).agg(F.max(F.expr(f"try_cast(regexp_extract(message, r'{pattern}', 1) AS INT)")).alias("complexity"))
    return files.join(found, keys, "left").withColumn("complexity", F.coalesce("complexity", F.lit(0)))


def nonblank_lines(text: Column) -> Column:
    """Lines with something other than white space; comments count."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.regexp_replace(x, r"[\s\x00]", "")) > 0))


def loc(content: Column) -> Column:
    """Of a binary content; 0 if it isn't UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), nonblank_lines(content.cast("string"))).otherwise(0)


def is_generated(text: Column) -> Column:
    """Whether the first line that isn't blank says so."""
    first = F.try_element_at(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S")), F.lit(1))
    return F.coalesce(first.rlike(r"(?i)^\s*#\s*This file is auto-generated"), F.lit(False))


def line_rate(hits: Column) -> Column:
    """Covered share of the executable lines (null: not executable); 0 if there are none."""
    run = F.filter(hits, lambda h: h.isNotNull())
    return F.when(F.size(run) > 0, F.size(F.filter(run, lambda h: h > 0)) / F.size(run).cast("double")).otherwise(0.0)


def max_merge(hits: DataFrame, keys: list[str]) -> DataFrame:
    """hits: keys, hits array<int>, several rows for a file. Per file line_rate over the greatest hits of each line.

    Shorter arrays end early, and a line is executable if any row has it so.
    """
    lines = hits.select(*keys, F.posexplode_outer("hits").alias("line", "hit"))
    merged = lines.groupBy(*keys, "line").agg(F.max("hit").alias("hit"))
    return merged.groupBy(*keys).agg(
        F.count("hit").alias("executable"), F.count_if(F.col("hit") > 0).alias("covered")
    ).select(*keys, "executable", "covered", F.when(F.col("executable") > 0, F.col("covered") / F.col("executable").cast("double")).otherwise(0.0).alias("line_rate"))


def suffix_match(reported: DataFrame, files: DataFrame, repo: str = "repo_id") -> DataFrame:
    """Report paths mapped to the file whose path is their longest suffix: repo, reported, path."""
    parts = F.split(F.regexp_replace("reported", "^/+", ""), "/")
    each = F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    tried = reported.select(repo, "reported").distinct().select(repo, "reported", each.alias("skipped", "path"))
    hit = tried.join(files.select(repo, "path"), [repo, "path"])
    return hit.groupBy(repo, "reported").agg(F.min_by("path", "skipped").alias("path"))


def with_coverage(files: DataFrame, report: DataFrame | None, keys: list[str]) -> DataFrame:
    """files with coverage and coverage_status: present, missing (a file the report lacks) or unavailable (no report)."""
    if report is None:
        return files.withColumn("coverage", F.lit(None).cast("double")).withColumn("coverage_status", F.lit("unavailable"))
    own = report.select(*keys, F.col("line_rate").alias("coverage"))
    return files.join(own, keys, "left").withColumn("coverage_status", F.when(F.col("coverage").isNull(), "missing").otherwise("present"))


def risk(coverage: Column) -> Column:
    """Uncovered share; a missing file counts as uncovered."""
    return F.lit(1.0) - F.coalesce(coverage, F.lit(0.0))


def risk_pct(coverage: Column, *group: str) -> Column:
    return percentile(risk(coverage), *group)
