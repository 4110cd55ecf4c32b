"""Files of text as rows, for one repository or many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def repository(repo_id: str | None) -> Column:
    """The given name, or the name of the folder that a file lies in."""
    return F.lit(repo_id) if repo_id is not None else folder(F.col("_metadata.file_path"))


def folder(path: Column) -> Column:
    """The last folder of a path, without `repo_id=`. No search from each place of the path, for this is done for each line."""
    return F.regexp_replace(F.substring_index(F.substring_index(path, "/", -2), "/", 1), "^repo_id=(?=.)", "")


def place() -> Column:
    """Where a row stands in its file, whatever tasks read the file."""
    return F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def whole(spark: SparkSession, path: str, repo_id: str | None) -> DataFrame:
    """repo_id, value: a row for each file."""
    return spark.read.text(path, wholetext=True).select(repository(repo_id).alias("repo_id"), "value")


def lines(spark: SparkSession, path: str, repo_id: str | None, separator: str | None = None) -> DataFrame:
    """repo_id, value."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return reader.text(path).select(repository(repo_id).alias("repo_id"), "value")


def numbered(rows: DataFrame) -> DataFrame:
    """rows with seq, their place in their repository from 0, in reading order.

    Two levels, so that no task sees a whole log: places within a partition, and the partitions' counts.
    """
    at = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))
    # the partition is a column of its own, so the window below stays within what one task has read
    inside = at.withColumn("nth", F.row_number().over(W.partitionBy("repo_id", "part").orderBy("at")) - 1)
    counts = at.groupBy("repo_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("repo_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("repo_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return inside.join(offsets, ["repo_id", "part"]).withColumn("seq", F.col("nth") + F.col("offset")).drop("at", "part", "nth", "offset")


def carried(rows: DataFrame, column: str, out: str) -> DataFrame:
    """rows (repo_id, value and more, as they are read) with the last value of the column that isn't null, at or above each row.

    A scan by segments: down the rows of each task's part of the text, then from part to part, by one row for each part.
    """
    at = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))
    inside = at.withColumn("here", F.last(column, ignorenulls=True).over(W.partitionBy("repo_id", "part").orderBy("at").rowsBetween(W.unboundedPreceding, 0)))
    ends = at.groupBy("repo_id", "part").agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col("at"))).alias("end"))
    before = W.partitionBy("repo_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    above = ends.select("repo_id", "part", F.last("end", ignorenulls=True).over(before).alias("above"))
    return inside.join(above, ["repo_id", "part"]).withColumn(out, F.coalesce("here", "above")).drop("at", "part", "here", "above")
