"""Coverage reports -> (repo_id, path, line_rate). Readers take any number of repositories' files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import max_merge, suffix_match
from .texts import place, repository, whole


class CoverageError(ValueError):
    pass


def _relative(path, root: str):
    """Without the project's root and a leading `./`."""
    plain = F.regexp_replace(path, r"^(\./)+", "")
    if not root:
        return plain
    return F.when(path.startswith(root.rstrip("/") + "/"), F.substr(path, F.lit(len(root.rstrip("/")) + 2))).otherwise(plain)


def _matched(found: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Report paths to scored files: by the path below the root, or else by the longest suffix."""
    named = found.withColumn("reported", _relative(F.col("reported"), root))
    return named.join(suffix_match(named, files), ["repo_id", "reported"])


def _entries(rows: DataFrame) -> DataFrame:
    """rows: repo_id, body (a variant). repo_id, key, value of each entry of the objects; what isn't an object has none."""
    objects = rows.filter(F.schema_of_variant("body").startswith("OBJECT"))
    return objects.lateralJoin(objects.sparkSession.tvf.variant_explode(F.col("body").outer())).select("repo_id", "key", "value")


def resultset(texts: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """JSON with suites of `coverage`, or `coverage` at the top; a file's lines are an array, or an object with `lines`."""
    top = _entries(texts.select("repo_id", F.try_parse_json("value").alias("body")))
    inner = top.select("repo_id", F.when(F.col("key") == "coverage", F.col("value")).otherwise(F.try_variant_get("value", "$.coverage", "variant")).alias("body"))
    lines = F.coalesce(F.try_variant_get("value", "$.lines", "array<int>"), F.try_variant_get("value", "$", "array<int>"))
    found = _entries(inner).select("repo_id", F.col("key").alias("reported"), lines.alias("hits")).filter("hits IS NOT NULL")
    return max_merge(_matched(found, files, root).select("repo_id", "path", "hits"), ["repo_id", "path"]).select("repo_id", "path", "line_rate")


def xml_classes(spark: SparkSession, path: str, repo_id: str | None) -> DataFrame:
    """Class elements of Cobertura files: repo_id, at, name, rate. Spark's XML reader looks for the elements, so many tasks read one file."""
    read = spark.read.format("xml").option("rowTag", "class").schema("`_filename` string, `_line-rate` string").load(path)
    return read.select(repository(repo_id).alias("repo_id"), place().alias("at"), F.col("_filename").alias("name"), F.col("`_line-rate`").try_cast("double").alias("rate"))


def cobertura(elements: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """elements: repo_id, at (their order), name, rate. Of several for a file the last counts."""
    bad = F.raise_error(F.lit("Error: line-rate must be a number between 0 and 1.")).cast("double")
    rated = F.when(F.col("rate").between(0, 1), F.col("rate")).otherwise(bad)
    rows = elements.filter("name IS NOT NULL").select("repo_id", "at", F.regexp_replace("name", r"^(\./)+", "").alias("path"), rated.alias("line_rate"))
    last = rows.groupBy("repo_id", "path").agg(F.max_by("line_rate", "at").alias("line_rate"))
    return last.join(files.select("repo_id", "path"), ["repo_id", "path"], "left_semi")


def lcov_records(spark: SparkSession, path: str, repo_id: str | None) -> DataFrame:
    """repo_id, at, value: a row for each record of LCOV files, which are split between records."""
    return spark.read.option("lineSep", "end_of_record").text(path).select(repository(repo_id).alias("repo_id"), place().alias("at"), "value")


def lcov(records: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """records: repo_id, at (their order), value. Each has the counts LF and LH, or else the DA lines they sum up."""
    number = lambda tag: F.expr(f"try_cast(regexp_extract(value, '(?m)^{tag}:(\\\\d+)', 1) AS INT)")
    lines = F.regexp_extract_all("value", F.lit(r"(?m)^DA:\d+,(\d+)"), 1)
    found = F.coalesce(number("LF"), F.size(lines))
    hit = F.coalesce(number("LH"), F.size(F.filter(lines, lambda x: x.cast("long") > 0)))
    bad = F.raise_error(F.lit("Error: LCOV record has more lines hit than found.")).cast("double")
    rate = F.when(hit > found, bad).when(found == 0, 0.0).otherwise(hit / found.cast("double"))
    rows = records.select("repo_id", F.regexp_extract("value", r"(?m)^SF:(.+?)\s*$", 1).alias("reported"), rate.alias("line_rate"), "at")
    rows = _matched(rows.filter("reported <> ''"), files, root)
    return rows.groupBy("repo_id", "path").agg(F.max_by("line_rate", "at").alias("line_rate"))


READERS = {".xml": (xml_classes, cobertura), ".info": (lcov_records, lcov), ".json": (whole, resultset)}


def read(spark: SparkSession, path: str, files: DataFrame, repo_id: str | None, root: str = "") -> DataFrame:
    """By the ending of the file's name, in any case. repo_id None: every file is of the repository its folder is named after."""
    ending = "." + path.lower().rpartition(".")[2]
    if ending not in READERS:
        raise CoverageError(f"Error: unsupported coverage format: {path}")
    rows, rates = READERS[ending]
    found = rows(spark, path, repo_id)
    if ending == ".xml" and found.isEmpty():
        raise CoverageError("Error: coverage XML has no class elements with filename and line-rate.")
    return rates(found, files, root)
