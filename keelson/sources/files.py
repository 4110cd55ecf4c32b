"""The scored files of a repository."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.paths import DEFAULT_EXCLUDES, LANGUAGES, language, language_group, matches_any
from ..operators.quality import is_generated, loc

LEAST_FILES = 5


class PopulationError(ValueError):
    pass


def _hidden(spark: SparkSession, root: str) -> tuple[list[str], list[str]]:
    """(folders, scored files) below root whose names begin with a dot or an underscore, which Spark's file sources skip.

    One pattern for each depth, until there is nothing as deep; names that aren't hidden never reach Python.
    """
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders, single, level = [], [], re.sub(r"([\\\[\]{}*?^])", r"\\\1", root)
    while fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{level}/*")):
        for entry in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{level}/[._]*")):
            name = entry.getPath().toString()
            if entry.isDirectory():
                folders.append(name)
            elif any(name.endswith(x) for x in LANGUAGES):
                single.append(name)
        level += "/*"
    return folders, single


def scanned(spark: SparkSession, root: str, repo_id: str) -> DataFrame:
    """Files with a scored ending, dot files and folders included: repo_id, path, content.

    Spark's binary file source lists and reads them, on any file system; from
    spark.sql.sources.parallelPartitionDiscovery.threshold folders on a job lists. Single files with hidden names, which
    no source of Spark's reads, come through the driver. Links to folders are followed.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(conf)
    top = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(root)).toString().rstrip("/")
    folders, single = _hidden(spark, top)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    every = reader.option("pathGlobFilter", f"*{{{','.join(LANGUAGES)}}}").load([top, *folders])
    # a scan leaves empty files out, but its list of files, which the driver holds anyway, doesn't
    names = spark.createDataFrame([(_plain(p),) for p in every.inputFiles() if any(p.endswith(x) for x in LANGUAGES)], "path string").distinct()
    read = names.join(every.select(F.regexp_replace("path", "^[a-z0-9]+:/+", "/").alias("path"), "content").dropDuplicates(["path"]), "path", "left")
    if single:
        held = [(re.sub("^[a-z0-9]+:/+", "/", p), bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(fs.open(jvm.org.apache.hadoop.fs.Path(p))))) for p in single]
        read = read.unionByName(spark.createDataFrame(held, "path string, content binary"))
    return read.select(F.lit(repo_id).alias("repo_id"), F.substr("path", F.lit(len(re.sub("^[a-z0-9]+:/+", "/", top)) + 2)).alias("path"), F.coalesce("content", F.lit(b"")).alias("content"))


def _plain(uri: str) -> str:
    """The path in a URI, with its escapes resolved."""
    return re.sub("^[a-z0-9]+:/+", "/", unquote(uri))


def collect(files: DataFrame, excludes: list[str] | tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """files: repo_id, path, content. (scored files with language, lang_group, loc and ordinal; counts of what was left out).

    Rules apply in turn: default globs, the caller's globs, generated files.
    """
    tagged = files.withColumn("language", language(F.col("path"))).filter("language IS NOT NULL")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    why = F.when(matches_any(F.col("path"), DEFAULT_EXCLUDES), "default").when(matches_any(F.col("path"), list(excludes)), "custom").when(is_generated(text), "generated")
    judged = tagged.withColumn("excluded", why)
    counts = judged.groupBy("repo_id").agg(F.count_if(F.col("excluded") == "default").alias("default_excluded"), F.count_if(F.col("excluded") == "custom").alias("custom_excluded"))
    kept = judged.filter("excluded IS NULL").withColumn("lang_group", language_group(F.col("language"))).withColumn("loc", loc(F.col("content")))
    ordinal = F.row_number().over(W.partitionBy("repo_id").orderBy("path")) - 1
    return kept.withColumn("ordinal", ordinal).drop("excluded"), counts


def population(files: DataFrame, min_files: int = 20) -> DataFrame:
    """Per repository how many files are scored, and whether these are too few to score (error) or to trust (small_repo)."""
    counted = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_files"))
    return counted.withColumn("verdict", F.when(F.col("n_files") < LEAST_FILES, "error").when(F.col("n_files") < min_files, "small_repo").otherwise("enough"))


def require_population(files: DataFrame, min_files: int = 20) -> list[str]:
    """By the smallest repository."""
    least = population(files, min_files).orderBy("n_files").first()
    if least is None or least["verdict"] == "error":
        raise PopulationError(f"Error: at least {LEAST_FILES} scored files are needed; found {least['n_files'] if least else 0}.")
    return ["small_repo"] if least["verdict"] == "small_repo" else []
