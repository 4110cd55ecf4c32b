"""Commit logs as text files -> rows. Each reader takes the output of one `git log` format, dumped per repository.

Records of the formats with several lines begin with a record separator, so a file can be split anywhere between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import renamed
from .texts import carried, lines, numbered

#: Commands whose output the readers take; days limits the window.
NUMSTAT = "git log --no-merges --since='{days} days ago' --numstat --format= --diff-filter=ACDMR -M"
NAME_ONLY = "git log --relative --since='{days} days ago' --name-only --format=%x1e%H --diff-filter=ACDMR -M"
NAME_STATUS = "git log --name-status --format=%x1e%ct --diff-filter=ACMRD -M"
#: With all branches, and each merge against its first parent.
GRAPH = "git log --all HEAD --no-renames --raw --no-abbrev --diff-merges=first-parent --format=%x1e%H%x1f%P%x1f%ct%x1f%D"
# The changes that count in a history.
STATUSES = "ACMRD"


def numstat(lines: DataFrame) -> DataFrame:
    """lines: repo_id, value. Rows: repo_id, path (the new name), added, deleted (null for binary files)."""
    parts = F.split("value", "\t", 3)
    out = lines.filter(F.size(parts) == 3).select("repo_id", renamed(parts[2]).alias("path"), *[F.expr(f"try_cast(split(value, '\\t', 3)[{i}] AS INT)").alias(n) for i, n in enumerate(("added", "deleted"))])
    return out.filter("path <> ''")


def name_only(records: DataFrame) -> DataFrame:
    """records: repo_id, value (the commit, then a path to a line). Rows: repo_id, commit, path."""
    held = records.select("repo_id", F.split("value", "\n").alias("lines"))
    sha = F.trim(F.col("lines")[0])
    each = held.filter(sha.rlike("^[0-9a-f]{40}$")).select("repo_id", sha.alias("commit"), F.explode(F.slice("lines", 2, F.size("lines"))).alias("value"))
    return each.filter("trim(value) <> ''").select("repo_id", "commit", renamed(F.col("value")).alias("path"))


def name_only_lines(lines: DataFrame) -> DataFrame:
    """lines: repo_id, value, of a log without record separators, as it is read (--format=%H). Rows: repo_id, commit, path.

    A path is of the commit above it; paths above the first commit are nobody's.
    """
    own = lines.withColumn("sha", F.when(F.trim("value").rlike("^[0-9a-f]{40}$"), F.trim("value")))
    under = carried(own, "sha", "commit").filter("sha IS NULL AND commit IS NOT NULL AND trim(value) <> ''")
    return under.select("repo_id", "commit", renamed(F.col("value")).alias("path"))


def name_status(records: DataFrame) -> DataFrame:
    """records: repo_id, seq (0 for the newest), value (a record: the epoch, then lines of status and paths).

    Rows: repo_id, seq, line_no, epoch, status, old_path, path.
    """
    held = records.select("repo_id", "seq", F.split("value", "\n").alias("lines")).filter(F.trim(F.col("lines")[0]) != "")
    each = held.select("repo_id", "seq", F.expr("try_cast(trim(lines[0]) AS BIGINT)").alias("epoch"), F.posexplode(F.slice("lines", 2, F.size("lines"))).alias("line_no", "value"))
    parts = F.split("value", "\t")
    moved = parts[0].rlike("^[RC]")
    counts = (F.size(parts) > 1) & parts[0].rlike(f"^[{STATUSES}]")
    return each.filter(counts).select(
        "repo_id", "seq", "line_no", "epoch", parts[0].alias("status"), F.when(moved, parts[1]).alias("old_path"),
        F.when(moved, F.try_element_at(parts, F.lit(3))).otherwise(parts[1]).alias("path"),
    )


def graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records: repo_id, value (a line about the commit, then one for each path). (commits, changes).

    Paths of a commit may come in more records, with nothing but its id in the first line, so that no record has to hold them all.
    commits: repo_id, sha, parents, epoch, refs. changes: repo_id, sha, path, old, new; old and new are mode and blob.
    """
    held = records.select("repo_id", F.split("value", "\n").alias("lines")).withColumn("head", F.split(F.col("lines")[0], "\x1f"))
    held = held.filter(F.size("head").isin(1, 4) & F.trim(F.col("head")[0]).rlike("^[0-9a-f]{40}$")).withColumn("sha", F.trim(F.col("head")[0]))
    words = lambda c, by: F.filter(F.split(c, by), lambda x: x != "")
    refs = F.flatten(F.transform(words(F.col("head")[3], ", "), lambda r: F.split(F.regexp_replace(r, "^tag: ", ""), " -> ")))
    commits = held.filter(F.size("head") == 4).select("repo_id", "sha", words(F.col("head")[1], " ").alias("parents"), F.expr("try_cast(head[2] AS BIGINT)").alias("epoch"), refs.alias("refs"))
    each = held.select("repo_id", "sha", F.explode("lines").alias("value")).filter("value LIKE ':%\t%'")
    parts, path = F.split(F.split_part("value", F.lit("\t"), F.lit(1)), " "), F.expr("substr(value, instr(value, '\t') + 1)")
    whole = lambda mode, blob: F.concat(mode, F.lit(" "), blob)
    return commits, each.select("repo_id", "sha", path.alias("path"), whole(F.substr(parts[0], F.lit(2)), parts[2]).alias("old"), whole(parts[1], parts[3]).alias("new"))


def read_records(spark: SparkSession, path: str, repo_id: str | None) -> DataFrame:
    """repo_id, value and seq (0 for the newest) of the records of dumped logs. repo_id None: by the folder of each file."""
    return numbered(lines(spark, path, repo_id, "\x1e").filter("trim(value) <> ''"))


def read_lines(spark: SparkSession, path: str, repo_id: str | None) -> DataFrame:
    return lines(spark, path, repo_id)
