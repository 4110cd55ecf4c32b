"""Age and depth of files' history: rename lineage, evidence, and the rules for new files."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbers import rounded
from ..sources.kept import Keep, keeper

DAY = 86_400
NEW_DAYS, NEW_COMMITS = 30, 3
#: Lines of a commit that a position can tell apart.
LINES = 1 << 24


def positions(log: DataFrame) -> DataFrame:
    """log: seq (0 for the newest commit), line_no. A place in reading order, newest first."""
    return log.withColumn("pos", F.col("seq") * F.lit(LINES) + F.col("line_no"))


def rebased(path: Column, prefix: str) -> Column:
    """Relative to the analysed folder; null outside it. prefix: empty, or the folder with a slash at its end."""
    if not prefix:
        return path
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1)))


def inside(named: DataFrame, prefix: str) -> DataFrame:
    """named: path. The distinct paths within the analysed folder, relative to it."""
    return named.select(rebased(F.col("path"), prefix).alias("path")).filter("path <> ''").distinct()


def _spans(renames: DataFrame) -> DataFrame:
    """renames: repo_id, key, pos, value. From each rename to the next one (back in time) of the same old name, the name stands for the value."""
    line = W.partitionBy("repo_id", "key").orderBy("pos")
    return renames.select("repo_id", "key", F.col("pos").alias("since"), F.lead("pos").over(line).alias("until"), "value")


def _at(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """asked: repo_id, cur, pos and more, with since and value of the span of `cur` that holds at pos, or nulls."""
    s = spans.withColumnsRenamed({"repo_id": "_repo", "key": "_key"})
    holds = (F.col("repo_id") == F.col("_repo")) & (F.col("cur") == F.col("_key")) & (F.col("since") < F.col("pos")) & (F.col("until").isNull() | (F.col("pos") <= F.col("until")))
    return asked.join(s, holds, "left").drop("_repo", "_key", "until")


def _chased(asked: DataFrame, spans: DataFrame, keep: Keep) -> DataFrame:
    """asked: repo_id, name, pos and more, with `cur`, what the name stands for at pos, and `met`, whether any span says so.

    A span leads to a name that stood for itself then, and on to what that has come to stand for since, so the spans' beginnings
    rise along the way and it ends. Rows that stay are written once.
    """
    now, done = asked.withColumns({"cur": F.col("name"), "last": F.lit(-1).cast("long")}), []
    while True:
        on = F.coalesce(F.col("since") > F.col("last"), F.lit(False))
        moved = _at(now, spans).withColumns({"moved": on & (F.col("value") != F.col("cur")), "cur": F.when(on, F.col("value")).otherwise(F.col("cur")), "last": F.when(on, F.col("since")).otherwise(F.col("last"))})
        now = keep(moved.drop("since", "value"))
        done.append(now.filter("NOT moved"))
        if now.filter("moved").isEmpty():
            return functools.reduce(DataFrame.unionByName, done).withColumn("met", F.col("last") >= 0).drop("last", "moved")
        now = now.filter("moved").drop("moved")


def _tops(moves: DataFrame, keep: Keep) -> DataFrame:
    """moves with `guess`, the name at the end of its chain of valid renames: pointer doubling over the renames.

    Each move points to the rename that its own name was the old one of at that time, if there is one. In each round it takes over
    what the one that it points to points at, so a chain of n renames takes log n rounds. A move that has come to its end is in no further one.
    """
    spans = _spans(moves.filter("valid").select("repo_id", "key", "pos", F.col("pos").alias("value")))
    up = keep(_at(moves.select("repo_id", F.col("name").alias("cur"), "pos"), spans).select("repo_id", "pos", F.col("value").alias("up")))
    rising, done = up.filter("up IS NOT NULL"), []
    while not rising.isEmpty():
        above = functools.reduce(DataFrame.unionByName, [rising, *done]).select("repo_id", F.col("pos").alias("up"), F.col("up").alias("above"))
        higher = keep(rising.join(above, ["repo_id", "up"], "left").select("repo_id", "pos", F.coalesce("above", "up").alias("up"), F.col("above").isNotNull().alias("moved")))
        done.append(higher.filter("NOT moved").drop("moved"))
        rising = higher.filter("moved").drop("moved")
    up = functools.reduce(DataFrame.unionByName, [rising, *done])
    names = moves.select("repo_id", F.col("pos").alias("up"), F.col("name").alias("top"))
    out = moves.join(up, ["repo_id", "pos"], "left").join(names, ["repo_id", "up"], "left")
    return keep(out.withColumn("guess", F.coalesce("top", "name")).drop("up", "top"))


def _rooted(moves: DataFrame, keep: Keep) -> DataFrame:
    """moves with `cur`, what their names stand for, and `met`, if the renames marked valid are those that count.

    The chains' ends are right unless an end was itself renamed meanwhile. So all names are followed anew through the guesses, until
    that changes none. What a move stands for depends on newer moves only, so there is one such state, the fold's.
    """
    held = _tops(moves, keep)
    while True:
        spans = _spans(held.filter("valid").select("repo_id", "key", "pos", F.col("guess").alias("value")))
        found = _chased(held, spans, keep)
        if found.filter("cur != guess").isEmpty():
            return found.drop("guess")
        held = found.withColumn("guess", F.col("cur")).drop("cur", "met")


def _judged(rooted: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moves with `counts`, whether a rename does; boundaries: where a wanted file's path was deleted, newest first)."""
    known = rooted.join(wanted.select("repo_id", F.col("path").alias("cur"), F.lit(True).alias("is_wanted")), ["repo_id", "cur"], "left").withColumn("is_wanted", F.coalesce("is_wanted", F.lit(False)))
    bounds = known.filter("gone AND is_wanted AND (NOT outside OR met)").groupBy("repo_id", "path").agg(F.min("pos").alias("bound"))
    for side in ("path", "old_path"):
        known = known.join(bounds.select("repo_id", F.col("path").alias(side), F.col("bound").alias(f"bound_{side}")), ["repo_id", side], "left")
    cut = lambda side: F.coalesce(F.col(f"bound_{side}") < F.col("pos"), F.lit(False))
    return known.withColumn("counts", ~F.col("gone") & F.col("is_wanted") & ~cut("path") & ~cut("old_path")).drop("bound_path", "bound_old_path", "is_wanted"), bounds


def lineage(log: DataFrame, files: DataFrame, prefix: str = "", keep: Keep | None = None) -> DataFrame:
    """log: repo_id, seq, line_no, epoch, status, old_path, path; files: repo_id, path. Per file first_epoch, total_commits.

    Only renames and deletions change what a name stands for. They are rows (repository, name, interval), never one group:
    which of them count is found in rounds of joins, beginning with all, and every other line is resolved by a join on its name and
    place. Whether a move counts depends on newer ones only, so the state that no round changes is the only one, and equals reading the log line by
    line. keep: writes rows that are read again and gives the table.
    """
    keep = keep or keeper(log.sparkSession)
    lines = positions(log).withColumn("own", rebased(F.col("path"), prefix)).withColumns({"name": F.coalesce("own", "path"), "outside": F.col("own").isNull()})
    wanted = keep(files.select("repo_id", "path").distinct())
    moves = lines.filter("status = 'D' OR status LIKE 'R%' AND own IS NOT NULL AND old_path IS NOT NULL").filter("path <> ''")
    key = F.coalesce(rebased(F.col("old_path"), prefix), F.col("old_path"))
    moves = keep(moves.select("repo_id", "pos", (F.col("status") == "D").alias("gone"), "path", "old_path", "name", "outside", key.alias("key")).withColumn("valid", ~F.col("gone")))
    while True:
        judged, bounds = _judged(_rooted(moves, keep), wanted)
        judged = keep(judged)
        if judged.filter("valid != counts").isEmpty():
            break
        moves = keep(judged.withColumn("valid", F.col("counts")).drop("counts", "cur", "met"))
    spans = keep(_spans(judged.filter("valid").select("repo_id", "key", "pos", F.col("cur").alias("value"))))
    commits = lines.select("repo_id", "seq", "epoch", "pos", "path", "own", "name", "outside").filter("status <> 'D'")
    free = commits.join(keep(bounds), ["repo_id", "path"], "left").filter("bound IS NULL OR bound >= pos").drop("bound", "path")
    renamed = spans.select("repo_id", F.col("key").alias("name"), F.lit(True).alias("renamed")).distinct()
    marked = keep(free.join(renamed, ["repo_id", "name"], "left"))
    followed = _chased(marked.filter("renamed"), spans, keep).filter("NOT outside OR met").select("repo_id", "seq", "epoch", F.col("cur").alias("path"))
    every = marked.filter("renamed IS NULL AND NOT outside").select("repo_id", "seq", "epoch", F.col("own").alias("path")).unionByName(followed)
    every = every.join(wanted, ["repo_id", "path"], "left_semi")
    return every.groupBy("repo_id", "path").agg(F.min("epoch").alias("first_epoch"), F.count_distinct("seq").alias("total_commits"))


def with_history(files: DataFrame, history: DataFrame, keys: list[str], as_of: Column, *, days: int = NEW_DAYS, commits: int = NEW_COMMITS, available: bool = True) -> DataFrame:
    """files with age_days, total_commits, new_file and metadata_available. as_of: epoch seconds.

    Without a history a file is new; where histories aren't available at all, none is.
    """
    if not available:
        return files.select("*", F.lit(0).cast("long").alias("age_days"), F.lit(0).cast("long").alias("total_commits"), F.lit(False).alias("new_file"), F.lit(False).alias("metadata_available"))
    known = files.join(history.select(*keys, "first_epoch", "total_commits"), keys, "left")
    age = F.greatest(F.floor((as_of - F.col("first_epoch")) / F.lit(float(DAY))), F.lit(0)).cast("long")
    total = F.coalesce("total_commits", F.lit(0)).cast("long")
    young = (F.lit(days > 0) & (age < days)) | (F.lit(commits > 0) & (total < commits))
    new = F.col("first_epoch").isNull() | young
    return known.withColumn("age_days", F.when(F.col("first_epoch").isNull(), F.lit(0)).otherwise(age).cast("long")).withColumn("new_file", new).withColumn(
        "total_commits", total
    ).withColumn("metadata_available", F.lit(True)).drop("first_epoch")


def evidence(age_days: Column, total_commits: Column, covered: Column, available: Column) -> Column:
    """How much is known of a file, 0 to 1; null without metadata. A report on its coverage can only raise it."""
    age = F.least(age_days / F.lit(30.0), F.lit(1.0))
    depth = F.least(total_commits / F.lit(3.0), F.lit(1.0))
    alone = (age + depth) / F.lit(2.0)
    best = F.when(covered, F.greatest(alone, (age + depth + F.lit(1.0)) / F.lit(3.0))).otherwise(alone)
    return F.when(available, rounded(best))


def newness(rows: DataFrame, graph: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """New files that depend on a trunk become trunks, other new leaves branches. Trunks are those before this step."""
    trunk = rows.filter("class = 'trunk'").select(*group, F.col("path").alias("dst"))
    repo = [k for k in keys if k != "path"]
    beside = graph.select(*repo, F.col("src").alias("path"), "dst").join(rows.select(*group, *[k for k in keys if k not in group]), keys)
    beside = beside.join(trunk, [*group, "dst"], "left_semi").select(*keys).distinct().withColumn("beside_trunk", F.lit(True))
    out = rows.join(beside, keys, "left").withColumn("beside_trunk", F.coalesce("beside_trunk", F.lit(False)))
    new, floored = F.col("new_file"), F.col("escalation").isin("complexity_floor", "fan_in_floor")
    adjacent = new & F.col("beside_trunk")
    recent = new & ~F.col("beside_trunk") & ((F.col("class") == "leaf") | floored)
    escalation = F.when(adjacent, "trunk_adjacent").when(recent, "recency_floor").otherwise(F.col("escalation"))
    name = F.when(adjacent, "trunk").when(recent, "branch").otherwise(F.col("class"))
    return out.withColumn("_class", name).withColumn("escalation", escalation).drop("class", "beside_trunk").withColumnRenamed("_class", "class")
