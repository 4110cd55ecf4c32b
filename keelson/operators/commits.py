"""Commit graphs: ancestors, merge bases, and the paths that a branch has changed since it left another one.

Histories are deep and mostly lines, so nothing goes commit by commit, and no table of all commits is written more than once or twice.
Commits are read in blocks, in the order of their times, and in a block first parents are joined to runs: a commit has a run and a
place in it, from the run's top (its oldest commit) on. Runs form a forest, in which doubling gives each the ones 1, 2, 4, ...
steps up, and where the line from there enters them. A set of ancestors is a place for each run that it reaches, up to which all are in it; it
spreads to all first-parent ancestors in as many joins as there are such steps, then takes in the other parents of the merges
that it reached, until there are none. Any order of times gives the same results; if it has nothing to do with parents, runs are short and many.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.kept import Keep, keeper

NONE = "0" * 40
#: Commits that a task holds at once.
BLOCK = 1 << 16


class RefError(ValueError):
    pass


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows repo_id, sha, up and more, with run (a number for each) and pos."""
    first, held, n = TaskContext.get().partitionId() << 40, [], 0

    def placed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        nonlocal first
        repos, shas, ups = (table.column(c).to_pylist() for c in ("repo_id", "sha", "up"))
        at = {key: i for i, key in enumerate(zip(repos, shas))}
        below: list[int | None] = [None] * len(shas)
        tops = []
        for i, key in enumerate(zip(repos, ups)):
            above = at.get(key)
            if above is None or below[above] is not None:
                tops.append(i)
            else:
                below[above] = i
        run, pos = [0] * len(shas), [0] * len(shas)
        for top in tops:
            i, k = top, 0
            while i is not None:
                run[i], pos[i] = first, k
                i, k = below[i], k + 1
            first += 1
        yield from table.append_column("run", pa.array(run, pa.int64())).append_column("pos", pa.array(pos, pa.int64())).to_batches()

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK:
            yield from placed(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield from placed(pa.Table.from_batches(held))


def _furthest(places: DataFrame) -> DataFrame:
    return places.groupBy("repo_id", "side", "run").agg(F.max("pos").alias("pos"))


class Graph:
    """commits: repo_id, sha, parents (array), epoch, refs (array). Parents that aren't in the table count as absent."""

    def __init__(self, commits: DataFrame, keep: Keep | None = None):
        self.keep = keep or keeper(commits.sparkSession)
        rest = F.slice("parents", 2, F.greatest(F.size("parents"), F.lit(1)))
        read = self.keep(commits.select("repo_id", "sha", F.get("parents", F.lit(0)).alias("up"), F.when(F.size("parents") > 1, rest).alias("others"), "epoch", "refs"))
        inner = read.repartitionByRange("repo_id", "epoch", "sha").sortWithinPartitions("repo_id", "epoch", "sha")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.schema.fields)
        #: repo_id, sha, up, others, epoch, refs, run, pos.
        self.commits = self.keep(inner.mapInArrow(_runs, f"{schema}, run long, pos long"))
        place = self.commits.select("repo_id", "sha", "run", "pos")
        # small tables are written before they are joined, so that Spark knows their size
        tops = self.keep(self.commits.filter("pos = 0").select("repo_id", "run", F.col("up").alias("sha")))
        above = place.withColumnsRenamed({"run": "up", "pos": "at"})
        found = self.keep(tops.filter("sha IS NOT NULL").join(above, ["repo_id", "sha"]).select("repo_id", "run", "up", "at"))
        #: Where the line goes on above each run that isn't a root.
        self.tied = found
        up = self.keep(tops.select("repo_id", "run").join(found, ["repo_id", "run"], "left").withColumn("depth", F.coalesce(F.col("at") + 1, F.lit(0))))
        self.steps: list[DataFrame] = []
        while not (rising := up.filter("up IS NOT NULL")).isEmpty():
            self.steps.append(rising.select("repo_id", "run", "up", "at"))
            more = up.select("repo_id", F.col("run").alias("up"), F.col("up").alias("next"), F.col("at").alias("enters"), F.col("depth").alias("more"))
            up = self.keep(up.join(more, ["repo_id", "up"], "left").select("repo_id", "run", F.col("next").alias("up"), F.col("enters").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        #: First-parent ancestors of each run's top.
        self.depth = up.select("repo_id", "run", "depth")
        merges = self.keep(self.commits.filter("others IS NOT NULL").select("repo_id", F.col("run").alias("of"), F.col("pos").alias("of_pos"), F.explode("others").alias("sha")))
        #: Other parents' places (run, pos), of the commit at (of, of_pos).
        self.others = self.keep(merges.join(place, ["repo_id", "sha"]).select("repo_id", "of", "of_pos", "run", "pos"))

    def placed(self, starts: DataFrame) -> DataFrame:
        """starts: repo_id, sha and more, a few. With run and pos instead of sha."""
        return self.keep(starts).join(self.commits.select("repo_id", "sha", "run", "pos"), ["repo_id", "sha"]).drop("sha")

    def line(self, starts: DataFrame) -> DataFrame:
        """starts: repo_id, side, run, pos. With all first-parent ancestors of each side's commits."""
        out = starts.select("repo_id", "side", "run", "pos")
        for step in self.steps:
            on = F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("run"), F.col("at").alias("pos")))
            each = out.join(step, ["repo_id", "run"], "left").select("repo_id", "side", F.explode(F.array_compact(F.array(F.struct("run", "pos"), on))).alias("x"))
            out = _furthest(each.select("repo_id", "side", "x.run", "x.pos"))
        return self.keep(_furthest(out))

    def ancestors(self, starts: DataFrame) -> DataFrame:
        """starts: repo_id, side, run, pos. With all ancestors of each side's commits."""
        reached = self.line(starts)
        fresh = reached
        while True:
            above = self.beside(fresh.select("repo_id", "side", "run", "pos"))
            known = reached.withColumnRenamed("pos", "known")
            above = self.keep(_furthest(above).join(known, ["repo_id", "side", "run"], "left").filter("known IS NULL OR pos > known").drop("known"))
            if above.isEmpty():
                return reached
            fresh = self.line(above)
            reached = self.keep(_furthest(reached.unionByName(fresh)))

    def beside(self, reached: DataFrame) -> DataFrame:
        """reached: repo_id, run, pos and more. The places of the other parents of the merges among them."""
        some = reached.withColumnsRenamed({"run": "of", "pos": "most"})
        return some.join(self.others, ["repo_id", "of"]).filter("of_pos <= most").drop("of", "of_pos", "most")

    def named(self, ref: str) -> DataFrame:
        """repo_id, sha of a branch, a tag, HEAD, or the beginning of a commit's id."""
        hit = F.array_contains("refs", ref)
        if len(ref) >= 4 and not set(ref) - set("0123456789abcdef"):
            hit |= F.col("sha").startswith(ref)
        return self.commits.filter(hit).groupBy("repo_id").agg(F.max_by("sha", F.array_contains("refs", ref)).alias("sha"))

    def merge_base(self, base: DataFrame, head: DataFrame) -> DataFrame:
        """base, head: repo_id, sha. repo_id, sha of the best common ancestor, the latest of several."""
        sides = base.select("repo_id", "sha", F.lit("base").alias("side")).unionByName(head.select("repo_id", "sha", F.lit("head").alias("side")))
        reached = self.ancestors(self.placed(sides))
        common = self.keep(reached.groupBy("repo_id", "run").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n")).filter("n = 2").drop("n"))
        # ancestors of a common ancestor are common, too, so the best ones are the last of a run and nobody's parent among them
        tied = common.select("repo_id", "run").join(self.tied, ["repo_id", "run"]).select("repo_id", F.col("up").alias("run"), F.col("at").alias("pos"))
        best = self.keep(common.join(tied.unionByName(self.beside(common)), ["repo_id", "run", "pos"], "left_anti"))
        return best.join(self.commits.select("repo_id", "run", "pos", "sha", "epoch"), ["repo_id", "run", "pos"]).groupBy("repo_id").agg(F.max_by("sha", F.struct("epoch", "sha")).alias("sha"))

    def changed(self, changes: DataFrame, base: DataFrame, head: DataFrame) -> DataFrame:
        """repo_id, path of what differs between the merge base and head, and is there at head.

        changes: repo_id, sha, path, old, new: of each commit against its first parent, what stood at a path before and after (NONE: nothing).

        Both trees grow along their own lines of first parents. Behind the commit where the lines part they are the same; of
        each line's own commits the last one that touches a path says what stands there, and if only the other line
        touches it, its first one says what stood there before.
        """
        start = self.keep(self.merge_base(base, head))
        ends = start.select("repo_id", "sha", F.lit("base").alias("side")).unionByName(head.select("repo_id", "sha", F.lit("head").alias("side")))
        of = lambda side, c: F.when(F.col("side") == side, F.col(c))
        most = self.line(self.placed(ends)).groupBy("repo_id", "run").agg(*[F.coalesce(F.max(of(side, "pos")), F.lit(-1)).alias(side) for side in ("base", "head")])
        apart = most.filter("base != head").select("repo_id", "run", F.when(F.col("base") > F.col("head"), "base").otherwise("head").alias("side"), F.least("base", "head").alias("low"), F.greatest("base", "head").alias("high"))
        # repositories without a common ancestor have no merge base, and no result
        apart = self.keep(apart.join(start.select("repo_id"), "repo_id", "left_semi").join(self.depth, ["repo_id", "run"]))
        own = self.commits.select("repo_id", "sha", "run", "pos").join(apart, ["repo_id", "run"]).filter("pos > low AND pos <= high")
        touched = changes.join(own.select("repo_id", "sha", "side", (F.col("depth") + F.col("pos")).alias("depth")), ["repo_id", "sha"])
        told = touched.groupBy("repo_id", "path").agg(
            F.max_by("new", of("head", "depth")).alias("at_head"), F.max_by("new", of("base", "depth")).alias("at_base"), F.min_by("old", of("head", "depth")).alias("before_head"), F.min_by("old", of("base", "depth")).alias("before_base"),
        )
        now, then = F.coalesce("at_head", "before_base"), F.coalesce("at_base", "before_head")
        return told.filter((now != then) & ~now.endswith(NONE)).select("repo_id", "path")


def changed_paths(commits: DataFrame, changes: DataFrame, base: str, head: str = "HEAD", keep: Keep | None = None) -> DataFrame:
    """Graph.changed between two refs; RefError if one of them is nowhere."""
    graph = Graph(commits, keep)
    found = {ref: graph.keep(graph.named(ref)) for ref in (base, head)}
    for ref, at in found.items():
        if at.isEmpty():
            raise RefError(f"Error: diff base ref not found: {ref}" if ref == base else f"Error: {ref} is not in the commit graph.")
    return graph.changed(changes, found[base], found[head])
