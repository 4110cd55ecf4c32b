"""Dependency graphs: edges, degrees, and constants resolved to the files that own them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbers import ratio


def edges(raw: DataFrame, files: DataFrame | None = None, repo: str = "repo_id") -> DataFrame:
    """Distinct (src, dst), without loops; with files only between files that are scored."""
    out = raw.filter("src <> dst").select(repo, "src", "dst").distinct()
    if files is not None:
        out = out.join(files.select(repo, F.col("path").alias("src")), [repo, "src"], "left_semi")
        out = out.join(files.select(repo, F.col("path").alias("dst")), [repo, "dst"], "left_semi")
    return out


def degrees(files: DataFrame, graph: DataFrame, repo: str = "repo_id") -> DataFrame:
    """files with fan_in and fan_out. Both counts come from one aggregation over the ends of the edges."""
    ends = graph.select(repo, F.explode(F.array(
        F.struct(F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")),
        F.struct(F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")),
    )).alias("e"))
    counted = ends.groupBy(repo, "e.path").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
    return files.join(counted, [repo, "path"], "left").fillna(0, ["fan_in", "fan_out"])


def edge_lists(graph: DataFrame, most: int = 50, repo: str = "repo_id") -> DataFrame:
    """Per file: dependents and dependencies (the first `most` of each, by path) and how many there are.

    Each task passes on no more than `most` edges of a side of a file, so a file that all others need is no large group.
    """
    side = lambda name, path, other: F.struct(F.lit(name).alias("side"), F.col(path).alias("path"), F.col(other).alias("other"))
    ends = graph.select(repo, F.explode(F.array(side("in", "dst", "src"), side("out", "src", "dst"))).alias("e")).select(repo, "e.*")
    nth = F.row_number().over(W.partitionBy(repo, "path", "side").orderBy("other"))
    first = ends.withColumn("_nth", nth).filter(F.col("_nth") <= most)
    listed = lambda name: F.sort_array(F.collect_list(F.when(F.col("side") == name, F.col("other"))))
    lists = first.groupBy(repo, "path").agg(listed("in").alias("dependents"), listed("out").alias("dependencies"))
    counted = ends.groupBy(repo, "path").agg(F.count_if(F.col("side") == "in").alias("n_dependents"), F.count_if(F.col("side") == "out").alias("n_dependencies"))
    return lists.join(counted, [repo, "path"])


def instability(fan_in: Column, fan_out: Column) -> Column:
    return ratio(fan_out, fan_in + fan_out)


def prefixes(constants: DataFrame, repo: str = "repo_id") -> DataFrame:
    """Every namespace that the constants lie in."""
    parts = F.split("constant", "::")
    inner = constants.filter(F.size(parts) > 1)
    each = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "::")))
    return inner.select(repo, each.alias("constant")).distinct()


def candidates(namespace: Column, name: Column) -> Column:
    """Names under which `name` may be found, innermost namespace first, the top level last."""
    scoped = F.when(F.size(namespace) > 0, F.transform(F.sequence(F.size(namespace), F.lit(1), F.lit(-1)), lambda i: F.concat_ws("::", F.array_join(F.slice(namespace, 1, i), "::"), name)))
    return F.concat(F.coalesce(scoped, F.array().cast("array<string>")), F.array(name))


def resolve(references: DataFrame, owners: DataFrame, repo: str = "repo_id") -> DataFrame:
    """references: repo, path, namespace, name, absolute; owners: repo, path, constant. Distinct (repo, path, constant).

    A bare name takes the nearest candidate that someone owns. A qualified one looks for its first part, takes the nearest
    that is owned or is a namespace, and is lost if its tail isn't there. Absolute names are taken as they are.
    """
    known = owners.select(repo, "constant").distinct()
    refs = references.select(repo, "path", "namespace", "name", "absolute").distinct()
    head = F.when(F.col("absolute") | ~F.col("name").contains("::"), F.col("name")).otherwise(F.substring_index("name", "::", 1))
    tail = F.when(~F.col("absolute") & F.col("name").contains("::"), F.expr("substr(name, instr(name, '::') + 2)"))
    tried = F.when(F.col("absolute"), F.array("name")).otherwise(candidates(F.col("namespace"), head))
    asked = refs.withColumn("tail", tail).select(repo, "path", "namespace", "name", "absolute", "tail", F.posexplode(tried).alias("rank", "constant"))
    found = known.withColumn("owned", F.lit(True)).unionByName(prefixes(known, repo).withColumn("owned", F.lit(False)))
    found = found.groupBy(repo, "constant").agg(F.max("owned").alias("owned"))
    hit = asked.join(found, [repo, "constant"]).filter(F.col("owned") | F.col("tail").isNotNull())
    nearest = hit.groupBy(repo, "path", "namespace", "name", "absolute", "tail").agg(F.min_by("constant", "rank").alias("root"))
    full = nearest.select(repo, "path", F.when(F.col("tail").isNull(), F.col("root")).otherwise(F.concat_ws("::", "root", "tail")).alias("constant"))
    return full.join(known, [repo, "constant"], "left_semi").select(repo, "path", "constant").distinct()


def constant_graph(files: DataFrame, references: DataFrame, owners: DataFrame, repo: str = "repo_id") -> tuple[DataFrame, DataFrame]:
    """(files with fan_in and fan_out, edges src -> dst).

    fan_in counts the other files that refer to a file's constant, for each of its owners. fan_out and the edges go to
    the owner with the greatest ordinal. files: repo, path, ordinal.
    """
    used = resolve(references, owners, repo)
    owned = owners.join(files.select(repo, "path", "ordinal"), [repo, "path"])
    into = owned.select(repo, F.col("path").alias("owner"), "constant").join(used, [repo, "constant"]).filter("owner <> path")
    fan_in = into.groupBy(repo, F.col("owner").alias("path")).agg(F.count(F.lit(1)).alias("fan_in"))
    last = owned.groupBy(repo, "constant").agg(F.max_by("path", "ordinal").alias("dst"))
    out = used.join(last, [repo, "constant"]).filter("path <> dst")
    fan_out = out.groupBy(repo, "path").agg(F.count(F.lit(1)).alias("fan_out"))
    scored = files.join(fan_in, [repo, "path"], "left").join(fan_out, [repo, "path"], "left").fillna(0, ["fan_in", "fan_out"])
    return scored, out.select(repo, F.col("path").alias("src"), "dst").distinct()
