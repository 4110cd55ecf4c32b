"""Connected components by contraction in random orders; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, home: str) -> DataFrame:
    """links: (a, b) of one type. Returns (node, label): label is the smallest node of the component.

    Each round orders the nodes anew by a salted hash. A node is merged into the first one within two steps, and links
    between merged nodes are the next round's, until none is left. The first node of a component takes in its neighbours
    in any case, so the rounds end; as orders are random, a constant share of the nodes goes in each (expected), so there
    are about log n rounds, whatever the ids and the shape.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = common.keep(both.filter("node != other").distinct(), f"{home}/links0")
    merged: list[DataFrame] = []
    while not both.isEmpty():
        turn = len(merged)
        place = lambda c, turn=turn: F.xxhash64(F.col(c), F.lit(turn))
        first = both.groupBy("node").agg(F.min_by("other", place("other")).alias("first"))
        # tables of their own, so that joins are between plain exchanges and Spark can split a node with many links
        near = common.keep(first.select("node", F.when(place("first") < place("node"), F.col("first")).otherwise(F.col("node")).alias("near")), f"{home}/near{turn}")
        theirs = both.join(near.select(F.col("node").alias("other"), "near"), "other").select("node", "near")
        into = theirs.groupBy("node").agg(F.min_by("near", place("near")).alias("far")).join(near, "node")
        into = into.select("node", F.when(place("far") < place("near"), F.col("far")).otherwise(F.col("near")).alias("into"))
        merged.append(common.keep(into, f"{home}/merged{turn}"))
        rest = both.join(merged[-1].withColumnRenamed("into", "x"), "node").select("x", "other")
        rest = rest.join(merged[-1].select(F.col("node").alias("other"), F.col("into").alias("y")), "other")
        both = common.keep(rest.filter("x != y").select(F.col("x").alias("node"), F.col("y").alias("other")).distinct(), f"{home}/links{turn + 1}")
    if not merged:
        return both.select("node", F.col("other").alias("label"))
    ends = merged[-1]
    for k in range(len(merged) - 2, -1, -1):
        onward = ends.select(F.col("node").alias("into"), F.col("into").alias("end"))
        ends = common.keep(merged[k].join(onward, "into", "left").select("node", F.coalesce("end", "into").alias("into")), f"{home}/ends{k}")
    smallest = common.keep(ends.groupBy("into").agg(F.min("node").alias("label")), f"{home}/smallest")
    return common.keep(ends.join(smallest, "into").select("node", "label"), f"{home}/labels")
