"""Mixing sources to target weights by systematic sampling; DataFrame operations only.

Sources, in the order of their code points with null last, weigh 5, 2, 1, 5, 2, 1, ... and share the words of the corpus
by weight. A target stops at `most` times its source's words; what is cut off goes to the others by weight, until no
target is above its stop. That fixed point is the water level at which sum(min(most * size, level * weight)) is the
whole, and prefix sums over the sources in the order of most * size / weight find it without a loop.

Within a source every document is expected target / size times. The documents stand in line by band of size, then by a
hash; the prefix sum of the expected copies starts at a random offset of the source, and a document is emitted once for
each integer that its stretch of the line crosses. As the line is ordered by size, the words taken stay close to the
target. Prefix sums have two levels (blocks of a source, rows of a block), so that a source with a third of all rows is
spread over many tasks, and they are integers (units of 2**-24), so that the order of addition doesn't matter.

Defined results: a null text has size 0; a null source is a source of its own, the last; rows equal in id, source and
size are interchangeable; null ids are allowed and count as one id; texts are only counted, whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

WEIGHTS = (5, 2, 1)
#: Units in one expected copy.
UNIT = 1 << 24
#: Blocks of a source and size band.
SPREAD = 64


def size_of(text):
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, most: int = 3, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources: one row each of (source, source_size). Adds weight and target."""
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("long")
    line = W.orderBy((F.lit(most) * F.col("source_size")).cast("double") / F.col("weight"), F.col("source").isNull(), "source")
    before, every = line.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    ranked = sources.withColumn("weight", pick).select(
        "source", "source_size", "weight",
        (F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double").alias("left_words"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double").alias("left_weight"),
    )
    # the level if this source were the first that doesn't stop; it is right for the first source that lies below its stop
    tried = ranked.withColumn("level", F.col("left_words") / F.col("left_weight"))
    free = F.col("level") * F.col("weight") <= most * F.col("source_size")
    level = F.min(F.when(free, F.struct(F.col("left_weight") * -1, "level"))).over(every)["level"]
    full = (F.lit(most) * F.col("source_size")).cast("double")
    return tried.withColumn("water", level).select(
        "source", "source_size", "weight", F.when(F.col("water").isNull(), full).otherwise(F.least(full, F.col("water") * F.col("weight"))).alias("target")
    )


def unit_hash(text):
    """28 bits of a string's md5, as both Spark and SQL databases can compute them."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def mix(docs: DataFrame, *, seed: int = 7, most: int = 3, carry: bool = False) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, copies; with carry also the whole row, as the struct `row`."""
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    sized = docs.select("doc_id", "source", size_of("text").alias("size"), *own)
    per_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long")
    start = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    per_source = per_source.withColumn("rate", rate).withColumn("start", F.shiftright(unit_hash(start), 4))
    turn = unit_hash(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    lined = sized.withColumn("turn", turn).withColumn("band", band("size")).withColumn("block", (F.col("turn") % SPREAD).cast("int"))
    right = blocks(lined).join(per_source, F.col("b_source").eqNullSafe(per_source["source"])).drop("source")
    # rows carried along differ in more than their ids, so that reruns give the same ones they need an order, too
    rest = [F.xxhash64("row"), F.xxhash64("row", F.lit(1))] if carry else []
    inside = W.partitionBy("source", "band", "block").orderBy("turn", "size", F.col("doc_id").isNull(), "doc_id", *rest)
    ranked = lined.withColumn("nth", F.row_number().over(inside))
    here = ranked["source"].eqNullSafe(right["b_source"]) & (ranked["band"] == right["b_band"]) & (ranked["block"] == right["b_block"])
    # whole copies up to the end of the document's stretch, less those up to its start
    crossed = F.expr(f"((rows_before + nth) * rate + start) div {UNIT} - ((rows_before + nth - 1) * rate + start) div {UNIT}")
    return ranked.join(right, here).select("doc_id", "source", "size", "source_size", "target", crossed.alias("copies"), *["row"] * carry)


def band(size: str):
    """Four bands to each doubling of size + 1, by integer operations."""
    return F.expr(f"length(bin({size} + 1)) * 4 + (({size} + 1) * 4 div shiftleft(1L, length(bin({size} + 1)) - 1)) - 4").cast("int")


def blocks(lined: DataFrame) -> DataFrame:
    """For each block the number of rows in the blocks of its source that stand before it."""
    counted = lined.groupBy("source", "band", "block").agg(F.count(F.lit(1)).alias("rows_here"))
    before = W.partitionBy("source").orderBy("band", "block").rowsBetween(W.unboundedPreceding, -1)
    return counted.select(
        F.col("source").alias("b_source"), F.col("band").alias("b_band"), F.col("block").alias("b_block"),
        F.coalesce(F.sum("rows_here").over(before), F.lit(0)).alias("rows_before"),
    )


def emit(mixed: DataFrame) -> DataFrame:
    """One row for each copy, `copy` counting from 1."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
