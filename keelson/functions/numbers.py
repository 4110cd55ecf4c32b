"""Rounding and percentiles as every operator uses them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def rounded(x: Column, digits: int = 4) -> Column:
    """Half up on the double itself, by operations that every SQL engine repeats exactly (round() differs between them)."""
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + F.lit(0.5)).cast("double") / scale


def percentile(x: Column | str, *group: str) -> Column:
    """Share of the group that is strictly smaller, among the others: 0 for ties at the bottom and for a group of one."""
    return F.percent_rank().over(W.partitionBy(*group).orderBy(x))


def ratio(a: Column, b: Column) -> Column:
    """a / b to four places, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(rounded(a.cast("double") / b))


def with_percentile(rows: DataFrame, column: str, out: str, *group: str, stretches: int = 256) -> DataFrame:
    """rows with `percentile` of the column as `out`, for groups too large for one task; null where the column is null.

    Equal values are counted first, so no window sees a row. The distinct values of a group are cut into stretches at
    approximate quantiles, and the rows below a value are those of the stretches before, and those before it in its own: windows over
    at most `stretches` counts, and over the values of one stretch.
    """
    keys = [*group, column]
    counts = rows.filter(F.col(column).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    cuts = counts.groupBy(*group).agg(F.percentile_approx(column, [k / stretches for k in range(1, stretches)], 10 * stretches).alias("_cuts"))
    placed = counts.join(cuts, list(group)) if group else counts.join(F.broadcast(cuts))  # one row of cuts
    placed = placed.withColumn("_stretch", F.size(F.filter("_cuts", lambda c: c < F.col(column)))).drop("_cuts")
    sums = placed.groupBy(*group, "_stretch").agg(F.sum("_n").alias("_sum"))
    line = W.partitionBy(*group)
    sums = sums.select(*group, "_stretch", F.coalesce(F.sum("_sum").over(line.orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_sum").over(line).alias("_total"))
    own = W.partitionBy(*group, "_stretch").orderBy(column).rowsBetween(W.unboundedPreceding, -1)
    below = placed.withColumn("_own", F.coalesce(F.sum("_n").over(own), F.lit(0))).join(sums, [*group, "_stretch"])
    share = F.when(F.col("_total") > 1, (F.col("_before") + F.col("_own")) / (F.col("_total") - 1)).otherwise(0.0)
    return rows.join(below.select(*keys, share.alias(out)), keys, "left")
