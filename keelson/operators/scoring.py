"""Composite scores, classes, floors, ranks, and checks on dispersion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbers import percentile, ratio, rounded
from .churn import with_churn_pct
from .quality import risk

# The weights of the signals.
DEFAULT_WEIGHTS = {
    "fan_in": 0.19,
    "fan_out": 0.095,
    "complexity": 0.2375,
    "churn": 0.2375,
    "coverage": 0.095,
    "interaction": 0.095,
    "coupling": 0.05,
}
BASE = ("fan_in", "fan_out", "complexity", "churn")
COMPLEXITY_FLOOR, FAN_IN_FLOOR = 15, 25
CLASS_RANK = {"trunk": 3, "branch": 2, "leaf": 1}


class WeightError(ValueError):
    pass


def active_weights(weights: dict[str, float], *, coverage: bool, coupling: bool) -> dict[str, float | None]:
    """The weights in use, scaled to 1; None for signals that aren't available."""
    active = [*BASE, *(("coverage", "interaction") if coverage else ()), *(("coupling",) if coupling else ())]
    total = 0.0
    for key in active:
        total += weights.get(key, 0.0)
    if total <= 0:
        raise WeightError("Error: active weights must be greater than 0.0.")
    return {key: weights.get(key, 0.0) / total if key in active else None for key in DEFAULT_WEIGHTS}


def score(weights: dict[str, float | None]) -> Column:
    """Weighted sum of the percentile columns; additions stand in a fixed order, for ranks depend on the last digit."""
    part = lambda key, pct: F.lit(weights[key]) * F.col(pct)
    total = ((part("fan_in", "fan_in_pct") + part("fan_out", "fan_out_pct")) + part("complexity", "complexity_pct")) + part("churn", "churn_pct")
    if weights["coverage"] is not None:
        total = total + part("coverage", "coverage_risk_pct")
        total = total + F.lit(weights["interaction"]) * F.col("fan_in_pct") * F.col("coverage_risk_pct")
    if weights["coupling"] is not None:
        total = total + part("coupling", "coupling_pct")
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def with_percentiles(files: DataFrame, *group: str) -> DataFrame:
    """files: the raw signals. Adds the percentile of each within the group, and instability."""
    out = files.withColumn("instability", ratio(F.col("fan_out"), F.col("fan_in") + F.col("fan_out")))
    out = with_churn_pct(out, *group)
    signals = {"fan_in": "fan_in", "fan_out": "fan_out", "complexity": "complexity", "instability": "instability", "coupling": "max_coupling"}
    for name, column in signals.items():
        out = out.withColumn(f"{name}_pct", percentile(column, *group))
    return out.withColumn("coverage_risk_pct", percentile(risk(F.col("coverage")), *group))


def with_interaction(files: DataFrame, *group: str) -> DataFrame:
    """Adds interaction_raw, of fan-in and lack of coverage, and its percentile; only a warning reads it."""
    return files.withColumn("interaction_raw", F.col("fan_in_pct") * F.col("coverage_risk_pct")).withColumn("interaction_pct", percentile("interaction_raw", *group))


def with_score(files: DataFrame, weights: dict[str, float], *group: str, coverage: bool) -> DataFrame:
    """Adds raw_score. Coupling counts in groups in which any file is coupled, so both sets of weights are in the plan."""
    apart = score(active_weights(weights, coverage=coverage, coupling=False))
    coupled = score(active_weights(weights, coverage=coverage, coupling=True))
    any_coupled = F.max("max_coupling").over(W.partitionBy(*group)) > 0
    return files.withColumn("coupling_available", any_coupled).withColumn("raw_score", F.when(F.col("coupling_available"), coupled).otherwise(apart))


def classified(pct: Column, trunk: int = 85, branch: int = 50) -> Column:
    return F.when(pct >= F.lit(trunk / 100.0), "trunk").when(pct >= F.lit(branch / 100.0), "branch").otherwise("leaf")


def with_class(files: DataFrame, *group: str, trunk: int = 85, branch: int = 50) -> DataFrame:
    """Adds score_pct, class and escalation: leaves with high complexity, or else high fan-in, are branches."""
    out = files.withColumn("score_pct", percentile("raw_score", *group)).withColumn("plain_class", classified(F.col("score_pct"), trunk, branch))
    leaf = F.col("plain_class") == "leaf"
    escalation = F.when(leaf & (F.col("complexity") >= COMPLEXITY_FLOOR), "complexity_floor").when(leaf & (F.col("fan_in") >= FAN_IN_FLOOR), "fan_in_floor").otherwise("")
    out = out.withColumn("escalation", escalation)
    return out.withColumn("class", F.when(F.col("escalation") != "", "branch").otherwise(F.col("plain_class"))).drop("plain_class")


def class_rank(name: Column) -> Column:
    return F.when(name == "trunk", 3).when(name == "branch", 2).otherwise(1)


def with_rank(files: DataFrame, *group: str, ordinal: str = "ordinal") -> DataFrame:
    """Adds score (to four places) and rank: class, then score, then the order of the files."""
    out = files.withColumn("score", rounded(F.col("raw_score")))
    order = W.partitionBy(*group).orderBy(class_rank(F.col("class")).desc(), F.col("score").desc(), F.col(ordinal).asc())
    return out.withColumn("rank", F.row_number().over(order).cast("long"))


def top_n(ranked: DataFrame, n: int, *group: str) -> DataFrame:
    """The first n of each group, by rank; after filters, ranks stay those of the whole repository."""
    place = F.row_number().over(W.partitionBy(*group).orderBy("rank"))
    return ranked.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def only(ranked: DataFrame, paths: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the given paths. Ranks were made before, and no filter passes below their window."""
    return ranked.join(paths.select(*keys).distinct(), keys, "left_semi")


def dispersion(files: DataFrame, signals: dict[str, tuple[Column, str]], *group: str) -> DataFrame:
    """signals: name -> (raw value, percentile column). Signals whose percentiles are all 0 although some raw value isn't."""
    each = [F.struct(F.lit(n).alias("signal"), F.abs(raw).cast("double").alias("raw"), F.col(pct).alias("pct")) for n, (raw, pct) in signals.items()]
    long = files.select(*group, F.explode(F.array(*each)).alias("s")).select(*group, "s.*")
    flat = long.groupBy(*group, "signal").agg(F.max("pct").alias("max_pct"), F.max("raw").alias("max_raw")).filter("max_pct = 0 AND max_raw > 0")
    return flat.select(*group, F.concat(F.lit("insufficient_dispersion_"), "signal").alias("code"))

