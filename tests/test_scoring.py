import pytest
from pyspark.sql import functions as F

from keelson.functions.numbers import percentile, rounded
from keelson.operators import churn, history, quality, scoring
from keelson.plans import analysis

GROUP = ["repo_id", "lang_group"]
COLUMNS = "repo_id string, lang_group string, language string, path string, ordinal int, fan_in int, fan_out int, complexity int, churn_commits int, churn_lines int, loc int, coverage double, max_coupling double"


def files(spark, rows):
    """rows: path -> (fan_in, fan_out, complexity, commits, lines, coverage, coupling)."""
    held = [("r", "ruby", "ruby", p, i, *v[:5], 1, *v[5:]) for i, (p, v) in enumerate(rows.items())]
    return spark.createDataFrame(held, COLUMNS)


def scored(frame, coverage, **how):
    out = scoring.with_score(scoring.with_percentiles(frame, *GROUP), scoring.DEFAULT_WEIGHTS, *GROUP, coverage=coverage)
    return {r["path"]: r for r in scoring.with_rank(scoring.with_class(out, *GROUP, **how), *GROUP).collect()}


FOUR = {"a": (3, 0, 1, 0, 0, None, 0.0), "b": (2, 1, 10, 1, 1, None, 0.0), "c": (1, 2, 0, 10, 10, None, 0.0), "d": (0, 0, 0, 0, 0, None, 0.0)}


def test_percentiles_share_the_lower_rank_on_ties(spark):
    rows = spark.createDataFrame([("g", 1), ("g", 2), ("g", 2), ("g", 5), ("one", 7), ("same", 3), ("same", 3)], "g string, x int")
    got = sorted((r.g, r.x, round(r.p, 4)) for r in rows.withColumn("p", percentile("x", "g")).collect())
    assert got == [("g", 1, 0.0), ("g", 2, 0.3333), ("g", 2, 0.3333), ("g", 5, 1.0), ("one", 7, 0.0), ("same", 3, 0.0), ("same", 3, 0.0)]


def test_four_factor_scores_and_classes(spark):
    got = scored(files(spark, FOUR), False)
    assert {p: r["score"] for p, r in got.items() if p != "d"} == {"a": 0.4583, "b": 0.7708, "c": 0.5208}
    assert {p: r["class"] for p, r in got.items()} == {"a": "leaf", "b": "trunk", "c": "branch", "d": "leaf"}
    assert [p for p, _ in sorted(got.items(), key=lambda x: x[1]["rank"])] == ["b", "c", "a", "d"]


def test_weights_are_scaled_over_the_active_signals():
    w = scoring.active_weights(scoring.DEFAULT_WEIGHTS, coverage=False, coupling=False)
    assert {k: v and round(v, 4) for k, v in w.items()} == {"fan_in": 0.25, "fan_out": 0.125, "complexity": 0.3125, "churn": 0.3125, "coverage": None, "interaction": None, "coupling": None}
    with pytest.raises(scoring.WeightError):
        scoring.active_weights(dict.fromkeys(scoring.DEFAULT_WEIGHTS, 0.0), coverage=False, coupling=False)


SAMPLE = {
    "app/controllers/posts_controller.rb": (0, 2, 1, 1, 8, 0.4, 0.0), "app/controllers/users_controller.rb": (0, 1, 1, 1, 7, 0.2, 0.0), "app/models/comment.rb": (0, 1, 1, 1, 7, 0.85, 0.0),
    "app/models/post.rb": (2, 1, 1, 1, 7, None, 0.0), "app/models/profile.rb": (1, 1, 1, 1, 7, 0.75, 0.0), "app/models/user.rb": (8, 0, 1, 3, 14, 1.0, 0.0), "app/services/auth_service.rb": (0, 1, 1, 1, 7, 0.0, 0.0),
    "app/services/post_service.rb": (0, 2, 1, 1, 7, 0.65, 0.0), "app/services/profile_service.rb": (0, 2, 1, 1, 8, 0.5, 0.0), "lib/some_utility.rb": (0, 0, 1, 1, 7, None, 0.0),
}


def test_sample_application(spark):
    got = scored(files(spark, SAMPLE), True)
    assert (got["app/models/post.rb"]["score"], got["app/models/profile.rb"]["score"]) == (0.3469, 0.2173)


def test_churn_ranks_the_rounded_mean(spark):
    rows = spark.createDataFrame([("r", "g", "a", 3, 1), ("r", "g", "b", 1, 2), ("r", "g", "c", 2, 3), ("r", "g", "d", 0, 0)], "repo_id string, lang_group string, path string, churn_commits int, churn_lines int")
    got = {r.path: round(r.churn_pct, 4) for r in churn.with_churn_pct(rows, *GROUP).collect()}
    assert got == {"a": 0.6667, "b": 0.3333, "c": 1.0, "d": 0.0}


def test_floors_lift_leaves_only_and_complexity_goes_first(spark):
    rows = {f"f{i}": (i, 0, i, i, i, None, 0.0) for i in range(10)} | {"x": (30, 0, 15, 0, 0, None, 0.0), "y": (26, 0, 3, 0, 0, None, 0.0)}
    got = scored(files(spark, rows), False, trunk=99, branch=98)
    assert (got["x"]["class"], got["x"]["escalation"]) == ("branch", "complexity_floor")
    assert (got["y"]["class"], got["y"]["escalation"]) == ("branch", "fan_in_floor")


def test_top_and_filter_keep_ranks(spark):
    frame = scoring.with_rank(scoring.with_class(scoring.with_score(scoring.with_percentiles(files(spark, FOUR), *GROUP), scoring.DEFAULT_WEIGHTS, *GROUP, coverage=False), *GROUP), *GROUP)
    only = scoring.only(frame, spark.createDataFrame([("a",), ("d",), ("zz",)], "path string"), ["path"])
    assert sorted((r.path, r["rank"]) for r in only.collect()) == [("a", 3), ("d", 4)]
    assert [r.path for r in scoring.top_n(only, 1, *GROUP).collect()] == ["a"]


def test_dispersion_needs_a_raw_value(spark):
    rows = {p: (4, 0, i, 0, 0, None, 0.0) for i, p in enumerate("abc")}
    frame = scoring.with_percentiles(files(spark, rows), *GROUP)
    signals = {"fan_in": (F.col("fan_in"), "fan_in_pct"), "fan_out": (F.col("fan_out"), "fan_out_pct"), "complexity": (F.col("complexity"), "complexity_pct")}
    assert [r.code for r in scoring.dispersion(frame, signals, "lang_group").collect()] == ["insufficient_dispersion_fan_in"]


@pytest.mark.parametrize(("age", "commits", "covered", "known", "want"), [(90, 5, False, True, 1.0), (30, 3, True, True, 1.0), (15, 3, True, True, 0.8333), (10, 1, False, False, None), (0, 0, False, True, 0.0), (15, 0, False, True, 0.25)])
def test_evidence(spark, age, commits, covered, known, want):
    row = spark.range(1).select(history.evidence(F.lit(age), F.lit(commits), F.lit(covered), F.lit(known)).alias("e")).first()
    assert row.e == want


def test_new_files_beside_trunks(spark):
    rows = spark.createDataFrame(
        [("r", "g", "t", "trunk", "", False), ("r", "g", "n", "leaf", "", True), ("r", "g", "m", "leaf", "", True), ("r", "g", "k", "branch", "fan_in_floor", True), ("r", "g", "b", "branch", "", True), ("r", "g", "o", "leaf", "", False)],
        "repo_id string, lang_group string, path string, class string, escalation string, new_file boolean",
    )
    edges = spark.createDataFrame([("r", "n", "t"), ("r", "m", "n"), ("r", "o", "t")], "repo_id string, src string, dst string")
    got = {r.path: (r["class"], r.escalation) for r in history.newness(rows, edges, GROUP, ["repo_id", "path"]).collect()}
    assert got == {"t": ("trunk", ""), "n": ("trunk", "trunk_adjacent"), "m": ("branch", "recency_floor"), "k": ("branch", "recency_floor"), "b": ("branch", ""), "o": ("leaf", "")}


def test_rounding_is_half_up(spark):
    row = spark.range(1).select(rounded(F.lit(0.00005)).alias("a"), rounded(F.lit(2 / 3)).alias("b"), rounded(F.lit(0.0)).alias("c")).first()
    assert tuple(row) == (0.0001, 0.6667, 0.0)


def test_coverage_of_merged_arrays(spark):
    rows = spark.createDataFrame([("a", [1, None, 0]), ("a", [0, None, 2, 1]), ("b", [None]), ("c", [])], "path string, hits array<int>")
    got = {r.path: (r.executable, r.covered, r.line_rate) for r in quality.max_merge(rows, ["path"]).collect()}
    assert got == {"a": (3, 3, 1.0), "b": (0, 0, 0.0), "c": (0, 0, 0.0)}


def test_result_columns(spark):
    assert len(analysis.RESULT_COLUMNS) == 27


def test_percentiles_of_large_groups(spark):
    import random

    from pyspark.sql import functions as F

    from pyspark.sql import Window as W

    from keelson.functions.numbers import percentile, with_percentile

    rng = random.Random(4)
    rows = [(k, "a" if k % 3 else "b", rng.choice([None, 1.0, rng.randint(0, 300) / 7])) for k in range(3000)] + [(5000, "alone", 2.0), (5001, "none", None)]
    frame = spark.createDataFrame(rows, "k int, g string, x double")
    for group in (("g",), ()):
        want = frame.filter("x IS NOT NULL").withColumn("p", percentile("x", *group) if group else F.percent_rank().over(W.orderBy("x")))
        got = with_percentile(frame, "x", "p", *group, stretches=8)
        assert got.count() == len(rows)
        assert {(r.k, r.p) for r in got.filter("x IS NOT NULL").collect()} == {(r.k, r.p) for r in want.select("k", "p").collect()}
        assert got.filter("x IS NULL AND p IS NOT NULL").isEmpty()
