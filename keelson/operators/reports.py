"""Gate findings, the drill-down on one file's edges, and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HIGH_SCORE, LOW_EVIDENCE, EDGE_ROWS = 0.75, 0.50, 50

# The gate's checks and what they say of a file.
CHECKS = {
    "trunk_touched": "Changed file is classified as trunk.",
    "low_evidence_high_score": "Score is >= 0.75 while evidence is nil or < 0.5.",
    "newness_trunk_adjacent": "New file is trunk-adjacent.",
}

# Warning codes and their messages.
MESSAGES = {
    "coverage_flag_deprecated": "--coverage is deprecated; use --ruby-coverage instead",
    "coverage_unavailable": "coverage data was not provided; coverage and interaction signals are unavailable",
    "coverage_partial": "coverage data did not include every scored file; missing files use uncovered risk",
    "diff_filter_empty": "diff filter matched no changed files; output rows are empty",
    "diff_no_scored_files": "diff matched no scored files; the PR may only touch unscorable files",
    "fan_in_rails_inference_failed": "Rails inference failed; inferred Rails references may be incomplete",
    "fan_in_reference_resolution_failed": "constant reference resolution failed; fan-in may be incomplete",
    "files_skipped": "one or more files were skipped during analysis",
    "git_error": "git command failed while computing temporal coupling; coupling is unavailable",
    "git_not_found": "git was not found in PATH while computing temporal coupling; coupling is unavailable",
    "js_depcruise_failed": "dependency-cruiser failed; JavaScript/TypeScript fan-in is unavailable",
    "js_depcruise_no_config": "dependency-cruiser config failed; retried with --no-config, so JavaScript/TypeScript fan-in may be undercounted",
    "js_depcruise_timeout": "dependency-cruiser timed out; JavaScript/TypeScript fan-in is unavailable",
    "js_eslint_failed": "ESLint failed for at least one batch; JavaScript/TypeScript complexity may be incomplete",
    "js_eslint_malformed": "ESLint produced malformed JSON for at least one batch; JavaScript/TypeScript complexity may be incomplete",
    "js_eslint_missing": "ESLint was not found; JavaScript/TypeScript complexity is unavailable",
    "js_eslint_timeout": "ESLint timed out for at least one batch; JavaScript/TypeScript complexity may be incomplete",
    "js_tools_missing": "Node.js or dependency-cruiser was not found; JavaScript/TypeScript fan-in is unavailable",
    "js_ts_parser_missing": "TypeScript files were present but @typescript-eslint/parser was not found; TypeScript complexity may be incomplete",
    "shallow_clone_newness_disabled": "shallow git clone detected; newness rules disabled (use fetch-depth: 0)",
    "shallow_clone_unshallow_failed": "auto-unshallow failed; evidence unavailable (use full git history)",
    "small_repo": "repo has fewer files than --min-files; results may be noisy",
    "temporal_coupling_bulk_commits_skipped": "one or more bulk commits were skipped while computing temporal coupling",
    "zero_churn_majority": "most files have zero churn in the selected window; churn may be less informative",
}


def message(code: str, count: int | None = None, most: int | None = None) -> str:
    prefix = "insufficient_dispersion_"
    if code.startswith(prefix):
        return f"every file has the same non-zero raw {code[len(prefix):]} value, so its percentile-ranked contribution collapsed to 0.0"
    text = MESSAGES.get(code, code.replace("_", " "))
    return f"{text} ({count} skipped; max_commit_files={most})" if count is not None and most is not None else text


def normalised_warnings(items: list) -> list[dict[str, str]]:
    """Codes, or dicts with a code and more; one entry for each code, the first."""
    out: dict[str, dict[str, str]] = {}
    for item in items:
        item = item if isinstance(item, dict) else {"code": str(item)}
        code = str(item["code"])
        out.setdefault(code, {"code": code, "message": item.get("message") or message(code, item.get("count"), item.get("max_commit_files"))})
    return list(out.values())


def first_warnings(found: DataFrame, *group: str) -> DataFrame:
    """found: code, message, place. The first of each code."""
    first = F.row_number().over(W.partitionBy(*group, "code").orderBy("place"))
    return found.withColumn("_nth", first).filter("_nth = 1").drop("_nth")


def gate_findings(rows: DataFrame) -> DataFrame:
    """A row for each check that a file fails; one reading of the rows serves all checks."""
    fails = {
        "trunk_touched": F.col("class") == "trunk",
        "low_evidence_high_score": (F.col("score") >= HIGH_SCORE) & (F.col("evidence").isNull() | (F.col("evidence") < LOW_EVIDENCE)),
        "newness_trunk_adjacent": F.col("new_file") & (F.col("escalation") == "trunk_adjacent"),
    }
    each = [F.when(test, F.struct(F.lit(name).alias("check"), F.lit(CHECKS[name]).alias("reason"))) for name, test in fails.items()]
    met = rows.withColumn("f", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())))
    return met.select("f.check", "path", "language", "score", "evidence", "class", "f.reason")


def gate_summary(findings: DataFrame) -> DataFrame:
    """Findings of every check, also of those without any."""
    names = findings.sparkSession.createDataFrame([(name,) for name in CHECKS], "check string")
    return names.join(findings.groupBy("check").agg(F.count(F.lit(1)).alias("findings")), "check", "left").fillna(0, ["findings"])


def edges_of(target: str, graph: DataFrame, rows: DataFrame, most: int = EDGE_ROWS) -> DataFrame:
    """Both sections of a file's drill-down: section, rank, path, score, class, fan_in, fan_out, instability; unscored: rank null."""
    ends = graph.filter((F.col("dst") == target) | (F.col("src") == target))
    near = ends.select(F.explode(F.filter(F.array(
        F.when(F.col("dst") == target, F.struct(F.lit("dependents").alias("section"), F.col("src").alias("path"))),
        F.when(F.col("src") == target, F.struct(F.lit("dependencies").alias("section"), F.col("dst").alias("path"))),
    ), lambda x: x.isNotNull())).alias("e")).select("e.*").distinct()
    scored = near.join(rows.select("path", "score", "class", "fan_in", "fan_out", "instability"), "path", "left")
    place = F.row_number().over(W.partitionBy("section").orderBy(F.col("score").desc_nulls_last(), "path")).cast("long")
    out = scored.withColumn("rank", place).filter(F.col("score").isNull() | (F.col("rank") <= most))
    return out.withColumn("rank", F.when(F.col("score").isNotNull(), F.col("rank"))).select("section", "rank", "path", "score", "class", "fan_in", "fan_out", "instability")
