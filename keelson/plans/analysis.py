"""The whole analysis as one lazy plan: raw tables in, ranked rows out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Options
from ..functions.numbers import percentile, rounded
from ..functions.paths import path_constant
from ..operators import churn, coupling, graph, history, quality, reports, scoring

Keep = Callable[[DataFrame], DataFrame]
KEYS, GROUP = ["repo_id", "path"], ["repo_id", "lang_group"]
GROUPS = ("ruby", "javascript")


@dataclass
class Inputs:
    """files: repo_id, path, language, lang_group, loc, ordinal (sources.files.collect). The others may be None.

    changes: numstat rows; commits: name-only rows; log: name-status rows; ruby: the references of Ruby files;
    lint: group -> messages; modules: JavaScript edges; coverage: group -> line rates.
    """

    files: DataFrame
    changes: DataFrame | None = None
    commits: DataFrame | None = None
    log: DataFrame | None = None
    log_prefix: str = ""
    ruby: DataFrame | None = None
    lint: dict[str, DataFrame] = field(default_factory=dict)
    modules: DataFrame | None = None
    coverage: dict[str, DataFrame | None] = field(default_factory=dict)
    history_available: bool = True
    warnings: list = field(default_factory=list)


@dataclass
class Report:
    rows: DataFrame
    edges: DataFrame
    pairs: DataFrame | None
    skipped: DataFrame | None
    warnings: list
    coverage_available: dict[str, bool]


def coupled_pairs(inputs: Inputs, options: Options) -> tuple[DataFrame | None, DataFrame | None]:
    """Over all languages at once: (pairs, commits over the cap)."""
    if inputs.commits is None:
        return None, None
    return coupling.coupled(inputs.commits, inputs.files, options.coupling_max_commit_files, threshold=options.coupling_threshold, min_commits=options.coupling_min_commits)


def dependencies(inputs: Inputs, group: str) -> tuple[DataFrame, DataFrame]:
    """(files of the group with fan_in and fan_out, edges). Skipped files still have edges."""
    files = inputs.files.filter(F.col("lang_group") == group)
    nothing = files.select("repo_id", F.col("path").alias("src"), F.col("path").alias("dst")).limit(0)
    if group == "ruby" and inputs.ruby is not None:
        owners = files.join(inputs.ruby.select(*KEYS, "primary").distinct(), KEYS, "left")
        owners = owners.select(*KEYS, F.coalesce(path_constant(F.col("path")), F.col("primary")).alias("constant")).filter("constant IS NOT NULL")
        refs = inputs.ruby.filter("name IS NOT NULL").join(files.select(*KEYS), KEYS, "left_semi")
        return graph.constant_graph(files, refs, owners)
    raw = inputs.modules if group == "javascript" and inputs.modules is not None else nothing
    edges = graph.edges(raw, files)
    return graph.degrees(files, edges), edges


def analyse_group(inputs: Inputs, options: Options, group: str, top: DataFrame | None, past: DataFrame | None, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """(scored rows of a language group, its edges)."""
    files, edges = dependencies(inputs, group)
    edges = keep(edges)
    lint = inputs.lint.get(group)
    if lint is not None:
        if group == "ruby":
            files = quality.readable(files, lint, KEYS)
        files = quality.max_complexity(files, lint, quality.RUBY_MESSAGE if group == "ruby" else quality.JS_MESSAGE, KEYS)
    else:
        files = files.withColumn("complexity", F.lit(0))
    if inputs.changes is not None:
        files = churn.counts(files, inputs.changes, KEYS)
    else:
        files = files.withColumns({c: F.lit(0).cast("long") for c in ("churn_commits", "churn_lines")})
    files = coupling.with_top(files, top, KEYS)
    report = inputs.coverage.get(group)
    files = quality.with_coverage(files, report, KEYS)
    files = scoring.with_percentiles(files, *GROUP).withColumn("loc_pct", percentile("loc", "repo_id", "language"))
    files = scoring.with_score(files, options.weights, *GROUP, coverage=report is not None)
    rows = scoring.with_class(files, *GROUP, trunk=options.trunk_threshold, branch=options.branch_threshold)
    # the rules for new files read the rows three times
    return with_newness(keep(rows), edges, past, options), edges


def with_newness(rows: DataFrame, edges: DataFrame, past: DataFrame | None, options: Options) -> DataFrame:
    """past: what history.lineage found, None if it isn't available."""
    available = past is not None and options.newness
    past = rows.limit(0) if past is None else past
    rows = history.with_history(rows, past, KEYS, F.lit(options.as_of), days=options.new_file_days, commits=options.new_file_min_commits, available=available)
    covered = F.col("coverage_status") == "present"
    rows = rows.withColumn("evidence", history.evidence(F.col("age_days"), F.col("total_commits"), covered, F.col("metadata_available")))
    return history.newness(rows, edges, GROUP, KEYS)


def analyse(inputs: Inputs, options: Options, keep: Keep = lambda rows: rows) -> Report:
    """keep: writes rows that are read more than once and gives the table; without it they are computed anew."""
    options.validate()
    past = keep(history.lineage(inputs.log, inputs.files, inputs.log_prefix)) if inputs.log is not None and inputs.history_available else None
    pairs, bulk = coupled_pairs(inputs, options)
    top = keep(coupling.top_partner(pairs)) if pairs is not None else None
    rows = edges = None
    for group in GROUPS:
        own_rows, own_edges = analyse_group(inputs, options, group, top, past, keep)
        rows = own_rows if rows is None else rows.unionByName(own_rows)
        edges = own_edges if edges is None else edges.unionByName(own_edges)
    # warnings and outputs all read the ranked rows
    ranked = keep(scoring.with_rank(rows, *GROUP))
    skipped = inputs.lint["ruby"].filter("skipped").select(*KEYS).distinct() if "ruby" in inputs.lint else None
    has = {g: inputs.coverage.get(g) is not None for g in GROUPS}
    unread = [] if inputs.ruby is None or inputs.ruby.filter("NOT parsed").isEmpty() else ["fan_in_reference_resolution_failed"]
    return Report(ranked, edges, pairs, skipped, reports.normalised_warnings([*inputs.warnings, *unread, *found_warnings(ranked, bulk, skipped, has, options)]), has)


def found_warnings(rows: DataFrame, bulk: DataFrame | None, skipped: DataFrame | None, coverage: dict[str, bool], options: Options) -> list:
    """Codes that the data calls for, each once: the results are a few counts for each group."""
    churned = churn.zero_inflation(rows, "lang_group").collect()
    missing = {r["lang_group"] for r in rows.filter("coverage_status = 'missing'").select("lang_group").distinct().collect()}
    out: list = []
    for group in GROUPS:
        own = next((r for r in churned if r["lang_group"] == group), None)
        if own is None:
            continue
        if not coverage[group]:
            out.append("coverage_unavailable")
        elif group in missing:
            out.append("coverage_partial")
        if own["zero_inflated"]:
            out.append("zero_churn_majority")
        if group == "ruby" and skipped is not None and not skipped.isEmpty():
            out.append("files_skipped")
        if own["n_files"] < options.min_files:
            out.append("small_repo")
    signals = {
        "fan_in": (F.col("fan_in"), "fan_in_pct"), "fan_out": (F.col("fan_out"), "fan_out_pct"), "complexity": (F.col("complexity"), "complexity_pct"),
        "churn": (F.col("churn_commits") + F.col("churn_lines"), "churn_pct"), "coupling": (F.col("max_coupling"), "coupling_pct"),
    }
    measured = scoring.with_interaction(rows.filter("coverage_status <> 'unavailable'"), *GROUP)
    covered = {"coverage": (quality.risk(F.col("coverage")), "coverage_risk_pct"), "interaction": (F.col("interaction_raw"), "interaction_pct")}
    flat = scoring.dispersion(rows, signals, "lang_group").unionByName(scoring.dispersion(measured, covered, "lang_group"))
    out += sorted({r["code"] for r in flat.select("code").collect()})
    if bulk is not None and (count := bulk.count()):
        out.append({"code": "temporal_coupling_bulk_commits_skipped", "count": count, "max_commit_files": options.coupling_max_commit_files})
    return reports.normalised_warnings(out)


#: The columns of a result, in order.
RESULT_COLUMNS = (
    "rank", "language", "file", "score", "evidence", "class", "new_file", "age_days", "escalation", "fan_in", "fan_in_pct", "fan_out", "fan_out_pct",
    "instability", "instability_pct", "complexity", "complexity_pct", "churn_commits", "churn_lines", "churn_pct", "loc", "loc_pct", "max_coupling",
    "max_coupling_partner", "coupling_partners", "coupling_pct", "coverage",
)
ROUNDED = ("fan_in_pct", "fan_out_pct", "instability_pct", "complexity_pct", "churn_pct", "loc_pct", "max_coupling", "coupling_pct", "coverage")


def results(rows: DataFrame) -> DataFrame:
    """rows as they are shown: RESULT_COLUMNS, fractions to four places, and lang_group and coverage_status."""
    shown = rows.withColumn("file", F.col("path"))
    return shown.select(*[rounded(F.col(c)).alias(c) if c in ROUNDED else F.col(c) for c in RESULT_COLUMNS], "lang_group", "coverage_status")


def selected(rows: DataFrame, options: Options, paths: DataFrame | None = None) -> DataFrame:
    """Filter and limit of the output; ranks stay."""
    out = scoring.only(rows, paths, ["path"]) if paths is not None else rows
    return scoring.top_n(out, options.top, *GROUP) if options.top else out
