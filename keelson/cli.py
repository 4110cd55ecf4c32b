"""Command line: `scan`, `edges` and `gate` over a working copy and the reports of its tools.

Logs and tool reports are files, made beforehand (sources.gitlog has the git commands); nothing here runs other programs.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .config import OptionError, Options, formula, parse_weights
from .operators import commits, coupling, history, reports, scoring
from .plans import writers
from .plans.analysis import Inputs, analyse, results, selected
from .sources import coverage, files, gitlog, ruby, texts
from .sources import reports as tools
from .sources.kept import NoSharedFolder, keeper


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("keelson")
    top.add_argument("--version", action="version", version=__version__)
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("scan", "edges"):
        p = sub.add_parser(name)
        if name == "edges":
            p.add_argument("file")
        p.add_argument("path", nargs="?", default=".")
        for flag in ("numstat", "name-only", "name-status", "ruby-lint", "js-lint", "modules", "ruby-coverage", "js-coverage", "coverage", "diff-base", "commits", "csv-dir", "log-prefix"):
            p.add_argument(f"--{flag}")
        p.add_argument("--changed", help="file with the changed paths from the top of the repository, a path to a line: git diff --name-only --diff-filter=d BASE...HEAD")
        p.add_argument("--only", help="paths, comma-separated")
        p.add_argument("--output", choices=("table", "json", "markdown", "csv"), default="table")
        p.add_argument("--weights", type=parse_weights)
        for flag in ("interaction-weight", "coupling-weight", "coupling-threshold"):
            p.add_argument(f"--{flag}", type=float)
        for flag in ("churn-days", "js-timeout", "trunk-threshold", "branch-threshold", "min-files", "top", "coupling-min-commits", "coupling-max-commit-files", "new-file-days", "new-file-min-commits", "as-of"):
            p.add_argument(f"--{flag}", type=int)
        p.add_argument("--exclude", action="append", default=[])
        p.add_argument("--no-newness", action="store_true")
        p.add_argument("--no-rails-inference", action="store_true")
        p.add_argument("--shallow", action="store_true", help="the clone is shallow (found by itself where PATH has a .git): histories are not complete")
    gate = sub.add_parser("gate")
    gate.add_argument("--input")
    gate.add_argument("--enforce", action="store_true")
    return top


def options_of(args: argparse.Namespace) -> Options:
    out = Options(exclude=args.exclude, ruby_coverage=args.ruby_coverage or args.coverage, js_coverage=args.js_coverage, diff_base=args.diff_base, newness=not args.no_newness, rails_inference=not args.no_rails_inference)
    for name in ("churn_days", "js_timeout", "trunk_threshold", "branch_threshold", "min_files", "top", "coupling_threshold", "coupling_min_commits", "coupling_max_commit_files", "new_file_days", "new_file_min_commits", "as_of"):
        if getattr(args, name) is not None:
            setattr(out, name, getattr(args, name))
    if args.weights:
        out.weights, out.custom_weights = args.weights, True
    for name in ("interaction", "coupling"):
        if (value := getattr(args, f"{name}_weight")) is not None:
            out.weights = {**out.weights, name: value}
    out.only_paths = args.only.split(",") if args.only else None
    out.as_of = out.as_of or int(datetime.now(timezone.utc).timestamp())
    return out.validate()


def is_shallow(path: str) -> bool:
    """Whether the clone that the folder lies in keeps a list of cut commits; `.git` may be a file that names the folder."""
    at = os.path.abspath(path)
    while not os.path.exists(git := os.path.join(at, ".git")):
        if at == (at := os.path.dirname(at)):
            return False
    if os.path.isfile(git):
        with open(git) as f:
            git = os.path.join(at, f.read().removeprefix("gitdir:").strip())
    return os.path.exists(os.path.join(git, "shallow"))


def load(spark: SparkSession, args: argparse.Namespace, options: Options, keep: Callable[[DataFrame], DataFrame]) -> Inputs:
    repo, root = os.path.basename(os.path.abspath(args.path)), os.path.abspath(args.path)
    scored, _ = files.collect(files.scanned(spark, args.path, repo), options.exclude)
    scored, shallow = keep(scored), args.shallow or is_shallow(args.path)
    notes = [*files.require_population(scored, options.min_files), *(["coverage_flag_deprecated"] if args.coverage else []), *(["shallow_clone_newness_disabled"] if shallow else [])]
    own = scored.filter("lang_group = 'ruby'")
    parsed = keep(ruby.references(own, options.rails_inference))
    lint = {g: read(texts.whole(spark, p, repo), root) for g, p, read in (("ruby", args.ruby_lint, tools.ruby_lint), ("javascript", args.js_lint, tools.js_lint)) if p}
    covered = {g: coverage.read(spark, p, scored.filter(F.col("lang_group") == g), repo, root) if p else None for g, p in (("ruby", options.ruby_coverage), ("javascript", options.js_coverage))}
    return Inputs(
        files=scored, ruby=parsed, lint=lint, coverage=covered, history_available=not shallow, log_prefix=args.log_prefix or "", warnings=notes,
        changes=gitlog.numstat(gitlog.read_lines(spark, args.numstat, repo)) if args.numstat else None,
        commits=gitlog.name_only(gitlog.read_records(spark, args.name_only, repo)) if args.name_only else None,
        log=keep(gitlog.name_status(gitlog.read_records(spark, args.name_status, repo))) if args.name_status else None,
        modules=tools.modules(texts.whole(spark, args.modules, repo), root) if args.modules else None,
    )


def wanted_paths(spark: SparkSession, args: argparse.Namespace, options: Options) -> DataFrame | None:
    """The paths that the output is limited to, relative to the analysed folder; None without a filter.

    Those of a diff and of --only count from the top of the repository, of which --log-prefix is the analysed folder.
    """
    if options.diff_base and not (args.changed or args.commits):
        raise OptionError("Error: --diff-base needs --commits FILE with the commit graph, or --changed FILE with the paths of the diff.")
    if options.diff_base and args.commits and not args.changed:
        named = commits.changed_paths(*gitlog.graph(gitlog.read_records(spark, args.commits, "")), options.diff_base).select("path")
    elif args.changed:
        named = spark.read.text(args.changed).select(F.trim("value").alias("path"))
    elif options.only_paths is not None:
        named = spark.createDataFrame([(p,) for p in options.only_paths], "path string")
    else:
        return None
    return history.inside(named, args.log_prefix or "")


def scan(spark: SparkSession, args: argparse.Namespace) -> int:
    options = options_of(args)
    paths = wanted_paths(spark, args, options)
    keep = keeper(spark)
    report = analyse(load(spark, args, options, keep), options, keep)
    notes = list(report.warnings)
    if paths is not None and paths.isEmpty():
        notes.append("diff_filter_empty")
    elif paths is not None and report.rows.join(paths, "path", "left_semi").isEmpty():
        notes.append("diff_no_scored_files")
    shown, any_coverage = results(selected(report.rows, options, paths)), any(report.coverage_available.values())
    count, skipped = report.rows.count(), report.skipped.count() if report.skipped is not None else 0
    coupled = not report.rows.filter("coupling_available").isEmpty()
    weights = scoring.active_weights(options.weights, coverage=any_coverage, coupling=coupled)
    label, now = formula(coverage=any_coverage, coupling=weights["coupling"]), datetime.fromtimestamp(options.as_of, timezone.utc)
    note = writers.scoring_note(weights, coverage=any_coverage)
    for line in (note, *(f"Warning: {w['message']}" for w in reports.normalised_warnings(notes))):
        print(line, file=sys.stderr)
    if args.output == "csv":
        writers.write_csv(shown, args.csv_dir or "keelson-csv")
    elif args.output == "json":
        meta = writers.meta(args.path, now.strftime("%Y-%m-%dT%H:%M:%SZ"), options.churn_days, count, skipped, weights, coverage=any_coverage, diff_base=options.diff_base, filtered=bool(args.changed), only=options.only_paths)
        for part in writers.to_json(shown, meta, notes):
            print(part, end="")
        print()
    else:
        note = None if any_coverage else note
        if args.output == "markdown":
            lines = writers.to_markdown(shown, day=now.strftime("%Y-%m-%d"), label=label, churn_days=options.churn_days, file_count=count, note=note)
        else:
            lines = writers.to_table(shown, repo=args.path, label=label, churn_days=options.churn_days, note=note, footer=f"{count} files analyzed." + (f" {skipped} files skipped." if skipped else ""))
        for line in lines:
            print(line)
    return 0


def edges(spark: SparkSession, args: argparse.Namespace) -> int:
    """Scores without coupling, as the drill-down has always shown them."""
    options = options_of(args)
    keep = keeper(spark)
    inputs = load(spark, args, options, keep)
    logged, inputs.commits = inputs.commits, None
    report = analyse(inputs, options, keep)
    header = report.rows.filter(F.col("path") == args.file).first()
    if header is None:
        print(f"Error: '{args.file}' was not found in the scored file set.", file=sys.stderr)
        return 1
    partners = []
    if logged is not None:
        pairs, _ = coupling.coupled(logged, inputs.files, options.coupling_max_commit_files, threshold=options.coupling_threshold, min_commits=options.coupling_min_commits)
        found = coupling.partners_of(pairs)
        partners = [p.asDict() for r in found.filter(F.col("path") == args.file).collect() for p in r["partners"]]
    print(writers.edges_text(args.file, header, reports.edges_of(args.file, report.edges, report.rows), partners, churn_days=options.churn_days, min_commits=options.coupling_min_commits, threshold=options.coupling_threshold))
    return 0


def gate(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.input:
        with open(args.input) as f:
            text = f.read()
    elif not sys.stdin.isatty():
        text = sys.stdin.read()
    else:
        raise writers.GateError("Error: gate needs --input or a report on standard input.")
    found = reports.gate_findings(writers.gate_rows(spark, text)).collect()
    print(writers.gate_markdown([r.asDict() for r in found], enforce=args.enforce))
    return int(args.enforce and bool(found))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("keelson").getOrCreate()
    try:
        return {"scan": scan, "edges": edges, "gate": gate}[args.command](spark, args)
    except (NoSharedFolder, OptionError, commits.RefError, files.PopulationError, coverage.CoverageError, writers.GateError, scoring.WeightError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
