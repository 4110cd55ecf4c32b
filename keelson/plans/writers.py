"""The sinks: table, CSV, JSON and Markdown of a report, and text of the drill-down and the gate.

Rows become lines on the executors, by one expression for each format. CSV is written there too; the others are documents
for people, and the driver passes their lines on one at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import formula
from ..operators.reports import CHECKS, normalised_warnings
from .analysis import RESULT_COLUMNS

SECTIONS = (("Ruby", "ruby"), ("JavaScript/TypeScript", "javascript"))
D4 = ("score", "fan_in_pct", "fan_out_pct", "instability", "instability_pct", "complexity_pct", "churn_pct", "loc_pct", "max_coupling", "coupling_pct")
MARKDOWN_COLUMNS = tuple(c for c in RESULT_COLUMNS if c not in ("fan_in_pct", "instability_pct", "complexity_pct", "loc", "loc_pct"))
FOOTNOTE = "References are read from the source text; what code resolves while it runs is not in fan_in."


def d4(x: float) -> str:
    return f"{x:.4f}"


def scoring_note(weights: dict, *, coverage: bool) -> str:
    """Which formula made the scores, and its weights."""
    used = ", ".join(f"{k} {w:.2f}" for k, w in weights.items() if w)
    return f"Note: {'with' if coverage else 'without'} coverage data, scores use the {formula(coverage=coverage, coupling=weights.get('coupling'))} formula ({used})."


def fixed4(c: str) -> Column:
    """Null stays null; format_string alone would write it out."""
    return F.when(F.col(c).isNotNull(), F.format_string("%.4f", c))


def plain(c: str) -> Column:
    """A fraction of four places without an exponent, which casts give below 0.001."""
    return F.when((F.col(c) > 0) & (F.col(c) < 0.001), fixed4(c)).otherwise(F.col(c).cast("string"))


def shown_coverage() -> Column:
    """Whole percent; a dash for a file that the report lacks, n/a without a report."""
    percent = F.concat(F.floor(F.col("coverage") * F.lit(100.0) + F.lit(0.5)).cast("string"), F.lit("%"))
    return F.when(F.col("coverage_status") == "unavailable", "n/a").otherwise(F.coalesce(percent, F.lit("—")))


def cell(c: str) -> Column:
    """As text for people; missing evidence is empty."""
    if c == "coverage":
        return shown_coverage()
    return F.coalesce(fixed4(c) if c in (*D4, "evidence") else F.col(c).cast("string"), F.lit(""))


def csv_cells() -> list[Column]:
    """Missing evidence is bare, missing coverage is quoted and empty."""
    own = {c: fixed4(c) for c in (*D4, "evidence")}
    own["coverage"] = F.when(F.col("coverage_status") == "missing", "—").when(F.col("coverage").isNull(), "").otherwise(plain("coverage"))
    return [own.get(c, F.col(c).cast("string")).alias(c) for c in RESULT_COLUMNS]


def csv_line() -> Column:
    return F.to_csv(F.struct(*csv_cells()))


def markdown_line() -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, MARKDOWN_COLUMNS)), F.lit(" |"))


def json_line() -> Column:
    """All columns, nulls too; a file that the coverage report lacks has a dash."""
    written = F.to_json(F.struct(*[F.col(c).alias("path" if c == "file" else c) for c in RESULT_COLUMNS]), {"ignoreNullFields": "false"})
    # 0.0001 to 0.0009 come with an exponent; within strings a quote never follows a brace or a comma, but a backslash
    written = F.regexp_replace(written, r'(?<key>[{,]"[a-z_]+":)(?<digit>\d)\.0E-4', "${key}0.000${digit}")
    dashed = F.regexp_replace(written, '"coverage":null\\}$', '"coverage":"—"}')
    return F.when(F.col("coverage_status") == "missing", dashed).otherwise(written)


def table_line() -> Column:
    cells = []
    for n, w, left in TABLE:
        text = truncated(F.coalesce(F.col(n), F.lit(""))) if n == "max_coupling_partner" else F.coalesce(fixed4(n), F.lit("n/a")) if n == "evidence" else cell(n)
        cells.append(F.when(F.length(text) >= w, text).otherwise((F.rpad if left else F.lpad)(text, w, " ")))
    return F.concat_ws("  ", *cells)


def write_csv(results: DataFrame, path: str) -> None:
    """27 columns, a header in each file; Ruby first, by rank. Files follow each other in that order."""
    ordered = results.orderBy(F.desc("lang_group"), "rank")
    ordered.select(*csv_cells()).write.option("header", True).mode("overwrite").csv(path)


def _lines(results: DataFrame, group: str, line: Column) -> Iterator[str]:
    """By rank; one partition at a time is on the driver."""
    for r in results.filter(F.col("lang_group") == group).orderBy("rank").select(line.alias("line")).toLocalIterator():
        yield r["line"]


def to_json(results: DataFrame, meta: dict, warnings: list) -> Iterator[str]:
    """Parts of the document, to be joined."""
    flat = normalised_warnings(warnings)
    yield json.dumps({"meta": {**meta, "schema_version": 1, "warnings": flat}, "warnings": flat}, ensure_ascii=False)[:-1]
    for _, group in SECTIONS:
        yield f', "{group}": ['
        for i, line in enumerate(_lines(results, group, json_line())):
            yield (", " if i else "") + line
        yield "]"
    yield "}"


def meta(repo: str, analysed_at: str, churn_days: int, file_count: int, skipped: int, weights: dict, *, coverage: bool, diff_base: str | None = None, filtered: bool = False, only: list | None = None) -> dict:
    out = {
        "repo": repo, "analyzed_at": analysed_at, "churn_days": churn_days, "file_count": file_count, "files_skipped": skipped,
        "formula": formula(coverage=coverage, coupling=weights.get("coupling")), "weights": {k: None if w is None else round(w, 4) for k, w in weights.items()},
    }
    if diff_base or filtered or only is not None:
        out["filtered"] = True
    return out | ({"diff_base": diff_base} if diff_base else {}) | ({"only_paths": only} if only is not None else {})


def to_markdown(results: DataFrame, *, day: str, label: str, churn_days: int, file_count: int, note: str | None = None) -> Iterator[str]:
    """Lines of the document."""
    yield from (f"## keelson — {day}", "", f"> {label}. Churn window: {churn_days} days. {file_count} files analyzed.", *(["", f"> {note}"] if note else []))
    for title, group in SECTIONS:
        yield from (f"### {title}", "", f"| {' | '.join(MARKDOWN_COLUMNS)} |", f"| {' | '.join('---' for _ in MARKDOWN_COLUMNS)} |")
        yield from _lines(results, group, markdown_line())
        yield ""
    yield from ("", f"*{FOOTNOTE}*")


# name, width, whether it stands to the left
TABLE = (
    ("rank", 5, False), ("language", 10, True), ("file", 45, True), ("score", 6, False), ("evidence", 8, False), ("class", 6, True), ("new_file", 5, False), ("age_days", 8, False),
    ("escalation", 15, True), ("fan_in", 6, False), ("fan_out", 7, False), ("instability", 11, False), ("complexity", 10, False), ("churn_commits", 13, False), ("churn_lines", 11, False),
    ("churn_pct", 9, False), ("loc", 5, False), ("loc_pct", 7, False), ("max_coupling", 12, False), ("max_coupling_partner", 40, True), ("coupling_partners", 17, False), ("coupling_pct", 12, False), ("coverage", 8, False),
)


def truncated(partner: Column, most: int = 40) -> Column:
    """The end of a long path says more than its start."""
    return F.when(F.length(partner) <= most, partner).otherwise(F.concat(F.lit("..."), F.right(partner, F.lit(most - 3))))


def to_table(results: DataFrame, *, repo: str, label: str, churn_days: int, note: str | None = None, footer: str = "") -> Iterator[str]:
    """Lines of the document."""
    yield from (f"keelson — {repo} ({churn_days}-day churn, {label})", *([note] if note else []), "")
    for title, group in SECTIONS:
        yield from (title, "  ".join(f"{n:<{w}}" if left else f"{n:>{w}}" for n, w, left in TABLE))
        yield from _lines(results, group, table_line())
        yield ""
    yield from (footer, FOOTNOTE)


def edges_text(target: str, header, sections: DataFrame, partners: list, *, churn_days: int, min_commits: int, threshold: float) -> str:
    out = ["", f"keelson edges — {target}", ""]
    if header is not None:
        out.append(f"  score: {d4(header['score'])}  class: {header['class']:<6}  fan_in: {header['fan_in']}  fan_out: {header['fan_out']}  instability: {d4(header['instability'])}")
        if header["escalation"]:
            out.append(f"  escalation: {header['escalation']}")
    out.append("")
    rows = sections.orderBy("section", "rank").collect()
    for title, name, what in (("Dependents", "dependents", "(files that depend on this file — blast radius)"), ("Dependencies", "dependencies", "(files this file depends on — fan-out)")):
        own = [r for r in rows if r["section"] == name]
        scored, rest = [r for r in own if r["rank"] is not None], sum(r["rank"] is None for r in own)
        out += [f"  ── {title} ({len(own)} files) {what} ──", ""]
        if not scored:
            out.append("    (none in scored file set)")
        else:
            out.append(f"  {'rank':>4}  {'file':<50}  {'score':>6}  {'class':<6}  {'fan_in':>6}  {'fan_out':>6}  {'instability':>11}")
            out += [f"  {r['rank']:>4}  {r['path']:<50}  {d4(r['score']):>6}  {r['class']:<6}  {r['fan_in']:>6}  {r['fan_out']:>6}  {d4(r['instability']):>11}" for r in scored]
            out += [f"    ... and {rest} unscored (gems, generated files)"] if rest else []
        out.append("")
    out += [f"  ── Temporal Coupling ({churn_days}-day window, min {min_commits} co-changes, threshold {threshold:.2f}) ──", ""]
    if not partners:
        out.append("    (none above threshold)")
    else:
        out += ["   coupling  co_changes  file", *(f"  {d4(p['coupling']):>8}  {p['co_changes']:>10}  {p['path']}" for p in partners)]
    return "\n".join([*out, "", "", "Edges come from the source text; what code resolves while it runs is missing.", f"Coupling comes from {churn_days} days of commits."])


def plural(n: int, noun: str) -> str:
    return f"{n} {noun}{'' if n == 1 else 's'}"


def gate_markdown(findings: list, *, enforce: bool = False) -> str:
    by = {c: [f for f in findings if f["check"] == c] for c in CHECKS}
    out = ["## keelson gate", "", f"**Mode:** {'enforce' if enforce else 'observation'}", f"**Summary:** {plural(len(findings), 'finding')} across {len(CHECKS)} checks.", ""]
    out += [f"- {'⚠️' if own else '✅'} `{c}` — {plural(len(own), 'finding')}" for c, own in by.items()] + [""]
    bar = lambda x: str(x).replace("|", "\\|")
    for c, own in by.items():
        out += [f"<details{' open' if own else ''}>", f"<summary><strong>{c}</strong> — {plural(len(own), 'finding')}</summary>", ""]
        if own:
            out += ["| file | class | score | evidence | reason |", "| --- | --- | ---: | ---: | --- |"]
            for f in own:
                evidence = "nil" if f["evidence"] is None else d4(f["evidence"])
                out.append(f"| `{bar(f['path'])}` | {bar(f['class'])} | {'—' if f['score'] is None else d4(f['score'])} | {evidence} | {bar(f['reason'])} |")
        else:
            out.append("_No findings._")
        out += ["", "</details>", ""]
    return "\n".join(out)


class GateError(ValueError):
    pass


def gate_rows(spark, text: str) -> DataFrame:
    """Rows of both sections of a JSON report."""
    try:
        body = json.loads(text)
    except ValueError as e:
        raise GateError(f"Error: invalid JSON input: {e}") from None
    rows = [*body.get("ruby", []), *body.get("javascript", [])]
    number = lambda x: None if x is None else float(x)
    held = [(r.get("path"), r.get("language"), number(r.get("score", 0)), number(r.get("evidence")), r.get("class"), bool(r.get("new_file")), r.get("escalation") or "") for r in rows]
    return spark.createDataFrame(held, "path string, language string, score double, evidence double, class string, new_file boolean, escalation string")
