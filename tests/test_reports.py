import json
import os

import pytest
from pyspark.sql import functions as F

from keelson import cli
from keelson.config import OptionError, Options, formula, parse_weights
from keelson.operators import reports
from keelson.plans import catalogue, texts, writers
from keelson.plans.analysis import Inputs, analyse, results
from keelson.sources import ruby


def test_gate(spark):
    rows = [("a", "ruby", 0.8, None, "trunk", True, "trunk_adjacent"), ("b|c", "ruby", 0.75, 0.5, "leaf", False, ""), ("d", "ruby", 0.9, 0.4, "branch", True, "recency_floor")]
    frame = spark.createDataFrame(rows, "path string, language string, score double, evidence double, class string, new_file boolean, escalation string")
    found = reports.gate_findings(frame)
    assert sorted((r.check, r.path) for r in found.collect()) == [("low_evidence_high_score", "a"), ("low_evidence_high_score", "d"), ("newness_trunk_adjacent", "a"), ("trunk_touched", "a")]
    assert {r.check: r.findings for r in reports.gate_summary(found.filter("path = 'd'")).collect()} == {"trunk_touched": 0, "low_evidence_high_score": 1, "newness_trunk_adjacent": 0}
    text = writers.gate_markdown([r.asDict() for r in found.collect()], enforce=True)
    assert "**Mode:** enforce" in text and "4 findings across 3 checks" in text and "| `a` | trunk | 0.8000 | nil |" in text
    assert "_No findings._" in writers.gate_markdown([])
    with pytest.raises(writers.GateError):
        writers.gate_rows(spark, "{")


def test_warnings_are_unique_by_code():
    got = reports.normalised_warnings(["git_error", {"code": "x", "message": "m"}, "git_error", {"code": "temporal_coupling_bulk_commits_skipped", "count": 3, "max_commit_files": 50}, "insufficient_dispersion_fan_in", "some_code"])
    assert [w["code"] for w in got] == ["git_error", "x", "temporal_coupling_bulk_commits_skipped", "insufficient_dispersion_fan_in", "some_code"]
    assert got[2]["message"].endswith("(3 skipped; max_commit_files=50)") and "raw fan_in value" in got[3]["message"] and got[4]["message"] == "some code"


@pytest.mark.parametrize("wrong", [{"trunk_threshold": 100}, {"branch_threshold": 85}, {"min_files": 0}, {"top": 0}, {"churn_days": 0}, {"coupling_threshold": 1.1}, {"new_file_days": -1}, {"diff_base": "x", "only_paths": ["a"]}, {"custom_weights": True, "weights": {"fan_in": 0.5, "coverage": 0.0}}])
def test_options_are_checked(wrong):
    with pytest.raises(OptionError):
        Options(**wrong).validate()


def test_weights_text():
    assert parse_weights("fan_in:0.4,fan_out:0.1,complexity:0.3,churn:0.15,coverage:0") == {"interaction": 0.0, "coupling": 0.05, "fan_in": 0.4, "fan_out": 0.1, "complexity": 0.3, "churn": 0.15, "coverage": 0.0}
    for bad in ("fan_in", "fan_in:x", "fan_in:1", "fan_in:2,fan_out:0,complexity:0,churn:0,coverage:0"):
        with pytest.raises(OptionError):
            parse_weights(bad)
    assert (formula(coverage=True, coupling=0.1), formula(coverage=False, coupling=None)) == ("5-factor + coupling", "4-factor")


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "shop"
    source = {"app/models/user.rb": "class User\nend\n", "app/models/post.rb": "class Post\n  belongs_to :user\nend\n"}
    source |= {f"app/services/s{i}.rb": f"class S{i}\n  def call = User.new\nend\n" for i in range(5)} | {"src/hub.js": "1\n", "src/a.js": "1\n", "src/b.ts": "1\n"}
    for name, body in source.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    (tmp_path / "numstat").write_text("5\t1\tapp/models/user.rb\n1\t1\tapp/models/user.rb\n1\t0\tapp/models/post.rb\n")
    (tmp_path / "names").write_text("".join(f"\x1e{i:040x}\n\napp/models/user.rb\napp/models/post.rb\n" for i in range(6)))
    (tmp_path / "status").write_text("\x1e1700000000\n\nM\tapp/models/user.rb\n\x1e1600000000\n\nA\tapp/models/user.rb\nA\tapp/models/post.rb\n")
    (tmp_path / "modules.json").write_text(json.dumps({"modules": [{"source": f"src/{n}", "dependencies": [{"resolved": "src/hub.js"}, {"resolved": "fs"}]} for n in ("a.js", "b.ts")]}))
    (tmp_path / "lcov.info").write_text("SF:app/models/user.rb\nLF:4\nLH:2\nend_of_record\n")
    return tmp_path, root


def flags(tmp_path, root):
    return [str(root), "--numstat", str(tmp_path / "numstat"), "--name-only", str(tmp_path / "names"), "--name-status", str(tmp_path / "status"), "--modules", str(tmp_path / "modules.json"), "--ruby-coverage", str(tmp_path / "lcov.info"), "--as-of", "1700086400"]


def test_scan_from_end_to_end(spark, project, capsys):
    tmp_path, root = project
    assert cli.main(["scan", *flags(tmp_path, root), "--output", "json"]) == 0
    got = json.loads(capsys.readouterr().out)
    rows = {r["path"]: r for r in got["ruby"] + got["javascript"]}
    user = rows["app/models/user.rb"]
    assert (user["rank"], user["class"], user["fan_in"], user["churn_commits"], user["churn_lines"], user["coverage"], user["max_coupling_partner"]) == (1, "trunk", 6, 2, 8, 0.5, "app/models/post.rb")
    assert rows["app/models/post.rb"]["coverage"] == "—" and rows["src/hub.js"]["coverage"] is None and rows["src/hub.js"]["fan_in"] == 2
    assert user["age_days"] == 1158 and user["new_file"] is True and rows["app/services/s0.rb"]["escalation"] == "trunk_adjacent"
    assert {"coverage_partial", "coverage_unavailable", "small_repo", "zero_churn_majority"} <= {w["code"] for w in got["warnings"]}
    assert got["meta"]["formula"] == "5-factor + coupling" and got["meta"]["schema_version"] == 1
    (tmp_path / "report.json").write_text(json.dumps(got))
    assert cli.main(["gate", "--input", str(tmp_path / "report.json"), "--enforce"]) == 1
    assert "trunk_touched" in capsys.readouterr().out


def test_other_outputs(spark, project, capsys):
    tmp_path, root = project
    assert cli.main(["scan", *flags(tmp_path, root), "--output", "markdown", "--top", "1"]) == 0
    text = capsys.readouterr().out
    assert "| 1 | ruby | app/models/user.rb |" in text and "post.rb | 0." not in text
    assert cli.main(["scan", *flags(tmp_path, root), "--output", "csv", "--csv-dir", str(tmp_path / "csv")]) == 0
    lines = next((tmp_path / "csv").glob("part-*.csv")).read_text().splitlines()
    assert lines[0].startswith("rank,language,file,score") and lines[1].startswith("1,ruby,app/models/user.rb,") and len(lines) == 11 and lines[-1].endswith(',""')
    assert cli.main(["edges", "app/models/user.rb", *flags(tmp_path, root)]) == 0
    text = capsys.readouterr().out
    assert "Dependents (6 files)" in text and "1.0000           6  app/models/post.rb" in text
    assert cli.main(["edges", "none.rb", *flags(tmp_path, root)]) == 1
    assert cli.main(["scan", str(root), "--top", "0"]) == 1


def test_diff_of_a_shallow_clone(spark, project, capsys):
    tmp_path, root = project
    assert cli.main(["scan", str(root), "--diff-base", "main"]) == 1
    (tmp_path / "changed").write_text("shop/src/a.js\nother/src/b.ts\n")
    (root / "app/models/bad.rb").write_text("class Bad\n")
    (root / ".git").mkdir()
    (root / ".git/shallow").write_text("x")
    assert cli.main(["scan", *flags(tmp_path, root), "--changed", str(tmp_path / "changed"), "--diff-base", "main", "--log-prefix", "shop/", "--output", "json"]) == 0
    out, err = capsys.readouterr()
    got = json.loads(out)
    assert [r["path"] for r in got["javascript"]] == ["src/a.js"] and not got["ruby"] and got["meta"]["diff_base"] == "main" and got["meta"]["filtered"]
    assert {"fan_in_reference_resolution_failed", "shallow_clone_newness_disabled"} <= {w["code"] for w in got["warnings"]}
    assert "Note: with coverage data" in err and "Warning: " in err


def test_analysis_without_logs(spark):
    files = spark.createDataFrame([("r", f"lib/f{i}.rb", "ruby", "ruby", i, i, f"class F{i}\n  F{(i + 1) % 6}\nend\n".encode()) for i in range(6)], "repo_id string, path string, language string, lang_group string, loc int, ordinal int, content binary")
    report = analyse(Inputs(files=files, ruby=ruby.references(files)), Options(as_of=1))
    rows = results(report.rows).collect()
    assert len(rows) == 6 and all(r["fan_in"] == 1 and r["fan_out"] == 1 and r["evidence"] is None and not r["new_file"] for r in rows)
    assert "insufficient_dispersion_fan_in" in {w["code"] for w in report.warnings}


def test_fractions_have_no_exponent(spark):
    """0.0003 is 3.0E-4 where Spark writes it; what a name holds stays as it is."""
    odd, x = 'a,"loc":3.0E-4', F.col("id") / 10000
    values = {c: F.lit(0.0) for c in writers.RESULT_COLUMNS} | {"file": F.lit(odd), "max_coupling_partner": F.lit(""), "churn_pct": x, "coverage": x, "coverage_status": F.lit("present")}
    for row in spark.range(10_001).select("id", *[v.alias(c) for c, v in values.items()]).select("id", writers.json_line().alias("json"), writers.csv_line().alias("csv")).collect():
        want = repr(row.id / 10000) if row.id >= 10 or not row.id else f"0.000{row.id}"
        assert f'"churn_pct":{want},' in row.json and row.json.endswith(f'"coverage":{want}}}') and row.csv.endswith(f",{want}")
        assert json.loads(row.json)["path"] == odd


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_module_report_has_every_edge(spark):
    """Those between packages, too."""
    got, want = (catalogue.QUERIES[n](spark, "/root/testdata/sf0.001").select("src", "dst").collect() for n in ("module_report", "dep_edges"))
    assert sorted(got) == sorted(want) and any(int(r.src[5:]) // texts.OWN != int(r.dst[5:]) // texts.OWN for r in catalogue.QUERIES["module_report"](spark, "/root/testdata/sf0.01").limit(1000).collect())


def test_tasks_of_large_shuffles_hold_inside_only(spark):
    """As many tasks as are asked for, although few are set; afterwards the settings are what they were."""
    from keelson.sources.kept import dealt

    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(name) for name in names]
    rows = spark.range(2_000_000).selectExpr("id % 900000 AS k", "uuid() AS v").groupBy("k").agg({"v": "max"})
    with dealt(spark, 40) as keep:
        assert len(keep(rows).inputFiles()) > 4
    assert [spark.conf.get(name) for name in names] == before
