import pytest
from pyspark.sql import functions as F

from keelson.operators import history
from keelson.sources import gitlog

NOW = 1_783_684_800  # 2026-07-10 12:00 UTC


def ago(days):
    return NOW - days * 86_400


def log_text(commits):
    """commits: (days ago, [lines]), oldest first."""
    return "".join(f"\x1e{ago(d)}\n\n" + "\n".join(lines) + "\n" for d, lines in reversed(commits))


def touches(path, n):
    return [(80 - i, [f"M\t{path}"]) for i in range(n)]


CASES = {
    "delete then re-add": ([(90, ["A\tapp/r.rb"]), *touches("app/r.rb", 3), (2, ["D\tapp/r.rb"]), (1, ["A\tapp/r.rb"])], "app/r.rb", "", (1, 1)),
    "rename, delete, re-add": ([(90, ["A\ta/c.rb"]), *touches("a/c.rb", 3), (60, ["R100\ta/c.rb\ta/u.rb"]), (30, ["D\ta/u.rb"]), (1, ["A\ta/u.rb"])], "a/u.rb", "", (1, 1)),
    "subdirectory": ([(90, ["A\tapp/models/user.rb"]), *touches("app/models/user.rb", 3)], "models/user.rb", "app/", (4, 90)),
    "rename carries history": ([(90, ["A\ta/o.rb"]), *touches("a/o.rb", 3), (1, ["R100\ta/o.rb\ta/n.rb"])], "a/n.rb", "", (5, 90)),
    "rename inside a subdirectory": ([(90, ["A\tapp/o.rb"]), *touches("app/o.rb", 3), (1, ["R100\tapp/o.rb\tapp/n.rb"])], "n.rb", "app/", (5, 90)),
    "rename from outside": ([(90, ["A\tlib/foo.rb"]), *touches("lib/foo.rb", 3), (1, ["R100\tlib/foo.rb\tapp/models/foo.rb"])], "models/foo.rb", "app/", (5, 90)),
    "earlier delete at the target": (
        [(100, ["A\ta/u.rb"]), (99, ["M\ta/u.rb"]), (90, ["A\ta/c.rb"]), (80, ["M\ta/c.rb"]), (70, ["M\ta/c.rb"]), (65, ["M\ta/c.rb"]), (60, ["D\ta/u.rb"]), (1, ["R100\ta/c.rb\ta/u.rb"])], "a/u.rb", "", (5, 90),
    ),
    "outside path with the same key": ([(90, ["A\tmodels/user.rb"]), *touches("models/user.rb", 3), (1, ["A\tapp/models/user.rb"])], "models/user.rb", "app/", (1, 1)),
    "older root file with the same key": ([(90, ["A\tlib/foo.rb"]), *touches("lib/foo.rb", 3), (1, ["A\tapp/lib/foo.rb"])], "lib/foo.rb", "app/", (1, 1)),
    "chain of renames": ([(90, ["A\ta.rb"]), (50, ["R100\ta.rb\tb.rb"]), (20, ["R090\tb.rb\tc.rb"])], "c.rb", "", (3, 90)),
    "a copy starts anew": ([(90, ["A\ta.rb"]), (5, ["C100\ta.rb\tb.rb"])], "b.rb", "", (1, 5)),
    "no history": ([(90, ["A\ta.rb"])], "z.rb", "", None),
}


@pytest.fixture(scope="module")
def lineages(spark, tmp_path_factory):
    """All cases of a prefix at once, each a repository."""
    out = {}
    for prefix in {case[2] for case in CASES.values()}:
        top, files = tmp_path_factory.mktemp("logs"), []
        for name, (commits, file, own, _) in CASES.items():
            if own == prefix:
                (top / name).mkdir()
                (top / name / "log").write_text(log_text(commits))
                files.append((name, file))
        log = gitlog.name_status(gitlog.read_records(spark, str(top / "*" / "log"), None))
        log = log.withColumn("repo_id", F.url_decode("repo_id"))
        for r in history.lineage(log, spark.createDataFrame(files, "repo_id string, path string"), prefix).collect():
            out[r.repo_id] = (r.total_commits, (NOW - r.first_epoch) // 86_400)
    return out


@pytest.mark.parametrize("name", CASES)
def test_lineage(lineages, name):
    assert lineages.get(name) == CASES[name][3]


def test_metadata_without_history(spark):
    files = spark.createDataFrame([("r", "a"), ("r", "b")], "repo_id string, path string")
    past = spark.createDataFrame([("r", "a", ago(40), 9)], "repo_id string, path string, first_epoch long, total_commits long")
    got = {r.path: (r.age_days, r.total_commits, r.new_file) for r in history.with_history(files, past, ["repo_id", "path"], F.lit(NOW)).collect()}
    assert got == {"a": (40, 9, False), "b": (0, 0, True)}
    got = {r.path: (r.age_days, r.new_file, r.metadata_available) for r in history.with_history(files, past, ["repo_id", "path"], F.lit(NOW), available=False).collect()}
    assert got == {"a": (0, False, False), "b": (0, False, False)}


def read_line_by_line(log, wanted, prefix):
    """log: (seq, epoch, status, old, new) of one repository, newest first. {file: (first epoch, commits)}."""
    alias, gone, seen = {}, set(), {}
    inside = lambda p: p[len(prefix) :] if p.startswith(prefix) else None

    def stands_for(name):
        been = set()
        while name in alias and name not in been:
            been.add(name)
            name = alias[name]
        return name

    for seq, epoch, status, old, new in log:
        own = inside(new)
        now = stands_for(own if own is not None else new) if own is not None or new in alias else None
        if status == "D":
            if now in wanted:
                gone.add(new)
            continue
        if now in wanted and new not in gone:
            seen.setdefault(now, set()).add((seq, epoch))
        if status == "R100" and own is not None and stands_for(own) in wanted and old not in gone and new not in gone:
            alias[inside(old) if inside(old) is not None else old] = stands_for(own)
    return {f: (min(e for _, e in s), len(s)) for f, s in seen.items()}


@pytest.mark.parametrize("prefix", ["", "app/"])
def test_lineage_equals_reading_line_by_line(spark, prefix):
    """Random logs over few names, so that names are reused, renamed in circles, deleted and renamed again; and long chains."""
    import random

    rng = random.Random(len(prefix))
    rows, files, want = [], [], {}
    for repo in range(60):
        names = [p + n for p in ("", "app/") for n in "abcd"[: 2 + repo % 3]]
        log = []
        for seq in range(rng.randint(5, 40)):
            for _ in range(rng.randint(1, 3)):
                status = rng.choice(["A", "M", "D", "R100", "R100", "C100"])
                log.append((seq, 1000 - seq, status, rng.choice(names) if status[0] in "RC" else None, rng.choice(names)))
        if repo % 10 == 0:  # one chain of many renames
            log = [(k, 1000 - k, "R100", f"{prefix}n{k + 1}", f"{prefix}n{k}") for k in range(70)] + log
            names.append(f"{prefix}n0")
        wanted = {n.removeprefix(prefix) for n in names if n.startswith(prefix) and rng.random() < 0.6} | {"n0"}
        rows += [(f"r{repo}", seq, line, epoch, status, old, new) for line, (seq, epoch, status, old, new) in enumerate(log)]
        files += [(f"r{repo}", f) for f in wanted]
        want |= {(f"r{repo}", f): x for f, x in read_line_by_line(log, wanted, prefix).items()}
    frame = spark.createDataFrame(rows, "repo_id string, seq long, line_no int, epoch long, status string, old_path string, path string").repartition(3)
    got = history.lineage(frame, spark.createDataFrame(files, "repo_id string, path string"), prefix).collect()
    assert {(r.repo_id, r.path): (r.first_epoch, r.total_commits) for r in got} == want and len(want) > 60


def test_rows_that_have_come_to_their_end_are_not_written_again(spark):
    """One long chain of renames beside many short ones: its rounds write its own rows only."""
    from keelson.sources.kept import keeper

    rows = [("r", k, 0, k, "R100", f"a/{k + 1}", f"a/{k}") for k in range(64)]
    rows += [("r", 1000 + k, 0, k, "R100", f"b/{k}/1", f"b/{k}/0") for k in range(2000)]
    log = spark.createDataFrame(rows, "repo_id string, seq long, line_no int, epoch long, status string, old_path string, path string")
    files = spark.createDataFrame([("r", "a/0")] + [("r", f"b/{k}/0") for k in range(2000)], "repo_id string, path string")
    write, written = keeper(spark), []
    got = history.lineage(log, files, keep=lambda rows: (written.append((out := write(rows)).count()), out)[1])
    assert {r.path: r.total_commits for r in got.collect()} == {"a/0": 64} | {f"b/{k}/0": 1 for k in range(2000)}
    assert sum(written) < 14 * len(rows), sum(written) / len(rows)
