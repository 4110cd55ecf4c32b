"""Commit graphs against git itself."""

import os
import random
import shutil
import subprocess

import pytest

from keelson.operators import commits
from keelson.plans import texts
from keelson.sources import gitlog


def git(at, *args, **env):
    return subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", "-c", "commit.gpgsign=false", "-C", str(at), *args], capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(at), **env}).stdout


def history(at, seed):
    """Three branches that change, delete, restore and merge files, criss-cross included."""
    rng, names = random.Random(seed), [f"d{k % 3}/f {k}.rb" for k in range(12)]
    at.mkdir()
    git(at, "init", "-q", "-b", "main")
    (at / "d0").mkdir()
    (at / "d0/first").write_text("x")
    git(at, "add", "-A")
    git(at, "commit", "-qm", "first")
    branches = ["main"]
    for n in range(45):
        when = f"{1_700_000_000 + n * 60} +0000"
        git(at, "checkout", "-q", rng.choice(branches))
        if len(branches) < 3 and rng.random() < 0.3:
            branches.append(f"b{len(branches)}")
            git(at, "checkout", "-q", "-b", branches[-1])
        if rng.random() < 0.25 and len(branches) > 1:
            git(at, "merge", "-q", "--no-ff", "-X", "ours", "-m", "m", rng.choice(branches), GIT_COMMITTER_DATE=when) if not broken(at, rng.choice(branches)) else None
        for name in rng.sample(names, 2):
            path = at / name
            path.parent.mkdir(exist_ok=True)
            if path.exists() and rng.random() < 0.2:
                path.unlink()
            else:
                path.write_text(f"{name}\n" * 9 + rng.choice(["one\n", "two\n", "three\n"]))
        git(at, "add", "-A")
        git(at, "commit", "-qm", "c", "--allow-empty", GIT_COMMITTER_DATE=when)
    git(at, "checkout", "-q", branches[-1])
    return branches


def broken(at, branch):
    """Whether a merge would stop at a conflict."""
    done = subprocess.run(["git", "-C", str(at), "merge-tree", "--write-tree", "-X", "ours", "HEAD", branch], capture_output=True)
    return done.returncode != 0


@pytest.mark.skipif(not shutil.which("git"), reason="needs git to compare with")
def test_changed_paths_equal_gits(spark, tmp_path):
    made = {}
    for seed in range(2):
        at = tmp_path / f"r{seed}"
        try:
            made[at.name] = history(at, seed)
        except subprocess.CalledProcessError as e:
            pytest.skip(f"this git lacks something: {e.stderr}")
        (tmp_path / f"log{seed}").mkdir()
        (tmp_path / f"log{seed}" / "log").write_text(git(at, *gitlog.GRAPH.split(" ")[1:]))
    for seed, (name, branches) in enumerate(made.items()):
        graph, changes = gitlog.graph(gitlog.read_records(spark, str(tmp_path / f"log{seed}"), name))
        held = commits.Graph(graph)
        for base in branches[:2]:
            want = set(git(tmp_path / name, "-c", "core.quotePath=false", "diff", "--name-only", "--diff-filter=d", f"{base}...HEAD").splitlines())
            bases = git(tmp_path / name, "merge-base", "--all", base, "HEAD").split()
            found = held.merge_base(held.named(base), held.named("HEAD")).collect()
            assert [r.sha in bases for r in found] == [True]
            if len(bases) == 1:
                got = {r.path for r in held.changed(changes, held.named(base), held.named("HEAD")).collect()}
                assert got == want


def test_refs_that_are_nowhere_and_no_common_ancestor(spark):
    rows = [("r", "a" * 40, [], 1, ["main"]), ("r", "b" * 40, [], 2, ["HEAD", "topic"]), ("r", "c" * 40, ["d" * 40], 3, [])]
    graph = spark.createDataFrame(rows, "repo_id string, sha string, parents array<string>, epoch long, refs array<string>")
    changes = spark.createDataFrame([("r", "a" * 40, "x", "0", "1")], "repo_id string, sha string, path string, old string, new string")
    with pytest.raises(commits.RefError):
        commits.changed_paths(graph, changes, "gone")
    assert commits.changed_paths(graph, changes, "main").collect() == []
    assert [r.sha[0] for r in commits.Graph(graph).named("bbbb").collect()] == ["b"]


def test_a_long_line_is_written_a_few_times_only(spark, monkeypatch):
    """Runs in blocks, whatever the times: equals a walk commit by commit, and rows written grow with the commits, not with their doublings."""
    import pyspark.sql.functions as F
    from keelson.sources.kept import keeper

    monkeypatch.setattr(commits, "BLOCK", 64)
    rng, n = random.Random(5), 1500
    parents = {0: []}
    for k in range(1, n):
        first = max(0, k - 1 - (rng.random() < 0.03) * rng.choice((1, 2)))
        parents[k] = [first, *({rng.randrange(k)} - {first} if rng.random() < 0.02 else ())]
    for times in ("order", "random"):
        epoch = {"order": lambda k: k, "random": lambda k: rng.randrange(10)}[times]
        rows = [("r", f"{k:040x}", [f"{p:040x}" for p in up], epoch(k), ["HEAD"] if k == n - 1 else ["main"] if k == n - 2 else []) for k, up in parents.items()]
        made = spark.createDataFrame(rows, "repo_id string, sha string, parents array<string>, epoch long, refs array<string>")
        write, written = keeper(spark), []
        graph = commits.Graph(made, lambda rows: (written.append((out := write(rows)).count()), out)[1])
        if times == "order":
            assert sum(written) < 4 * n  # a table of all commits in each doubling: 12 * n
        seen, todo = set(), [n - 1]
        while todo:
            if (k := todo.pop()) not in seen:
                seen.add(k)
                todo += parents[k]
        start = graph.placed(graph.named("HEAD").withColumn("side", F.lit("head")))
        inside = graph.ancestors(start).withColumnRenamed("pos", "most").join(graph.commits, ["repo_id", "run"]).filter("pos <= most")
        assert {int(r.sha, 16) for r in inside.select("sha").collect()} == seen
        depth = {0: 0}
        for k in range(1, n):
            depth[k] = depth[parents[k][0]] + 1
        told = graph.commits.join(graph.depth, ["repo_id", "run"]).select("sha", (F.col("depth") + F.col("pos")).alias("d")).collect()
        assert {int(r.sha, 16): r.d for r in told} == depth


def test_paths_of_a_commit_in_several_records(spark):
    """They are the same changes, and the commit stays one."""
    a, b, c = "a" * 40, "b" * 40, "c" * 40
    paths = [f":100644 100644 {'0' * 39}{k} {'1' * 39}{k} M\tx {k}" for k in range(6)]
    head, last = f"{a}\x1f{b} {c}\x1f5\x1fHEAD -> main", f"{b}\x1f\x1f4\x1f\n\n{paths[0]}\n"
    whole = [("r", "\n".join([head, "", *paths, ""])), ("r", last)]
    pieces = [("r", f"{a}\n\n{paths[0]}\n{paths[1]}\n"), ("r", f"{head}\n\n\n"), ("r", last), ("r", f"{a}\n\n" + "\n".join(paths[2:])), ("r", f"nothing\n\n{paths[0]}\n")]
    one, more = ([sorted(map(tuple, x.collect())) for x in gitlog.graph(spark.createDataFrame(rows, "repo_id string, value string"))] for rows in (whole, pieces))
    assert one == more and [len(x) for x in one] == [2, 7]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_no_record_holds_all_paths_of_the_merge(spark):
    """They grow with the table of parts."""
    records = [r.value for r in texts._branches(spark, "/root/testdata/sf0.01").collect()]
    merge, = {x.split("\x1f")[0] for x in records if x.count("\x1f") == 3 and " " in x.split("\x1f")[1]}
    own = [x for x in records if x.startswith(merge)]
    assert sum(x.count("\tpart/") for x in own) > 1000 and len(own) > 10 and max(x.count("\tpart/") for x in own) <= texts.LINES
    assert sum(x.count("\x1f") == 3 for x in records) == spark.read.parquet("/root/testdata/sf0.01/orders.parquet").count()
