import json

import pytest
from pyspark.sql import functions as F

from keelson.operators import churn, coupling, quality
from keelson.sources import coverage, files, gitlog, reports, ruby, texts


@pytest.fixture
def known(spark):
    return spark.createDataFrame([("r", p) for p in ("app/a.rb", "app/b.rb", "b.rb", "lib/c.rb")], "repo_id string, path string")


def rates(frame):
    return {r.path: round(r.line_rate, 4) for r in frame.collect()}


def test_resultset_merges_suites_and_matches_the_longest_suffix(spark, tmp_path, known):
    body = {"unit": {"coverage": {"/ci/app/a.rb": {"lines": [1, None, 0, 0]}, "/ci/app/b.rb": [1, 1]}}, "other": {"coverage": {"/ci/app/a.rb": {"lines": [0, None, 3]}}}}
    at = tmp_path / "resultset.json"
    at.write_text(json.dumps(body, indent=1))
    assert rates(coverage.read(spark, str(at), known, "r")) == {"app/a.rb": 0.6667, "app/b.rb": 1.0}
    at.write_text(json.dumps({"coverage": {"lib/c.rb": [0, None]}}))
    assert rates(coverage.read(spark, str(at), known, "r")) == {"lib/c.rb": 0.0}


def test_cobertura_takes_the_last_entry(spark, tmp_path, known):
    at = tmp_path / "c.XML"
    at.write_text('<coverage><packages><package><classes><class filename="./app/a.rb" line-rate="0.25"/><class filename="app/a.rb" line-rate="0.5"/><class filename="x.rb" line-rate="1"/></classes></package></packages></coverage>')
    assert rates(coverage.read(spark, str(at), known, "r")) == {"app/a.rb": 0.5}
    at.write_text("<coverage><!-- <class filename='app/b.rb' line-rate='1'/> --><class name='a>b' line-rate='0.75'\n filename='app/a.rb'/></coverage>")
    assert rates(coverage.read(spark, str(at), known, "r")) == {"app/a.rb": 0.75}
    at.write_text("<coverage/>")
    with pytest.raises(coverage.CoverageError):
        coverage.read(spark, str(at), known, "r")
    at.write_text('<coverage><class filename="app/a.rb" line-rate="1.5"/></coverage>')
    with pytest.raises(Exception, match="line-rate"):
        coverage.read(spark, str(at), known, "r").collect()


def test_lcov_counts_or_lines(spark, tmp_path, known):
    at = tmp_path / "lcov.info"
    at.write_text("TN:\nSF:/ci/app/a.rb\nDA:1,1\nLF:5\nLH:4\nend_of_record\nSF:lib/c.rb\nDA:1,0\nDA:2,7\nend_of_record\n")
    assert rates(coverage.read(spark, str(at), known, "r")) == {"app/a.rb": 0.8, "lib/c.rb": 0.5}
    at.write_text("SF:app/a.rb\nLF:1\nLH:2\nend_of_record\n")
    with pytest.raises(Exception, match="more lines hit"):
        coverage.read(spark, str(at), known, "r").collect()
    with pytest.raises(coverage.CoverageError):
        coverage.read(spark, "x.txt", known, "r")


def test_numstat_and_zero_inflation(spark, tmp_path):
    at = tmp_path / "numstat"
    at.write_text("3\t1\tapp/{models => services}/t.rb\n-\t-\tapp/a b.rb\n2\t2\told.rb => new.rb\n1\t0\tnew.rb\n\n")
    changes = gitlog.numstat(gitlog.read_lines(spark, str(at), "r"))
    known = spark.createDataFrame([("r", p) for p in ("app/services/t.rb", "app/a b.rb", "new.rb", "x.rb", "y.rb", "z.rb", "w.rb")], "repo_id string, path string")
    counted = churn.counts(known, changes, ["repo_id", "path"])
    assert {r.path: (r.churn_commits, r.churn_lines) for r in counted.collect() if r.churn_commits} == {"app/services/t.rb": (1, 4), "app/a b.rb": (1, 0), "new.rb": (2, 5)}
    row = churn.zero_inflation(counted, "repo_id").first()
    assert (row.zero_percentage, row.zero_inflated) == (57, True)


def test_coupling_counts_small_commits_and_skips_bulk(spark, tmp_path):
    log, sha = [], lambda i: f"{i:040x}"
    for i, paths in enumerate([["a", "b"]] * 3 + [["a"]] + [["b", "b", "c"]] + [["a", "b", "c", "d", "e"]]):
        log.append("\x1e" + sha(i) + "\n\n" + "\n".join(paths) + "\n")
    at = tmp_path / "names"
    at.write_text("".join(log))
    grouped = coupling.commits(gitlog.name_only(gitlog.read_records(spark, str(at), "r")))
    kept, bulk = coupling.bulk_filter(grouped, 4)
    assert bulk.count() == 1
    got = {(r.path, r.partner): (r.coupling, r.co_changes, r.own_changes) for r in coupling.pairs(kept, threshold=0.3, min_commits=3).collect()}
    assert got == {("a", "b"): (0.75, 3, 4), ("b", "a"): (0.75, 3, 4)}
    assert coupling.pairs(kept, threshold=0.8, min_commits=3).count() == 0
    top = {r.path: (r.max_coupling_partner, r.coupling_partners) for r in coupling.top_partner(coupling.pairs(kept, threshold=0.0, min_commits=1)).collect()}
    assert top == {"a": ("b", 1), "b": ("c", 2), "c": ("b", 1)}


def test_lint_and_module_reports(spark, tmp_path):
    lint = tmp_path / "lint.json"
    lint.write_text(json.dumps({"files": [{"path": "a.rb", "offenses": [{"cop_name": "Metrics/CyclomaticComplexity", "message": "too high. [7/0]"}, {"cop_name": "M", "message": "x [3/0]"}]}, {"path": "b.rb", "offenses": []}, {"path": "c.rb", "offenses": [{"cop_name": "Lint/Syntax", "message": "unexpected", "severity": "fatal"}]}]}))
    messages = reports.ruby_lint(texts.whole(spark, str(lint), "r"))
    known = spark.createDataFrame([("r", p) for p in ("a.rb", "b.rb", "d.rb")], "repo_id string, path string")
    got = {r.path: r.complexity for r in quality.max_complexity(known, messages, quality.RUBY_MESSAGE, ["repo_id", "path"]).collect()}
    assert got == {"a.rb": 7, "b.rb": 0, "d.rb": 0}
    assert [r.path for r in messages.filter("skipped").collect()] == ["c.rb"]
    js = tmp_path / "js.json"
    js.write_text(json.dumps([{"filePath": "/w/src/a.js", "messages": [{"message": "Function has a complexity of 4."}, {"message": "Method has a complexity of 9."}]}]))
    got = quality.max_complexity(spark.createDataFrame([("r", "src/a.js")], "repo_id string, path string"), reports.js_lint(texts.whole(spark, str(js), "r"), "/w"), quality.JS_MESSAGE, ["repo_id", "path"]).first()
    assert got.complexity == 9
    deps = tmp_path / "deps.json"
    deps.write_text(json.dumps({"modules": [{"source": "src/a.js", "dependencies": [{"resolved": "src/h.js"}, {"resolved": "src/h.js"}, {"resolved": "src/a.js"}]}, {"source": "src/h.js", "dependencies": []}]}))
    assert reports.modules(texts.whole(spark, str(deps), "r")).count() == 3


def test_collector(spark, tmp_path):
    made = {"app/a.rb": b"x\n\n# c\n", "spec/a_spec.rb": b"x", ".hidden/b.ts": b"1", ".hidden/_deep/.er/x y%+.rb": b"", "app/_under.rb": b"a", "lib/.dot.js": b"b", "we [ird] {a}/c.rb": b"", "gen.rb": b"\n# This file is auto-generated from x\n", "src/c.tsx": b"\xff\xfe", "src/d.min.js": b"", "README.md": b"", "skip/e.js": b"1\n2", "A.RB": b""}
    for name, body in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    kept, counts = files.collect(files.scanned(spark, str(tmp_path), "r"), ["skip/**"])
    got = {r.path: (r.language, r.lang_group, r["loc"]) for r in kept.collect()}
    assert got == {"app/a.rb": ("ruby", "ruby", 2), ".hidden/b.ts": ("typescript", "javascript", 1), "src/c.tsx": ("typescript", "javascript", 0), ".hidden/_deep/.er/x y%+.rb": ("ruby", "ruby", 0), "app/_under.rb": ("ruby", "ruby", 1), "lib/.dot.js": ("javascript", "javascript", 1), "we [ird] {a}/c.rb": ("ruby", "ruby", 0)}
    assert tuple(counts.select("default_excluded", "custom_excluded").first()) == (2, 1)
    with pytest.raises(files.PopulationError):
        files.require_population(kept.limit(4))


SOURCE = b'''
module Admin
  class User < Base::Record
    belongs_to :account
    has_many :line_items, class_name: "Shop::Item", dependent: :destroy
    has_many :categories
    has_one :dynamic, class_name: NAMES[0]
    belongs_to :thing, polymorphic: true
    belongs_to :plain, polymorphic: false
    with_options(optional: true) do
      has_one :profile
    end
    scope :x, -> { joins(Plan) if Plan }
    items.each do
      has_one :ignored
    end
    others.each { has_one :ignored_too }
    included { has_one :kept }
    def short(x) = x.to_s
    def call
      return Plan unless x > 1
      y = if Billing::Plan.active? then 1 else 2 end
      "#{z("Nested::Text")} #{Within.new("#{Inmost::One}")} \\#{Not}".strip
      v = y.z ? if a then Chosen end : [*if b then Listed end]
      puts %W[#{Worded} Plain], /a#{Matched}/ unless Guard
      "Foo::Bar".constantize
      Object.new
      Kernel.const_get(:X)
      while y do break end
      <<~SQL
        SELECT Fake FROM Other #{Table.name}
      SQL
      y =~ /Regex::Const/
      ::Top::Level
    end
    class << self
      def inner; Deep; end
    end
  end
end
'''


def test_ruby_references():
    primary, refs, parsed = ruby.extract(SOURCE)
    assert parsed and primary == "Admin"
    body = ("Admin", "User")
    got = {(tuple(n), name, a) for n, name, a in refs}
    want = {(("Admin",), "Base::Record", False), (("Admin",), "User", False), ((), "Admin", False)}
    want |= {(body, n, False) for n in ("Account", "Shop::Item", "Category", "Plain", "Profile", "Plan", "Billing::Plan", "Object", "Kernel", "Deep", "NAMES", "Within", "Inmost::One", "Chosen", "Listed", "Worded", "Matched", "Guard", "Table", "Kept")}
    want |= {(body, "Foo::Bar", True), (body, "Top::Level", True)}
    assert got == want
    assert not any(name == "Account" for _, name, _ in ruby.extract(SOURCE, rails=False)[1])


# a source and the names that it refers to
RUBY = {
    b'w = %Q{#{Real} end}\n': "Real", b"%q|class Foo end|\n": "", b"W = %Q<#{Real} end>\n": "Real", b"%w(a (b) c).each do |x| Foo end\n%r{a/#{B}}x =~ C\n%x(ls #{D})\n%s(e)\n": "Foo B C D",
    b"class A; X = %w[a]; end\n": "A", b"A::B = 1\nC ||= D\nE, F = G, H\n": "A D G H", b"x = 1..MAX\n3.times { Foo }\n": "MAX Foo", b'Integer("3")\nFoo::Bar(1)\nRational 1, 2\n': "Foo",
    b"f(Foo: 1, bar: Baz)\n": "Baz", b"a = $'\nb = Foo\n": "Foo", b"class A < Struct.new(:x)\n Y\nend\n": "A Struct Y", b"foo /a#{B}/, C\nx / y / D\n": "B C D", b"a = b ? C : D\n": "C D",
    b"def x=(v)\n  @x = Foo\nend\ndef y = Bar\ndef self.z(a) = Baz.new(a)\ndef ==(o)\n  Q\nend\ndef []=(k,v)\n S\nend\n": "Foo Bar Baz Q S", b"while x do Foo end\nfor a in B do C end\nuntil D\n E\nend\nbegin\n F\nend while G\n": "Foo B C D E F G",
    b"x = <<~A + <<-B\n #{Foo}\nA\n #{Bar} end\n  B\nBaz\n": "Foo Bar Baz", b"case x\nin Foo(a:) then Bar\nin {b: Baz}\n Q\nend\n": "Foo Bar Baz Q", b"return if Foo\nraise Bar unless Baz\n": "Foo Bar Baz",
    b"def class; A; end\nx.class.end\n": "A", b"=begin\nFoo\n=end\nBar\n__END__\nBaz\n": "Bar", b'"#{a ? "x#{B}" : \'}\'}" + C\n': "B C", b"p ?a, ?\\n, Foo\nx ? ?a : Bar\n": "Foo Bar", b"foo::Bar\nFoo::baz\n": "Foo", b"def Foo.bar; end\nalias end x\n": "Foo",
}


@pytest.mark.parametrize("source", RUBY)
def test_ruby_literals_and_constants(source):
    _, refs, parsed = ruby.extract(source, rails=False)
    assert parsed and {name for _, name, _ in refs} == set(RUBY[source].split())


def test_ruby_scopes_of_superclasses():
    refs = ruby.extract(b"module M\n class A < B; end\n class C < D.new(E); end\nend\n")[1]
    assert {(tuple(n), name) for n, name, _ in refs} == {((), "M"), (("M",), "A"), (("M",), "B"), (("M",), "C"), (("M", "C"), "D"), (("M", "C"), "E")}


def test_ruby_blocks_of_class_bodies():
    refs = ruby.extract(b"class A\n  concern.included do\n    has_one :b\n  end\n  list.each do\n    has_one :c\n  end\n  x = with_options(y) do |z|\n    has_one :d\n  end\n  self.has_many :es\n  z.has_one :f\n  'G'&.constantize\nend\n")[1]
    assert {name for _, name, _ in refs} == {"A", "B", "D", "E"}


@pytest.mark.parametrize("source", [b"end\n", b'x = "a\n', b"foo(\n", b"if x\n", b"x = <<~A\n b\n", b")\n", b"def a\n  if x\nend\n", b"%w[a\n", b"(]\n"])
def test_ruby_that_is_refused(source):
    assert ruby.extract(source) == (None, [], False)


def test_ruby_rows(spark):
    files = spark.createDataFrame([("r", "a.rb", b"class A; B; end"), ("r", "b.rb", b""), ("r", "c.rb", b"class"), ("r", "d.rb", None), ("r", "e.rb", b"end")], "repo_id string, path string, content binary")
    got = sorted((r.path, r.primary or "", r.name or "", r.parsed) for r in ruby.references(files).collect())
    assert got == [("a.rb", "A", "A", True), ("a.rb", "A", "B", True), ("b.rb", "", "", True), ("c.rb", "", "", True), ("d.rb", "", "", True), ("e.rb", "", "", False)]


@pytest.mark.parametrize("blank", ["\t\n", "\r\n", " \x0b\n\f\n", ""])
def test_blank_lines_before_a_generated_files_note(spark, blank):
    from keelson.operators.quality import is_generated

    made = spark.createDataFrame([(f"{blank}# This file is auto-generated",)], "text string")
    assert made.select(is_generated(made.text)).first()[0]


def test_ruby_compact_names_and_bad_sources():
    assert ruby.extract(b"class A::B::C\n  X\nend\n")[:2] == ("A::B::C", [([], "A::B::C", False), (["A::B::C"], "X", False)])
    assert ruby.extract(b"class A\n")[2] is False
    assert ruby.extract(b"\xff")[2] is False
    assert ruby.extract(None) == (None, [], True)


def test_records_of_many_repositories_keep_their_order(spark, tmp_path):
    for repo, n in (("one", 300), ("two", 7)):
        (tmp_path / repo).mkdir()
        (tmp_path / repo / "log").write_text("".join(f"\x1e{1000 - i}\n\nM\tf{i}\nT\tlink\n" for i in range(n)))
    rows = gitlog.name_status(gitlog.read_records(spark, str(tmp_path / "*" / "log"), None)).collect()
    assert sorted((r.repo_id, r.seq, r.epoch, r.path) for r in rows) == [(repo, i, 1000 - i, f"f{i}") for repo, n in (("one", 300), ("two", 7)) for i in range(n)]


def test_commits_are_carried_down_over_splits(spark, tmp_path):
    (tmp_path / "r").mkdir()
    want, text = [], "stray\n"
    for k in range(400):
        sha = f"{k:040x}"
        text += sha + "\n\n" + "".join(f"f{k}_{i}\n" for i in range(k % 4 * 9))
        want += [(sha, f"f{k}_{i}") for i in range(k % 4 * 9)]
    (tmp_path / "r" / "log").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        lines = texts.lines(spark, str(tmp_path / "*" / "log"), None)
        assert lines.rdd.getNumPartitions() > 20
        assert sorted((r.commit, r.path) for r in gitlog.name_only_lines(lines).collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_constants_of_paths_equal_plain_code(spark):
    """Random folders in any order; and the path is split once, however deep the expression is."""
    import random
    import re

    from keelson.functions import paths

    def constant(path):
        parts = path.split("/")
        found = [parts.index(r) for r in ("app", "lib", "test") if r in parts]
        if not found:
            return None
        rest = parts[min(found) + (2 if parts[min(found)] == "app" else 1) :]
        rest = [p for p in rest[rest.index("concerns") + 1 if "concerns" in rest else 0 :] if p != "concerns"]
        rest[-1:] = [re.sub(r"\.rb$", "", p) for p in rest[-1:]]
        name = "::".join("".join(w[:1].upper() + w[1:].lower() for w in p.split("_")) for p in rest)
        return name if re.fullmatch(r"[A-Z]\w*(::[A-Z]\w*)*", name, re.A) else None

    rng = random.Random(3)
    made = ["/".join(rng.choice(["app", "lib", "test", "models", "concerns", "a_b", "x.rb", "1a", "", "tEST_q"]) for _ in range(rng.randint(1, 6))) + rng.choice(["", ".rb"]) for _ in range(3000)]
    rows = spark.createDataFrame([(p,) for p in made], "path string").select("path", paths.path_constant(F.col("path")).alias("constant")).collect()
    assert {r.path: r.constant for r in rows} == {p: constant(p) for p in made} and sum(r.constant is not None for r in rows) > 300
    assert str(paths.path_constant(F.col("path"))).count("split(path") == 1


def test_folders_of_files(spark):
    """The same as by one expression, which searched from each place of a path, for each line of a file."""
    made = ["file:/a/repo_id=r1/part.txt", "file:///tmp/x/r 2/log", "s3://b/repo_id=/log", "file:/x.txt", "/a/repo_id=repo_id=q/f"]
    old = F.regexp_extract("path", r"(?:repo_id=)?([^/]+)/[^/]+$", 1)
    rows = spark.createDataFrame([(p,) for p in made], "path string").select("path", texts.folder(F.col("path")).alias("got"), old.alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] and len(rows) == 5


def test_ruby_source_takes_time_by_its_length():
    """Long lines, macros without end and interpolations in one heredoc: no search or copy from each place of the file."""
    import time

    n = 30_000
    texts = ["X = [" + "A::B, " * n + "]\n", "class A\n" + "belongs_to :b\n" * n + "end\n", "x = <<~T\n" + "#{A}\n" * n + "T\n"]
    start = time.process_time()
    found = [ruby.extract(text.encode()) for text in texts]
    assert time.process_time() - start < 15  # the first alone takes minutes if each constant looks for the beginning of its line
    assert [parsed for _, _, parsed in found] == [True] * 3
    assert found[0][1] == [([], "A::B", False)] and (["A"], "B", False) in found[1][1] and found[2][1] == [([], "A", False)]
