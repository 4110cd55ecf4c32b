"""Registered queries of the sources and sinks: reports and logs are written out from the tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import paths
from ..functions.numbers import percentile
from ..operators import commits, graph, history, quality, reports
from ..sources import coverage, files, gitlog, ruby, texts
from ..sources import reports as tools
from ..sources.kept import dealt, keeper, shared
from . import tables as t
from . import twins as q
from . import writers
from .analysis import RESULT_COLUMNS, ROUNDED, results
from .catalogue import GROUP, HITS_SQL, LOC_SQL, _hits, _ranked, query



def key():
    return F.col("p_partkey")


#: So many parts make a repository: their number grows with the table.
OWN = 500
REPO_SQL = f"'r' || p_partkey // {OWN}"


def repo(number=None):
    """Of a part, or of another number."""
    return F.concat(F.lit("r"), F.floor((key() if number is None else number) / OWN).cast("long"))


def _parts(spark, sf_dir):
    return t.table(spark, sf_dir, "part").select("p_partkey", "p_size", repo().alias("repo"))


def _joined(rows, line, separator: str, key: str = "p_partkey", repo: str = "repo"):
    """A text for each repository: the lines of its rows in the order of their key."""
    held = rows.groupBy(F.col(repo).alias("repo_id")).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("line")))).alias("held"))
    return held.select("repo_id", F.array_join(F.col("held.line"), separator).alias("value"))


def _files(spark, sf_dir):
    return _parts(spark, sf_dir).select(F.col("repo").alias("repo_id"), F.concat(F.lit("part/"), key()).alias("path"))


def _written(texts):
    """Writes each repository's text to a file in a folder of its own, below a shared one; the pattern of these files."""
    top = shared(texts.sparkSession)
    texts.select("repo_id", "value").repartition("repo_id").write.partitionBy("repo_id").text(top)
    return f"{top}/*/*.txt"


# ---- logs


@query("""SELECT 'part/' || l_partkey AS path, count(*) AS changes, count(*) FILTER (l_linenumber % 7 = 0) AS binaries, sum(CASE WHEN l_linenumber % 7 <> 0 THEN l_quantity::BIGINT + l_linenumber END)::BIGINT AS lines
FROM lineitem GROUP BY l_partkey""")
def numstat_log(spark, sf_dir):
    name = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("part/{old => "), "l_partkey", F.lit("}"))).when(F.col("l_suppkey") % 3 == 1, F.concat(F.lit("was.rb => part/"), "l_partkey")).otherwise(F.concat(F.lit("./part/"), "l_partkey"))
    binary = F.col("l_linenumber") % 7 == 0
    number = lambda c: F.when(binary, "-").otherwise(c.cast("long").cast("string"))
    lines = t.table(spark, sf_dir, "lineitem").select(F.lit(t.REPO).alias("repo_id"), F.concat_ws("\t", number(F.col("l_quantity")), number(F.col("l_linenumber")), name).alias("value"))
    lines = lines.unionByName(spark.createDataFrame([(t.REPO, ""), (t.REPO, "no tabs")], "repo_id string, value string"))
    read = gitlog.numstat(lines)
    return read.groupBy("path").agg(F.count(F.lit(1)).alias("changes"), F.count_if(F.col("added").isNull()).alias("binaries"), F.sum(F.col("added") + F.col("deleted")).cast("long").alias("lines"))


def _orders(spark, sf_dir, line, *head):
    lines = t.table(spark, sf_dir, "lineitem")
    held = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("line")))).alias("held"))
    return held.select(F.lit(t.REPO).alias("repo_id"), F.col("l_orderkey").cast("long").alias("seq"), F.concat_ws("\n", *head, F.lit(""), F.array_join("held.line", "\n"), F.lit("")).alias("value"))


@query("SELECT md5(l_orderkey::VARCHAR) || '00000000' AS commit, 'part/' || l_partkey AS path FROM lineitem WHERE l_orderkey % 5 <> 0")
def name_only_log(spark, sf_dir):
    sha = F.when(F.col("l_orderkey") % 5 == 0, "not a commit").otherwise(F.concat(F.md5(F.col("l_orderkey").cast("string")), F.lit("00000000")))
    return gitlog.name_only(_orders(spark, sf_dir, F.concat(F.lit("part/"), "l_partkey"), sha)).select("commit", "path")


@query("SELECT 'r' || l_orderkey // 5000 AS repo_id, md5(l_orderkey::VARCHAR) || '00000000' AS commit, 'part/' || l_partkey AS path FROM lineitem")
def carry_forward_log(spark, sf_dir):
    """Logs without separators, of a repository for each 5,000 keys of orders; each begins with a path of no commit."""
    logged = _orders(spark, sf_dir, F.concat(F.lit("part/"), "l_partkey"), F.concat(F.md5(F.col("l_orderkey").cast("string")), F.lit("00000000")))
    logged = logged.select(F.concat(F.lit("r"), F.floor(F.col("seq") / 5000).cast("long")).alias("repo_id"), "seq", "value")
    whole = logged.groupBy("repo_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("seq", "value")))["value"], "\n").alias("value"))
    return gitlog.name_only_lines(texts.lines(spark, _written(whole.withColumn("value", F.concat(F.lit("stray\n"), "value"))), None))


@query("""SELECT l_orderkey::BIGINT AS seq, l_orderkey::BIGINT * 100 AS epoch, CASE l_linenumber % 5 WHEN 0 THEN 'R090' WHEN 1 THEN 'A' WHEN 2 THEN 'D' ELSE 'M' END AS status,
  CASE WHEN l_linenumber % 5 = 0 THEN 'old/' || l_suppkey END AS old_path, 'part/' || l_partkey AS path FROM lineitem WHERE l_linenumber % 5 <> 4""")
def name_status_log(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("R090", "A", "D", "M", "T")]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    line = F.concat_ws("\t", kind, F.when(F.col("l_linenumber") % 5 == 0, F.concat(F.lit("old/"), "l_suppkey")), F.concat(F.lit("part/"), "l_partkey"))
    return gitlog.name_status(_orders(spark, sf_dir, line, (F.col("l_orderkey") * 100).cast("string"))).select("seq", "epoch", "status", "old_path", "path")


# ---- coverage


@query(f"""WITH {HITS_SQL}, merged AS (SELECT user_id, h, max(hit) AS hit FROM cells GROUP BY ALL)
SELECT 'u/' || user_id AS path, CASE WHEN count(hit) > 0 THEN count(*) FILTER (hit > 0)::DOUBLE / count(hit)::DOUBLE ELSE 0::DOUBLE END AS line_rate FROM merged GROUP BY user_id""")
def resultset_report(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    lines = F.when(F.col("event_type") == "click", F.to_json(F.struct(F.col("hits").alias("lines")))).otherwise(F.to_json("hits"))
    entry = F.concat(F.lit('"/ci/u/'), "user_id", F.lit('": '), lines)
    suites = hits.groupBy(repo(F.col("user_id")).alias("repo_id"), "event_type").agg(F.array_join(F.collect_list(entry), ", ").alias("body"))
    texts = suites.select("repo_id", F.concat(F.lit('{"'), "event_type", F.lit('": {"coverage": {'), "body", F.lit("}}}")).alias("value"))
    known = hits.select(repo(F.col("user_id")).alias("repo_id"), F.concat(F.lit("u/"), "user_id").alias("path")).distinct()
    return coverage.resultset(texts, known).select("path", "line_rate")


@query(f"SELECT {REPO_SQL} AS repo_id, 'part/' || p_partkey AS path, (p_partkey % 100)::DOUBLE / 100::DOUBLE AS line_rate FROM part WHERE p_partkey % 9 <> 0")
def cobertura_report(spark, sf_dir):
    rate = ((key() % 100) / F.lit(100.0)).cast("string")
    tag = lambda name, r: F.concat(F.lit('<class name="a&gt;b" filename="'), name, F.lit('"\n line-rate="'), r, F.lit('" complexity="1"><lines><line number="1"/></lines></class>'))
    name = F.concat(F.lit("part/"), key())
    line = F.when(key() % 9 == 0, F.concat(F.lit("<!--"), tag(name, rate), F.lit("-->"))).when(key() % 4 == 0, F.concat(tag(F.concat(F.lit("./"), name), F.lit("0.999")), tag(name, rate))).otherwise(tag(name, rate))
    texts = _joined(_parts(spark, sf_dir), line, "\n").withColumn("value", F.concat(F.lit("<?xml version='1.0'?><coverage><classes>"), "value", F.lit("</classes></coverage>")))
    return coverage.cobertura(coverage.xml_classes(spark, _written(texts), None), _files(spark, sf_dir))


@query(f"""SELECT {REPO_SQL} AS repo_id, 'part/' || p_partkey AS path, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 10)::DOUBLE / (10 + p_partkey % 5)::DOUBLE ELSE (CASE WHEN p_partkey % 3 > 0 THEN 1 ELSE 0 END)::DOUBLE / 2::DOUBLE END AS line_rate FROM part""")
def lcov_report(spark, sf_dir):
    counts = F.concat(F.lit("\nDA:1,1\nLF:"), 10 + key() % 5, F.lit("\nLH:"), key() % 10)
    line = F.concat(F.lit("TN:\nSF:/ci/part/"), key(), F.when(key() % 2 == 0, counts).otherwise(F.concat(F.lit("\nDA:1,0\nDA:2,"), key() % 3)), F.lit("\nend_of_record"))
    return coverage.lcov(coverage.lcov_records(spark, _written(_joined(_parts(spark, sf_dir), line, "\n")), None), _files(spark, sf_dir))


# ---- lint and dependencies


@query("""SELECT 'part/' || p_partkey AS path, CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE greatest(p_size, p_partkey % 30) END::INT AS complexity, p_partkey % 11 = 0 AS skipped FROM part""")
def ruby_lint_report(spark, sf_dir):
    messages, known = _ruby_messages(spark, sf_dir)
    scored = quality.max_complexity(known, messages, quality.RUBY_MESSAGE, ["repo_id", "path"])
    skipped = messages.groupBy("repo_id", "path").agg(F.bool_or("skipped").alias("skipped"))
    return scored.join(skipped, ["repo_id", "path"]).select("path", F.col("complexity").cast("int").alias("complexity"), "skipped")


@query(f"SELECT {REPO_SQL} AS repo_id, 'part/' || p_partkey AS path FROM part WHERE p_partkey % 11 <> 0")
def files_readable(spark, sf_dir):
    """Files whose lint report has no fatal offense."""
    messages, known = _ruby_messages(spark, sf_dir)
    return quality.readable(known, messages, ["repo_id", "path"])


def _ruby_messages(spark, sf_dir):
    """A lint report for each repository, read back, and the files it is about."""
    offense = lambda n: F.concat(F.lit('{"cop_name": "Metrics/CyclomaticComplexity", "severity": "convention", "message": "Cyclomatic complexity is too high. ['), n, F.lit('/0]"}'))
    fatal = F.when(key() % 11 == 0, '{"cop_name": "Lint/Syntax", "severity": "fatal", "message": "unexpected token"}')
    found = F.when(key() % 13 == 0, F.concat_ws(", ", fatal)).otherwise(F.concat_ws(", ", fatal, offense(F.col("p_size")), offense(key() % 30)))
    line = F.concat(F.lit('{"path": "/w/part/'), key(), F.lit('", "offenses": ['), found, F.lit("]}"))
    texts = _joined(_parts(spark, sf_dir), line, ", ").withColumn("value", F.concat(F.lit('{"files": ['), "value", F.lit("]}")))
    return tools.ruby_lint(texts, "/w"), _files(spark, sf_dir)


@query("SELECT 'part/' || p_partkey AS path, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size END::INT AS complexity FROM part")
def js_lint_report(spark, sf_dir):
    message = F.when(key() % 4 == 0, "").otherwise(F.concat(F.lit('{"ruleId": "complexity", "message": "Function has a complexity of 1."}, {"ruleId": "complexity", "message": "Method has a complexity of '), "p_size", F.lit('."}')))
    line = F.concat(F.lit('{"filePath": "./part/'), key(), F.lit('", "messages": ['), message, F.lit("]}"))
    texts = _joined(_parts(spark, sf_dir), line, ", ").withColumn("value", F.concat(F.lit("["), "value", F.lit("]")))
    return quality.max_complexity(_files(spark, sf_dir), tools.js_lint(texts), quality.JS_MESSAGE, ["repo_id", "path"]).select("path", F.col("complexity").cast("int").alias("complexity"))


def _dependencies(spark, sf_dir):
    """Of each part the parts that it has an edge to."""
    return t.part_edges(spark, sf_dir).groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("dsts"))


@query(f"WITH {q.EDGES} SELECT src, dst FROM edges")
def module_report(spark, sf_dir):
    """One codebase, whose report comes in a text for each package, so that they grow in number. `fs` and null are no files of it."""
    targets = F.transform("dsts", lambda d: F.concat(F.lit('{"resolved": "'), d, F.lit('"}, {"resolved": "fs"}, {"resolved": null}')))
    line = F.concat(F.lit('{"source": "./'), "src", F.lit('", "dependencies": ['), F.array_join(targets, ", "), F.lit("]}"))
    owned = _dependencies(spark, sf_dir).withColumn("repo", repo(F.split_part("src", F.lit("/"), F.lit(2)).cast("long")))
    texts = _joined(owned, line, ", ", "src").withColumn("value", F.concat(F.lit('{"modules": ['), "value", F.lit("]}")))
    read = tools.modules(texts).withColumn("repo_id", F.lit(t.REPO))
    return graph.edges(read, t.parts(spark, sf_dir)).select("src", "dst")


# ---- Ruby source


def _classes(spark, sf_dir, lines):
    """A file for each part: a class with a line for each part that it has an edge to, @ for its number; which one says that number."""
    number = lambda x: F.split_part(x, F.lit("/"), F.lit(2))
    pick = F.array(*map(F.lit, lines))
    # lines are made for each edge, as functions over arrays aren't compiled
    d = number(F.col("dst"))
    made = t.part_edges(spark, sf_dir).select("src", F.replace(F.get(pick, (d.cast("long") % len(lines)).cast("int")), F.lit("@"), d).alias("line"))
    held = made.groupBy("src").agg(F.array_join(F.collect_list("line"), "").alias("body"))
    source = F.concat(F.lit("class P"), number(F.col("src")), F.lit("\n"), "body", F.lit("end\n"))
    return held.select(F.lit(t.REPO).alias("repo_id"), F.col("src").alias("path"), F.encode(source, "UTF-8").alias("content"))


@query(f"""WITH {q.EDGES}, numbered AS (SELECT src, split_part(src, '/', 2) AS s, split_part(dst, '/', 2)::BIGINT AS d FROM edges)
SELECT src AS path, 'P' || s AS owner, 'P' || d AS name, CASE d % 11 WHEN 2 THEN '' ELSE 'P' || s END AS namespace, d % 11 = 2 AS absolute, count(*) AS n FROM numbered WHERE d % 11 NOT IN (3, 7, 8) GROUP BY ALL
UNION ALL SELECT DISTINCT src, 'P' || s, 'P' || s, '', false, 1 FROM numbered""")
def ruby_references(spark, sf_dir):
    """A class for each part, with a line for each part that it has an edge to; lines of 3, 7 and 8 hold no reference."""
    bodies = (
        "  belongs_to :p_@\n", '  x = "#{P@.new("a}")}"\n', "  ::P@.call unless x\n", "  items.each { has_one :p_@ }\n", "  y = z.q ? if a then P@ end : 2\n", "  z <<~SQL\n    FROM Other #{P@.table}\n  SQL\n",
        "  w = %Q<end #{P@.new} <class Other> end>\n", "  P@ = %w[class P@ end] + %i(a (P@) do)\n", "  z %q|P@ end|, P@: %r{{P@}}, q: 'P@'\n", "  y = 1..P@ while z /P(@)/i\n", "  def m@(x) = x.y { |a| a || P@ }\n",
    )

    read = ruby.references(_classes(spark, sf_dir, bodies))
    shown = read.filter("parsed AND name IS NOT NULL").select("path", F.col("primary").alias("owner"), "name", F.when(F.col("absolute"), F.lit("")).otherwise(F.array_join("namespace", "::")).alias("namespace"), "absolute")
    return shown.withColumn("n", F.lit(1).cast("long"))


@query(f"""WITH {q.EDGES}, numbered AS (SELECT src, split_part(src, '/', 2) AS s, split_part(dst, '/', 2)::BIGINT AS d FROM edges)
SELECT src AS path, 'P' || d AS name, CASE WHEN d % 5 = 2 THEN 'P' || s ELSE '' END AS namespace, d % 5 <> 2 AS absolute, count(*) AS n FROM numbered WHERE d % 5 < 3 GROUP BY ALL
UNION ALL SELECT DISTINCT src, 'P' || s, '', false, 1 FROM numbered""")
def ruby_constantized(spark, sf_dir):
    """Names in strings that become constants; those with an interpolation or another call hold no reference."""
    calls = ('  x = "P@".constantize\n', "  y ||= 'P@'.safe_constantize&.new\n", '  "P@".const_get(:q)\n', '  "#{z}P@".constantize\n', "  'P@'.constantized\n")
    read = ruby.references(_classes(spark, sf_dir, calls))
    shown = read.filter("parsed AND name IS NOT NULL").select("path", "name", F.when(F.col("absolute"), F.lit("")).otherwise(F.array_join("namespace", "::")).alias("namespace"), "absolute")
    return shown.withColumn("n", F.lit(1).cast("long"))


@query(f"""WITH {q.EDGES}, numbered AS (SELECT src, dst, split_part(src, '/', 2)::BIGINT AS s, split_part(dst, '/', 2)::BIGINT AS d FROM edges)
SELECT src AS path, 'M' || d % 10 || '::P' || d AS constant FROM numbered WHERE d % 3 = 1 OR (d % 3 = 0 AND d % 10 = s % 10)""")
def const_resolution(spark, sf_dir):
    owners, refs = _constants(spark, sf_dir)
    with dealt(spark, t.tasks(spark, sf_dir, "lineitem")) as keep:
        return keep(graph.resolve(refs, owners).select("path", "constant"))


def _constants(spark, sf_dir):
    """Part k owns M<k % 10>::P<k>; references are bare, qualified or absolute by the number of the part they mean."""
    owners = t.parts(spark, sf_dir).select("repo_id", "path", F.concat(F.lit("M"), key() % 10, F.lit("::P"), key()).alias("constant"))
    number = lambda c: F.split_part(F.col(c), F.lit("/"), F.lit(2)).cast("long")
    s, d = number("src"), number("dst")
    name = F.when(d % 3 == 1, F.concat(F.lit("M"), d % 10, F.lit("::P"), d)).otherwise(F.concat(F.lit("P"), d))
    refs = t.part_edges(spark, sf_dir).select("repo_id", F.col("src").alias("path"), F.array(F.concat(F.lit("M"), s % 10), F.lit("Deep")).alias("namespace"), name.alias("name"), (d % 3 == 2).alias("absolute"))
    return owners, refs


@query(f"""WITH {q.EDGES}, used AS (
  SELECT src, dst FROM (SELECT *, split_part(src, '/', 2)::BIGINT AS s, split_part(dst, '/', 2)::BIGINT AS d FROM edges) WHERE d % 3 = 1 OR (d % 3 = 0 AND d % 10 = s % 10)
) SELECT 'part/' || p_partkey AS path, (SELECT count(*) FROM used WHERE dst = 'part/' || p_partkey) AS fan_in, (SELECT count(*) FROM used WHERE src = 'part/' || p_partkey) AS fan_out FROM part""")
def const_graph(spark, sf_dir):
    owners, refs = _constants(spark, sf_dir)
    with dealt(spark, t.tasks(spark, sf_dir, "lineitem")) as keep:
        return keep(graph.constant_graph(t.parts(spark, sf_dir), refs, owners)[0].select("path", "fan_in", "fan_out"))


# ---- histories


@query("""SELECT 'p/' || p_partkey || '.rb' AS path, CASE WHEN p_partkey % 5 = 0 THEN 1000000 + p_partkey ELSE p_partkey END::BIGINT AS first_epoch,
  (CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 3 END + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS total_commits FROM part""")
def rename_lineage(spark, sf_dir):
    """Each file: changed, then (back in time) renamed if its number is a multiple of 3, changed, deleted before if one of 5, added."""
    now = F.concat(F.lit("p/"), key(), F.lit(".rb"))
    then = F.when(key() % 3 == 0, F.concat(F.lit("old/"), key(), F.lit(".rb"))).otherwise(now)
    line = lambda step, status, path, old=F.lit(None).cast("string"): F.struct(F.lit(step).alias("step"), F.lit(status).alias("status"), old.alias("old_path"), path.alias("path"))
    steps = F.array_compact(F.array(
        line(0, "M", now), F.when(key() % 3 == 0, line(1, "R100", now, then)), F.when(key() % 5 == 0, line(2, "A", then)).otherwise(line(2, "M", then)),
        F.when(key() % 5 == 0, line(3, "D", then)), line(4, "A", then),
    ))
    epochs = F.element_at(F.array(*[F.lit(x) for x in (3_000_000, 2_000_000, 1_000_000, 500_000, 0)]), F.col("step") + 1) + key()
    log = t.table(spark, sf_dir, "part").select("p_partkey", F.explode(steps).alias("x")).select("p_partkey", "x.*")
    log = log.select(repo().alias("repo_id"), (F.col("step") * 10_000_000 + 9_999_999 - key()).cast("long").alias("seq"), F.lit(0).alias("line_no"), epochs.cast("long").alias("epoch"), "status", "old_path", "path")
    with dealt(spark, t.tasks(spark, sf_dir, "part", 5)) as keep:
        return keep(history.lineage(log, t.table(spark, sf_dir, "part").select(repo().alias("repo_id"), now.alias("path")), keep=keep).select("path", "first_epoch", "total_commits"))


@query("""WITH placed AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT 'c/' || o_custkey || '/' || max(n) AS path, min(o_orderkey)::BIGINT * 100 AS first_epoch, count(*) AS total_commits FROM placed GROUP BY o_custkey""")
def rename_chains(spark, sf_dir):
    """One repository: each order of a customer renames its file, the first one adds it, after (for each third customer) deleting one that had its name."""
    orders = t.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("long").alias("o_orderkey"))
    placed = orders.withColumn("n", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    name = lambda n: F.concat(F.lit("c/"), "o_custkey", F.lit("/"), n)
    line = lambda at, status, old=F.lit(None).cast("string"): F.struct(F.lit(at).alias("line_no"), F.lit(status).alias("status"), old.alias("old_path"), name(F.col("n")).alias("path"))
    again = F.when((F.col("n") == 1) & (F.col("o_custkey") % 3 == 0), F.array(line(0, "A"), line(1, "D"), line(2, "M"))).when(F.col("n") == 1, F.array(line(0, "A"))).otherwise(F.array(line(0, "R100", name(F.col("n") - 1))))
    log = placed.select(F.lit(t.REPO).alias("repo_id"), (F.lit(1 << 33) - F.col("o_orderkey")).alias("seq"), (F.col("o_orderkey") * 100).alias("epoch"), F.explode(again).alias("x")).select("repo_id", "seq", "epoch", "x.*")
    now = placed.groupBy("o_custkey").agg(F.max("n").alias("n")).select(F.lit(t.REPO).alias("repo_id"), name(F.col("n")).alias("path"))
    with dealt(spark, t.tasks(spark, sf_dir, "orders", 2)) as keep:
        return keep(history.lineage(log, now, keep=keep).select("path", "first_epoch", "total_commits"))


#: Orders in the order of their keys as commits: the older half is the trunk, then they go to two branches in turn; the first commit of the head
#: branch in the last quarter merges the other branch, whose side then stands wherever it touched a path.
BRANCHES = """WITH numbered AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, count(*) OVER () AS total FROM orders), placed AS (
  SELECT *, CASE WHEN 2 * n < total THEN 'trunk' WHEN n % 2 = 0 THEN 'base' ELSE 'head' END AS branch FROM numbered
), met AS (SELECT min(n) AS n FROM placed WHERE branch = 'head' AND 4 * n >= 3 * total), written AS (
  SELECT p.n, p.branch, 'part/' || l_partkey AS path, CASE WHEN max(l_linenumber) % 7 = 0 THEN repeat('0', 40) ELSE md5(((max(l_linenumber) + p.n) % 3)::VARCHAR) || '00000000' END AS blob
  FROM lineitem JOIN placed p ON l_orderkey = o_orderkey GROUP BY p.n, p.branch, l_partkey
), latest AS (SELECT path, arg_max(blob, w.n) AS blob FROM written w, met WHERE branch = 'base' AND w.n < met.n GROUP BY path), entries AS (
  SELECT n, branch, path, blob FROM written WHERE NOT (branch = 'head' AND n IN (SELECT n FROM met))
  UNION ALL SELECT met.n, 'head', path, blob FROM latest, met
)"""


#: Numbers of parts whose lines make a record of the merge.
LINES = 100


def _branches(spark, sf_dir):
    """The dump of the commit graph: a record for each order, and more for the merge, which may touch all parts."""
    orders = t.table(spark, sf_dir, "orders").select("o_orderkey")
    numbered = texts.numbered(orders.orderBy("o_orderkey").withColumn("repo_id", F.lit(t.REPO))).withColumnRenamed("seq", "n")
    total = orders.count()
    n = F.col("n")
    placed = keeper(spark)(numbered.select("o_orderkey", "n", F.when(2 * n < total, "trunk").when(n % 2 == 0, "base").otherwise("head").alias("branch")))
    merge = placed.filter((F.col("branch") == "head") & (4 * n >= 3 * total)).agg(F.min("n")).first()[0]
    # blobs are numbers until the lines are written: 0 for none
    lines = t.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("part"), "l_linenumber")
    blob = F.when(F.max("l_linenumber") % 7 == 0, 0).otherwise((F.max("l_linenumber") + n) % 3 + 1).cast("byte")
    written = lines.join(placed, "o_orderkey").groupBy("o_orderkey", "n", "branch", "part").agg(blob.alias("blob")).drop("o_orderkey")
    latest = written.filter((F.col("branch") == "base") & (n < merge)).groupBy("part").agg(F.max_by("blob", "n").alias("blob"))
    own = written.filter(~((F.col("branch") == "head") & (n == merge))).unionByName(latest.select(F.lit(merge).cast("long").alias("n"), F.lit("head").alias("branch"), "part", "blob"))
    # what stood before, on the line of each branch; both lines begin with the trunk
    sided = own.withColumn("side", F.explode(F.when(F.col("branch") == "trunk", F.array(F.lit("base"), F.lit("head"))).otherwise(F.array("branch"))))
    sided = sided.withColumn("old", F.coalesce(F.lag("blob").over(W.partitionBy("side", "part").orderBy("n")), F.lit(0).cast("byte"))).filter("branch <> 'trunk' OR side = 'head'")
    blobs = F.array(F.lit("0" * 40), *[F.concat(F.md5(F.lit(str(k))), F.lit("00000000")) for k in range(3)])
    mode = lambda b: F.when(b == 0, "000000").otherwise("100644")
    line = lambda x: F.concat(F.lit(":"), F.concat_ws(" ", mode(x["old"]), mode(x["blob"]), F.get(blobs, x["old"].cast("int")), F.get(blobs, x["blob"].cast("int"))), F.lit(" M\tpart/"), x["part"])
    piece = F.when((F.col("branch") == "head") & (n == merge), F.floor(F.col("part") / LINES))
    each = sided.select("n", piece.alias("piece"), F.struct("part", "old", "blob").alias("x"))
    each = each.unionByName(placed.select("n", F.lit(None).cast("long").alias("piece"), F.lit(None).cast(each.schema["x"].dataType).alias("x")))  # orders without lines have a record, too
    raw = F.array_join(F.transform("held", line), "\n")
    sha = lambda k: F.concat(F.md5(k.cast("string")), F.lit("00000000"))
    fork = (total + 1) // 2 - 1
    parent = F.when(n <= fork + 1, n - 1).otherwise(F.greatest(n - 2, F.lit(fork)))
    second = F.when(n == merge, n - 1)
    refs = F.when(n == total - 1 - (total - 2) % 2, "HEAD -> topic, tag: v1").when(n == total - 1 - (total - 1) % 2, "origin/main").otherwise("")
    head = F.when(F.col("piece").isNull(), F.concat_ws("\x1f", sha(n), F.when(n == 0, "").otherwise(F.concat_ws(" ", sha(parent), sha(second))), n.cast("string"), refs)).otherwise(sha(n))
    return each.groupBy("n", "piece").agg(F.collect_list("x").alias("held")).select(F.lit(t.REPO).alias("repo_id"), F.concat(head, F.lit("\n\n"), raw, F.lit("\n")).alias("value"))


@query(f"""{BRANCHES}, trees AS (
  SELECT path, arg_max(blob, e.n) FILTER (branch <> 'base') AS at_head, arg_max(blob, e.n) FILTER (branch = 'trunk' OR branch = 'base' AND e.n < met.n) AS at_base FROM entries e, met GROUP BY path
) SELECT path FROM trees WHERE at_head IS NOT NULL AND at_head <> repeat('0', 40) AND at_head IS DISTINCT FROM coalesce(at_base, repeat('0', 40))""")
def merge_base_diff(spark, sf_dir):
    return commits.changed_paths(*gitlog.graph(keeper(spark)(_branches(spark, sf_dir))), "origin/main").select("path")


# ---- paths and words

FOLDERS = ("app", "db", "db/migrate", "node_modules/x", "a/node_modules", "vendor", "app/vendor", "app/js", "tmp", "log/a", "coverage", "spec", "app/spec", "test", "__tests__", "src/__tests__", "lib", ".hidden")
ENDINGS = (".rb", ".min.js", ".test.tsx", ".spec.js", "test.js", ".ts", ".py")
PATH_SQL = f"""placed AS (SELECT p_partkey, [{', '.join(f"'{x}'" for x in FOLDERS)}][p_partkey % {len(FOLDERS)} + 1] || '/f' || p_partkey || [{', '.join(f"'{x}'" for x in ENDINGS)}][p_partkey % {len(ENDINGS)} + 1] AS path FROM part
  UNION ALL SELECT 0, 'db/schema.rb' UNION ALL SELECT -1, 'app/db/schema.rb'), judged AS (
  SELECT *, path = 'db/schema.rb' OR regexp_matches(path, '^(db/migrate|vendor|tmp|log|coverage|spec|test)/') OR regexp_matches(path, '(^|/)(node_modules|__tests__)/') OR regexp_matches(path, '[.]min[.]js$|[.](test|spec)[.][jt]sx?$') AS excluded FROM placed)"""


@query("""SELECT DISTINCT substr(path, 5) AS path FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'src/' WHEN 1 THEN 'src/' || p_partkey // 8 || '.rb' WHEN 2 THEN 'srcs/' || p_partkey ELSE 'src/src/' || p_partkey END AS path FROM part)
  WHERE starts_with(path, 'src/') AND length(path) > 4""")
def rebased_paths(spark, sf_dir):
    """Names of a diff within one folder: the folder itself, names that more than one part has, a folder that begins alike, and one of the same name inside."""
    name = F.when(key() % 4 == 0, F.lit("src/")).when(key() % 4 == 1, F.concat(F.lit("src/"), F.floor(key() / 8).cast("long"), F.lit(".rb"))).when(key() % 4 == 2, F.concat(F.lit("srcs/"), key())).otherwise(F.concat(F.lit("src/src/"), key()))
    return history.inside(t.table(spark, sf_dir, "part").select(name.alias("path")), "src/")


@query("""SELECT s_nationkey AS repo_id, count(*) AS n_files, CASE WHEN count(*) < 5 THEN 'error' WHEN count(*) < 20 THEN 'small_repo' ELSE 'enough' END AS verdict FROM supplier GROUP BY s_nationkey""")
def population(spark, sf_dir):
    """Suppliers as files, nations as repositories."""
    return files.population(t.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("repo_id")))


def _placed(spark, sf_dir):
    pick = lambda items: F.element_at(F.array(*[F.lit(x) for x in items]), (key() % len(items) + 1).cast("int"))
    made = _parts(spark, sf_dir).select("p_partkey", F.concat(pick(FOLDERS), F.lit("/f"), key(), pick(ENDINGS)).alias("path"))
    return made.unionByName(spark.createDataFrame([(0, "db/schema.rb"), (-1, "app/db/schema.rb")], made.schema))


@query(f"WITH {PATH_SQL} SELECT path, excluded FROM judged")
def glob_exclude(spark, sf_dir):
    return _placed(spark, sf_dir).select("path", paths.matches_any(F.col("path"), paths.DEFAULT_EXCLUDES).alias("excluded"))


@query(f"""WITH {PATH_SQL}, scored AS (
  SELECT *, CASE WHEN ends_with(path, '.rb') THEN 'ruby' WHEN regexp_matches(path, '[.]jsx?$') THEN 'javascript' WHEN regexp_matches(path, '[.]tsx?$') THEN 'typescript' END AS language FROM judged WHERE NOT excluded AND NOT starts_with(path, 'app/js/')
) SELECT path, language, CASE language WHEN 'ruby' THEN 'ruby' ELSE 'javascript' END AS lang_group, CASE WHEN abs(p_partkey) % 4 = 0 THEN 0 ELSE 2 END::INT AS loc, row_number() OVER (PARTITION BY floor(p_partkey / {OWN}::DOUBLE) ORDER BY path) - 1 AS ordinal
FROM scored WHERE language IS NOT NULL AND abs(p_partkey) % 7 <> 3""")
def files_collected(spark, sf_dir):
    """The rules in turn: endings, default globs, the caller's globs, generated files; text that isn't UTF-8 has no lines."""
    text = F.when(F.abs("p_partkey") % 7 == 3, "\n# This file is auto-generated\nx").otherwise("x\n\n # y\n")
    content = F.concat(F.encode(text, "UTF-8"), F.when((F.abs("p_partkey") % 4 == 0) & (F.abs("p_partkey") % 7 != 3), F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    made = _placed(spark, sf_dir).select(repo().alias("repo_id"), "path", content.alias("content"))
    kept, _ = files.collect(made, ["app/js/**"])
    return kept.select("path", "language", "lang_group", F.col("loc").cast("int").alias("loc"), F.col("ordinal").cast("long").alias("ordinal"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE {LOC_SQL} END::INT AS loc FROM documents")
def loc_cases(spark, sf_dir):
    tail = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("C3"))).otherwise(F.unhex(F.lit("")))
    content = F.concat(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), tail)
    return t.table(spark, sf_dir, "documents").select("doc_id", quality.loc(content).alias("loc"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'a/c' || p_partkey || '/x.rb' WHEN 1 THEN 'new' || p_partkey || '.rb' WHEN 2 THEN 'a/x' || p_partkey || '.rb' WHEN 3 THEN 'a/s' || p_partkey || '/x.rb' WHEN 4 THEN 'a/b' || p_partkey || '.rb' ELSE 'with space/' || p_partkey || ' b.rb' END AS renamed FROM part""")
def rename_path_normalize(spark, sf_dir):
    forms = (("a/{b => c", "}/x.rb"), ("old.rb => new", ".rb"), ("a/{sub => }/x", ".rb"), ("a/{ => s", "}/x.rb"), ("./a/b", ".rb"), ("with space/", " b.rb"))
    made = F.coalesce(*[F.when(key() % 6 == i, F.concat(F.lit(x), key(), F.lit(y))) for i, (x, y) in enumerate(forms)])
    return _parts(spark, sf_dir).select("p_partkey", paths.renamed(made).alias("renamed"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'PlanX' || p_partkey WHEN 1 THEN 'Billing::TaxR' || p_partkey WHEN 2 THEN 'Tag' || p_partkey WHEN 4 THEN 'Shop::Cart' || p_partkey WHEN 5 THEN 'Models::U' || p_partkey || 'Test' END AS constant FROM part""")
def zeitwerk_constant(spark, sf_dir):
    forms = (("app/models/plan_x", ".rb"), ("lib/billing/tax_r", ".rb"), ("app/models/concerns/tag", ".rb"), ("config/r", ".rb"), ("engines/shop/app/models/shop/cart", ".rb"), ("test/models/u", "_test.rb"))
    made = F.coalesce(*[F.when(key() % 6 == i, F.concat(F.lit(x), key(), F.lit(y))) for i, (x, y) in enumerate(forms)])
    return _parts(spark, sf_dir).select("p_partkey", paths.path_constant(made).alias("constant"))


STEMS = ("box", "branch", "bus", "city", "post", "line_item", "HTTP_server", "quiz", "dish")
IRREGULAR = ", ".join(f"('{many}', '{one}')" for many, one in paths.IRREGULAR.items())
CAMEL_SQL = "array_to_string(list_transform(string_split({0}, '_'), lambda x: upper(x[1]) || lower(x[2:])), '')"


@query(f"""WITH words AS (SELECT DISTINCT p_brand, stem, CASE WHEN ends_with(stem, 'y') THEN stem[:-2] || 'ies' WHEN regexp_matches(stem, '(s|x|z|ch|sh)$') THEN stem || 'es' ELSE stem || 's' END AS many, stem AS one
  FROM (SELECT p_brand, lower(replace(p_brand, '#', '_')) || s AS stem FROM part, (VALUES {', '.join(f"('{x}')" for x in STEMS)}) v(s))), every AS (SELECT many, one FROM words UNION ALL SELECT * FROM (VALUES {IRREGULAR}) i(many, one))
SELECT many AS word, one AS singular, {CAMEL_SQL.format('many')} AS camel FROM every""")
def singularize_camelize(spark, sf_dir):
    brands = t.table(spark, sf_dir, "part").select(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("brand"), F.explode(F.array(*[F.lit(x) for x in STEMS])).alias("s"))
    stems = brands.select(F.concat("brand", "s").alias("stem")).distinct()
    s = F.col("stem")
    many = F.when(s.endswith("y"), F.concat(F.regexp_replace(s, "y$", ""), F.lit("ies"))).when(s.rlike("(s|x|z|ch|sh)$"), F.concat(s, F.lit("es"))).otherwise(F.concat(s, F.lit("s")))
    words = stems.select(many.alias("word")).unionByName(spark.createDataFrame([(w,) for w in paths.IRREGULAR], "word string"))
    return words.select("word", paths.singularized(F.col("word")).alias("singular"), paths.camelized(F.col("word")).alias("camel"))


@query("""SELECT event_type AS code, min(event_id)::BIGINT AS place, 'm' || min(event_id) AS message FROM events GROUP BY event_type""")
def warnings_by_code(spark, sf_dir):
    found = t.table(spark, sf_dir, "events").select(F.col("event_type").alias("code"), F.col("event_id").cast("long").alias("place"), F.concat(F.lit("m"), "event_id").alias("message"))
    return reports.first_warnings(found)


# ---- sinks

SHOWN = f"""{q.RANKED}, told AS (
  SELECT *, path AS file, CASE WHEN split_part(lang_group, '#', 2)::INT % 2 = 1 THEN 'ruby' ELSE 'typescript' END AS language, CASE WHEN ordinal % 7 <> 0 THEN (ordinal % 11)::DOUBLE / 10::DOUBLE END AS evidence,
    ordinal % 4 = 0 AS new_file, ordinal % 400 AS age_days, CASE WHEN max_coupling > 0 THEN 'part/' || ordinal % 13 ELSE '' END AS max_coupling_partner, ordinal % 5 AS coupling_partners, {q.pct('loc', 'lang_group')} AS loc_pct,
    CASE WHEN coverage IS NOT NULL THEN 'present' WHEN ordinal % 10 = 0 THEN 'unavailable' ELSE 'missing' END AS coverage_status FROM ranked
), shown AS (
  SELECT lang_group, coverage_status, {', '.join(f'{q.r4(c)} AS {c}' if c in ROUNDED else c for c in RESULT_COLUMNS)} FROM told
)"""


def _shown(spark, sf_dir):
    ranked = _ranked(spark, sf_dir)
    place = F.col("ordinal")
    status = F.when(F.col("coverage").isNotNull(), "present").when(place % 10 == 0, "unavailable").otherwise("missing")
    odd = F.substring_index("lang_group", "#", -1).cast("int") % 2 == 1
    return results(ranked.withColumns({
        "language": F.when(odd, "ruby").otherwise("typescript"), "evidence": F.when(place % 7 != 0, (place % 11) / F.lit(10.0)), "new_file": place % 4 == 0, "age_days": place % 400,
        "max_coupling_partner": F.when(F.col("max_coupling") > 0, F.concat(F.lit("part/"), place % 13)).otherwise(""), "coupling_partners": place % 5, "loc_pct": percentile("loc", *GROUP), "coverage_status": status,
    }))


def _sql_cell(c: str, empty: str) -> str:
    if c in (*writers.D4, "evidence"):
        return f"coalesce(printf('%.4f', {c}), {empty})"
    return f"{c}::VARCHAR"


_QUOTED = "CASE WHEN {0} = '' THEN '\"\"' ELSE {0} END"
_CSV = " || ',' || ".join(_QUOTED.format("CASE WHEN coverage_status = 'missing' THEN '—' ELSE coalesce(coverage::VARCHAR, '') END") if c == "coverage" else _QUOTED.format(c) if c in ("escalation", "max_coupling_partner") else _sql_cell(c, "''") for c in RESULT_COLUMNS)
_MARKDOWN = " || ' | ' || ".join("CASE WHEN coverage_status = 'unavailable' THEN 'n/a' ELSE coalesce(floor(coverage * 100::DOUBLE + 0.5::DOUBLE)::INT || '%', '—') END" if c == "coverage" else _sql_cell(c, "''") for c in writers.MARKDOWN_COLUMNS)
_TEXT = ("language", "file", "class", "escalation", "max_coupling_partner")
_JSON = " || ',' || ".join(f"""'"{"path" if c == "file" else c}":' || """ + (f"""'"' || {c} || '"'""" if c in _TEXT else """CASE WHEN coverage_status = 'missing' THEN '"—"' ELSE coalesce(coverage::VARCHAR, 'null') END""" if c == "coverage" else f"coalesce({c}::VARCHAR, 'null')") for c in RESULT_COLUMNS)


@query(f"WITH {SHOWN} SELECT lang_group, rank, {_CSV} AS line FROM shown")
def score_csv(spark, sf_dir):
    return _shown(spark, sf_dir).select("lang_group", "rank", writers.csv_line().alias("line"))


@query(f"WITH {SHOWN} SELECT lang_group, rank, '| ' || {_MARKDOWN} || ' |' AS line FROM shown")
def score_markdown(spark, sf_dir):
    return _shown(spark, sf_dir).select("lang_group", "rank", writers.markdown_line().alias("line"))


@query(f"WITH {SHOWN} SELECT lang_group, rank, '{{' || {_JSON} || '}}' AS line FROM shown")
def score_json(spark, sf_dir):
    return _shown(spark, sf_dir).select("lang_group", "rank", writers.json_line().alias("line"))


_TABLE = " || '  ' || ".join(
    f"CASE WHEN length({x}) >= {w} THEN {x} ELSE {'rpad' if left else 'lpad'}({x}, {w}, ' ') END"
    for n, w, left in writers.TABLE
    for x in ["(" + ("coalesce(printf('%.4f', evidence), 'n/a')" if n == "evidence" else "CASE WHEN coverage_status = 'unavailable' THEN 'n/a' ELSE coalesce(floor(coverage * 100::DOUBLE + 0.5::DOUBLE)::INT || '%', '—') END" if n == "coverage" else _sql_cell(n, "''")) + ")"]
)


@query(f"WITH {SHOWN} SELECT lang_group, rank, {_TABLE} AS line FROM shown")
def score_table(spark, sf_dir):
    return _shown(spark, sf_dir).select("lang_group", "rank", writers.table_line().alias("line"))
