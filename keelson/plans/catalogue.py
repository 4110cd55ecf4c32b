"""Registered queries of the reference's own operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import percentile, rounded, with_percentile
from ..operators import churn, coupling, graph, history, quality, reports, scoring
from ..sources.kept import dealt
from . import tables as t
from . import twins as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

GROUP = ["repo_id", "lang_group"]


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def values(spark: SparkSession, names: str, rows: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})")


# ---- percentiles and churn


@query(f"SELECT p_partkey, p_brand, p_size, {q.pct('p_size', 'p_brand')} AS size_pct FROM part")
def pct_rank_signal(spark, sf_dir):
    return t.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", percentile("p_size", "p_brand").alias("size_pct"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, percent_rank() OVER (ORDER BY l_extendedprice) AS price_pct, percent_rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS quantity_pct FROM lineitem")
def pct_rank_large_groups(spark, sf_dir):
    """All lines of orders as one group, and as three."""
    lines = t.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag")
    ranked = with_percentile(with_percentile(lines, "l_extendedprice", "price_pct"), "l_quantity", "quantity_pct", "l_returnflag")
    return ranked.select("l_orderkey", "l_linenumber", "l_extendedprice", "price_pct", "quantity_pct")


@query(f"WITH {q.changes(180)} SELECT path, churn_commits, churn_lines FROM churned")
def churn_counts(spark, sf_dir):
    return churn.counts(t.parts(spark, sf_dir), t.part_changes(spark, sf_dir), ["repo_id", "path"]).select("path", "churn_commits", "churn_lines")


@query(f"WITH {q.PERCENTILES} SELECT path, churn_commits, churn_lines, churn_signal, churn_pct FROM pcts")
def churn_composite_pct(spark, sf_dir):
    files = churn.counts(t.parts(spark, sf_dir), t.part_changes(spark, sf_dir), ["repo_id", "path"])
    mean = churn.composite("churn_commits", "churn_lines", *GROUP)[2]
    return files.withColumn("churn_signal", mean).select("path", "churn_commits", "churn_lines", "churn_signal", percentile("churn_signal", *GROUP).alias("churn_pct"))


def _zero_sql(days: int) -> str:
    return f"""WITH {q.changes(days)} SELECT {days} AS days, lang_group, count(*) AS n_files, count(*) FILTER (churn_commits = 0) AS zero_files,
      floor(count(*) FILTER (churn_commits = 0) * 100::DOUBLE / count(*)::DOUBLE + 0.5::DOUBLE)::BIGINT AS zero_percentage,
      count(*) FILTER (churn_commits = 0) > 0.5 * count(*) AS zero_inflated FROM churned GROUP BY lang_group"""


@query(f"({_zero_sql(30)}) UNION ALL ({_zero_sql(180)})")
def zero_inflation(spark, sf_dir):
    out = None
    for days in (30, 180):
        files = churn.counts(t.parts(spark, sf_dir), t.part_changes(spark, sf_dir, days), ["repo_id", "path"])
        one = churn.zero_inflation(files, "lang_group").withColumn("days", F.lit(days))
        out = one if out is None else out.unionByName(one)
    return out


# ---- temporal coupling

SUPPLIER_SQL = q.coupled("SELECT l_orderkey AS commit, l_suppkey AS path FROM lineitem", 50, 5, 0.04)
HOURS_SQL = q.coupled("SELECT date_trunc('hour', ts) AS commit, user_id AS path FROM events", 13, 5, 0.1)


def _supplier_pairs(spark, sf_dir):
    tasks = t.tasks(spark, sf_dir, "lineitem")
    kept, _ = coupling.bulk_filter(coupling.commits(t.supplier_changes(spark, sf_dir), tasks=tasks), 50)
    return coupling.pairs(kept, threshold=0.04, min_commits=5, tasks=tasks)


@query(f"WITH {SUPPLIER_SQL} SELECT path, partner, coupling, co_changes, own_changes FROM pairs")
def coupling_pairs(spark, sf_dir):
    return _supplier_pairs(spark, sf_dir).drop("repo_id")


@query(f"WITH {HOURS_SQL} SELECT path, partner, coupling, co_changes, own_changes FROM pairs")
def coupling_bulk_filter(spark, sf_dir):
    kept, _ = coupling.bulk_filter(coupling.commits(t.user_hours(spark, sf_dir)), 13)
    return coupling.pairs(kept, threshold=0.1, min_commits=5).drop("repo_id")


@query(f"WITH {q.coupled('SELECT date_trunc(' + chr(39) + 'hour' + chr(39) + ', ts) AS commit, user_id AS path FROM events', 1 << 30, 5, 0.1)} SELECT path, partner, coupling, co_changes, own_changes FROM pairs")
def coupling_without_cap(spark, sf_dir):
    return coupling.pruned_pairs(t.user_hours(spark, sf_dir), threshold=0.1, min_commits=5).drop("repo_id")


@query(f"WITH {HOURS_SQL} SELECT count(DISTINCT commit) FILTER (n <= 13) AS kept, count(DISTINCT commit) FILTER (n > 13) AS skipped FROM sized")
def coupling_bulk_skipped(spark, sf_dir):
    grouped = coupling.commits(t.user_hours(spark, sf_dir))
    return grouped.agg(F.count_if(F.size("paths") <= 13).alias("kept"), F.count_if(F.size("paths") > 13).alias("skipped"))


@query(f"""WITH {SUPPLIER_SQL}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY coupling DESC, co_changes DESC, partner) AS place, count(*) OVER (PARTITION BY path) AS n FROM pairs
) SELECT path, coupling AS max_coupling, partner AS max_coupling_partner, n AS coupling_partners FROM placed WHERE place = 1""")
def coupling_top_partner(spark, sf_dir):
    return coupling.top_partner(_supplier_pairs(spark, sf_dir)).drop("repo_id")


@query(f"""WITH {SUPPLIER_SQL}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY coupling DESC, co_changes DESC, partner) AS place, count(*) OVER (PARTITION BY path) AS n FROM pairs
) SELECT s_suppkey AS path, coalesce(coupling, 0::DOUBLE) AS max_coupling, coalesce(partner::VARCHAR, '') AS max_coupling_partner, coalesce(n, 0) AS coupling_partners FROM supplier LEFT JOIN placed ON path = s_suppkey AND place = 1""")
def coupling_aggregate(spark, sf_dir):
    files = t.table(spark, sf_dir, "supplier").select(F.lit(t.REPO).alias("repo_id"), F.col("s_suppkey").alias("path"))
    top = coupling.top_partner(_supplier_pairs(spark, sf_dir)).withColumn("max_coupling_partner", F.col("max_coupling_partner").cast("string"))
    return coupling.with_top(files, top, ["repo_id", "path"]).drop("repo_id")


@query(f"""WITH {SUPPLIER_SQL} SELECT path, string_agg(partner || ':' || co_changes || ':' || own_changes, ' ' ORDER BY coupling DESC, co_changes DESC, partner) AS partners FROM pairs GROUP BY path""")
def coupling_partners(spark, sf_dir):
    entry = lambda x: F.concat_ws(":", *[x[c].cast("string") for c in ("path", "co_changes", "own_changes")])
    return coupling.partners_of(_supplier_pairs(spark, sf_dir)).select("path", F.array_join(F.transform("partners", entry), " ").alias("partners"))


# ---- graph


@query(f"""WITH {q.EDGES}, ends AS (SELECT dst AS path, 'in' AS side, src AS other FROM edges UNION ALL SELECT src, 'out', dst FROM edges), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY path, side ORDER BY other) AS nth FROM ends
) SELECT path, coalesce(string_agg(other, ' ' ORDER BY other) FILTER (side = 'in' AND nth <= 10), '') AS dependents, coalesce(string_agg(other, ' ' ORDER BY other) FILTER (side = 'out' AND nth <= 10), '') AS dependencies,
  count(*) FILTER (side = 'in') AS n_dependents, count(*) FILTER (side = 'out') AS n_dependencies FROM numbered GROUP BY path""")
def edge_lists(spark, sf_dir):
    lists = graph.edge_lists(t.part_edges(spark, sf_dir), 10)
    with dealt(spark, t.tasks(spark, sf_dir, "lineitem")) as keep:
        return keep(lists.select("path", F.array_join("dependents", " ").alias("dependents"), F.array_join("dependencies", " ").alias("dependencies"), "n_dependents", "n_dependencies"))


@query(f"WITH {q.EDGES} SELECT src, dst FROM edges")
def dep_edges(spark, sf_dir):
    return t.part_edges(spark, sf_dir).drop("repo_id")


@query(f"WITH {q.SIGNALS} SELECT path, fan_in, fan_out FROM signals")
def fan_in_out(spark, sf_dir):
    return graph.degrees(t.parts(spark, sf_dir), t.part_edges(spark, sf_dir)).select("path", "fan_in", "fan_out")


@query(f"WITH {q.SIGNALS} SELECT path, instability, {q.pct('instability', 'lang_group')} AS instability_pct FROM signals")
def instability(spark, sf_dir):
    files = graph.degrees(t.parts(spark, sf_dir), t.part_edges(spark, sf_dir))
    files = files.withColumn("instability", graph.instability(F.col("fan_in"), F.col("fan_out")))
    return files.select("path", "instability", percentile("instability", *GROUP).alias("instability_pct"))


# ---- complexity, length, coverage


@query("""SELECT user_id, coalesce(max(try_cast(nullif(regexp_extract(props, '"k": ([0-9]+)', 1), '') AS INT)), 0) AS complexity FROM events GROUP BY user_id""")
def complexity_max(spark, sf_dir):
    events = t.table(spark, sf_dir, "events")
    users = events.select("user_id").distinct()
    return quality.max_complexity(users, events.select("user_id", F.col("props").alias("message")), r'"k": (\d+)', ["user_id"])


LOC_SQL = r"""len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\s\x0b\x00]', '', 'g') <> ''))::INT"""


@query(f"SELECT doc_id, {LOC_SQL} AS loc FROM documents")
def loc_nonblank(spark, sf_dir):
    return t.table(spark, sf_dir, "documents").select("doc_id", quality.nonblank_lines(F.col("text")).alias("loc"))


@query(f"SELECT doc_id, lang, loc, {q.pct('loc', 'lang')} AS loc_pct FROM (SELECT doc_id, lang, {LOC_SQL} AS loc FROM documents)")
def loc_pct_by_language(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "lang", quality.nonblank_lines(F.col("text")).alias("loc"))
    return docs.select("doc_id", "lang", "loc", percentile("loc", "lang").alias("loc_pct"))


LABELLED_SQL = "labelled AS (SELECT d.doc_id, d.lang, l.quality::DOUBLE * (d.n_chars % 100)::DOUBLE / 100::DOUBLE AS line_rate, l.doc_id IS NOT NULL AS present FROM documents d LEFT JOIN labels l USING (doc_id))"


def _covered_documents(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rates = docs.join(t.table(spark, sf_dir, "labels"), "doc_id").select("doc_id", (F.col("quality").cast("double") * (F.col("n_chars") % 100).cast("double") / F.lit(100.0)).alias("line_rate"))
    return quality.with_coverage(docs, rates, ["doc_id"])


@query(f"WITH {LABELLED_SQL} SELECT doc_id, 1::DOUBLE - coalesce(line_rate, 0::DOUBLE) AS risk, {q.pct('1::DOUBLE - coalesce(line_rate, 0::DOUBLE)', 'lang')} AS coverage_risk_pct FROM labelled")
def coverage_risk(spark, sf_dir):
    docs = _covered_documents(spark, sf_dir)
    return docs.select("doc_id", quality.risk(F.col("coverage")).alias("risk"), quality.risk_pct(F.col("coverage"), "lang").alias("coverage_risk_pct"))


@query(f"WITH {LABELLED_SQL} SELECT doc_id, line_rate AS coverage, CASE WHEN present THEN 'present' ELSE 'missing' END AS coverage_status FROM labelled")
def coverage_tristate(spark, sf_dir):
    return _covered_documents(spark, sf_dir).select("doc_id", "coverage", "coverage_status")


def _hits(spark, sf_dir):
    """Of each user and event type the hours' counts as an array of hits: null for hours 0 to 5, ragged at the end."""
    events = t.table(spark, sf_dir, "events").filter("event_type IN ('click', 'error')")
    hourly = events.groupBy("user_id", "event_type", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    gathered = hourly.groupBy("user_id", "event_type").agg(F.map_from_entries(F.collect_list(F.struct("hour", "n"))).alias("m"), F.max("hour").alias("last"))
    hits = F.transform(F.sequence(F.lit(0), F.col("last")), lambda h: F.when(h >= 6, F.coalesce(F.try_element_at(F.col("m"), h), F.lit(0))))
    return gathered.select("user_id", "event_type", hits.alias("hits"))


HITS_SQL = """hourly AS (
  SELECT user_id, event_type, hour(ts) AS h, count(*) AS n FROM events WHERE event_type IN ('click', 'error') GROUP BY ALL
), cells AS (
  SELECT x.user_id, x.event_type, g.h, CASE WHEN g.h >= 6 THEN coalesce(y.n, 0) END AS hit
  FROM (SELECT user_id, event_type, max(h) AS last FROM hourly GROUP BY ALL) x JOIN range(24) g(h) ON g.h <= x.last
  LEFT JOIN hourly y ON y.user_id = x.user_id AND y.event_type = x.event_type AND y.h = g.h
)"""


@query(f"WITH {HITS_SQL} SELECT user_id, event_type, CASE WHEN count(hit) > 0 THEN count(*) FILTER (hit > 0)::DOUBLE / count(hit)::DOUBLE ELSE 0::DOUBLE END AS line_rate FROM cells GROUP BY ALL")
def coverage_line_rate(spark, sf_dir):
    return _hits(spark, sf_dir).select("user_id", "event_type", quality.line_rate(F.col("hits")).alias("line_rate"))


@query(f"""WITH {HITS_SQL}, merged AS (SELECT user_id, h, max(hit) AS hit FROM cells GROUP BY ALL)
SELECT user_id, count(hit) AS executable, count(*) FILTER (hit > 0) AS covered, CASE WHEN count(hit) > 0 THEN count(*) FILTER (hit > 0)::DOUBLE / count(hit)::DOUBLE ELSE 0::DOUBLE END AS line_rate FROM merged GROUP BY user_id""")
def coverage_max_merge(spark, sf_dir):
    return quality.max_merge(_hits(spark, sf_dir).select("user_id", "hits"), ["user_id"])


SUFFIXES = ("en", "de", "fr", "es", "en/1", "ththly.example.org/en/777", "en/777", "fr/65.html")


@query(f"""WITH files(path) AS (VALUES {', '.join(f"('{s}')" for s in SUFFIXES)}), asked AS (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS reported FROM pages)
SELECT reported, arg_max(path, length(path)) AS path FROM asked JOIN files ON reported = path OR ends_with(reported, '/' || path) GROUP BY reported""")
def coverage_suffix_match(spark, sf_dir):
    files = values(spark, "repo_id, path", ", ".join(f"('{t.REPO}', '{s}')" for s in SUFFIXES))
    asked = t.table(spark, sf_dir, "pages").select(F.lit(t.REPO).alias("repo_id"), F.regexp_replace("url", "[?#].*$", "").alias("reported"))
    return quality.suffix_match(asked, files).select("reported", "path")


# ---- scores


def _scored(spark, sf_dir, coverage: bool = True):
    files = scoring.with_percentiles(t.part_signals(spark, sf_dir), *GROUP)
    return scoring.with_score(files, scoring.DEFAULT_WEIGHTS, *GROUP, coverage=coverage)


def _formula(name: str, coverage: bool, coupled: bool):
    def run(spark, sf_dir):
        weights = scoring.active_weights(scoring.DEFAULT_WEIGHTS, coverage=coverage, coupling=coupled)
        files = scoring.with_percentiles(t.part_signals(spark, sf_dir), *GROUP)
        return files.select("path", "lang_group", rounded(scoring.score(weights)).alias("score"))

    run.__name__ = name
    query(f"WITH {q.PERCENTILES} SELECT path, lang_group, {q.r4(q.score(coverage, coupled))} AS score FROM pcts")(run)


@query(f"WITH {q.PERCENTILES}, raw AS (SELECT path, lang_group, fan_in_pct * coverage_risk_pct AS interaction_raw FROM pcts) SELECT *, {q.pct('interaction_raw', 'lang_group')} AS interaction_pct FROM raw")
def interaction_pct(spark, sf_dir):
    files = scoring.with_percentiles(t.part_signals(spark, sf_dir), *GROUP)
    return scoring.with_interaction(files, *GROUP).select("path", "lang_group", "interaction_raw", "interaction_pct")


_formula("weighted_score_4f", False, False)
_formula("weighted_score_4f_coupling", False, True)
_formula("weighted_score_5f", True, False)
_formula("weighted_score_5f_coupling", True, True)


@query(f"WITH {q.scored(True)} SELECT path, coupling_available, {q.r4('raw_score')} AS score FROM scored")
def weighted_score_by_group(spark, sf_dir):
    return _scored(spark, sf_dir).select("path", "coupling_available", rounded(F.col("raw_score")).alias("score"))


def _classed(spark, sf_dir):
    return scoring.with_class(_scored(spark, sf_dir), *GROUP)


def _ranked(spark, sf_dir):
    return scoring.with_rank(_classed(spark, sf_dir), *GROUP)


@query(f"WITH {q.CLASSED} SELECT path, {q.r4('score_pct')} AS score_pct, class, escalation FROM classed")
def classify_floors(spark, sf_dir):
    return _classed(spark, sf_dir).select("path", rounded(F.col("score_pct")).alias("score_pct"), "class", "escalation")


RANK_COLUMNS = ["rank", "lang_group", "path", "score", "class", "escalation", "fan_in", "fan_out", "instability", "complexity", "churn_commits", "churn_lines", "max_coupling"]


@query(f"WITH {q.RANKED} SELECT {', '.join(RANK_COLUMNS)} FROM ranked")
def rank_rows(spark, sf_dir):
    return _ranked(spark, sf_dir).select(*RANK_COLUMNS)


@query(f"WITH {q.RANKED} SELECT rank, lang_group, path, score, class FROM ranked WHERE rank <= 10")
def top_n_per_group(spark, sf_dir):
    return scoring.top_n(_ranked(spark, sf_dir), 10, *GROUP).select("rank", "lang_group", "path", "score", "class")


@query(f"WITH {q.RANKED} SELECT rank, lang_group, path, score, class FROM ranked WHERE ordinal % 17 = 0")
def only_filter_after_rank(spark, sf_dir):
    wanted = t.parts(spark, sf_dir).filter("p_partkey % 17 = 0").select("repo_id", "path")
    return scoring.only(_ranked(spark, sf_dir), wanted, ["repo_id", "path"]).select("rank", "lang_group", "path", "score", "class")


DISPERSED = {"fan_in": "fan_in", "fan_out": "fan_out", "complexity": "complexity", "constant": "7", "nothing": "0", "churn": "churn_commits + churn_lines", "coupling": "max_coupling"}


@query(f"""WITH {q.PERCENTILES}, long AS (
  {' UNION ALL '.join(f"SELECT lang_group, '{n}' AS signal, abs({x})::DOUBLE AS raw, {q.pct(f'({x})::DOUBLE', 'lang_group') if n in ('constant', 'nothing') else f'{n}_pct'} AS pct FROM pcts" for n, x in DISPERSED.items())}
) SELECT lang_group, 'insufficient_dispersion_' || signal AS code FROM long GROUP BY lang_group, signal HAVING max(pct) = 0 AND max(raw) > 0""")
def dispersion_warnings(spark, sf_dir):
    files = scoring.with_percentiles(t.part_signals(spark, sf_dir), *GROUP)
    files = files.withColumn("constant_pct", percentile(F.lit(7.0) + F.lit(0) * F.col("loc"), *GROUP)).withColumn("nothing_pct", percentile(F.lit(0) * F.col("loc"), *GROUP))
    signals = {n: (F.expr(x), f"{n}_pct") for n, x in DISPERSED.items()}
    return scoring.dispersion(files, signals, "lang_group")


# ---- history


@query(f"WITH {q.HISTORY} SELECT path, age_days, total_commits, new_file FROM fresh")
def history_age(spark, sf_dir):
    files = history.with_history(t.customers(spark, sf_dir), t.customer_history(spark, sf_dir), ["repo_id", "path"], t.seconds(t.AS_OF))
    return files.select("path", "age_days", "total_commits", "new_file")


EVIDENCE_SQL = f"""{q.HISTORY}, parts AS (
  SELECT *, least(age_days::DOUBLE / 30::DOUBLE, 1::DOUBLE) AS a, least(total_commits::DOUBLE / 3::DOUBLE, 1::DOUBLE) AS c, c_acctbal > 0 AS covered FROM fresh
), evident AS (
  SELECT *, {q.r4('CASE WHEN covered THEN greatest((a + c) / 2::DOUBLE, (a + c + 1::DOUBLE) / 3::DOUBLE) ELSE (a + c) / 2::DOUBLE END')} AS evidence FROM parts
)"""


def _aged(spark, sf_dir):
    files = history.with_history(t.customers(spark, sf_dir), t.customer_history(spark, sf_dir), ["repo_id", "path"], t.seconds(t.AS_OF))
    found = history.evidence(F.col("age_days"), F.col("total_commits"), F.col("c_acctbal") > 0, F.col("metadata_available"))
    return files.withColumn("evidence", found)


@query(f"WITH {EVIDENCE_SQL} SELECT path, covered, evidence FROM evident")
def evidence(spark, sf_dir):
    return _aged(spark, sf_dir).select("path", (F.col("c_acctbal") > 0).alias("covered"), "evidence")


NEW_SQL = f"""{EVIDENCE_SQL}, ranked AS (
  SELECT *, {q.pct('c_acctbal', 'lang_group')} AS p FROM evident
), before AS (
  SELECT *, CASE WHEN p >= 0.85::DOUBLE THEN 'trunk' WHEN p >= 0.5::DOUBLE THEN 'branch' WHEN path % 4 = 0 THEN 'branch' ELSE 'leaf' END AS old_class,
    CASE WHEN p < 0.5::DOUBLE AND path % 4 = 0 THEN 'complexity_floor' ELSE '' END AS old_escalation FROM ranked
), edges AS (
  SELECT DISTINCT src, dst FROM (SELECT o_custkey AS src, lead(o_custkey) OVER (PARTITION BY o_orderdate::DATE ORDER BY o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL AND src <> dst
), beside AS (
  SELECT DISTINCT a.path FROM before a JOIN edges ON src = a.path JOIN before b ON b.path = dst AND b.lang_group = a.lang_group AND b.old_class = 'trunk'
), judged AS (
  SELECT x.*, new_file AND y.path IS NOT NULL AS adjacent, new_file AND y.path IS NULL AND (old_class = 'leaf' OR old_escalation <> '') AS recent FROM before x LEFT JOIN beside y ON y.path = x.path
), renewed AS (
  SELECT path, lang_group, new_file, evidence, {q.r4('p')} AS score, CASE WHEN adjacent THEN 'trunk' WHEN recent THEN 'branch' ELSE old_class END AS class,
    CASE WHEN adjacent THEN 'trunk_adjacent' WHEN recent THEN 'recency_floor' ELSE old_escalation END AS escalation FROM judged
)"""


def _renewed(spark, sf_dir):
    files = _aged(spark, sf_dir).withColumn("p", percentile("c_acctbal", *GROUP))
    floored = (F.col("p") < 0.5) & (F.col("path") % 4 == 0)
    files = files.withColumn("escalation", F.when(floored, "complexity_floor").otherwise("")).withColumn("class", F.when(floored, "branch").otherwise(scoring.classified(F.col("p"))))
    return history.newness(files, t.customer_edges(spark, sf_dir), GROUP, ["repo_id", "path"]).withColumn("score", rounded(F.col("p")))


@query(f"WITH {NEW_SQL} SELECT path, new_file, class, escalation FROM renewed")
def newness_rules(spark, sf_dir):
    return _renewed(spark, sf_dir).select("path", "new_file", "class", "escalation")


# ---- gate and drill-down

GATE_SQL = f"""{NEW_SQL}, findings AS (
  SELECT 'trunk_touched' AS "check", *, '{reports.CHECKS["trunk_touched"]}' AS reason FROM renewed WHERE class = 'trunk'
  UNION ALL SELECT 'low_evidence_high_score', *, '{reports.CHECKS["low_evidence_high_score"]}' FROM renewed WHERE score >= 0.75 AND (evidence IS NULL OR evidence < 0.5)
  UNION ALL SELECT 'newness_trunk_adjacent', *, '{reports.CHECKS["newness_trunk_adjacent"]}' FROM renewed WHERE new_file AND escalation = 'trunk_adjacent'
)"""


@query(f'WITH {GATE_SQL} SELECT "check", path, lang_group AS language, score, evidence, class, reason FROM findings')
def gate_findings(spark, sf_dir):
    return reports.gate_findings(_renewed(spark, sf_dir).withColumnRenamed("lang_group", "language"))


@query(f"""WITH {GATE_SQL} SELECT c."check", count(f.path) AS findings FROM (VALUES {', '.join(f"('{c}')" for c in reports.CHECKS)}) AS c("check") LEFT JOIN findings f ON f."check" = c."check" GROUP BY c."check" """)
def gate_summary(spark, sf_dir):
    return reports.gate_summary(reports.gate_findings(_renewed(spark, sf_dir).withColumnRenamed("lang_group", "language")))


@query(f"""WITH {q.RANKED}, near AS (
  SELECT DISTINCT 'dependents' AS section, src AS path FROM edges WHERE dst = 'part/7' UNION ALL SELECT DISTINCT 'dependencies', dst FROM edges WHERE src = 'part/7'
), placed AS (
  SELECT section, row_number() OVER (PARTITION BY section ORDER BY score DESC NULLS LAST, r.path) AS rank, r.path, score, class, fan_in, fan_out, instability FROM near JOIN ranked r ON r.path = near.path
) SELECT * FROM placed WHERE rank <= 50""")
def edges_report(spark, sf_dir):
    return reports.edges_of("part/7", t.part_edges(spark, sf_dir), _ranked(spark, sf_dir))


# ---- set operations


@query("""SELECT 'union' AS op, p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') UNION ALL SELECT 'difference', p_partkey FROM part WHERE p_brand = 'Brand#1' AND p_size <= 25
UNION ALL SELECT 'intersection', p_partkey FROM part WHERE p_brand = 'Brand#2' AND p_size > 25""")
def set_ops(spark, sf_dir):
    part = t.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    one, two, large = part.filter("p_brand = 'Brand#1'"), part.filter("p_brand = 'Brand#2'"), part.filter("p_size > 25").select("p_partkey")
    named = lambda df, op: df.select(F.lit(op).alias("op"), "p_partkey")
    union = named(one.unionByName(two), "union")
    return union.unionByName(named(one.join(large, "p_partkey", "left_anti"), "difference")).unionByName(named(two.join(large, "p_partkey", "left_semi"), "intersection"))


@query(f"""WITH {q.RANKED} SELECT 'meta' AS part, count(*) AS n_files, count(*) FILTER (class = 'trunk') AS trunks, count(*) FILTER (coverage IS NULL) AS uncovered FROM ranked""")
def footer_counts(spark, sf_dir):
    return _ranked(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("class") == "trunk").alias("trunks"), F.count_if(F.col("coverage").isNull()).alias("uncovered")).withColumn("part", F.lit("meta"))
