"""Pieces of SQL that the twins of several queries share. Every piece is a list of common table expressions."""

from __future__ import annotations

from ..operators.scoring import active_weights, DEFAULT_WEIGHTS


def r4(x: str) -> str:
    return f"(floor(({x}) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE)"


def pct(x: str, group: str) -> str:
    return f"percent_rank() OVER (PARTITION BY {group} ORDER BY {x})"


def changes(days: int) -> str:
    return f"""changes AS (
  SELECT 'part/' || l_partkey AS path, l_quantity::BIGINT AS added FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL {days} DAY
), churned AS (
  SELECT p_brand AS lang_group, 'part/' || p_partkey AS path, p_partkey AS ordinal, p_size, coalesce(n, 0) AS churn_commits, coalesce(lines, 0)::BIGINT AS churn_lines
  FROM part LEFT JOIN (SELECT path, count(*) AS n, sum(added) AS lines FROM changes GROUP BY path) c ON c.path = 'part/' || p_partkey
)"""


EDGES = """edges AS (
  SELECT DISTINCT 'part/' || src AS src, 'part/' || dst AS dst FROM (
    SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst FROM lineitem
  ) WHERE dst IS NOT NULL AND src <> dst
)"""

DEGREES = """degrees AS (
  SELECT c.*, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM churned c
  LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) i ON i.dst = c.path LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) o ON o.src = c.path
)"""

SIGNALS = f"""{changes(180)}, {EDGES}, {DEGREES}, signals AS (
  SELECT lang_group, path, ordinal, fan_in, fan_out, churn_commits, churn_lines, (p_size // 3)::INT AS complexity, p_size AS loc,
    CASE WHEN split_part(lang_group, '#', 2)::INT % 2 = 1 AND ordinal % 3 = 0 THEN (ordinal % 50)::DOUBLE / 100::DOUBLE ELSE 0::DOUBLE END AS max_coupling,
    CASE WHEN ordinal % 5 <> 0 THEN (ordinal % 97)::DOUBLE / 96::DOUBLE END AS coverage,
    CASE WHEN fan_in + fan_out = 0 THEN 0::DOUBLE ELSE {r4('fan_out::DOUBLE / (fan_in + fan_out)::DOUBLE')} END AS instability
  FROM degrees
)"""

PERCENTILES = f"""{SIGNALS}, churn_ranks AS (
  SELECT *, floor((0.5::DOUBLE * {pct('churn_commits', 'lang_group')} + 0.5::DOUBLE * {pct('churn_lines', 'lang_group')}) * 10000000000::DOUBLE + 0.5::DOUBLE) / 10000000000::DOUBLE AS churn_signal
  FROM signals
), pcts AS (
  SELECT *, {pct('churn_signal', 'lang_group')} AS churn_pct, {pct('fan_in', 'lang_group')} AS fan_in_pct, {pct('fan_out', 'lang_group')} AS fan_out_pct,
    {pct('complexity', 'lang_group')} AS complexity_pct, {pct('instability', 'lang_group')} AS instability_pct, {pct('max_coupling', 'lang_group')} AS coupling_pct,
    {pct('1::DOUBLE - coalesce(coverage, 0::DOUBLE)', 'lang_group')} AS coverage_risk_pct, max(max_coupling) OVER (PARTITION BY lang_group) > 0 AS coupling_available
  FROM churn_ranks
)"""


def score(coverage: bool, coupling: bool) -> str:
    w = {k: None if v is None else f"{v!r}::DOUBLE" for k, v in active_weights(DEFAULT_WEIGHTS, coverage=coverage, coupling=coupling).items()}
    out = f"((({w['fan_in']} * fan_in_pct + {w['fan_out']} * fan_out_pct) + {w['complexity']} * complexity_pct) + {w['churn']} * churn_pct)"
    if coverage:
        out = f"(({out} + {w['coverage']} * coverage_risk_pct) + ({w['interaction']} * fan_in_pct) * coverage_risk_pct)"
    if coupling:
        out = f"({out} + {w['coupling']} * coupling_pct)"
    return f"least(greatest({out}, 0::DOUBLE), 1::DOUBLE)"


def scored(coverage: bool) -> str:
    return f"""{PERCENTILES}, scored AS (
  SELECT *, CASE WHEN coupling_available THEN {score(coverage, True)} ELSE {score(coverage, False)} END AS raw_score FROM pcts
)"""


CLASSED = f"""{scored(True)}, score_pcts AS (
  SELECT *, {pct('raw_score', 'lang_group')} AS score_pct FROM scored
), plain AS (
  SELECT *, CASE WHEN score_pct >= 0.85::DOUBLE THEN 'trunk' WHEN score_pct >= 0.5::DOUBLE THEN 'branch' ELSE 'leaf' END AS plain_class FROM score_pcts
), floored AS (
  SELECT *, CASE WHEN plain_class = 'leaf' AND complexity >= 15 THEN 'complexity_floor' WHEN plain_class = 'leaf' AND fan_in >= 25 THEN 'fan_in_floor' ELSE '' END AS escalation FROM plain
), classed AS (
  SELECT *, CASE WHEN escalation <> '' THEN 'branch' ELSE plain_class END AS class FROM floored
)"""

RANKED = f"""{CLASSED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang_group ORDER BY CASE class WHEN 'trunk' THEN 3 WHEN 'branch' THEN 2 ELSE 1 END DESC, score DESC, ordinal) AS rank
  FROM (SELECT *, {r4('raw_score')} AS score FROM classed)
)"""


def coupled(commits: str, most: int, least: int, threshold: float) -> str:
    """commits: a query of (commit, path)."""
    return f"""touches AS (SELECT DISTINCT * FROM ({commits})), sized AS (
  SELECT *, count(*) OVER (PARTITION BY commit) AS n FROM touches
), kept AS (SELECT commit, path FROM sized WHERE n <= {most} OR {most} = 0), own AS (
  SELECT path, count(*) AS own FROM kept GROUP BY path
), together AS (
  SELECT a.path AS a, b.path AS b, count(*) AS co_changes FROM kept a JOIN kept b ON a.commit = b.commit AND a.path < b.path GROUP BY a.path, b.path HAVING count(*) >= {least}
), rated AS (
  SELECT a, b, co_changes, x.own AS own_a, y.own AS own_b, {r4('co_changes::DOUBLE / least(x.own, y.own)::DOUBLE')} AS coupling
  FROM together JOIN own x ON x.path = a JOIN own y ON y.path = b
), pairs AS (
  SELECT a AS path, b AS partner, coupling, co_changes, own_b AS own_changes FROM rated WHERE coupling >= {threshold}::DOUBLE
  UNION ALL SELECT b, a, coupling, co_changes, own_a FROM rated WHERE coupling >= {threshold}::DOUBLE
)"""


HISTORY = """history AS (
  SELECT o_custkey AS path, min(epoch(o_orderdate)::BIGINT) AS first_epoch, count(DISTINCT o_orderkey) AS total_commits FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY o_custkey
), aged AS (
  SELECT c_mktsegment AS lang_group, c_custkey AS path, c_acctbal, first_epoch,
    CASE WHEN first_epoch IS NULL THEN 0 ELSE greatest(floor((epoch(TIMESTAMP '1996-01-01') - first_epoch)::DOUBLE / 86400::DOUBLE), 0)::BIGINT END AS age_days,
    coalesce(total_commits, 0)::BIGINT AS total_commits
  FROM customer LEFT JOIN history ON path = c_custkey
), fresh AS (
  SELECT *, first_epoch IS NULL OR age_days < 30 OR total_commits < 3 AS new_file FROM aged
)"""
