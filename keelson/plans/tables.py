"""The driver's tables read as a repository: which columns stand for files, commits, edges and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import churn, graph

REPO = "tables"
#: The lookback of churn, in days, and the end of customers' history.
LOOKBACK, AS_OF = 180, "1996-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table for each task of a shuffle, so that the memory of a task stays as it is while the table grows.
ROWS_OF_A_TASK = 1 << 18


def tasks(spark: SparkSession, sf_dir: str, name: str, each: int = 1) -> int:
    """How many tasks should share a shuffle of what comes from the table, `each` rows of one: those that are set, or more if it is large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-each * table(spark, sf_dir, name).count() // ROWS_OF_A_TASK))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files; a brand is a language group."""
    return table(spark, sf_dir, "part").select(
        F.lit(REPO).alias("repo_id"), F.col("p_brand").alias("lang_group"), F.concat(F.lit("part/"), "p_partkey").alias("path"), F.col("p_partkey").alias("ordinal"),
        F.col("p_size"), F.col("p_partkey"),
    )


def part_changes(spark: SparkSession, sf_dir: str, days: int = LOOKBACK) -> DataFrame:
    """Lines of orders in the last `days` days as changes of parts."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    latest = orders.agg(F.max("o_orderdate")).scalar()
    recent = orders.filter(F.col("o_orderdate") >= latest - F.expr(f"INTERVAL {days} DAYS"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return lines.join(recent.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select(
        F.lit(REPO).alias("repo_id"), F.concat(F.lit("part/"), "l_partkey").alias("path"), F.col("l_quantity").cast("long").alias("added"), F.lit(0).cast("long").alias("deleted"),
    )


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each part to the next one in the same order."""
    line = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    raw = lines.withColumn("next", F.lead("l_partkey").over(line)).filter("next IS NOT NULL")
    named = raw.select(F.lit(REPO).alias("repo_id"), F.concat(F.lit("part/"), "l_partkey").alias("src"), F.concat(F.lit("part/"), "next").alias("dst"))
    return graph.edges(named)


def part_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw signals of parts; coverage is missing for each fifth part, coupling is there in brands with odd numbers only."""
    files = churn.counts(parts(spark, sf_dir), part_changes(spark, sf_dir), ["repo_id", "path"])
    files = graph.degrees(files, part_edges(spark, sf_dir))
    key = F.col("p_partkey")
    coupled = (F.substring_index("lang_group", "#", -1).cast("int") % 2 == 1) & (key % 3 == 0)
    return files.select(
        "repo_id", "lang_group", "path", "ordinal", "fan_in", "fan_out", "churn_commits", "churn_lines", F.floor(F.col("p_size") / 3).cast("int").alias("complexity"),
        F.when(coupled, (key % 50) / F.lit(100.0)).otherwise(0.0).alias("max_coupling"), F.when(key % 5 != 0, (key % 97) / F.lit(96.0)).alias("coverage"), F.col("p_size").alias("loc"),
    )


def supplier_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits, suppliers as files."""
    return table(spark, sf_dir, "lineitem").select(F.lit(REPO).alias("repo_id"), F.col("l_orderkey").alias("commit"), F.col("l_suppkey").alias("path"))


def user_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours as commits, users as files."""
    return table(spark, sf_dir, "events").select(F.lit(REPO).alias("repo_id"), F.date_trunc("hour", "ts").alias("commit"), F.col("user_id").alias("path"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.lit(REPO).alias("repo_id"), F.col("c_mktsegment").alias("lang_group"), F.col("c_custkey").alias("path"), F.col("c_acctbal"))


def past_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(F.col("o_orderdate") < F.lit(AS_OF).cast("timestamp"))


def customer_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First order (epoch seconds) and number of orders, before AS_OF."""
    return past_orders(spark, sf_dir).groupBy(F.lit(REPO).alias("repo_id"), F.col("o_custkey").alias("path")).agg(
        F.min(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("first_epoch"), F.count_distinct("o_orderkey").alias("total_commits")
    )


def customer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each customer to the one that ordered next on the same day."""
    line = W.partitionBy(F.to_date("o_orderdate")).orderBy("o_orderkey")
    raw = table(spark, sf_dir, "orders").withColumn("dst", F.lead("o_custkey").over(line)).filter("dst IS NOT NULL")
    return graph.edges(raw.select(F.lit(REPO).alias("repo_id"), F.col("o_custkey").alias("src"), "dst"))


def seconds(day: str):
    return F.unix_seconds(F.lit(day).cast("timestamp"))
