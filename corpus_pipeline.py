"""A training corpus from raw documents, in five stages; each calls one of the operators of keelson.llm.

All stages but the last return the columns of documents, whatever other columns there are and however they are called;
an empty table passes through. Rows are told apart by id and text; of rows equal in both, one stays, chosen by a hash of
the other columns, so reruns agree. By stage:

1. Language ID. Goes: null texts, texts without a letter, and texts whose best language stands less than a third of
   the way from chance to certainty (short or mixed ones). Ids, sources and labels don't matter; null labels are never learnt. Without any label all go.
2. Exact dedup. Of texts equal without white space the one with the most code points stays, then the smallest id (null
   last). An empty text is a text like others.
3. N-gram Jaccard join. Of each group of linked documents the smallest id stays (null last). Texts without shingles stay.
4. Mixing. Documents as often as the mix takes them; a null source is a source of its own; empty texts count no words.
5. Byte-level BPE. A row for each copy: doc_id, n_tokens and two digests. A null text counts as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from keelson.llm import byte_bpe, common, exact_dedup, jaccard_join, language_id, mixing
from keelson.llm.queries import tokenizer

#: Where between chance (0) and certainty (1) a language counts as recognised; with four languages, a score of one half.
LEAST_CERTAINTY = 1 / 3


def _keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose row_key is in kept (a column `key`, distinct); of rows with equal keys one."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(0)
    keyed = docs.select(common.row_key("doc_id", "text").alias("key"), tie.alias("tie"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    first = F.row_number().over(W.partitionBy("key").orderBy("tie"))
    return keyed.join(kept.select("key"), "key").withColumn("nth", first).filter("nth = 1").select("row.*")


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is recognised: without letters, or without a clear prediction."""
    learnt = language_id.sample(docs)
    net = language_id.train(learnt) if learnt else None
    chance = 1 / len(net.langs) if net else 1.0
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_rest")
    seen = language_id.predict(docs.select("text", rest), net, ["text", "_rest"])
    found = seen.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= chance + LEAST_CERTAINTY * (1 - chance)))
    return found.select(*[F.col("text") if c == "text" else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep_rows(docs, exact_dedup.dedup(docs, keys=True).filter("kept").select("key").distinct())


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the smallest id stays; documents without shingles are no group."""
    rows = jaccard_join.join(docs.select("doc_id", "text"))
    first = rows.filter("n_shingles > 0").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("first"))
    alone = rows.filter("n_shingles = 0").select("key")
    return _keep_rows(docs, first.select("first.key").unionByName(alone).distinct())


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.emit(mixing.mix(docs, carry=True)).select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(docs, *tokenizer(), digests=True)


STAGES = [
    ("language_id", by_language),
    ("exact_dedup", without_copies),
    ("jaccard_join", without_near_copies),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: A network's predictions and BPE merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, home = common.table(spark, sf_dir, "documents"), common.shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = common.keep(stage(spark, docs, sf_dir), f"{home}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
