"""Hard-negative mining with one-dimensional distance keys, by integer inner products.

Vectors get one more component, sqrt(M - |x|^2) with M the largest squared norm, and queries a zero there: then the nearest vectors
are those of the greatest inner product. Each vector's key is (its nearest pivot, its distance from it); the index is a
table that lies sorted by the key in the shared folder. A pivot's distances are cut at quantiles into annuli, and of
each annulus the least and greatest distance and the count are known: PIVOTS * ANNULI rows, whatever the corpus.

A query's distance from a pivot bounds, by the triangle inequality, the scores within an annulus from both sides. The query
asks the annuli with the highest bounds first, a share that expands by GROWTH each round, and in each it meets the index in blocks
of bounded size. It is done when its k-th score is higher than the bound of every annulus that it hasn't asked, so the
results are exact; equal scores go to the smaller id. Positives are one such search among the same label, the
negatives of each positive another one among other labels, within a window of scores, which rules out annuli on both ends.

In high dimensions without clusters few annuli can be ruled out, and most of the index is read; the results don't change.

Defined results: rows without a label or vector, or with a null, non-finite or too large component (LARGEST) take no part.
Null ids are no anchors and come after all others among equal scores, and keep their own label. Repeated ids and equal rows are
rows of their own, told apart by a number. Shorter vectors count as ending in zeros, an empty one scores 0. An empty
table, or one without anchors, gives an empty result. Other columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import blocks, common

#: Pivots, annuli of each, rows of the sample that pivots are fitted on, annuli asked first, and how much more each round.
PIVOTS, ANNULI, SAMPLE, FIRST, GROWTH = 16, 8, 4096, 16, 8
#: Rows of the index and queries that meet in one block.
BLOCK = (4096, 512)
#: Components are below this in size, so their products are whole numbers that doubles hold.
LARGEST = 1 << 23
SCALE = 256


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))


def usable(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST / SCALE)
    return vector.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))


def augmented(v: np.ndarray, norm: float) -> np.ndarray:
    return np.concatenate([v, np.sqrt(np.maximum(norm - (v**2).sum(1), 0))[:, None]], 1)


class Index:
    """rows: rid, vec_id, label, v (whole numbers)."""

    def __init__(self, rows: DataFrame, home: str):
        self.home, self.spark, self.turn = home, rows.sparkSession, 0
        whole = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
        most = rows.agg(F.max(whole), F.max(F.size("v"))).first()
        self.norm, self.width = float(most[0] or 0), most[1] or 0
        self.norm = self.norm * (1 + 1e-9) + 1  # so that rounding leaves no negative rest
        sample = rows.select("v", F.xxhash64("rid", "vec_id").alias("at")).orderBy("at").limit(SAMPLE).select("v").toArrow()
        self.pivots = blocks.centres(augmented(blocks.matrix(sample.column("v"), self.width), self.norm), PIVOTS)
        placed = common.keep(rows.mapInArrow(self._place(), "rid long, vec_id long, label long, v array<int>, pivot int, distance double"), f"{home}/placed")
        at = [k / ANNULI for k in range(1, ANNULI)]
        bounds = placed.groupBy("pivot").agg(F.percentile_approx("distance", at, 1000).alias("bounds"))
        annulus = F.size(F.filter("bounds", lambda b: b < F.col("distance")))
        # one row a pivot; equal distances share an annulus, so the rows are spread by their number, too
        celled = placed.join(F.broadcast(bounds), "pivot").withColumn("cell", F.col("pivot") * ANNULI + annulus)
        celled = celled.repartitionByRange("cell", "distance", "rid").sortWithinPartitions("cell", "distance").drop("bounds", "pivot")
        self.rows = common.keep(celled, f"{home}/index")
        edges = self.rows.groupBy("cell").agg(F.min("distance").alias("least"), F.max("distance").alias("most")).orderBy("cell").toArrow()
        self.cells, self.least, self.most = (edges.column(c).to_numpy() for c in ("cell", "least", "most"))

    def _place(self):
        pivots, width, norm = self.pivots, self.width, self.norm

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                far = blocks.squares(augmented(blocks.matrix(batch.column("v"), width), norm), pivots)
                near = far.argmin(1)
                extra = [pa.array(near.astype(np.int32)), pa.array(np.sqrt(far[np.arange(len(near)), near]))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "pivot", "distance"])

        return work

    def search(self, queries: DataFrame, k: int, *, same: bool) -> DataFrame:
        """queries: qid (distinct), rid (of the row itself, which is no result), label, v, least, most (of scores; null: open).

        Rows qid, score, vec_id, rid, rank: the first k rows of the same label, or of another one, by score, then vec_id.
        """
        self.turn += 1
        home = f"{self.home}/search{self.turn}"
        queries = common.keep(queries.select("qid", "rid", "label", "v", "least", "most"), f"{home}/queries")
        order = W.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
        found, asked, size = None, 0, FIRST
        while asked < max(len(self.cells), 1):
            known = queries
            if found is None:
                known = queries.withColumns({"n": F.lit(0).cast("long"), "kth": F.lit(None).cast("double")})
            else:
                known = queries.join(found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")), "qid", "left").fillna(0, ["n"])
            requests = common.keep(known.mapInArrow(self._ask(k, asked, size), REQUEST), f"{home}/requests{asked}")
            if requests.isEmpty():
                break
            held = self.rows.select("cell", "rid", "vec_id", "label", "v")
            met = blocks.meet(held, requests, ["cell"], self._best(k, same), "qid long, score double, vec_id long, rid long", most=BLOCK, home=f"{home}/cuts{asked}")
            met = met if found is None else met.unionByName(found.drop("rank"))
            found = common.keep(met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), f"{home}/found{asked}")
            asked, size = asked + size, size * GROWTH
        return found if found is not None else self.spark.createDataFrame([], "qid long, score double, vec_id long, rid long, rank int")

    def _ask(self, k: int, asked: int, size: int):
        """Of each query the next `size` annuli behind the `asked` ones, unless its k results are certain already."""
        pivots, cells, least, most, norm, width = self.pivots, self.cells, self.least, self.most, self.norm, self.width

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = blocks.matrix(batch.column("v"), width)
                own = (v**2).sum(1)
                far = np.sqrt(blocks.squares(np.concatenate([v, np.zeros((len(v), 1))], 1), pivots))[:, cells // ANNULI]
                slack = 1e-6 * (norm + own)[:, None] + 1e-3
                high = (own[:, None] + norm - np.maximum(np.maximum(least - far, far - most), 0) ** 2) / 2 + slack
                low = (own[:, None] + norm - (far + most) ** 2) / 2 - slack
                floor, top, kth = (_doubles(batch.column(c), x) for c, x in (("least", -np.inf), ("most", np.inf), ("kth", -np.inf)))
                high = np.minimum(high, top[:, None])  # what is left of an annulus below the window's upper end
                open_ = (high >= floor[:, None]) & (low <= top[:, None])
                rank = np.argsort(np.argsort(np.where(open_, -high, np.inf), axis=1, kind="stable"), axis=1)
                full = batch.column("n").to_numpy() >= k
                now = open_ & (rank >= asked) & (rank < asked + size) & ~(full[:, None] & (high < kth[:, None]))
                row, cell = np.nonzero(now)
                if len(row):
                    part = pa.Table.from_batches([batch]).take(pa.array(row)).combine_chunks().to_batches()[0]
                    columns = {"cell": pa.array(cells[cell], pa.int32())} | {c: part.column(c) for c in ("qid", "rid", "label", "v")}
                    columns |= {"floor": pa.array(np.maximum(floor, np.where(full, kth, -np.inf))[row]), "top": pa.array(top[row])}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        return work

    def _best(self, k: int, same: bool):
        width = self.width

        def work(targets: pa.Table, requests: pa.Table) -> pa.Table:
            ids = targets.column("vec_id")
            order = np.lexsort((targets.column("rid").to_numpy(), np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())))
            targets = targets.take(pa.array(order))
            t, q = blocks.matrix(targets.column("v"), width), blocks.matrix(requests.column("v"), width)
            score = _products(q, t)
            fits = (requests.column("label").to_numpy()[:, None] == targets.column("label").to_numpy()) == same
            fits &= requests.column("rid").to_numpy()[:, None] != targets.column("rid").to_numpy()
            fits &= (score >= requests.column("floor").to_numpy()[:, None]) & (score <= requests.column("top").to_numpy()[:, None])
            score = np.where(fits, score, -np.inf)
            if score.shape[1] > k:
                least = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
                fits &= score >= least
            row, at = np.nonzero(fits)
            order = np.lexsort((at, -score[row, at], row))
            row, at = row[order], at[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            row, at = row[nth < k], at[nth < k]
            part = targets.select(["vec_id", "rid"]).take(pa.array(at))
            return pa.table({"qid": requests.column("qid").take(pa.array(row)), "score": pa.array(score[row, at], pa.float64()), "vec_id": part.column("vec_id"), "rid": part.column("rid")})

        return work


REQUEST = "cell int, qid long, rid long, label long, v array<int>, floor double, top double"


def _doubles(column: pa.Array, empty: float) -> np.ndarray:
    return np.asarray(column.cast(pa.float64()).fill_null(empty), np.float64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, through integers where doubles might not hold a sum."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    return a @ b.T if most < 2**53 else (a.astype(np.int64) @ b.astype(np.int64).T).astype(np.float64)


def mine(vectors: DataFrame, label: Column, anchors: Column, *, home: str, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """vectors: vec_id, embedding and label. label: a whole number; anchors: which rows are.

    Of each anchor's first `positives` rows of its label, the first `negatives` rows of other labels whose score is
    between the given percentages of the positive's. Rows anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. home: a folder that executors and driver share.
    """
    held = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").alias("v"))
    held = held.filter(F.col("label").isNotNull() & usable(F.col("v"))).withColumn("v", quantised(F.col("v")))
    rows = common.keep(held.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "v"), f"{home}/rows")
    index = Index(rows, home)
    asking = common.keep(rows.filter(anchors), f"{home}/anchors")
    open_ = {"least": F.lit(None).cast("double"), "most": F.lit(None).cast("double")}
    near = index.search(asking.select(F.col("rid").alias("qid"), "rid", "label", "v").withColumns(open_), positives, same=True)
    score, (low, high) = F.col("score").cast("long"), window
    pairs = near.filter("score >= 0").select(
        (F.col("qid") * positives + F.col("rank") - 1).alias("pair"), F.col("qid").alias("rid"), F.col("vec_id").alias("positive_id"), score.alias("positive_score"),
        F.expr(f"cast({low} * cast(score AS LONG) + 99 AS LONG) div 100").cast("double").alias("least"), F.expr(f"({high} * cast(score AS LONG)) div 100").cast("double").alias("most"),
    )
    pairs = common.keep(pairs.join(asking, "rid"), f"{home}/pairs")
    out = index.search(pairs.select(F.col("pair").alias("qid"), "rid", "label", "v", "least", "most"), negatives, same=False)
    named = out.select(F.col("qid").alias("pair"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").cast("long").alias("negative_score"))
    named = named.join(pairs.select("pair", F.col("vec_id").alias("anchor_id"), "positive_id", "positive_score"), "pair")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
