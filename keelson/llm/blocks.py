"""Rows that share a cell meet in blocks of bounded size: what both vector operators search with."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def meet(targets: DataFrame, requests: DataFrame, keys: list[str], work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, *, most: tuple[int, int], home: str) -> DataFrame:
    """work(targets, requests) of each pair of blocks with equal keys. Both sides have `rid`, a number that spreads their rows.

    A cell with more than `most` targets or requests is cut into as many blocks as its counts ask for, and every block of
    its targets meets every block of its requests, so no task gets more than about `most` rows of either, however many a
    cell holds. Cells that lack a side go nowhere. The counts are a table under `home`, so that both joins with it are
    between plain exchanges and Spark can split a cell there, too.
    """
    n = targets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_t")).join(requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_q")), keys)
    cuts = common.keep(n.select(*keys, F.ceil(F.col("n_t") / most[0]).cast("int").alias("t_cuts"), F.ceil(F.col("n_q") / most[1]).cast("int").alias("q_cuts")), home)
    own = lambda cuts: F.pmod(F.xxhash64("rid"), F.col(cuts)).cast("int")
    every = lambda cuts: F.explode(F.sequence(F.lit(0), F.col(cuts) - 1))
    t = targets.join(cuts, keys).withColumns({"t_block": own("t_cuts"), "asks": F.lit(False)}).withColumn("q_block", every("q_cuts"))
    q = requests.join(cuts, keys).withColumns({"q_block": own("q_cuts"), "asks": F.lit(True)}).withColumn("t_block", every("t_cuts"))
    both = t.drop("t_cuts", "q_cuts").unionByName(q.drop("t_cuts", "q_cuts"), allowMissingColumns=True)

    def block(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        return work(table.filter(pa.array(~asks)), table.filter(pa.array(asks)))

    return both.groupBy(*keys, "t_block", "q_block").applyInArrow(block, schema)


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix of doubles; shorter lists end in zeros."""
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, offsets = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64), held.offsets.to_numpy().astype(np.int64)
    length = np.diff(offsets)
    out = np.zeros((len(length), width))
    row = np.repeat(np.arange(len(length)), length)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)] = values
    return out


def centres(points: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means from evenly spread rows of a bounded sample; a centre that loses all its points stays where it is."""
    if not len(points):
        return np.zeros((1, points.shape[1]))
    found = np.unique(points[np.linspace(0, len(points) - 1, k).astype(int)], axis=0)
    for _ in range(rounds):
        near = squares(points, found).argmin(axis=1)
        held = np.bincount(near, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, near, points)
        found = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], found)
    return found


def squares(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all of `to`."""
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ to.T + (to**2).sum(1), 0)
