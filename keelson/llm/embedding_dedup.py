"""Near-duplicate embeddings by an inverted multi-index.

Vectors are brought to length one and halved. Each half has a codebook of its own (k-means on at most SAMPLE vectors, picked by a
hash), and a cell of the index is a label and a pair of codewords. Every vector is in the index.

A vector visits cells in the order of their distance by the multi-sequence algorithm: both halves' codewords are sorted by how far the
vector is from their regions (a lower bound, by the planes between codewords), and a heap walks the product of the two
sequences from its near corner. A pair of cosine `cosine` is apart by delta = sqrt(2 - 2 * cosine) at most. The walk ends when the
distance exceeds `reach` deltas: at 1 no pair can be missed; by default it is SIGMAS / sqrt(dimension), the length that a
difference of delta in a random direction has across a plane with a chance of 1 in 6,000. Of two cells only the
earlier one's vectors visit the other, so each pair is verified once, as a cosine in double precision.

Equal vectors of a label are one entry with a count. Cells with many entries are cut into blocks (see blocks.meet), which
give sums of links and a spanning forest of the links in them, never the links themselves; components of the forests are
those of the links. A group of M different near copies still costs M * M / 2 products in numpy.

Defined results: null labels, null, empty, zero vectors and those with null or non-finite components link with nothing. They are classes of their
own row; null ids, too, except that a class has the smallest id that isn't null. Repeated ids and equal rows are rows of their own that link with each other. Shorter
vectors count as ending in zeros. `kept` is whether the row's id is its class's, so rows that share the id share
it. An empty table gives an empty result; other columns never matter.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, common
from .components import components

COSINE = 0.98
#: Rows that codebooks are fitted on; entries of a cell that a label evenly spread over the product grid would have; largest codebook.
SAMPLE, CELL, LARGEST_BOOK = 8192, 64, 256
SIGMAS = 3.6
BLOCK = (2048, 2048)


def usable(vector):
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True, initial=1e-300)  # squares of very small and large components stay in range
    return v / np.sqrt((v**2).sum(1))[:, None]


def away(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest codeword, least distance to the region of each): a region lies beyond the planes halfway to all other codewords."""
    far = blocks.squares(points, book)
    apart = np.sqrt(blocks.squares(book, book))
    np.fill_diagonal(apart, np.inf)
    least = np.zeros_like(far)
    for m in range(len(book)):  # beyond the plane towards m
        np.maximum(least, (far - far[:, m : m + 1]) / (2 * np.maximum(apart[m], 1e-12)), out=least)
    near = far.argmin(1)
    least[np.arange(len(near)), near] = 0
    return near, least


def multi_sequence(first: np.ndarray, second: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Pairs of places in the order of first + second (both not negative), up to the limit."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    heap = [(x[0] + y[0], 0, 0)]
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > limit:
            return
        yield int(a[i]), int(b[j])
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """linked: a matrix of rows and columns. Links (row, column) of a spanning forest."""
    rows, columns = linked.any(1), linked.any(0)
    free = columns.copy()
    from_row, to_column = [], []
    for start in np.flatnonzero(rows):
        if not rows[start]:
            continue
        rows[start], stack = False, [int(start)]
        while stack:
            r = stack.pop()
            for c in np.flatnonzero(linked[r] & free).tolist():
                free[c] = False
                from_row.append(r)
                to_column.append(c)
                more = np.flatnonzero(linked[:, c] & rows)
                rows[more] = False
                from_row += more.tolist()
                to_column += [c] * len(more)
                stack += more.tolist()
    return np.array(from_row, np.int64), np.array(to_column, np.int64)


def dedup(vectors: DataFrame, *, home: str, cosine: float = COSINE, reach: float | None = None) -> DataFrame:
    """vectors: vec_id, embedding and label. Per row vec_id, n_links, component_id, kept. home: a folder that executors and driver share."""
    held = vectors.select("vec_id", "label", F.col("embedding").alias("v"))
    held = held.withColumn("v", F.when(F.col("label").isNotNull() & usable(F.col("v")), F.col("v")))
    rows = common.keep(held.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v"), f"{home}/rows")
    entries = rows.filter("v IS NOT NULL").groupBy("label", "v").agg(F.min("row").alias("rid"), F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    entries = common.keep(entries, f"{home}/entries")
    size = entries.agg(F.count(F.lit(1)), F.count_distinct("label"), F.max(F.size("v"))).first()
    width = size[2] or 1
    sample = entries.select("v", F.xxhash64("rid", F.lit(13)).alias("at")).orderBy("at").limit(SAMPLE).select("v").toArrow()
    words = min(LARGEST_BOOK, max(2, math.ceil(math.sqrt(size[0] / max(size[1], 1) / CELL))))
    points = units(blocks.matrix(sample.column("v"), width))
    books = blocks.centres(points[:, : width // 2], words), blocks.centres(points[:, width // 2 :], words)
    delta = math.sqrt(2 - 2 * cosine)
    limit = (min(1.0, SIGMAS / math.sqrt(width)) if reach is None else reach) ** 2 * delta**2 + 1e-9

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = units(blocks.matrix(batch.column("v"), width))
            (near_a, far_a), (near_b, far_b) = away(u[:, : width // 2], books[0]), away(u[:, width // 2 :], books[1])
            own = near_a * len(books[1]) + near_b
            far_a, far_b = far_a**2, far_b**2
            visited = [[c for i, j in multi_sequence(far_a[k], far_b[k], limit) if (c := i * len(books[1]) + j) >= own[k]] for k in range(len(own))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(visited, pa.list_(pa.int32()))], [*batch.schema.names, "cell", "visited"])

    kind, of = rows.schema["label"].dataType.simpleString(), rows.schema["v"].dataType.simpleString()
    placed = entries.select("label", "v", "rid", "n").mapInArrow(visit, f"label {kind}, v {of}, rid long, n long, cell int, visited array<int>")
    placed = common.keep(placed, f"{home}/placed")

    def verify(targets: pa.Table, requests: pa.Table) -> pa.Table:
        t, q = blocks.matrix(targets.column("v"), width), blocks.matrix(requests.column("v"), width)
        t_id, q_id = targets.column("rid").to_numpy(), requests.column("rid").to_numpy()
        linked = units(q) @ units(t).T >= cosine
        inside = requests.column("own").to_numpy()  # of one cell, the smaller number asks
        linked &= ~inside[:, None] | (q_id[:, None] < t_id)
        row, column = forest(linked)
        n_q, n_t = linked @ targets.column("n").to_numpy(), requests.column("n").to_numpy() @ linked
        some_q, some_t = n_q > 0, n_t > 0
        rid = np.concatenate([q_id[some_q], t_id[some_t], q_id[row]])
        links = np.concatenate([n_q[some_q], n_t[some_t], np.zeros(len(row), np.int64)])
        other = pa.array(np.concatenate([np.zeros(some_q.sum() + some_t.sum(), np.int64), t_id[column]]), mask=np.arange(len(rid)) < some_q.sum() + some_t.sum())
        return pa.table({"rid": pa.array(rid, pa.int64()), "links": pa.array(links, pa.int64()), "other": other})

    requests = placed.select("label", "v", "rid", "n", F.col("cell").alias("at"), F.explode("visited").alias("cell"))
    requests = common.keep(requests.withColumn("own", F.col("at") == F.col("cell")).drop("at"), f"{home}/requests")
    found = blocks.meet(placed.drop("visited"), requests, ["label", "cell"], verify, "rid long, links long, other long", most=BLOCK, home=f"{home}/cuts")
    found = common.keep(found, f"{home}/found")
    links = found.filter("other IS NULL").groupBy("rid").agg(F.sum("links").alias("links"))
    labels = components(found.filter("other IS NOT NULL").select(F.col("rid").alias("a"), F.col("other").alias("b")), f"{home}/components")
    known = entries.join(links, "rid", "left").join(labels.select(F.col("node").alias("rid"), F.col("label").alias("component")), "rid", "left")
    known = common.keep(known.select("label", "v", "first_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rid").alias("component")), f"{home}/known")
    smallest = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = common.keep(known.join(smallest, "component").select("label", "v", "n_links", "component_id"), f"{home}/classes")
    out = rows.select("vec_id", "label", "v").join(classes, ["label", "v"], "left")
    # a row with a vector has its class's smallest id, which is null only if all of them are
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.col("vec_id").eqNullSafe(component)).alias("kept"))
