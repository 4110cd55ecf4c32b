"""op12 and op13 against brute force, and on awkward tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import blocks, embedding_dedup, hard_negatives

SHAPE = "vec_id long, embedding array<float>, label int, cell string, rid string, v string"
rng = np.random.default_rng(11)


def made(n=600, dims=8, hot=150):
    """Clusters, equal vectors, near copies of one vector, ties, repeated ids, and rows that take no part."""
    base = rng.normal(size=(40, dims))
    x = np.concatenate([base[rng.integers(0, 40, n - hot)] + rng.normal(size=(n - hot, dims)) * rng.choice([0.0, 0.02, 0.3], n - hot)[:, None], base[:1] + rng.normal(size=(hot, dims)) * 0.03])
    x = np.round(x / np.linalg.norm(x, axis=1)[:, None], 3).astype(np.float32)
    rows = [(k if k % 50 else k - k % 100, x[k].tolist(), int(rng.integers(0, 3)) if k < n - hot else 1) for k in range(n)]
    odd = [(700, None, 1), (701, [], 1), (702, [float("nan")] * dims, 1), (703, [None] * dims, 1), (704, x[0].tolist(), None), (None, x[0].tolist(), 1), (None, x[1].tolist(), 2), (705, [0.0] * dims, 1), (706, [1.0, 0.5], 1), (707, [float("inf")] + [0.0] * (dims - 1), 2), (800, x[3].tolist(), 0)]
    return rows + odd


ROWS = made()


@pytest.fixture(scope="module")
def vectors(spark):
    """Columns that could clash with those the operators make, too."""
    return spark.createDataFrame([(*r, "x", "y", "z") for r in ROWS], SHAPE).repartition(5)


def fine(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def padded(v, dims=8):
    return np.array([*v, *[0.0] * (dims - len(v))], np.float64)


def brute_negatives(rows):
    held = [(i, np.floor(256 * padded(v)), (lab + 1) % 3 if i is not None and i % 7 == 0 else lab) for i, v, lab in rows if lab is not None and fine(v)]
    order = lambda s: (-s[1], s[0] is None, s[0] or 0)
    out = []
    for k, (i, x, lab) in enumerate(held):
        if i is None or i % 100:
            continue
        scores = [(j, int(x @ y), other) for m, (j, y, other) in enumerate(held) if m != k]
        for p in sorted((s for s in scores if s[2] == lab), key=order)[:5]:
            fit = sorted((s for s in scores if s[2] != lab and 30 * p[1] <= 100 * s[1] <= 90 * p[1]), key=order)[:10]
            out += [(i, p[0], r + 1, s[0], p[1], s[1]) for r, s in enumerate(fit)]
    return sorted(out, key=repr)


def mined(frame, home):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 3).otherwise(F.col("label"))
    return hard_negatives.mine(frame, label, F.col("vec_id") % 100 == 0, home=f"file://{home}")


@pytest.mark.parametrize("block", [None, (50, 7)])
def test_negatives_equal_brute_force(spark, vectors, tmp_path, monkeypatch, block):
    if block:
        monkeypatch.setattr(hard_negatives, "BLOCK", block)
        monkeypatch.setattr(hard_negatives, "FIRST", 2)
        monkeypatch.setattr(hard_negatives, "GROWTH", 3)
    got = sorted(map(tuple, mined(vectors, tmp_path / "n").collect()), key=repr)
    assert got == brute_negatives(ROWS) and len(got) > 100


def test_negatives_of_empty_and_anchorless_tables(spark, vectors, tmp_path):
    assert mined(vectors.limit(0), tmp_path / "e").collect() == []
    assert mined(vectors.filter("vec_id = 1"), tmp_path / "f").collect() == []
    assert mined(vectors.filter("vec_id = 200 AND label IS NOT NULL").limit(1), tmp_path / "g").collect() == []


def test_products_beyond_doubles_stay_exact():
    a = np.array([[2.0**22 + 1] * 700])
    assert hard_negatives._products(a * 1, a)[0, 0] == float(700 * (2**22 + 1) ** 2)


def brute_classes(rows):
    held = [(k, padded(v)) for k, (_, v, lab) in enumerate(rows) if lab is not None and fine(v) and any(v)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, x) in enumerate(held):
        for j, y in held[:n]:
            if rows[i][2] == rows[j][2] and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.98:
                links[i], links[j] = links[i] + 1, links[j] + 1
                parent[root(i)] = root(j)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root(k)] = min(least.get(root(k), r[0]), r[0])
    return sorted(((r[0], links[k], c := least.get(root(k)), r[0] == c) for k, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("block,reach", [(None, None), ((40, 30), 1.0)])
def test_classes_equal_brute_force(spark, vectors, tmp_path, monkeypatch, block, reach):
    if block:
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        monkeypatch.setattr(embedding_dedup, "CELL", 8)
    got = embedding_dedup.dedup(vectors, home=f"file://{tmp_path}/d", reach=reach)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_classes(ROWS)


def test_classes_of_empty_tables(spark, vectors, tmp_path):
    assert embedding_dedup.dedup(vectors.limit(0), home=f"file://{tmp_path}/h").collect() == []
    alone = embedding_dedup.dedup(vectors.filter("vec_id = 704"), home=f"file://{tmp_path}/i").collect()
    assert [tuple(r) for r in alone] == [(704, 0, 704, True)]


def test_recall_of_the_default_reach(spark, tmp_path):
    """Pairs of every cosine from 0.98 to 1 in 64 dimensions, far more codewords than the query would take: over 0.99 are found."""
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = r.normal(size=(600, 64))
    y -= (y * x).sum(1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    cosine = r.uniform(0.98, 1, 600)[:, None]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * y]))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    before, embedding_dedup.CELL = embedding_dedup.CELL, 2
    try:
        got = embedding_dedup.dedup(frame, home=f"file://{tmp_path}/r").agg(F.sum("n_links")).first()[0]
    finally:
        embedding_dedup.CELL = before
    assert got >= 0.99 * 1200


def test_the_walk_is_in_order_and_complete():
    first, second = rng.uniform(0, 1, 9), rng.uniform(0, 1, 7)
    got = list(embedding_dedup.multi_sequence(first, second, 0.8))
    sums = [first[i] + second[j] for i, j in got]
    assert sums == sorted(sums) and set(got) == {(i, j) for i in range(9) for j in range(7) if first[i] + second[j] <= 0.8}


def test_bounds_of_regions_hold():
    book, points = rng.normal(size=(12, 5)), rng.normal(size=(300, 5))
    near, least = embedding_dedup.away(points, book)
    apart = np.sqrt(blocks.squares(points, points))
    assert all((least[:, near[k]] <= apart[:, k] + 1e-9).all() for k in range(300))


def test_forest_spans_the_links():
    linked = rng.uniform(size=(30, 40)) < 0.03
    row, column = embedding_dedup.forest(linked.copy())
    assert linked[row, column].all()

    def classes(pairs):
        label = list(range(70))
        for _ in range(70):
            for a, b in pairs:
                label[a] = label[b + 30] = min(label[a], label[b + 30])
        return label

    assert classes(list(zip(row, column, strict=True))) == classes(list(zip(*np.nonzero(linked), strict=True)))
    assert len(row) == 70 - len(set(classes(list(zip(row, column, strict=True)))))
