"""The pipeline's stages, each on its own, on awkward rows."""

import corpus_pipeline as P
from keelson.llm import common

from .test_operators import AWKWARD, DOCS, brute_components, prose, shingles


def test_stages(spark):
    rows = [*AWKWARD, *[(100 + i, prose(120, i), "en", f"s{i % 3}") for i in range(40)], (300, prose(120, 0) + " more", "en", "s0"), (301, prose(120, 1).replace(" ", "  "), "en", "s1")]
    rows += [(400, prose(90, 400), "en", "s2"), (400, prose(90, 400), "de", "s0"), (401, "12 34 56 " * 20, "en", "s1")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "length(text) AS n_chars", "'x' AS _row", "'y' AS key", "1 AS row", "2 AS nth", "3 AS `a.b`")
    at, kept = docs, {}
    for name, stage in P.STAGES:
        at = common.keep(stage(spark, at, ""), common.shared_dir(spark))
        if name != "byte_bpe":
            assert at.columns == docs.columns
        kept[name] = sorted((r.doc_id for r in at.collect()), key=repr)
    assert {101, 110, 300, 301} <= set(kept["language_id"]) and not {1, 2, 5, 401} & set(kept["language_id"])
    exact = kept["exact_dedup"]
    assert len(exact) == len(set(exact)) and 301 in exact and 101 not in exact and 3 in exact and 4 not in exact
    assert 100 in kept["jaccard_join"] and 300 not in kept["jaccard_join"]
    assert set(kept["mixing"]) <= set(kept["jaccard_join"])
    assert kept["byte_bpe"] == kept["mixing"]


def brute_stages(docs):
    """The ids that stages 2 and 3 keep, by plain loops."""
    exact = [(d, t) for d, t in docs]
    norm = lambda t: "".join((t or "").split(" ")).translate({c: None for c in range(9, 14)})
    best = {}
    for d, t in exact:
        best[norm(t)] = min(best.get(norm(t), (1, 0, 0, t)), (-len(t or ""), d is None, d or 0, t), key=lambda x: x[:3])
    kept = [(x[2] if not x[1] else None, x[3]) for x in best.values()]
    parts, near = brute_components(kept), []
    for d, t in kept:
        n = len(shingles(t))
        if not n or (d, n, d) in parts:
            near.append(d)
    return sorted((d for d, _ in kept), key=repr), sorted(near, key=repr)


def test_dedup_stages_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    frame = spark.createDataFrame([(d, t, "en", "s") for d, t in docs], DOCS)
    exact = common.keep(P.without_copies(spark, frame, ""), common.shared_dir(spark))
    near = P.without_near_copies(spark, exact, "")
    ids = lambda f: sorted((r.doc_id for r in f.collect()), key=repr)
    assert (ids(exact), ids(near)) == brute_stages(docs)


def test_equal_rows_choose_alike(spark):
    rows = [(1, "same text here", lang, s) for lang in ("en", "de", "fr") for s in ("a", "b")]
    picked = {tuple(P.without_copies(spark, spark.createDataFrame(r, DOCS).repartition(n), "").first()) for n, r in ((1, rows), (3, rows[::-1]))}
    assert len(picked) == 1


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in P.STAGES:
        docs = common.keep(stage(spark, docs, ""), common.shared_dir(spark))
    assert docs.count() == 0
