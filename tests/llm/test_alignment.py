"""op11 against the tokenizers' libraries and nested loops."""

import hashlib
import json
from collections import Counter

import numpy as np
import pytest

from keelson.llm import queries
from keelson.llm import tokenizer_alignment as alignment

TEXTS = [
    None, "", " ", "  \n\n x", "hello world, hello!", "naïve café déjà vu", "中文 and 🙂 emoji", "a ▁ b", "<|endoftext|> </s> <s> <0x41>", "\x00\x01 \x7f", "x" * 5000, "ab " * 3000, " " * 700 + "y",
    "hello world, hello!", "l'été 1234567890 $%&*", "Ünïcödé space wide", "don't can't we'll I'm", "\r\n\ttabs\tand\x0b\x0c",
]


@pytest.fixture(scope="module")
def models():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return queries._vocabulary("byte_bpe_50k.json"), queries._vocabulary("piece_bpe_32k.model"), public_tokenizers.PATTERN


def brute(texts, a, b):
    rows, links = [], []
    for text in texts:
        ids_a, ids_b = (a.encode([text])[0], b.encode([text])[0]) if text else ([], [])
        if not text or any(b"".join(s.strings[i] for i in ids) != (" " + text).encode() for s, ids in ((a, ids_a), (b, ids_b))):
            rows.append((0, 0, 0, "", 0, 0))
            links.append([])
            continue
        at_a, at_b = ([sum(len(s.strings[i]) for i in ids[: k + 1]) for k in range(len(ids))] for s, ids in ((a, ids_a), (b, ids_b)))
        shared = sorted(set(at_a) & set(at_b))
        groups, before, products = [], 0, 0
        for end in shared:
            left = [i for i, e in zip(ids_a, at_a, strict=True) if before < e <= end]
            right = [i for i, e in zip(ids_b, at_b, strict=True) if before < e <= end]
            groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
            before, products = end, products + len(left) * len(right)
        links.append([(i, j) for i, e in zip(ids_a, at_a, strict=True) for j, f in zip(ids_b, at_b, strict=True) if e == f])
        rows.append((len(ids_a), len(ids_b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), len(set(at_a) | set(at_b)), products))
    count = Counter(x for each in links for x in each)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return [(k, r[0], r[1], r[2], len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), *r[3:]) for k, (r, x) in enumerate(zip(rows, links, strict=True))]


def test_alignment_equals_nested_loops(spark, tmp_path, models):
    texts = [t if t is None or len(t) < 2000 else t[:2000] for t in TEXTS]  # the loops are quadratic
    a, b = alignment.byte_level(models[0].decode(), models[2]), alignment.word_pieces(models[1])
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, links string, n_a int").repartition(3)
    got = sorted(map(tuple, alignment.align(docs, *models, home=f"file://{tmp_path}/a").collect()))
    assert got == brute(texts, a, b)
    assert got[7][1:] == (0, 0, 0, 0, 0, 0, "", 0, 0)  # a word start of its own can't be told from a space


def test_alignment_of_null_ids_and_an_empty_table(spark, tmp_path, models):
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    got = alignment.align(docs, *models, home=f"file://{tmp_path}/b").collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "3", "None"] and len({tuple(r)[1:] for r in got}) == 1
    assert alignment.align(docs.limit(0), *models, home=f"file://{tmp_path}/c").collect() == []


def test_merging_by_rank_gives_the_librarys_ids(models):
    slow, fast = alignment.byte_level(models[0].decode(), models[2]), alignment.byte_level(models[0].decode(), models[2], True)
    assert alignment.ranked(models[0].decode())
    texts = [t for t in TEXTS if t] + [c + d + c for c in map(chr, range(256)) for d in ("", " ", "a", "'s", "\n 1")]
    assert slow.encode(texts) == fast.encode(texts)


def test_vocabularies_that_rank_does_not_merge_are_found():
    alphabet = list(alignment.byte_alphabet())
    model = lambda *merges: json.dumps({"model": {"vocab": {c: i for i, c in enumerate(alphabet)} | {a + b: 256 + k for k, (a, b) in enumerate(merges)}, "merges": [f"{a} {b}" for a, b in merges]}})
    assert alignment.ranked(model(("a", "b"), ("ab", "c")))
    assert not alignment.ranked(model(("b", "c"), ("a", "b"), ("ab", "c")))  # abc alone comes to a, bc
    swapped = json.loads(model(("a", "b"), ("c", "d")))
    swapped["model"]["vocab"] |= {"ab": 257, "cd": 256}
    assert not alignment.ranked(json.dumps(swapped))


def test_linkable_lists_every_pair_that_ends_together():
    a, b = [b"", b"x", b"ax", b"ba", b"a"], [b"x", b"bax", b"a", b""]
    assert alignment.linkable(a, b).tolist() == sorted(i * 4 + j for i, x in enumerate(a) for j, y in enumerate(b) if x and y and (x.endswith(y) or y.endswith(x)))


def test_elementary_intervals_of_one_text():
    rng = np.random.default_rng(3)
    for _ in range(50):
        size = int(rng.integers(1, 40))
        ends = [np.r_[np.sort(rng.choice(np.arange(1, size), rng.integers(0, size), replace=False)), size] if size > 1 else np.array([1]) for _ in range(2)]
        got = alignment.aligned(*ends)
        spans = [list(zip([0, *e[:-1]], e, strict=True)) for e in ends]
        overlaps = [(i, j, min(a[1], b[1]) - max(a[0], b[0])) for i, a in enumerate(spans[0]) for j, b in enumerate(spans[1]) if min(a[1], b[1]) > max(a[0], b[0])]
        assert sorted(map(tuple, got["overlaps"].tolist())) == sorted(overlaps)
        shared = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        group = lambda e: next(k for k, s in enumerate(shared) if e <= s)
        assert sorted(map(tuple, got["products"].tolist())) == sorted((i, j) for i, a in enumerate(ends[0]) for j, b in enumerate(ends[1]) if group(a) == group(b))
        assert len(got["groups"]) == len(shared)
