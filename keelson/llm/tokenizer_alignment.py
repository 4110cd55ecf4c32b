"""Alignment of two tokenizers' tokens over the same bytes, by elementary intervals.

A batch of texts is laid end to end. The sorted union of both tokenizers' token ends gives the elementary intervals, and
np.searchsorted gives each interval's owner on either side: an interval is one overlap of two tokens. Where both owners
end at the interval's end, a group of tokens closes, and the two are linked; all pairs of a group's tokens, which `products`
counts, are the ranges' sizes multiplied. `aligned` has overlaps, groups and products of one text in full.

Two tokens that end together cover the same last bytes, so the shorter one is a suffix of the longer one. The pairs that can ever be
linked are therefore listed from the two vocabularies alone (`linkable`; no more than the bytes in both), whatever the
corpus. A first pass writes each text's links as numbers of such pairs to the shared folder; Spark counts them; the
counts, an array of that length, go back to the tasks, which read the table again and sum up.

Encoding is left to the tokenizers' own libraries, inside the tasks.

Defined results: null and empty texts, and those whose tokens don't spell a space and the text, have no tokens: zeros and
an empty digest. Null, repeated and clashing ids are ids like others, equal rows get equal rows and count as often as
they stand, an empty table gives an empty result, other columns never matter. A text is aligned by one task: memory
grows with the longest one, by about 150 bytes a byte.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_bpe, common

#: Bytes of text that are aligned at a time, and the tokens whose decimal ids are spelt at a time.
AT_A_TIME, SPELT = 1 << 20, 1 << 18
WORD_START = "▁"
WIDE = re.compile("[^\x00-\xff]")
#: Rows whose links are summed up at a time.
SUMMED = 500


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary: themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """One tokenizer. strings: the bytes of every id; encode: the ids of each text, a space before it included."""

    def __init__(self, strings: list[bytes], encode: Callable[[list[str]], list[list[int]]]):
        self.strings, self.encode = strings, encode
        self.spell = byte_bpe.Speller(dict(enumerate(strings)))
        self.length = self.spell.length

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int32) for ids in self.encode(texts)]


def byte_level(model: str, pattern: str, by_rank: bool = False) -> Side:
    """A byte-level BPE of the tokenizers library, or with by_rank (see `ranked`) of the faster tiktoken library.

    The two libraries' own tables of letters could differ, so the second one gets Latin-1 texts only.
    """
    from tokenizers import Tokenizer

    held, alphabet = json.loads(model), byte_alphabet()
    names = {**held["model"]["vocab"], **{x["content"]: x["id"] for x in held.get("added_tokens", [])}}
    strings = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        strings[i] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()

    @functools.cache
    def library() -> Tokenizer:
        coder = Tokenizer.from_str(model)
        coder.encode_special_tokens = True
        return coder

    def ids(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in library().encode_batch([" " + t for t in texts], add_special_tokens=False)] if texts else []

    if not by_rank:
        return Side(strings, ids)
    import tiktoken

    added = {x["id"] for x in held.get("added_tokens", [])}
    coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={s: i for i, s in enumerate(strings) if s and i not in added}, special_tokens={})

    def faster(texts: list[str]) -> list[list[int]]:
        narrow = [t.isascii() or not WIDE.search(t) for t in texts]
        rest = iter(ids([t for t, n in zip(texts, narrow, strict=True) if not n]))
        return [coder.encode_ordinary(" " + t) if n else next(rest) for t, n in zip(texts, narrow, strict=True)]

    return Side(strings, faster)


def ranked(model: str) -> bool:
    """Whether merging by the ids' order gives what the list of merges gives.

    So it is if merges make the ids in their order, each from two tokens that its bytes alone come to before it. Then two
    neighbours that spell a token are the pair it is made of, for nothing has merged across their ends.
    """
    held, alphabet = json.loads(model)["model"], byte_alphabet()
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in held["merges"]]
    if any(held["vocab"].get(a + b) != len(alphabet) + k for k, (a, b) in enumerate(merges)) or len({a + b for a, b in merges}) < len(merges):
        return False
    rank = {pair: k for k, pair in enumerate(merges)}
    for pair in merges:
        parts = list("".join(pair))
        while len(parts) > 2:
            least = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), len(rank)))
            if (parts[least], parts[least + 1]) not in rank:
                return False
            parts[least : least + 2] = [parts[least] + parts[least + 1]]
        if tuple(parts) != pair:
            return False
    return True


def word_pieces(model: bytes) -> Side:
    """A BPE of the sentencepiece library, which puts the space before the text by itself."""
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [coder.id_to_piece(i) for i in range(coder.get_piece_size())]
    strings = [bytes([int(n[3:5], 16)]) if coder.is_byte(i) else n.replace(WORD_START, " ").encode() for i, n in enumerate(names)]
    return Side(strings, lambda texts: coder.encode(texts, num_threads=1) if texts else [])


def linkable(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sorted keys (a's id * len(b) + b's id) of all pairs of tokens that may end together over equal bytes."""
    found = set()
    for left, right, swapped in ((a, b, False), (b, a, True)):
        named: dict[bytes, list[int]] = {}
        for j, s in enumerate(right):
            if s:
                named.setdefault(s, []).append(j)
        for i, s in enumerate(left):
            for k in range(len(s)):
                found.update(j * len(b) + i if swapped else i * len(b) + j for j in named.get(s[k:], ()))
    return np.array(sorted(found), np.int64)


def cut(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends of the elementary intervals, their owners on either side, whether a group closes there)."""
    both = np.sort(np.concatenate((end_a, end_b)), kind="stable")  # np.union1d by merging: its own hashing is slower here
    ends = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    own_a, own_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    return ends, own_a, own_b, (end_a[own_a] == ends) & (end_b[own_b] == ends)


def aligned(end_a: np.ndarray, end_b: np.ndarray) -> dict[str, np.ndarray]:
    """Of one text: overlaps (a, b, bytes), groups (first and last a, first and last b), products (a, b): places of tokens."""
    ends, own_a, own_b, closes = cut(end_a, end_b)
    last_a, last_b = own_a[closes], own_b[closes]
    first_a, first_b = np.r_[0, last_a[:-1] + 1][: len(last_a)], np.r_[0, last_b[:-1] + 1][: len(last_b)]
    n_a, n_b = last_a - first_a + 1, last_b - first_b + 1
    size = n_a * n_b
    group = np.repeat(np.arange(len(size)), size)
    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return {
        "overlaps": np.stack([own_a, own_b, np.diff(ends, prepend=0)], 1), "groups": np.stack([first_a, last_a, first_b, last_b], 1),
        "products": np.stack([first_a[group] + nth // n_b[group], first_b[group] + nth % n_b[group]], 1),
    }


class Aligner:
    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        pairs = linkable(a.strings, b.strings)
        self.pair = byte_bpe.PairTable(*np.divmod(pairs, len(b.strings)), np.arange(len(pairs)))
        numbers = {}
        for k, (side, separator) in enumerate(((a, ","), (a, "|"), (b, ","), (b, ";"))):
            base = (k > 0) * len(a.strings) + (k > 1) * len(a.strings) + (k > 2) * len(b.strings)
            numbers.update((base + i, f"{i}{separator}".encode()) for i in range(len(side.strings)))
        self.number, self.last_a, self.in_b, self.last_b = byte_bpe.Speller(numbers), len(a.strings), 2 * len(a.strings), len(b.strings)

    def batch(self, texts: list[str | None]) -> dict[str, list]:
        """Columns of the texts, in their order: n_a, n_b, n_groups, n_overlaps, n_products, groups_sha256, links."""
        n = len(texts)
        out = {c: [0] * n for c in COUNTS} | {"groups_sha256": [""] * n, "links": [np.zeros(0, np.int32)] * n}
        at = [k for k, t in enumerate(texts) if t]
        ids_a, ids_b = self.a([texts[k] for k in at]), self.b([texts[k] for k in at])
        raw = [b" " + texts[k].encode() for k in at]
        fine = [i for i, r in enumerate(raw) if self.a.spell(ids_a[i]) == r and self.b.spell(ids_b[i]) == r]
        if not fine:
            return out
        ids_a, ids_b, at, raw = ([x[i] for i in fine] for x in (ids_a, ids_b, at, raw))
        bytes_to = np.cumsum([len(r) for r in raw])
        a, b = np.concatenate(ids_a), np.concatenate(ids_b)
        end_a, end_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        ends, own_a, own_b, closes = cut(end_a, end_b)
        last_a, last_b = own_a[closes], own_b[closes]
        n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        links = self.pair(a[last_a], b[last_b])
        # a group's tokens of a, then those of b; the last of each has a separator of its own
        code_a, code_b = a.astype(np.int64), b.astype(np.int64) + self.in_b
        code_a[last_a] += self.last_a
        code_b[last_b] += self.last_b
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.repeat(np.cumsum(n_b) - n_b, n_a)] = code_a
        codes[np.arange(len(b)) + np.repeat(np.cumsum(n_a), n_b)] = code_b
        to_cut, to_group = np.searchsorted(ends, bytes_to, "right"), np.searchsorted(ends[closes], bytes_to, "right")
        to_product = np.r_[0, np.cumsum(n_a * n_b)][to_group]
        from_cut = from_group = from_product = from_code = 0
        for i, k in enumerate(at):
            to_code = from_code + len(ids_a[i]) + len(ids_b[i])
            digest, last = hashlib.sha256(), b""
            for part in range(from_code, to_code, SPELT):
                digest.update(last)
                last = self.number(codes[part : min(part + SPELT, to_code)])
            digest.update(last[:-1])
            row = (len(ids_a[i]), len(ids_b[i]), to_group[i] - from_group, to_cut[i] - from_cut, to_product[i] - from_product)
            for c, v in zip(COUNTS, row, strict=True):
                out[c][k] = int(v)
            out["groups_sha256"][k], out["links"][k] = digest.hexdigest(), links[from_group : to_group[i]]
            from_cut, from_group, from_product, from_code = to_cut[i], to_group[i], to_product[i], to_code
        return out


COUNTS = ("n_a", "n_b", "n_groups", "n_overlaps", "n_products")


@functools.lru_cache(maxsize=2)
def _aligner(model_a: bytes, model_b: bytes, pattern: str, by_rank: bool) -> Aligner:
    """Kept by the worker for its next tasks."""
    return Aligner(byte_level(model_a.decode(), pattern, by_rank), word_pieces(model_b))


def align(docs: DataFrame, model_a: bytes, model_b: bytes, pattern: str, *, home: str) -> DataFrame:
    """docs: doc_id, text. Per row doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps, n_products.

    home: a folder that executors and driver share.
    """
    docs = docs.select("doc_id", "text")
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    models = spark.sparkContext.broadcast((model_a, model_b, pattern, ranked(model_a.decode())))
    names = ["doc_id", *COUNTS, "groups_sha256", "links"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*models.value)
        for batch in batches:
            for start, end in common.slices(batch, "text", AT_A_TIME):
                part = batch.slice(start, end - start)
                out = aligner.batch(part.column("text").to_pylist())
                columns = [part.column("doc_id"), *(pa.array(out[c], pa.int64()) for c in COUNTS), pa.array(out["groups_sha256"], pa.string())]
                offsets = np.r_[0, np.cumsum([len(x) for x in out["links"]])].astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*out["links"], np.zeros(0, np.int32)]), pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    shape = ", ".join([f"doc_id {kind}", *(f"{c} long" for c in COUNTS), "groups_sha256 string", "links array<int>"])
    coded = common.keep(docs.mapInArrow(work, shape), f"{home}/aligned")
    a, b = byte_level(model_a.decode(), pattern), word_pieces(model_b)
    pairs = linkable(a.strings, b.strings)
    counted = coded.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).toArrow()
    count = np.zeros(len(pairs), np.int64)
    count[counted.column("pair").to_numpy()] = counted.column("n").to_numpy()
    highest = np.zeros(len(b.strings), np.int64)
    np.maximum.at(highest, pairs % len(b.strings), count)
    known = spark.sparkContext.broadcast((count, count == highest[pairs % len(b.strings)]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = known.value
        for batch in (whole.slice(at, SUMMED) for whole in batches for at in range(0, whole.num_rows, SUMMED)):
            held = batch.column("links")
            values, offsets = held.flatten().to_numpy(), held.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            total = lambda x: pa.array(np.diff(np.r_[0, np.cumsum(x, dtype=np.int64)][offsets]), pa.int64())
            rest = {c: batch.column(c) for c in names if c != "links"}
            rest |= {"n_links": pa.array(np.diff(offsets), pa.int64()), "n_best": total(best[values]), "count_sum": total(count[values])}
            yield pa.RecordBatch.from_arrays([rest[c] for c in shown], shown)

    shown = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_products"]
    return coded.mapInArrow(sums, ", ".join([f"doc_id {kind}", *(f"{c} string" if c == "groups_sha256" else f"{c} long" for c in shown[1:])]))
