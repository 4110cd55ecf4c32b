"""Byte-level BPE encoding and decoding with numpy matrices.

The pieces of a batch that aren't tokens themselves are dealt into buckets by length (above 32 bytes by steps of 32). A bucket is one
padded matrix of token ids, a row for each piece, with a second matrix that holds the rank of every adjacent pair. Each
round, every row merges its leftmost pair of least rank: the pair's cell takes the merged id, the cells to its right
move up by one, so that the matrix gets narrower, and two pair ranks are looked up anew. Rows without a pair are done and leave the matrix. Pairs are
looked up in an open-addressing hash table, also numpy arrays. Pieces above LONGEST bytes, for which shifting whole rows
would cost the square of their length, merge by a heap over a linked list, in the same order.

The rank file is broadcast once, and a Python worker builds its tables from it once, not for every task.

Defined results: a null text counts as an empty one, and an empty text has no tokens; a null id is an id like others;
equal rows get equal rows, as a pair of least rank that stands twice merges at its leftmost place first; an empty table
gives an empty result; other columns never matter.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

NONE = np.int32(2**31 - 1)
#: Bytes of the longest piece that goes through the matrices.
LONGEST = 1024
#: Pieces whose ids a task remembers, and the length of those worth it.
REMEMBERED, SHORT = 400_000, 48


class PairTable:
    """Hash table from (left id, right id) to the merged id."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(left) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys, rest = (left.astype(np.int64) << 32) | right, np.arange(len(left))
        slot = self.slots(keys)
        self.longest = 0
        while len(rest):  # those that find their slot taken try the next one
            free = self.keys[slot[rest]] == -1
            _, first = np.unique(slot[rest[free]], return_index=True)
            won = rest[free][first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], merged[won]
            rest = rest[self.keys[slot[rest]] != keys[rest]]
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            self.longest += 1

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        slot = self.slots(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        for _ in range(self.longest):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            same = held == keys[open_]
            out[open_[same]] = self.values[slot[open_[same]]]
            open_ = open_[~same & (held != -1)]
        return out


def splitter(pattern: str):
    """Cuts a text into its pieces. Latin-1 texts go through the standard library's engine, which is faster.

    That engine knows no property classes, so for code points below 256 they are spelt out.
    """
    import regex

    every = "".join(map(chr, range(256)))
    spelt = {name: "".join(re.escape(c) for c in regex.findall(prop, every)) for name, prop in ((r"\p{L}", r"\p{L}"), (r"\p{N}", r"\p{N}"), (r"\s", r"\s"))}
    latin = re.sub(r"\[\^[^\]]*\]|\\p\{\w\}|\\s|\\S", lambda m: _spell(m[0], spelt), pattern)
    full, short = regex.compile(pattern).findall, re.compile(latin).findall

    def split(text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return full(text)
        return short(text)

    return split


def _spell(item: str, spelt: dict[str, str]) -> str:
    if item == r"\S":
        return f"[^{spelt[r'\s']}]"
    inside = item[1:-1] if item.startswith("[") else item
    for name, chars in spelt.items():
        inside = inside.replace(name, chars)
    return f"[{inside}]"


class Speller:
    """Joins the byte strings of ids, by gathering from one array that holds them all."""

    def __init__(self, strings: dict[int, bytes]):
        size = max(strings, default=-1) + 1
        every = [strings.get(i, b"") for i in range(size)]
        self.length = np.fromiter(map(len, every), np.int64, size)
        self.start = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(every), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        length = self.length[ids]
        skip = self.start[ids] - (np.cumsum(length) - length)
        return self.blob[np.arange(length.sum()) + np.repeat(skip, length)].tobytes()


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, splitter(pattern)
        self.token = {i: t for t, i in ranks.items()}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        found = [(l, r, i) for t, i in ranks.items() for k in range(1, len(t)) if (l := ranks.get(t[:k])) is not None and (r := ranks.get(t[k:])) is not None]
        self.pairs = PairTable(*np.array(found or [(-2, -2, 0)], np.int64).T)
        self.known: dict[str, bytes] = {}  # the ids of a piece, four bytes each

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = [self.split(t) for t in texts]
        new = set().union(*split).difference(self.known)
        merged = self.merge(new)
        self.known.update((p, ids) for p, ids in merged.items() if len(p) <= SHORT)
        known = self.known if all(len(p) <= SHORT for p in merged) else self.known | merged
        for pieces in split:
            yield np.frombuffer(b"".join(map(known.__getitem__, pieces)), np.int32)

    def merge(self, pieces: Iterable[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            b = p.encode()
            if (i := self.ranks.get(b)) is not None:
                out[p] = i.to_bytes(4, sys.byteorder)
            elif len(b) > LONGEST:
                out[p] = np.array(self._by_heap(b), np.int32).tobytes()
            else:
                buckets.setdefault(len(b) if len(b) <= 32 else -(-len(b) // 32) * 32, []).append((p, b))
        for width, rows in buckets.items():
            step = max(1, (1 << 20) // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                out.update(zip([p for p, _ in part], self._matrix([b for _, b in part], width), strict=True))
        return out

    def _matrix(self, rows: list[bytes], width: int) -> list[bytes]:
        n = len(rows)
        length = np.fromiter(map(len, rows), np.int64, n)
        raw = np.frombuffer(b"".join(b.ljust(width, b"\0") for b in rows), np.uint8).reshape(n, width)
        ids = self.of_byte[raw]
        column = np.arange(width)
        rank = np.full((n, width), NONE, np.int32)  # of the pair that starts in this cell
        here = column[None, :-1] < (length - 1)[:, None]
        rank[:, :-1][here] = self.pairs(ids[:, :-1][here], ids[:, 1:][here])
        done = [b""] * n
        row = np.arange(n)
        while n:
            at = rank.argmin(axis=1)
            every = np.arange(n)
            least = rank[every, at]
            live = least != NONE
            if not live.all():
                over = np.flatnonzero(~live)
                flat, cells = ids[over].tobytes(), ids.shape[1] * 4
                for k, (r, size) in enumerate(zip(row[over].tolist(), length[over].tolist(), strict=True)):
                    done[r] = flat[k * cells : k * cells + size * 4]
                ids, rank, length, row, at, least = (x[live] for x in (ids, rank, length, row, at, least))
                n = len(row)
                if not n:
                    break
                every = np.arange(n)
            # close the gap behind the merged pair: every row loses one cell
            stay = column[: ids.shape[1]] != (at + 1)[:, None]
            width = ids.shape[1] - 1
            ids, rank = ids[stay].reshape(n, width), rank[stay].reshape(n, width)
            ids[every, at] = least
            length = length - 1
            rank[every, at] = NONE
            for left, ok in ((at, at < length - 1), (at - 1, at > 0)):
                k, c = every[ok], left[ok]
                rank[k, c] = self.pairs(ids[k, c], ids[k, c + 1])
        return done

    def _by_heap(self, b: bytes) -> tuple[int, ...]:
        n, token, ranks = len(b), self.token, self.ranks
        ids = [ranks[b[i : i + 1]] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(i: int) -> int | None:
            j = after[i]
            return ranks.get(token[ids[i]] + token[ids[j]]) if j < n else None

        heap = [(r, i) for i in range(n) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            r, i = heapq.heappop(heap)
            if gone[i] or pair(i) != r:
                continue
            j = after[i]
            ids[i], gone[j], after[i] = r, 1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (i, before[i]):
                if k >= 0 and (x := pair(k)) is not None:
                    heapq.heappush(heap, (x, k))
        return tuple(ids[i] for i in range(n) if not gone[i])


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """lines: a rank file, a token in base64 and its rank to a line."""
    return {base64.b64decode(t): int(i) for t, i in (line.split() for line in lines.splitlines() if line)}


@functools.lru_cache(maxsize=2)
def _coder(rank_lines: bytes, pattern: str) -> tuple[ByteBPE, Speller, Speller]:
    """(coder, bytes of ids, decimal ids followed by a space); kept by the worker for its next tasks."""
    ranks = read_ranks(rank_lines)
    return ByteBPE(ranks, pattern), Speller({i: t for t, i in ranks.items()}), Speller({i: b"%d " % i for i in ranks.values()})


def encode(docs: DataFrame, rank_lines: bytes, pattern: str, *, ids: bool = True, digests: bool = False) -> DataFrame:
    """docs: doc_id and text. Per row doc_id and n_tokens; with ids also ids, with digests also ids_sha256 and decoded_sha256."""
    shape = [("n_tokens", "long")] + [("ids_sha256", "string"), ("decoded_sha256", "string")] * digests + [("ids", "array<int>")] * ids
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *dict(shape)]
    shared = docs.sparkSession.sparkContext.broadcast(rank_lines)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, spell, number = _coder(shared.value, pattern)
        for batch in batches:
            for start, end in common.slices(batch, "text"):
                part = batch.slice(start, end - start)
                coded = list(coder.encode_batch([t or "" for t in part.column("text").to_pylist()]))
                columns = [part.column("doc_id"), pa.array(map(len, coded), pa.int64())]
                if digests:
                    columns.append(pa.array([hashlib.sha256(number(x)[:-1]).hexdigest() for x in coded], pa.string()))
                    columns.append(pa.array([hashlib.sha256(spell(x)).hexdigest() for x in coded], pa.string()))
                if ids:
                    columns.append(pa.array(coded, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(work, ", ".join([f"doc_id {kind}", *(f"{n} {t}" for n, t in shape)]))


def decode(coded: DataFrame, rank_lines: bytes) -> DataFrame:
    """coded: doc_id and ids. Per row: doc_id and bytes, which are the text's for what encode made of it."""
    kind = coded.schema["doc_id"].dataType.simpleString()
    shared = coded.sparkSession.sparkContext.broadcast(rank_lines)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, spell, _ = _coder(shared.value, ".")
        for batch in batches:
            out = [spell(np.array(ids or [], np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return coded.select("doc_id", "ids").mapInArrow(work, f"doc_id {kind}, bytes binary")
