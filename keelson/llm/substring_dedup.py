"""Substring deduplication: suffix automata of reference shards, and matching statistics against them.

A window is `window` consecutive words of one document. Every word goes that lies in a window whose word sequence also
starts somewhere else, in the same document or another.

1. Anchors. The least hash of the word groups inside a window is the window's anchor. Equal windows have equal anchors,
   and neighbouring windows mostly share theirs, so a text has about one anchor to 14 words. Anchors are counted over the
   corpus; those that stand only once are dropped, and with them nearly all text that has no twin.
2. Reference shards. A document's consecutive windows with the same repeated anchor form a passage. Equal passages are
   one row with the number of their places. Shards hold whole anchors, so that windows which could be equal always meet
   in one shard.
3. Automata. A task reads its shards in turn. From a shard's passages it builds a suffix automaton over their words,
   with the number of places for each state, and then streams the passages through it: the matching statistics say
   which windows of a passage have a second place in the corpus. Only one shard is in memory at a time.
4. Anchors whose different passages hold more than `heavy` words (one text with thousands of near copies, the borders of
   a passage that stands everywhere) would make a shard too large for a task. Their passages are taken as documents and
   dealt again, by anchors of longer groups (GROUPS, then the whole window). A longer group leaves fewer words around it
   that can differ, and the windows that have no twin drop out; with a group as long as the window an anchor has one
   passage only, so every shard ends below the limit, however many copies there are.
5. The spans found go back to the documents (a passage's answer is joined to all places where it stands), maximal spans
   are merged, and the words outside them are kept.

An automaton goes to the tasks that hold its shard's passages, not to the whole cluster: sent to every task, the automata
would cost the number of shards times the corpus.

Defined results: a null or empty text has no words; a null id is an id like others; equal rows are copies of each other,
so all their windows go; documents with fewer than `window` words keep everything; an empty table gives an empty result;
columns other than id and text never matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 35
#: Words of the groups whose least hash is an anchor, level by level; the last level's group is the window itself.
GROUPS = (8, 24)
#: Words of an anchor's different passages above which they are dealt again at the next level.
HEAVY = 50_000
#: Windows of a passage at most, and words of a shard from which it is closed.
PASSAGE, SHARD = 512, 20_000


def _mix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ (x >> 31)


def group_hashes(words: list[bytes], group: int) -> np.ndarray:
    """A 64-bit hash of each `group` consecutive words."""
    n = len(words) - group + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(crc32, words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for j in range(group):
        h += w[j : j + n] * np.uint64(_mix(j) | 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    done, out = 1, x
    while done < span:
        step = min(done, span - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def window_anchors(words: list[bytes], window: int, group: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every group, anchor of every window)."""
    h = group_hashes(words, group)
    span = window - group + 1
    return h, sliding_min(h, span) if len(h) >= span else h[:0]


class SuffixAutomaton:
    """Of several word sequences; each state knows in how many places its words end, by the sequences' weights."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.places = [-1], [0], [0]

    def _state(self, length: int, follow: dict, link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.places.append(0)
        return len(self.length) - 1

    def _extend(self, last: int, word) -> int:
        follow, length, link = self.next, self.length, self.link
        known = follow[last].get(word)
        if known is not None:
            if length[known] == length[last] + 1:
                return known
            return self._split(last, word, known)
        new = self._state(length[last] + 1, {}, 0)
        p = last
        while p != -1 and word not in follow[p]:
            follow[p][word] = new
            p = link[p]
        if p != -1:
            q = follow[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p: int, word, q: int) -> int:
        follow, link = self.next, self.link
        copy = self._state(self.length[p] + 1, dict(follow[q]), link[q])
        link[q] = copy
        while p != -1 and follow[p].get(word) == q:
            follow[p][word] = copy
            p = link[p]
        return copy

    def add(self, words: list, weight: int) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)
            self.places[last] += weight

    def finish(self) -> None:
        """Adds up the places: a state's words also end wherever those of the states linked to it end."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.places[self.link[s]] += self.places[s]

    def repeated(self, words: list, window: int) -> list[int]:
        """Starts of the windows that have two places or more, from the matching statistics of the words."""
        follow, link, length, places = self.next, self.link, self.length, self.places
        state = matched = 0
        out = []
        for at, word in enumerate(words):
            while state and word not in follow[state]:
                state = link[state]
                matched = length[state]
            state = follow[state].get(word, 0)
            matched = matched + 1 if state else 0
            if matched >= window:
                while length[link[state]] >= window:
                    state = link[state]
                matched = min(matched, length[state])
                if places[state] > 1:
                    out.append(at - window + 1)
        return out


def _spans(starts: list[int], window: int) -> list[int]:
    """Flat list of [start, end) word spans that the windows cover."""
    out: list[int] = []
    for s in starts:
        if out and s <= out[-1]:
            out[-1] = s + window
        else:
            out += (s, s + window)
    return out


def _anchor_rows(window: int, group: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                h, least = window_anchors(text.split(), window, group)
                own = np.unique(least)
                if len(own):
                    held = h[np.isin(h, own)]
                    values, times = np.unique(held, return_counts=True)
                    own = np.concatenate([values, values[times > 1]])  # twice in this text: two places
                found.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("times"), pa.array(found, pa.list_(pa.int64()))], ["item", "times", "anchors"])

    return work


def _passage_rows(window: int, group: int):
    shape = pa.schema([("item", pa.binary()), ("start", pa.int32()), ("anchor", pa.int64()), ("times", pa.int64()), ("n", pa.int64()), ("passage_hash", pa.binary()), ("passage", pa.binary())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(shape)], schema=shape)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for item, text, times, repeated in zip(*(batch.column(c).to_pylist() for c in ("item", "text", "times", "repeated")), strict=True):
                words = text.split()
                _, least = window_anchors(words, window, group)
                own = np.sort(np.array(repeated, np.int64).view(np.uint64))
                at = np.searchsorted(own, least).clip(max=len(own) - 1)
                hit = own[at] == least
                edges = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (hit[1:] != hit[:-1]), [True]]))
                for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    if not hit[start]:
                        continue
                    anchor = int(least[start].view(np.int64))
                    for s in range(start, end, PASSAGE):
                        part = words[s : min(s + PASSAGE, end) + window - 1]
                        passage = b" ".join(part)
                        rows.append((item, s, anchor, times, len(part), hashlib.md5(passage).digest(), passage))
                    if len(rows) >= 50_000:
                        yield batch_of(rows)
                        rows = []
            yield batch_of(rows)

    return work


def _automaton_rows(window: int):
    """Reads passages in the order of their anchors; a shard is closed at the first new anchor once it is large enough."""

    def answer(shard: list[tuple[bytes, list[bytes], int]]) -> pa.RecordBatch:
        automaton = SuffixAutomaton()
        for _, words, times in shard:
            automaton.add(words, min(times, 2))
        automaton.finish()
        found = [(h, spans) for h, words, _ in shard if (spans := _spans(automaton.repeated(words, window), window))]
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.binary()), pa.array([s for _, s in found], pa.list_(pa.int32()))], ["passage_hash", "spans"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple[bytes, list[bytes], int]] = []
        size, last = 0, None
        for batch in batches:
            for anchor, h, passage, times in zip(*(batch.column(c).to_pylist() for c in ("anchor", "passage_hash", "passage", "times")), strict=True):
                if anchor != last and size >= SHARD:
                    yield answer(shard)
                    shard, size = [], 0
                words = passage.split(b" ")
                shard.append((h, words, times))
                size, last = size + len(words), anchor
        if shard:
            yield answer(shard)

    return work


def _found(items: DataFrame, home: str, window: int, groups: tuple[int, ...], heavy: int) -> DataFrame:
    """items: item, text (words as bytes), times. (item, spans): flat lists of the [start, end) words of repeated windows, unmerged."""
    group, deeper = groups[0], groups[1:]
    anchors = common.keep(items.select("item", "text", "times").mapInArrow(_anchor_rows(window, group), "item binary, times long, anchors array<bigint>"), f"{home}/anchors{group}")
    each = anchors.select("item", "times", F.explode("anchors").alias("anchor"))
    # kept as tables, so that the joins that follow are between two plain exchanges and Spark can split a common key
    counted = common.keep(each.groupBy("anchor").agg(F.sum("times").alias("places")).filter("places > 1").select("anchor"), f"{home}/counted{group}")
    of_item = each.join(counted, "anchor").groupBy("item").agg(F.collect_set("anchor").alias("repeated"))
    cut = items.join(of_item, "item").select("item", "text", "times", "repeated")
    places = common.keep(
        cut.mapInArrow(_passage_rows(window, group), "item binary, start int, anchor long, times long, n long, passage_hash binary, passage binary"), f"{home}/passages{group}"
    )
    distinct = common.keep(places.groupBy("anchor", "passage_hash", "passage").agg(F.sum("times").alias("times"), F.first("n").alias("n")), f"{home}/distinct{group}")
    light, answers = distinct, None
    if deeper:
        wide = common.keep(distinct.groupBy("anchor").agg(F.sum("n").alias("words")).filter(F.col("words") > heavy).select("anchor"), f"{home}/wide{group}")
        if not wide.isEmpty():
            again = distinct.join(wide, "anchor", "left_semi").select(F.col("passage_hash").alias("item"), F.col("passage").alias("text"), "times")
            answers = _found(common.keep(again, f"{home}/again{group}"), home, window, deeper, heavy).withColumnRenamed("item", "passage_hash")
            light = distinct.join(wide, "anchor", "left_anti")
    spans = light.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "passage_hash", "passage", "times").mapInArrow(_automaton_rows(window), "passage_hash binary, spans array<int>")
    answers = common.keep(spans if answers is None else spans.unionByName(answers), f"{home}/answers{group}")
    shifted = F.transform("spans", lambda x: x + F.col("start"))
    found = places.select("item", "start", "passage_hash").join(answers, "passage_hash").select("item", shifted.alias("spans"))
    return common.keep(found.groupBy("item").agg(F.flatten(F.collect_set("spans")).alias("spans")), f"{home}/spans{group}")


def repeated_spans(docs: DataFrame, *, window: int = WINDOW, groups: tuple[int, ...] = GROUPS, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """(keyed documents: item, doc_id, text as bytes; spans: item, spans as a flat list of [start, end) words, unmerged)."""
    keyed = docs.select(common.row_key("doc_id", "text").alias("item"), "doc_id", F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("text"))
    levels = (*(g for g in groups if g < window), window)
    return keyed, _found(keyed.select("item", "text", F.lit(1).cast("long").alias("times")), common.shared_dir(docs.sparkSession), window, levels, heavy)


def kept_words(words: list[bytes], flat: list[int] | None) -> list[bytes]:
    if not flat:
        return words
    out, at = [], 0
    for start, end in sorted(zip(flat[::2], flat[1::2], strict=True)):
        out += words[at:start]
        at = max(at, end)
    return out + words[at:]


def dedup(docs: DataFrame, *, texts: bool = False, **how) -> DataFrame:
    """Per row of docs (doc_id and text): doc_id, n_words, n_removed, kept_sha256; with texts also kept_text."""
    keyed, spans = repeated_spans(docs, **how)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, digests, kept = [], [], [], []
            for text, flat in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = text.split()
                left = kept_words(words, flat)
                out = b" ".join(left)
                total.append(len(words))
                gone.append(len(words) - len(left))
                digests.append(hashlib.sha256(out).hexdigest())
                if texts:
                    kept.append(out.decode())
            columns = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.string())] * texts, names + ["kept_text"] * texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return keyed.join(spans, "item", "left").select("doc_id", "text", "spans").mapInArrow(work, shape)
