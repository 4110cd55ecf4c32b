"""Quality rules by compression bands: how far zstandard shrinks a document, as a whole and chunk by chunk.

A text that repeats itself or is full of marks shrinks too much, one without structure (encoded binary, keys) too little.
What is usual depends on the length, so each length has limits of its own: lengths are grouped STEPS to a doubling, and
the limits of a group come from the corpus. They lie HIGH and LOW spreads above and below the median of the logarithm of
the ratio; the spread is the distance from the median down to the quantile QUANTILE, and SPREAD_LEAST at least.

Junk must not make its own limits, so median and spread are taken of the ordinary part only: the shortest interval that
holds half of the group is found, in it the shortest that holds half of that, and what lies further from its middle than
TRIM times the spread it stands for is left out. That holds while junk, high and low together, is less than half of a
group (tested to 45 %). A text's chunks count, together, like one text. A group that holds fewer than LEAST is judged
with its neighbours, nearest first, until they are LEAST; none of them counts for more than LEAST, and the rise of the
ratio with the length between them is taken out by the median slope between their medians, from 0 to SLOPE_MOST. So a
length that only junk has, or one text alone, is judged by what the lengths around it are like. Whatever the corpus
holds, a text fails whose compressed form exceeds the share PACKED of it plus PACKED_MORE bytes: encoded binary needs 75
%, prose never came near in any of the languages of the test tables. Hexadecimal digits shrink about as much as short
prose and can be told from it in long texts only. A group of LEAST and more that is mostly junk of another kind goes by
its own limits: that is the breakdown point.

The limits are learnt from all documents that pass the base rules: their whole texts and all their chunks, as a chunk of
some length shrinks like a text of that length. Only a histogram (length group, step of the ratio) leaves the tasks; its
size is bounded by the number of groups and steps, whatever the corpus holds.

A document fails when its whole ratio leaves the limits of its length, or when the chunks that leave theirs hold more
than CHUNK_SHARE of its bytes, so that one odd passage in a long text doesn't condemn it. Every chunk is judged, the last
and shorter one too; a text no longer than a chunk is its own only chunk. Beside the verdict stand the base counts.

Defined results: a null text counts as an empty one, which has no words and so fails the base; equal rows get equal rows;
an empty table gives an empty result; null ids and other columns never matter. Texts of any length go through whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVEL = 3
#: Length groups to a doubling, and steps of the histogram to a factor e of the ratio.
STEPS, FINE = 4, 200
#: Spreads above and below the median, the quantile that gives the spread, and the least spread.
HIGH, LOW, QUANTILE, SPREAD_LEAST = 3.5, 4.5, 0.16, 0.015
#: Texts and chunks that a length group needs to stand alone, and the greatest rise of the logarithm of the ratio from group to group.
LEAST, SLOPE_MOST = 400, 0.08
#: Weight of a whole text, and of all its chunks together, so that one long text isn't many.
WHOLE = 1 << 20
#: Spreads beyond which texts don't count, and the half width, in spreads, of the middle quarter of a normal distribution.
TRIM, QUARTER = 5.0, 0.319
#: Longest compressed form of a text that isn't taken for noise: this share of it and so many bytes more.
PACKED, PACKED_MORE = 0.72, 40
#: Bytes of a chunk, and the share of bytes that may lie in chunks outside their limits.
CHUNK, CHUNK_SHARE = 1024, 0.25

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

SCHEMA = """doc_id {id}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,
base_failed boolean, kept boolean, ratio double, odd_chunk_share double"""

#: Limits of the logarithm of the ratio, by length group.
Limits = dict[int, tuple[float, float]]


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    total = end = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def base_failed(n_words: int, repeats: int) -> bool:
    return n_words < 50 or 100 * repeats > 50 * n_words


def group_of(size: int) -> int:
    return int(STEPS * math.log2(size))


def chunks(data: bytes, compress, chunk: int = CHUNK) -> list[tuple[int, float]]:
    """(bytes, ratio) of each."""
    return [(len(part), len(part) / len(compress(part))) for part in (data[at : at + chunk] for at in range(0, len(data), chunk))]


def measured(data: bytes, compress, chunk: int = CHUNK) -> tuple[float, list[tuple[int, float]]]:
    """(ratio of the whole, (bytes, ratio) of each chunk)."""
    each = chunks(data, compress, chunk)
    return each[0][1] if len(each) == 1 else len(data) / len(compress(data)) if data else 0.0, each


def weighed(data: bytes, compress) -> Counter[tuple[int, int]]:
    """What one text adds to the histogram: itself and, if it has several, its chunks."""
    ratio, each = measured(data, compress)
    seen = Counter({(group_of(len(data)), math.floor(math.log(ratio) * FINE)): WHOLE})
    for n, r in each if len(each) > 1 else []:
        seen[group_of(n), math.floor(math.log(r) * FINE)] += max(WHOLE // len(each), 1)
    return seen


def quantile(steps: list[tuple[float, float]], share: float) -> float:
    """steps: (value, weight), sorted."""
    left = share * sum(n for _, n in steps)
    for value, n in steps:
        left -= n
        if left <= 0:
            return value
    return steps[-1][0]


def shortest(steps: list[tuple[float, float]], share: float) -> tuple[int, int]:
    """The part [start, end) of steps, of least width, that holds this share of the weight."""
    need = share * sum(n for _, n in steps) - 1e-9
    best, held, end = (math.inf, 0, len(steps)), 0.0, 0
    for start, (value, n) in enumerate(steps):
        while end < len(steps) and held < need:
            held += steps[end][1]
            end += 1
        if held < need:
            break
        best = min(best, (steps[end - 1][0] - value, start, end))
        held -= n
    return best[1:]


def ordinary(steps: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Without what lies far from where most are."""
    start, end = shortest(steps, 0.5)
    half = steps[start:end]
    start, end = shortest(half, 0.5)
    low, high = half[start][0], half[end - 1][0]
    far = TRIM * max((high - low) / 2 / QUARTER, SPREAD_LEAST)
    return [(value, n) for value, n in steps if abs(value - (low + high) / 2) <= far]


def slope(middles: dict[int, float], weights: dict[int, float]) -> float:
    """Weighted median of the slopes between all pairs of groups."""
    pairs = [((middles[b] - middles[a]) / (b - a), weights[a] * weights[b]) for a in middles for b in middles if a < b]
    return min(max(quantile(sorted(pairs), 0.5), 0.0), SLOPE_MOST) if pairs else 0.0


def limits_of(histogram: dict[tuple[int, int], int]) -> Limits:
    """histogram: (length group, step of the ratio) to the weight of its texts and chunks."""
    held: dict[int, list[tuple[float, float]]] = {}
    for (group, step), n in sorted(histogram.items()):
        held.setdefault(group, []).append(((step + 0.5) / FINE, n))
    counts = {group: sum(n for _, n in steps) for group, steps in held.items()}
    enough = LEAST * WHOLE
    weights = {group: min(n, enough) for group, n in counts.items()}
    middles = {group: quantile(ordinary(steps), 0.5) for group, steps in held.items()}
    out = {}
    for group in held:
        reach, near = 0, [group]
        while sum(weights[g] for g in near) < enough and len(near) < len(held):
            reach += 1
            near = [g for g in held if abs(g - group) <= reach]
        rise = slope({g: middles[g] for g in near}, weights)
        pooled = sorted((value - rise * (g - group), n * weights[g] / counts[g]) for g in near for value, n in held[g])
        usual = ordinary(pooled)
        middle = quantile(usual, 0.5)
        spread = max(middle - quantile(usual, QUANTILE), SPREAD_LEAST)
        out[group] = (middle - LOW * spread, middle + HIGH * spread)
    return out


def odd(size: int, ratio: float, limits: Limits) -> bool:
    """A text that failed the base may have a length that no other has: then it has no limits but the absolute one."""
    low, high = limits.get(group_of(size), (-math.inf, math.inf))
    return size / ratio > PACKED * size + PACKED_MORE or not low <= math.log(ratio) <= high


def verdict(data: bytes, compress, limits: Limits, share: float = CHUNK_SHARE) -> tuple[bool, float, float]:
    """(passed, ratio of the whole, share of the bytes in chunks outside their limits)."""
    if not data:
        return True, 0.0, 0.0
    ratio, each = measured(data, compress)
    odd_share = sum(n for n, r in each if odd(n, r, limits)) / len(data)
    return not odd(len(data), ratio, limits) and odd_share <= share, ratio, odd_share


def learn(docs: DataFrame, *, level: int = LEVEL) -> Limits:
    """The limits that the documents which pass the base rules give."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=level).compress
        seen: Counter[tuple[int, int]] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                data = (text.as_py() or "").encode()
                words = data.split()
                if base_failed(len(words), repeat_words(words)):
                    continue
                seen.update(weighed(data, compress))
        rows = list(seen.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.int32()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], ["grp", "step", "n"])

    counted = docs.select("text").mapInArrow(work, "grp int, step int, n long").groupBy("grp", "step").agg(F.sum("n").alias("n"))
    return limits_of({(r["grp"], r["step"]): r["n"] for r in counted.collect()})


def judge(docs: DataFrame, *, level: int = LEVEL) -> DataFrame:
    """docs: doc_id and text. One row of SCHEMA for each."""
    docs = docs.select("doc_id", "text")
    limits = learn(docs, level=level)
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=level).compress
        for batch in batches:
            rows = []
            for held in batch.column("text"):
                text = held.as_py() or ""
                data = text.encode()
                words = data.split()
                repeats = repeat_words(words)
                failed = base_failed(len(words), repeats)
                passed, ratio, share = verdict(data, compress, limits)
                rows.append((
                    len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup_lines(text), repeats,
                    failed, passed and not failed, ratio, share,
                ))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [x.split()[0] for x in SCHEMA.split(",")])

    return docs.mapInArrow(work, SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString()))
