"""N-gram Jaccard join by sizes, heavy and light, and the groups that its links form.

A document is the set of its distinct 5-word shingles (64-bit hashes); documents with equal sets are one set. Two sets
link when their Jaccard similarity reaches NUM / DEN. Tokens have one global order: light ones by hash, then the heavy
ones, those in `heavy` documents or more. Of a set with n tokens, any partner shares ceil(n * NUM / DEN), so its first
n - ceil(n * NUM / DEN) + k tokens hold k of the shared ones.

- Small sets (fewer tokens than the boundary) enumerate the two-token subsets of the prefix for k = 2; two small sets
  that link share a subset.
- Larger sets enter the inverted lists of their prefix tokens, for k = 1 + n // 40, and so do the small ones large
  enough to link with them. The lists are scanned, and pairs that meet in fewer than k lists are no candidates.
- The boundary is the size at which the subsets of all smaller sets plus the list entries of the others cost least,
  counted from the histogram of sizes and the mean length of a list.
- A set whose prefix reaches into the heavy tokens consists of them by about three quarters: near copies of a text that
  many documents hold. Light lists have fewer than `heavy` entries at any corpus size, those of heavy tokens any number,
  so these sets leave the lists. They are gathered into families (components over shared prefix tokens). All sets of a
  family are first compared with PIVOTS of it, chosen by hash; sets that link with the same pivot, or with pivots that
  sets between them connect, are in one component already and never compared with each other. What remains is cut into bands of size, each 4/3 of the one before, as sets further
  apart can't link, and compared within a band and with its neighbours, block by block through the token incidence
  matrix; a task emits a spanning forest of its links, not all pairs.

Candidates are verified on their whole sets, and no link between different sets is lost. Shingles and sets go by 64-bit
hashes: different ones that clash count as one, of which a few are to be expected from some 4 billion different sets on.

Of the heavy tokens the most frequent are broadcast, HEAVY_MOST at most. If there are more, the documents' other tokens
are dealt out by bucket, meet the bucket's heavy ones there, and the answer is joined back to the documents; a token dealt
out stands in at most one HEAVY_MOST-th of all that documents hold, so no bucket grows with the most frequent ones. Order,
lists and result are the same. Also broadcast: a bitmap of fixed size that spares most documents the shuffle of their sets.

Defined results: null and empty texts have no shingles and link with nothing; null ids count as larger than all others;
equal rows are in one component; other columns never matter; an empty table gives an empty result; texts of any length are
read whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common
from .components import components
from .substring_dedup import _mix

SHINGLE, NUM, DEN = 5, 3, 4
#: Documents from which on a token is heavy, and heavy tokens that are broadcast at most (16 MB).
HEAVY, HEAVY_MOST = 64, 1 << 21
#: Tokens of a bucket, tokens gathered before they are dealt out, bits that tell tokens of a bucket apart when counted.
BUCKET, GATHER, SLOT_BITS = 1 << 22, 1 << 20, 24
#: Bits of the bitmap of sets to fetch: 8 MB.
MARK_BITS = 26
#: Sets of a block.
BLOCK = 1024
#: Sets of a family that all others of it are compared with, and groups in which each task's counts of sizes are summed.
PIVOTS, SUMS = 8, 1024


def tokens_of(text: bytes | None) -> np.ndarray:
    """The set of a text: sorted distinct 64-bit hashes of its shingles."""
    from xxhash import xxh3_64_intdigest

    words = (text or b"").lower().split()
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.array([_mix(xxh3_64_intdigest(b" ".join(words)))] if words else [], np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        h += w[j : j + n] * np.uint64(_mix(100 + j) | 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def needed(n: int) -> int:
    """Tokens that any partner of a set of n shares with it."""
    return -(-n * NUM // DEN)


def shared_lists(n: int) -> int:
    return 1 + n // 40


def set_id(tokens: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(tokens.tobytes())).view(np.int64))


def _codes(tokens: np.ndarray, bits: int) -> np.ndarray:
    return tokens >> np.uint64(64 - SLOT_BITS - bits)


def _among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which codes are in known, which is sorted."""
    return known[np.searchsorted(known, codes).clip(max=len(known) - 1)] == codes if len(known) else np.zeros(len(codes), bool)


def _planes(values: np.ndarray, n: int) -> bytes:
    """n bytes of each value, highest first, byte by byte: sorted values compress well so."""
    return b"".join((values >> np.uint64(8 * k)).astype(np.uint8).tobytes() for k in range(n - 1, -1, -1))


def _unplaned(data: bytes, n: int) -> np.ndarray:
    out = 0
    for plane in np.frombuffer(data, np.uint8).reshape(n, -1):
        out = (out << 8) | plane.astype(np.int64)
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few MB of text, so that what a task makes of a batch at once is bounded, too."""
    for batch in batches:
        for start, end in common.slices(batch, "text"):
            yield batch.slice(start, end - start)


def _cuts(bucket: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of equal values."""
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist() if len(bucket) else []
    return list(zip(edges[:-1], edges[1:], strict=True))


def _count_rows(bits: int):
    """Tokens of many documents, counted and dealt into buckets: planes of sorted slots and their counts. Buckets below 0: a task's sizes of sets."""

    def batch_of(buckets: list[int], packed: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(packed, pa.binary())], ["bucket", "packed"])

    def deal(held: list[np.ndarray]) -> pa.RecordBatch:
        # a token in a third of all documents is one entry for each GATHER tokens
        codes, times = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
        times = times.astype(np.uint64)
        bucket = (codes >> np.uint64(SLOT_BITS)).astype(np.int64)
        buckets, packed = [], []
        for s, e in _cuts(bucket):
            buckets.append(int(bucket[s]))
            packed.append(_planes(codes[s:e] & np.uint64((1 << SLOT_BITS) - 1), 3) + _planes(times[s:e], 3))
        return batch_of(buckets, packed)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, sizes = [], 0, np.zeros(128, np.int64)
        for batch in _parts(batches):
            for text in batch.column("text").to_pylist():
                tokens = tokens_of(text)
                held.append(_codes(tokens, bits))
                size += len(tokens)
                sizes[min(len(tokens), 126)] += 1
                sizes[127] += len(tokens)
                if size >= GATHER:
                    yield deal(held)
                    held, size = [], 0
        yield deal(held)
        yield batch_of([-1 - TaskContext.get().partitionId() % SUMS], [sizes.tobytes()])

    return work


def _count_bucket(table: pa.Table) -> pa.Table:
    """Codes in HEAVY documents or more; for buckets below 0 the sums of their arrays, under negative codes."""
    bucket, packed = table.column("bucket")[0].as_py(), table.column("packed").to_pylist()
    if bucket < 0:
        sizes = sum(np.frombuffer(b, np.int64) for b in packed)
        return pa.table({"code": pa.array(-1 - np.arange(128), pa.int64()), "docs": pa.array(sizes, pa.int64())})
    parts = [_unplaned(b, 6) for b in packed]
    both = np.concatenate(parts)
    del parts, packed
    both.sort()
    slots = both >> 24
    edges = np.array([s for s, _ in _cuts(slots)], np.int64)
    count, slots = np.add.reduceat(both & 0xFFFFFF, edges), slots[edges]
    hot = count >= HEAVY
    codes = np.concatenate([slots[hot] + (bucket << SLOT_BITS), [-200]])
    return pa.table({"code": pa.array(codes, pa.int64()), "docs": pa.array(np.concatenate([count[hot], [int((count[~hot] ** 2).sum())]]), pa.int64())})


def _ask_rows(bits: int, heavy):
    """Tokens of many documents but for those in the broadcast, dealt into buckets with the documents' places in their chunk; bucket null: the keys of a chunk."""

    def deal(keys: list[bytes], held: list[np.ndarray]) -> pa.RecordBatch:
        chunk = hashlib.md5(b"".join(keys)).digest()
        codes = np.concatenate([*held, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(held), dtype=np.uint64), [len(h) for h in held])
        order = np.argsort(codes, kind="stable")
        codes, owner = codes[order], owner[order]
        bucket = (codes >> np.uint64(SLOT_BITS)).astype(np.int64)
        buckets, packed = [None], [b"".join(keys)]
        for s, e in _cuts(bucket):
            buckets.append(int(bucket[s]))
            packed.append(_planes(codes[s:e] & np.uint64((1 << SLOT_BITS) - 1), 3) + _planes(owner[s:e], 3))
        return pa.RecordBatch.from_arrays([pa.array([chunk] * len(buckets), pa.binary()), pa.array(buckets, pa.int64()), pa.array(packed, pa.binary())], ["chunk", "bucket", "packed"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, size = [], [], 0
        for batch in _parts(batches):
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tokens = tokens_of(text)
                codes = _codes(tokens, bits)
                codes = codes[~_among(codes, heavy.value)]
                if len(codes):
                    keys.append(key)
                    held.append(codes)
                    size += len(codes)
                if size >= GATHER:
                    yield deal(keys, held)
                    keys, held, size = [], [], 0
        if keys:
            yield deal(keys, held)

    return work


def _answer(asked: pa.Table, hot: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk its heavy tokens, as pairs of a document's place and a code."""
    known, chunks, packed = np.sort(hot.column("code").to_numpy()), [], []
    for chunk, bucket, data in zip(*(asked.column(c).to_pylist() for c in ("chunk", "bucket", "packed")), strict=True):
        both = _unplaned(data, 6)
        codes = (both >> 24) + (bucket << SLOT_BITS)
        found = _among(codes, known)
        if found.any():
            chunks.append(chunk)
            packed.append(np.stack([both[found] & 0xFFFFFF, codes[found]]).tobytes())
    return pa.table({"chunk": pa.array(chunks, pa.binary()), "keyed": pa.array([False] * len(chunks), pa.bool_()), "packed": pa.array(packed, pa.binary())})


def _flags(table: pa.Table) -> pa.Table:
    """Of one chunk: (key, its heavy codes)."""
    rows = list(zip(table.column("keyed").to_pylist(), table.column("packed").to_pylist(), strict=True))
    names = next((data for keyed, data in rows if keyed), b"")
    pairs = [np.frombuffer(data, np.int64).reshape(2, -1) for keyed, data in rows if not keyed]
    place, code = np.concatenate([*pairs, np.zeros((2, 0), np.int64)], axis=1)
    order = np.lexsort((code, place))
    place, code = place[order], code[order]
    cuts = _cuts(place)
    return pa.table({"key": pa.array([names[16 * int(place[s]) :][:16] for s, _ in cuts], pa.binary()), "hot": pa.array([code[s:e] for s, e in cuts], pa.list_(pa.int64()))})


def most_frequent(hot: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """hot: code, docs. (codes to broadcast, the others): the former are those of the highest levels that hold `most` codes or fewer together."""
    level = F.floor(F.log2("docs") * 8).cast("int")
    held, cut = 0, 1 << 20
    for r in hot.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 512 levels
        held += r["count"]
        if held > most:
            break
        cut = r["level"]
    return hot.filter(level >= cut).select("code"), hot.filter(level < cut).select("code")


def flagged(texts: DataFrame, hot: DataFrame, heavy, bits: int, home: str) -> DataFrame:
    """texts with the column hot, the sorted codes of a document's heavy tokens that aren't in the broadcast."""
    asked = common.keep(texts.select("key", "text").mapInArrow(_ask_rows(bits, heavy), "chunk binary, bucket long, packed binary"), f"{home}/asked")
    named = asked.filter("bucket IS NULL").select("chunk", F.lit(True).alias("keyed"), "packed")
    in_bucket = hot.withColumn("bucket", F.shiftright("code", SLOT_BITS))
    found = asked.filter("bucket IS NOT NULL").groupBy("bucket").cogroup(in_bucket.groupBy("bucket")).applyInArrow(_answer, "chunk binary, keyed boolean, packed binary")
    flags = found.unionByName(named).groupBy("chunk").applyInArrow(_flags, "key binary, hot array<long>")
    # equal rows share a key and have equal flags
    return texts.join(common.keep(flags.dropDuplicates(["key"]), f"{home}/flags"), "key", "left")


def boundary(sizes: list[int], total: int, list_length: float) -> int:
    """The size below which sets enumerate subsets. sizes[n]: number of sets with n tokens, for n up to 125."""

    def prefix(n: int, k: int) -> int:
        return max(0, min(n, n - needed(n) + k))

    def cost(x: int) -> float:
        subsets = sum(sizes[n] * math.comb(prefix(n, 2), 2) for n in range(2, x))
        return subsets + sum(sizes[n] * prefix(n, shared_lists(n)) * list_length for n in range(needed(x), 126))

    return min(range(2, 100), key=cost)


def _prefix_rows(bits: int, heavy, limit: int, kind: pa.DataType):
    """A row for each document (bucket null), and rows of packed list entries. heavy: a broadcast; rows may have a column hot of further heavy codes."""

    def deal(keys: list[np.ndarray], owners: list[tuple[int, int, int]]) -> list[tuple]:
        if not owners:
            return []
        key = np.concatenate(keys)
        times = [c for _, _, c in owners]
        sets = np.repeat(np.array([s for s, _, _ in owners], np.int64), times)
        size = np.repeat(np.array([n for _, n, _ in owners], np.int32), times)
        order = np.argsort(key)
        key, sets, size = key[order], sets[order], size[order]
        bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist()
        # 32 bits beside the bucket: lists that fall together only add candidates
        low = ((key >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return [(None, None, None, None, None, int(bucket[s]), low[s:e].tobytes(), sets[s:e].tobytes(), size[s:e].tobytes()) for s, e in zip(edges[:-1], edges[1:], strict=True)]

    shape = pa.schema([("key", pa.binary()), ("doc_id", kind), ("n", pa.int64()), ("set", pa.int64()), ("family", pa.list_(pa.int64())), ("bucket", pa.int64()), ("keys", pa.binary()), ("sets", pa.binary()), ("sizes", pa.binary())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(shape)], schema=shape)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, size = [], [], 0
        for batch in _parts(batches):
            rows = []
            each = [np.array(h or [], np.uint64) for h in batch.column("hot").to_pylist()] if "hot" in batch.schema.names else [np.zeros(0, np.uint64)] * batch.num_rows
            for row_key, doc_id, text, hot in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text")), each, strict=True):
                tokens = tokens_of(text)
                n = len(tokens)
                own = set_id(tokens)
                family = None
                if n:
                    codes = _codes(tokens, bits)
                    is_hot = _among(codes, heavy.value) | _among(codes, hot)
                    light = tokens[~is_hot]
                    first = n - needed(n) + 1
                    if len(light) < min(n, first - 1 + max(shared_lists(n), 2)):
                        family = np.concatenate([light, tokens[is_hot]])[:first].view(np.int64).tolist()
                    parts = []
                    if n < limit:
                        p = light[: first + 1]
                        i, j = np.triu_indices(len(p), 1)
                        parts.append((p[i] * np.uint64(_mix(201) | 1) + p[j] * np.uint64(_mix(202) | 1)) ^ np.uint64(_mix(203)))
                    if n >= needed(limit):
                        parts.append(light[: first - 1 + shared_lists(n)])
                    mine = np.concatenate([*parts, np.zeros(0, np.uint64)])
                    if len(mine):
                        keys.append(mine)
                        owners.append((own, n, len(mine)))
                        size += len(mine)
                rows.append((row_key, doc_id, n, own, family, None, None, None, None))
                if size >= GATHER:
                    rows += deal(keys, owners)
                    keys, owners, size = [], [], 0
            yield batch_of(rows)
        yield batch_of(deal(keys, owners))

    return work


def _scan_lists():
    """Pairs of different sets that meet in enough of a bucket's lists, with the number of lists; sizes must be compatible."""

    def scan(table: pa.Table) -> pa.Table:
        columns = [np.concatenate([np.frombuffer(b, kind) for b in table.column(c).to_pylist()]) for c, kind in (("keys", np.uint32), ("sets", np.int64), ("sizes", np.int32))]
        key, sets, size = columns
        order = np.lexsort((sets, key))
        key, sets, size = key[order], sets[order], size[order]
        first = np.concatenate([[True], (key[1:] != key[:-1]) | (sets[1:] != sets[:-1])])
        key, sets, size = key[first], sets[first], size[first]
        a, b, least = [], [], []
        # entries k places apart in the same list, for growing k until no list is that long
        at, step = np.arange(len(key)), 1
        while True:
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
            if not len(at):
                break
            x, y = size[at].astype(np.int64), size[at + step].astype(np.int64)
            low, high = np.minimum(x, y), np.maximum(x, y)
            fits = low * DEN >= high * NUM
            a.append(sets[at[fits]])
            b.append(sets[at[fits] + step])
            least.append(low[fits])
            step += 1
        a, b, least = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (a, b, least))
        order = np.lexsort((b, a))
        a, b, least = a[order], b[order], least[order]
        edge = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([edge, [len(a)]]))
        return pa.table({"a": pa.array(a[edge], pa.int64()), "b": pa.array(b[edge], pa.int64()), "least": pa.array(least[edge], pa.int64()), "lists": pa.array(count, pa.int64())})

    return scan


def _fetch(marks, bits: int):
    """(set, tokens) of the documents whose set is marked."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.frombuffer(marks.value, np.uint8)
        for batch in _parts(batches):
            sets, held = [], []
            for text in batch.column("text").to_pylist():
                tokens = tokens_of(text)
                own = set_id(tokens)
                at = own & ((1 << bits) - 1)
                if len(tokens) and marked[at >> 3] >> (at & 7) & 1:
                    sets.append(own)
                    held.append(tokens.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), pa.array(held, pa.list_(pa.int64()))], ["set", "tokens"])

    return work


def _compare_blocks(table: pa.Table) -> pa.Table:
    """A spanning forest of the links between the sets of one block, or of two."""
    sets, side = np.array(table.column("set").to_pylist(), np.int64), np.array(table.column("side").to_pylist())
    held = [np.array(t, np.int64) for t in table.column("tokens").to_pylist()]
    size = np.array([len(t) for t in held], np.int64)
    universe, column, times = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    # tokens of one set only can't be shared
    shared = np.cumsum(times > 1) - 1
    row = np.repeat(np.arange(len(held)), size)
    own = times[column] > 1
    row, column = row[own], shared[column[own]]
    width = int((times > 1).sum())
    common_tokens = np.zeros((len(held), len(held)), np.float32)
    for start in range(0, width, 4096):  # in stripes, so that the matrix stays small
        part = (column >= start) & (column < start + 4096)
        stripe = np.zeros((len(held), min(4096, width - start)), np.float32)
        stripe[row[part], column[part] - start] = 1
        common_tokens += stripe @ stripe.T
    # rows of links are made one at a time, and a set that has been reached is not reached again
    block = np.unique(side, return_inverse=True)[1]
    one_block, fresh, a, b = block.max() == 0, np.ones(len(held), bool), [], []
    for root in range(len(held)):
        if not fresh[root]:
            continue
        fresh[root], todo = False, [root]
        while todo:
            i = todo.pop()
            link = fresh & ((DEN + NUM) * common_tokens[i].astype(np.int64) >= NUM * (size[i] + size))
            if not one_block:
                link &= block != block[i]
            reached = np.flatnonzero(link)
            fresh[reached] = False
            todo += reached.tolist()
            a += [int(sets[i])] * len(reached)
            b += sets[reached].tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def similar(x: str, y: str) -> Column:
    """Whether two arrays of tokens link; sizes are compared first."""
    n, m = F.size(x), F.size(y)
    both = F.size(F.array_intersect(x, y))
    return (NUM * F.greatest(n, m) <= DEN * F.least(n, m)) & ((DEN + NUM) * both >= NUM * (n + m))


def with_pivots(labels: DataFrame, sets: DataFrame, home: str) -> tuple[DataFrame, DataFrame]:
    """labels: set, label. ((set, label, band, pivot), links with pivots); pivot: the pivots, as bits, that the set is connected with, 0 for none."""
    band = F.floor(F.log(F.size("tokens")) / F.log(F.lit(DEN / NUM))).cast("int")
    held = common.keep(labels.join(sets, "set").select("set", "label", band.alias("band"), "tokens"), f"{home}/held")
    chosen = held.groupBy("label").agg(F.array_distinct(F.array(*[F.min_by("set", F.xxhash64("set", F.lit(k))) for k in range(PIVOTS)])).alias("chosen"))
    chosen = chosen.select("label", F.posexplode("chosen").alias("place", "a")).withColumn("pivot", F.expr("shiftleft(1, place)"))
    pivots = common.keep(chosen.join(sets.select(F.col("set").alias("a"), F.col("tokens").alias("other")), "a"), f"{home}/pivots")
    met = common.keep(held.join(pivots, "label").filter(similar("tokens", "other")).select("set", "label", "pivot", "a"), f"{home}/met")
    reached = common.keep(met.groupBy("set", "label").agg(F.bit_or("pivot").alias("pivot")), f"{home}/reached")
    # at most 2 ** PIVOTS of a label; sets that share a pivot are joined until nothing is added
    every = common.keep(reached.groupBy("label").agg(F.sort_array(F.collect_set("pivot")).alias("every")), f"{home}/every")
    joined = F.aggregate(F.flatten(F.array_repeat("every", PIVOTS)), F.col("pivot"), lambda own, x: F.when(own.bitwiseAND(x) != 0, own.bitwiseOR(x)).otherwise(own))
    groups = every.select("label", "every", F.explode("every").alias("pivot")).select("label", "pivot", joined.alias("group"))
    grouped = reached.join(groups, ["label", "pivot"]).select("set", F.col("group").alias("pivot"))
    return held.drop("tokens").join(grouped, "set", "left").fillna(0, ["pivot"]), met.filter("a != set").select("a", F.col("set").alias("b"))


def family_members(sized: DataFrame, home: str) -> DataFrame:
    """sized: set, label, band, pivot. A row for each set and pair of blocks to compare that its own block is in: set, label, side, low and high (blocks)."""
    sized = common.keep(sized, f"{home}/sized")
    blocks = sized.groupBy("label", "band", "pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    # a label has at most PIVOTS + 1 groups in each of its bands
    spread = common.keep(blocks.groupBy("label").agg(F.collect_list(F.struct("band", "pivot", "n")).alias("spread")), f"{home}/spread")
    number = lambda band, pivot, i: band.cast("long") * (1 << 44) + pivot.cast("long") * (1 << 34) + i.cast("long")
    band, pivot = F.col("band"), F.col("pivot")
    mine = F.filter("spread", lambda x: (x["band"] == band) & (x["pivot"] == pivot))[0]["n"]
    at = sized.join(spread, "label").withColumn("side", number(band, pivot, F.pmod(F.xxhash64("set"), mine)))
    near = F.filter("spread", lambda x: (F.abs(x["band"] - band) <= 1) & ((x["pivot"] != pivot) | (pivot == 0)))
    others = F.flatten(F.transform(near, lambda x: F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda i: number(x["band"], x["pivot"], i))))
    side = F.col("side")
    return at.select("set", "label", "side", F.explode(others).alias("x")).select("set", "label", "side", F.least(side, F.col("x")).alias("low"), F.greatest(side, F.col("x")).alias("high"))


def join(docs: DataFrame) -> DataFrame:
    """docs: doc_id (of any type with an order) and text. Per row: doc_id, n_shingles, component_id, label (one for each component) and key (the row_key of id and text)."""
    spark, home = docs.sparkSession, common.shared_dir(docs.sparkSession)
    texts = docs.select(common.row_key("doc_id", "text").alias("key"), "doc_id", F.encode("text", "UTF-8").alias("text"))
    # six bytes to a word
    bits = max(4, math.ceil(math.log2(max(1, (docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0) / 6 / BUCKET))))

    counted = texts.select("text").mapInArrow(_count_rows(bits), "bucket long, packed binary").groupBy("bucket").applyInArrow(_count_bucket, "code long, docs long")
    counted = common.keep(counted, f"{home}/counted")
    stats = {r["code"]: r["docs"] for r in counted.filter("code < 0").groupBy("code").agg(F.sum("docs").alias("docs")).collect()}
    sizes, total = [stats.get(-1 - n, 0) for n in range(126)], stats.get(-128, 0)
    limit = boundary(sizes, total, 1 + stats.get(-200, 0) / max(1, total))
    frequent, others = most_frequent(counted.filter((F.col("code") >= 0) & (F.col("docs") >= HEAVY)), HEAVY_MOST)
    heavy = spark.sparkContext.broadcast(np.sort(frequent.toPandas()["code"].to_numpy(np.uint64)))
    asked = texts if others.isEmpty() else flagged(texts, others, heavy, bits, home)

    id_type = docs.schema["doc_id"].dataType
    entries = common.keep(
        asked.mapInArrow(_prefix_rows(bits, heavy, limit, to_arrow_type(id_type)), f"key binary, doc_id {id_type.simpleString()}, n long, set long, family array<long>, bucket long, keys binary, sets binary, sizes binary"),
        f"{home}/entries",
    )
    rows = entries.filter("bucket IS NULL").select("key", "doc_id", "n", "set", "family")
    met = entries.filter("bucket IS NOT NULL").select("bucket", "keys", "sets", "sizes").groupBy("bucket").applyInArrow(_scan_lists(), "a long, b long, least long, lists long")
    met = met.groupBy("a", "b").agg(F.min("least").alias("least"), F.sum("lists").alias("lists"))
    # two small sets may meet in a subset only; all others must meet in shared_lists(n) lists
    candidates = common.keep(met.filter((F.col("lists") >= 1 + F.floor(F.col("least") / 40)) | (F.col("least") < limit)).select("a", "b"), f"{home}/candidates")

    family = rows.filter("family IS NOT NULL").select("set", F.explode("family").alias("key")).distinct()
    # tables of their own, here and below, so that joins are between plain exchanges and Spark can split a common key
    family = common.keep(family, f"{home}/family")
    centres = common.keep(family.groupBy("key").agg(F.min("set").alias("a")), f"{home}/centres")
    stars = common.keep(family.join(centres, "key").select("a", F.col("set").alias("b")).filter("a != b"), f"{home}/stars").distinct()
    labels = components(stars, f"{home}/families")
    wanted = candidates.select(F.col("a").alias("set")).unionByName(candidates.select(F.col("b").alias("set"))).unionByName(labels.select(F.col("node").alias("set")))
    wanted = common.keep(wanted.distinct(), f"{home}/wanted")
    at = F.col("set").bitwiseAND(F.lit((1 << MARK_BITS) - 1))
    pages = wanted.groupBy(F.floor(at / 32768).cast("int").alias("page")).agg(F.bitmap_construct_agg((at % 32768).cast("long")).alias("bits")).collect()
    marks = bytearray(1 << (MARK_BITS - 3))
    for p in pages:
        marks[p["page"] * 4096 : (p["page"] + 1) * 4096] = p["bits"]
    fetched = texts.select("text").mapInArrow(_fetch(spark.sparkContext.broadcast(bytes(marks)), MARK_BITS), "set long, tokens array<long>")
    sets = common.keep(fetched.dropDuplicates(["set"]).join(wanted, "set"), f"{home}/sets")

    left = candidates.join(sets.select(F.col("set").alias("a"), F.col("tokens").alias("x")), "a")
    pairs = left.join(sets.select(F.col("set").alias("b"), F.col("tokens").alias("y")), "b")
    light_links = pairs.filter(similar("x", "y")).select("a", "b")

    sized, pivot_links = with_pivots(labels.select(F.col("node").alias("set"), "label"), sets, home)
    heavy_links = family_members(sized, home).join(sets, "set")
    heavy_links = heavy_links.groupBy("label", "low", "high").applyInArrow(_compare_blocks, "a long, b long")

    groups = components(light_links.unionByName(pivot_links).unionByName(heavy_links), f"{home}/groups")
    labelled = rows.join(groups.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    smallest = common.keep(labelled.groupBy("label").agg(F.min("doc_id").alias("component_id")), f"{home}/smallest")
    joined = labelled.join(smallest, "label")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "label", "key")
