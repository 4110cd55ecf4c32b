"""Personal data: fixed patterns for four kinds, and bootstrapped contextual extraction for what they don't know.

The base finds e-mail addresses, IP addresses, payment cards and phone numbers. With key-like strings (32 or more
hexadecimal digits) they are the seeds. A lexical pattern is what stands before an identifier: the two words to its left
and the signs attached to it. Patterns and identifiers form a graph over the corpus:

1. Every seed, and every other identifier-like word (a digit, `least` characters), gives an edge between its pattern and
   itself. A seed inside a word, after letters or digits, has no pattern.
2. A second reading counts all words that follow the patterns met with SUPPORT different identifiers or more, identifiers
   or not. SUPPORT is the same for every corpus.
3. Rounds, as joins over the graph. Seeds are known identifiers with score 1. A pattern is worth the mean score of all
   that follows it (what isn't known counts 0), and extracts if it has SUPPORT different known identifiers and is worth
   CONFIDENCE or more. What an extracting pattern finds becomes known, with the pattern's worth as its score and the kind
   that most of its known identifiers have, and so induces further patterns in the next round. Scores only rise, so the
   rounds end when no pattern is added.
4. Identifiers after extracting patterns become spans of the pattern's kind, unless a base span overlaps them.

"Of the" may stand before some cards but mostly before words, so it never extracts; `token = "` does.

Patterns are tables, of any length, and are joined to what is counted and found. Only a bitmap of their contexts, of fixed
size, is broadcast; it spares most words the join.

Defined results: a null text counts as an empty one and has no spans; equal rows get equal spans, and count twice in the
graph; offsets are code points; other columns never matter; an empty table gives an empty result. All searches
are linear in the length of a text, which is read whole.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .substring_dedup import _mix

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
LEAST, SUPPORT, CONFIDENCE = 8, 5, 0.8
#: Bits of the bitmap of contexts: 8 MB.
MARK_BITS = 26
#: Longest word that stands in a pattern itself; longer ones are there by their digest.
CONTEXT = 30

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The contract's patterns; what they can't need to give back is possessive, so that long runs cost linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WITH_DIGIT = re.compile(r"(?<!\S)[^\s0-9]*+[0-9]\S*+")
KEY = re.compile(r"[0-9a-f]{32,}")
EDGE = re.compile(r"[^\w]*")
SIGNS = re.compile(r"[^\w\s]*")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    out = list(emails(text))
    for m in IP.finditer(text):
        parts = m[0].split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:] or 0) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def words_before(text: str, at: int) -> list[str]:
    """The two words before a word, whole, however far they are."""
    size = 2 * CONTEXT + 8
    while True:
        words = text[max(0, at - size) : at].split()
        if size >= at or len(words) > 2:  # the first of three may have been cut
            return words[-2:]
        size *= 2


def identifiers(text: str, least: int = LEAST) -> Iterator[tuple[int, int, str]]:
    """(start, end, pattern) of identifier-like words, stripped of the signs around them."""
    for m in WITH_DIGIT.finditer(text):
        word = m[0]
        lead = EDGE.match(word).end()
        body = word[lead:].rstrip("\"'`.,;:!?)]}>#$%&*|=")
        if len(body) < least or not any("0" <= c <= "9" for c in body):
            continue
        start = m.start() + lead
        yield start, start + len(body), pattern_of(words_before(text, m.start()), word[:lead])


def short(word: str) -> str:
    return word if len(word) <= CONTEXT else hashlib.md5(word.encode()).hexdigest()


def pattern_of(left: list[str], lead: str) -> str:
    words = [short(x) for w in left for x in w.lower().split()][-2:]
    return "\t".join([*([""] * (2 - len(words)) + words), short(lead.lower())])


def edges_of(text: str, least: int = LEAST) -> Iterator[tuple[str, str, str | None]]:
    """(pattern, instance, kind) of the base spans that only signs attach to what is before them, and of other identifiers."""
    spans, seeds = base_spans(text), {}
    for kind, s, e in spans:
        word = s
        while word and not text[word - 1].isspace() and EDGE.fullmatch(text[word - 1]):
            word -= 1
        if not word or text[word - 1].isspace():
            # signs that a span begins with count as attached, as they do for all words
            seeds.setdefault(SIGNS.match(text, word).end(), (word, s, e, kind))
    longer, others = {}, []
    order, k, reach = sorted((s, e) for _, s, e in spans), 0, 0
    for start, end, pattern in identifiers(text, least):
        while k < len(order) and order[k][0] < start:
            reach = max(reach, order[k][1])
            k += 1
        if start in seeds:
            longer[start] = end
        elif start >= reach:  # not a part of a span
            body = text[start:end]
            others.append((pattern, body, SECRET if KEY.fullmatch(body) and not body.isdigit() else None))
    for start, (word, s, e, kind) in seeds.items():
        yield pattern_of(words_before(text, word), text[word:start]), text[s : max(e, longer.get(start, e))], kind
    yield from others


def _edges(least: int):
    shape = ["pattern", "instance", "kind"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                if not text:
                    continue
                rows += [(pattern, hashlib.sha256(instance.encode()).digest()[:16], kind) for pattern, instance, kind in edges_of(text, least)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary(), pa.string()))], shape)

    return work


def _places(words: list[str]) -> np.ndarray:
    """The bit of each two adjacent words."""
    from xxhash import xxh3_64_intdigest

    w = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    h = w[:-1] * np.uint64(_mix(301) | 1) + w[1:] * np.uint64(_mix(302) | 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(_mix(303) | 1)
    return (h >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def _mark_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = [int(_places(p.split("\t")[:2])[0]) for p in batch.column("pattern").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64())], ["at"])


def _marks(patterns: DataFrame) -> np.ndarray | None:
    """The bitmap of the patterns' contexts; None without patterns."""
    at = F.col("at")
    places = patterns.select("pattern").mapInArrow(_mark_rows, "at long")
    pages = places.groupBy(F.floor(at / 32768).cast("int").alias("page")).agg(F.bitmap_construct_agg(at % 32768).alias("bits")).collect()
    marks = bytearray(1 << (MARK_BITS - 3))
    for p in pages:
        marks[p["page"] * 4096 : (p["page"] + 1) * 4096] = p["bits"]
    return np.frombuffer(bytes(marks), np.uint8) if pages else None


def _marked(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    return marks[at >> 3] >> (at & 7).astype(np.uint8) & 1


def _followers(marks):
    """How many words of a batch follow each pattern of a marked context."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: Counter[str] = Counter()
            for text in batch.column("text").to_pylist():
                whole = ["", "", *(text or "").lower().split()]
                words = list(map(short, whole))
                for i in np.flatnonzero(_marked(marks.value, _places(words[:-1]))).tolist():
                    count["\t".join([words[i], words[i + 1], short(EDGE.match(whole[i + 2])[0])])] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["pattern", "followers"])

    return work


def learn(docs: DataFrame, *, least: int = LEAST, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Patterns that extract: pattern, kind, worth."""
    spark, home = docs.sparkSession, common.shared_dir(docs.sparkSession)
    texts = docs.select("text")
    met = texts.mapInArrow(_edges(least), "pattern string, instance binary, kind string")
    edges = common.keep(met.groupBy("pattern", "instance", "kind").agg(F.count(F.lit(1)).alias("times")), f"{home}/edges")
    wide = common.keep(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support).select("pattern"), f"{home}/wide")
    marks = _marks(wide)
    if marks is None:
        return wide.select("pattern", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("worth"))
    counted = texts.mapInArrow(_followers(spark.sparkContext.broadcast(marks)), "pattern string, followers long").groupBy("pattern").agg(F.sum("followers").alias("followers"))
    followers = common.keep(counted.join(wide, "pattern", "left_semi"), f"{home}/followers")
    graph = common.keep(edges.join(wide, "pattern", "left_semi"), f"{home}/graph")
    best = lambda *cols: F.max(F.struct(*cols))
    # what a seed is doesn't depend on where it stands
    seeds = common.keep(edges.filter("kind IS NOT NULL").groupBy("instance").agg(F.max("kind").alias("kind"), F.lit(1.0).alias("score")), f"{home}/seeds")
    known, n, turn = seeds, -1, 0
    while True:
        links = graph.select("pattern", "instance", "times").join(known, "instance")
        of_kind = links.groupBy("pattern", "kind").agg(F.count_distinct("instance").alias("n"), F.sum(F.col("score") * F.col("times")).alias("good"))
        each = of_kind.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), best("n", "kind")["kind"].alias("kind"))
        worth = F.least(F.lit(1.0), F.col("good") / F.greatest("followers", F.lit(1)))
        judged = each.join(followers, "pattern").select("pattern", "kind", "n", worth.alias("worth"))
        found = common.keep(judged.filter((F.col("n") >= support) & (F.col("worth") >= confidence)).select("pattern", "kind", "worth"), f"{home}/patterns{turn}")
        before, n = n, found.count()
        if n == before or not n:
            return found
        promoted = graph.select("pattern", "instance").join(found, "pattern").groupBy("instance").agg(best("worth", "kind").alias("x"))
        promoted = promoted.join(seeds.select("instance"), "instance", "left_anti").select("instance", "x.kind", F.col("x.worth").alias("score"))
        known = common.keep(seeds.unionByName(promoted), f"{home}/known{turn}")
        turn += 1


def _free(text: str, base: list[Span], marks: np.ndarray, least: int) -> list[tuple[str, int, int]]:
    """(pattern, start, end) of the identifiers in marked contexts that no base span overlaps."""
    out, order, reach = [], sorted((s, e) for _, s, e in base), [0]
    for _, e in order:
        reach.append(max(reach[-1], e))
    for start, end, pattern in identifiers(text, least):
        # of the base spans that start before its end, none reaches into it
        if reach[bisect_left(order, (end,))] <= start and _marked(marks, _places(pattern.split("\t")[:2]))[0]:
            out.append((pattern, start, end))
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, **how) -> DataFrame:
    """docs: doc_id and text. Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans (base and added)."""
    docs = docs.select("doc_id", "text")
    spark, home = docs.sparkSession, common.shared_dir(docs.sparkSession)
    patterns = learn(docs, **how)
    marks, least = spark.sparkContext.broadcast(_marks(patterns)), how.get("least", LEAST)
    names = ["key", "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "free"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                count = Counter(k for k, _, _ in base)
                free = _free(text, base, marks.value, least) if marks.value is not None else []
                text = _joined(base)
                rows.append((*(count[k] for k in KINDS), hashlib.sha256(text.encode()).hexdigest(), text, free))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.struct([("pattern", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"key binary, doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, free array<struct<pattern:string,start:long,end:long>>"
    read = docs.select(common.row_key("doc_id", "text").alias("key"), "doc_id", "text").mapInArrow(work, shape)
    counts = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256"]
    n_base = sum((F.col(f"n_{k}") for k in KINDS), F.lit(0).cast("long"))
    if marks.value is None:
        return read.select(*counts, F.col("base").alias("spans"), F.lit(0).cast("long").alias("n_added"), n_base.alias("n_spans"))
    read = common.keep(read, f"{home}/read")
    free = read.filter(F.size("free") > 0).select("key", F.explode("free").alias("word")).select("key", "word.*")
    added = free.join(patterns, "pattern").groupBy("key").agg(F.collect_set(F.concat_ws(":", "kind", "start", "end")).alias("added"))
    added = common.keep(added, f"{home}/added")
    every = read.drop("free").join(added, "key", "left")
    # in the order of kinds, then by start
    order = F.array(*[F.lit(k) for k in (*KINDS, SECRET)])
    spans = F.concat(F.filter(F.split("base", ","), lambda x: x != ""), F.col("added"))
    sortable = F.transform(spans, lambda x: F.struct(F.array_position(order, F.split_part(x, F.lit(":"), F.lit(1))), F.split_part(x, F.lit(":"), F.lit(2)).cast("long"), x.alias("span")))
    listed = F.array_join(F.array_sort(sortable)["span"], ",")
    n_added = F.when(F.col("added").isNull(), 0).otherwise(F.size("added")).cast("long")
    return every.select(*counts, F.when(F.col("added").isNull(), F.col("base")).otherwise(listed).alias("spans"), n_added.alias("n_added"), (n_base + n_added).alias("n_spans"))
