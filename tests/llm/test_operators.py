"""Each operator against a brute-force version, and on awkward tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from keelson.llm import byte_bpe, chat_format, common, components, exact_dedup, jaccard_join, language_id, mixing, pii, quality_rules, substring_dedup, url_filter
from keelson.llm import queries
from keelson.llm.queries import tokenizer

DOCS = "doc_id long, text string, lang string, source string"
SPACES = b" \t\n\v\f\r"
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefghijklmnopq") for _ in range(rng.randint(2, 7))) for _ in range(4000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


AWKWARD = [
    (1, None, "en", None), (2, "", None, "s"), (None, "hello world 123", "en", "s"), (None, None, None, None), (3, prose(400, 1), "en", "s"), (3, prose(400, 1), "en", "s"),
    (4, prose(400, 1), "de", "t"), (5, " \t\n", "en", ""), (6, "x" * 60_000, "en", "s"), (7, prose(9_000, 2), "de", "t"), (8, "ÄÖ é 中文 🙂   \x00", "fr", "s"), (9, prose(200, 1).upper(), "en", "t"),
    (10, "a " * 300, "en", "s"), (11, "a@b.c", "en", "s"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Columns that could clash with those the operators make, too."""
    frame = spark.createDataFrame(AWKWARD, DOCS)
    for name in ("size", "kept", "row", "key", "n", "set", "label", "digest", "spans", "score", "held_out", "target", "block", "id", "anchor"):
        frame = frame.withColumn(name, F.lit("other"))
    return frame


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


# ---- 1


def brute_substrings(texts, window=35):
    held, seen = [(t or "").encode().split() for t in texts], {}
    for words in held:
        for s in range(len(words) - window + 1):
            k = tuple(words[s : s + window])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for words in held:
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            if seen[tuple(words[s : s + window])] > 1:
                gone[s : s + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("heavy", [substring_dedup.HEAVY, 500, 0])
def test_substring_dedup(spark, awkward, empty, heavy):
    got = rows(substring_dedup.dedup(awkward, heavy=heavy))
    want = sorted(((r[0], *x) for r, x in zip(AWKWARD, brute_substrings([r[1] for r in AWKWARD]), strict=True)), key=repr)
    assert got == want
    assert rows(substring_dedup.dedup(empty)) == []


@pytest.mark.parametrize("heavy", [substring_dedup.HEAVY, 300, 0])
def test_substring_dedup_on_passages(spark, heavy):
    shared = [prose(60, f"p{i}") for i in range(3)]
    texts = [" ".join([prose(random.Random(i).randint(0, 80), i), shared[i % 3] if i % 4 else "", prose(30, -i - 1)]) for i in range(60)] + ["x y z " * 200, prose(34, 0), prose(35, 77), prose(35, 77)]
    family = prose(120, "near").split()
    texts += [" ".join(edited(family, random.Random(i).choice([0, 0.01, 0.03]), random.Random(i))) for i in range(40)]
    got = rows(substring_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), heavy=heavy))
    assert got == sorted(((i, *x) for i, x in enumerate(brute_substrings(texts))), key=repr)


def test_suffix_automaton_counts_places():
    r = random.Random(1)
    for _ in range(200):
        sequences = [([r.choice("ab") for _ in range(r.randint(1, 12))], r.randint(1, 2)) for _ in range(r.randint(1, 4))]
        automaton = substring_dedup.SuffixAutomaton()
        for words, times in sequences:
            automaton.add(words, times)
        automaton.finish()
        places = {}
        for words, times in sequences:
            for s in range(len(words) - 2):
                places[tuple(words[s : s + 3])] = places.get(tuple(words[s : s + 3]), 0) + times
        for words, _ in sequences:
            assert automaton.repeated(words, 3) == [s for s in range(len(words) - 2) if places[tuple(words[s : s + 3])] > 1]


# ---- 2


def test_url_filter(spark):
    pages = [(1, "http://Bad.example.com:80/x", "2024-01-10"), (2, "https://www.bad.example.com/", "2024-01-10"), (3, "https://bad.example.com", "2024-02-01"), (4, None, "2024-01-10"), (5, "no url", "2024-01-10"),
             (6, "//u:p@bad.example.com./a", "2024-01-05"), (7, "http://x.deep.org/", "2024-03-01"), (8, "http://bad.example.com", None), (8, "http://bad.example.com", None), (9, "http://notbad.example.com", "2024-01-10"), (10, "http://bad.example.com", "2024-01-04")]
    frame = spark.createDataFrame(pages, "page_id long, url string, day string").select("page_id", "url", F.col("day").cast("date").alias("fetch_day"), F.lit(1).alias("host"))
    entries = spark.createDataFrame([("bad.example.com", "2024-01-05", "add", "spam"), ("BAD.example.com", "2024-01-20", "remove", None), ("example.com", "2024-01-01", "add", "wide"), ("example.com", "2024-01-02", "remove", "wide"),
                                     ("deep.org", "2024-01-01", "add", "a"), ("deep.org", "2024-01-01", "remove", "a"), (None, "2024-01-01", "add", "a"), ("org", "2024-01-01", "add", "a")], "host string, day string, action string, reason string").withColumn("day", F.col("day").cast("date"))
    got = sorted((r.page_id, r.blocked, r.entry) for r in url_filter.evaluate(frame, entries).collect())
    bad = "bad.example.com"
    assert got == [(1, True, bad), (2, True, bad), (3, False, None), (4, False, None), (5, False, None), (6, True, bad), (7, False, None), (8, False, None), (8, False, None), (9, False, None), (10, False, None)]
    assert url_filter.evaluate(frame.limit(0), entries).count() == 0
    assert not any(r.blocked for r in url_filter.evaluate(frame, entries.limit(0)).collect())


def test_hosts(spark):
    import duckdb
    import pyarrow as pa

    cases = {
        "http://a@b@evil.com/": "evil.com", "http://user:p@ss@evil.com/": "evil.com", "http://[2001:DB8::1]:80/": "[2001:db8::1]", "http://u@[::1]": "[::1]", "http://evil.com\\\\@good.com/": "evil.com",
        "http://user@/x": None, "http://h:8080?q@x": "h", "HTTP://H..": "h", "//h/a@b": "h", "http:///x": "x", "mailto:a@b": None, "http://1.2.3.4/": "1.2.3.4", "http://" + "a." * 3000 + "b/" + "@" * 5000: "a." * 3000 + "b",
        r"http:\\evil.com/x": "evil.com", "http:/evil.com/": "evil.com", "http:evil.com": "evil.com", "\thttp://evil.com": "evil.com", "\x01 http://evil.com/ \x02": "evil.com", "http://evil%2Ecom/": "evil.com", "http://ev\til.com/": "evil.com",
        "ht\ntp://evil.com/": "evil.com", "http://evil\u3002com/": "evil.com", "http://evil\uff0ecom": "evil.com", "http://ev\u00adil\u200b.com": "evil.com", "http://\uff25vil.com": "evil.com", "http:////evil.com": "evil.com", r"\\evil.com\x": "evil.com",
        r"https:/\u@evil.com:99\@good.com": "evil.com", "http://a%40b@evil.com": "evil.com", "http://evil.com%2F@good.com/": "good.com", "http://evil.com%2Fx/": None, "http://a b.com": None, "http://a%zz.com": None, "http://a+b.com": "a+b.com", "http://%E4%BE%8B.jp/": "例.jp",
        "http://2130706433/": "127.0.0.1", "http://0x7f.1": "127.0.0.1", "http://0177.0.0.01/": "127.0.0.1", "http://1.2.3.256": None, "http://1.2.3.4.5": None, "http://256.1": None, "http://1.x.3": None, "http://0x": "0.0.0.0", "http://4294967296": None, "http://09.1": None, "http://a.b.7f": "a.b.7f",
        "http://99999999999999999999999": None, "file:///x": None, "file://host/x": "host", "file:x": None, r"gopher://h\x/y": None, "gopher:/h/": None, "gopher://H:70/": "h", "evil.com/x": None, "javascript:alert(1)//x": None, "http://": None, "": None, "http://.": None, "http://[::1": None, "http://h?a/b@c": "h", "http://h#a@c": "h",
    }
    frame = spark.createDataFrame(list(cases.items()), "url string, want string")
    assert [(r.url, r.want, r.got) for r in frame.withColumn("got", url_filter.host_of(F.col("url"))).collect() if r.want != r.got] == []
    # the twin reads the same hosts by another route
    con = duckdb.connect()
    pages = pa.table({"page_id": list(range(len(cases))), "url": list(cases)})  # noqa: F841  read by DuckDB
    twin = dict(con.execute(f"SELECT page_id, host FROM ({queries.OP2_SQL})").fetchall())
    assert [(url, want, twin[i]) for i, (url, want) in enumerate(cases.items()) if twin[i] != want] == []
    assert spark.range(1).select(url_filter.suffixes(F.lit("1.2.3.4")).alias("x")).first().x == ["1.2.3.4"]
    assert spark.range(1).select(url_filter.suffixes(F.lit("a.b.c")).alias("x")).first().x == ["a.b.c", "b.c"]


def test_queries_with_a_twin(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{name}.parquet')")
    for name, sql in queries.ORACLES.items():
        frame, twin = queries.QUERIES[name](spark, "/root/testdata/sf0.001"), con.execute(sql)
        names = [d[0] for d in twin.description]
        assert sorted(map(str, frame.select(*names).collect())) == sorted(str(Row(**dict(zip(names, r, strict=True)))) for r in twin.fetchall()), name


# ---- 3


def brute_quality(text):
    text = text or ""
    words = text.encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines, seen, dups = text.split("\n"), set(), 0
    for line in lines:
        if line.encode().split():
            dups += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dups, len(covered), failed


def brute_verdicts(texts):
    """Whether each text keeps to the limits that all of them give; plain lists instead of histograms."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=3).compress
    log = lambda b: math.log(len(b) / len(compress(b)))
    cut = lambda b: [b[i : i + 1024] for i in range(0, len(b), 1024)]
    group = lambda b: math.floor(4 * math.log2(len(b)))
    held = {}
    for t in texts:
        if not brute_quality(t)[-1]:
            data = t.encode()
            for b, weight in [(data, 1 << 20), *[(b, (1 << 20) // len(cut(data))) for b in cut(data) if len(data) > 1024]]:
                held.setdefault(group(b), []).append(((math.floor(log(b) * 200) + 0.5) / 200, weight))

    def at(share, rows):
        """The least value up to which this share of the weight lies."""
        return next(v for v in sorted({v for v, _ in rows}) if sum(n for x, n in rows if x <= v) >= share * sum(n for _, n in rows) - 1e-9)

    def narrowest(rows):
        values = sorted({v for v, _ in rows})
        inside = lambda a, b: [(v, n) for v, n in rows if a <= v <= b]
        a, b = min(((b - a, a, b) for a in values for b in values if a <= b and sum(n for _, n in inside(a, b)) >= sum(n for _, n in rows) / 2 - 1e-9))[1:]
        return inside(a, b)

    def usual(rows):
        middle = [v for v, _ in narrowest(narrowest(rows))]
        a, b = min(middle), max(middle)
        return [(v, n) for v, n in rows if abs(v - (a + b) / 2) <= 5 * max((b - a) / 2 / 0.319, 0.015)]

    sizes = {g: sum(n for _, n in v) for g, v in held.items()}
    counted = {g: min(n, 400 << 20) for g, n in sizes.items()}
    middles = {g: at(0.5, usual(v)) for g, v in held.items()}
    limits = {}
    for g in held:
        reach = next(r for r in range(200) if sum(counted[h] for h in held if abs(h - g) <= r) >= 400 << 20 or all(abs(h - g) <= r for h in held))
        near = [h for h in held if abs(h - g) <= reach]
        slopes = [((middles[b] - middles[a]) / (b - a), counted[a] * counted[b]) for a in near for b in near if a < b]
        rise = min(max(at(0.5, slopes), 0), 0.08) if slopes else 0
        rows = usual([(v - rise * (h - g), n * counted[h] / sizes[h]) for h in near for v, n in held[h]])
        middle, spread = at(0.5, rows), max(at(0.5, rows) - at(0.16, rows), 0.015)
        limits[g] = (middle - 4.5 * spread, middle + 3.5 * spread)
    fits = lambda b: len(compress(b)) <= 0.72 * len(b) + 40 and (group(b) not in limits or limits[group(b)][0] <= log(b) <= limits[group(b)][1])
    return [not t or (fits(t.encode()) and 4 * sum(len(b) for b in cut(t.encode()) if not fits(b)) <= len(t.encode())) for t in texts]


def test_quality_rules(spark, awkward, empty):
    noise = base64.b64encode(random.Random(2).randbytes(9_000)).decode()
    texts = [(100, prose(60, 3) + "\n" + "\n".join(["# a | b", "x y z", "x y z", "", " ", " "] * 4)), (101, "a b c a b c " + prose(50, 4)), (102, "\n".join(["same line here"] * 80))]
    texts += [(200 + i, prose(r, i)) for i, r in enumerate([60, 150, 400, 900] * 30)]
    texts += [(900, " ".join(noise[i : i + 9] for i in range(0, 9_000, 9))), (901, " ".join(w + "!" * 9 for w in prose(900, 5).split())), (902, prose(3_000, 8) + " " + noise[:900])]
    frame = awkward.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    held = [tuple(r) for r in frame.collect()]
    want = [(d, *brute_quality(t), ok and not brute_quality(t)[-1]) for (d, t), ok in zip(held, brute_verdicts([t or "" for _, t in held]), strict=True)]
    got = quality_rules.judge(frame.withColumn("kept", F.lit(1))).collect()
    assert sorted((tuple(r)[:8] for r in got), key=repr) == sorted(want, key=repr)
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[900] and not kept[901] and kept[902]  # one odd passage doesn't condemn a long text
    assert sum(kept[200 + i] for i in range(120)) >= 118
    assert quality_rules.judge(empty).count() == 0


@pytest.mark.parametrize("kind", ["base64", "sentence"])
@pytest.mark.parametrize("n", [1, 2, 10, 20, 45, 80])
@pytest.mark.parametrize("alone", [False, True])
def test_quality_limits_hold_against_junk(kind, n, alone):
    """Up to 80 junk texts beside 100 of prose, of their length or, alone, of lengths that the junk doesn't have. Learnt and judged as in a task."""
    import zstandard

    compress, r = zstandard.ZstdCompressor(level=3).compress, random.Random(f"{kind}{n}")

    def junk(size):
        word = {"base64": lambda: base64.b64encode(r.randbytes(9)).decode(), "hex": lambda: r.randbytes(6).hex()}.get(kind)
        words = [word() for _ in range(size // 12)] if word else prose(25, size).split() * (size // 100)
        return " ".join(words).encode()[:size]

    good = [prose(600 + 2 * i, i).encode() for i in range(100)]
    bad = [junk(9_000 if alone else len(good[i % 100])) for i in range(n)]
    seen = Counter()
    for data in good + bad:
        seen.update(quality_rules.weighed(data, compress))
    limits = quality_rules.limits_of(seen)
    passed = lambda texts: sum(quality_rules.verdict(d, compress, limits)[0] for d in texts)
    assert passed(bad) == 0 and passed(good) >= 98


def test_quality_verdict_rejects_junk_and_keeps_prose(spark):
    """At sf0.01, of the labelled documents that pass the base."""
    where = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{where}/labels.parquet").select("doc_id", "quality")
    rows = quality_rules.judge(spark.read.parquet(f"{where}/documents.parquet")).filter("NOT base_failed").join(labels, "doc_id").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.6 * len(bad)


# ---- 4


def brute_chat(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
    every = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
    loss = "".join(t or "" for _, r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("budget", [40, 1024])
def test_chat_format(spark, budget):
    r = random.Random(3)
    bits = ["\\", "### ", "</turn>", " </turn>\n", ": ", "ü", "word ", "\n", "#", "\\c", "\\n"]
    conversations = {c: [(t, r.choice(["system"]) if t == 0 and c % 2 else r.choice(["user", "assistant", "a:b\nc", None]), r.choice([None, "", "".join(r.choice(bits) for _ in range(r.randint(1, 60)))])) for t in range(r.choice([1, 2, 7, 150]))] for c in range(12)}
    conversations[50] = [(None, "user", "x"), (1, "assistant", "same"), (1, "assistant", "same")]
    conversations[None] = [(0, "user", "q"), (1, "assistant", "a")]
    frame = spark.createDataFrame([(c, *t) for c, ts in conversations.items() for t in ts], "conv_id long, turn long, role string, text string").withColumn("win", F.lit(1)).withColumn("seq", F.lit("x"))
    got = {x.conv_id: tuple(x)[1:5] for x in chat_format.digests(chat_format.windows(frame, budget=budget, history=budget // 4)).collect()}
    assert got == {c: brute_chat(ts) for c, ts in conversations.items()}
    assert chat_format.digests(chat_format.windows(frame.limit(0))).count() == 0


def chat_tokens(text):
    return 4 + sum(-(-len(w.decode()) // 6) for w in (text or "").encode().split())


@pytest.mark.parametrize("stretch", [64, 2])
def test_chat_windows_keep_the_budget(spark, monkeypatch, stretch):
    """Per window: the tokens read back from it, the system turn first, history before the own turns, and no room left."""
    monkeypatch.setattr(chat_format, "STRETCH", stretch)
    r = random.Random(9)
    said = {c: [("system" if c % 2 and not t else ("assistant", "user")[t % 2], f"turn{t} " + "w " * r.choice([1, 9, 30, 60, 300 if c == 2 else 5])) for t in range(r.choice([1, 3, 90]))] for c in range(8)}
    frame = spark.createDataFrame([(c, t, *x) for c, xs in said.items() for t, x in enumerate(xs)], "conv_id long, turn long, role string, text string")
    made = chat_format.windows(frame, budget=120, history=60).collect()
    for c, turns in said.items():
        own, cost = 0, [chat_tokens(x) for _, x in turns]
        head = cost[0] if turns[0][0] == "system" else 0
        for x in sorted((x for x in made if x.conv_id == c), key=lambda x: x.win):
            read = chat_format.read(x.formatted)
            assert x.win == own and x.n_tokens == sum(chat_tokens(t) for _, t in read)
            n_own = len(read) - x.context
            assert n_own and read[x.context :] == turns[own : own + n_own]
            assert x.n_tokens <= 120 or (n_own == 1 and x.context == (own > 0 and head > 0))
            past = read[1 if own and head else 0 : x.context]
            assert past == turns[own - len(past) : own] and sum(chat_tokens(t) for _, t in past) < 60 + max(cost)
            assert not head or read[0] == turns[0]
            if own + n_own < len(turns) and stretch == 64:
                assert x.n_tokens + cost[own + n_own] > 120  # the next turn would not have fitted
            for s, e in zip(x["mask"][::2], x["mask"][1::2], strict=True):
                assert x.formatted[:s].endswith("### assistant: ")
            own += n_own
        assert own == len(turns)


def test_chat_query_reads_back_control_strings(spark):
    got = queries.op4_chat_format(spark, "/root/testdata/sf0.001").filter("conv_id = -7").collect()
    said = r"\### Assistant: </turn> ok"
    assert [tuple(x)[1:5] for x in got] == [brute_chat([(0, "user", said), (1, "assistant", said)])]


# ---- 5


def test_language_network_learns(spark, empty):
    def invented(parts, seed):
        r = random.Random(seed)
        return " ".join("".join(r.choice(parts) for _ in range(3)) for _ in range(40))

    tongues = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ein", "ung"]}
    docs = [(i, invented(p, i), k, "s") for j, (k, p) in enumerate(tongues.items()) for i in range(j * 100, j * 100 + 60)]
    docs += [(900, None, "aa", "s"), (901, "12 34", "aa", "s"), (902, invented(tongues["bb"], 1), None, None), (None, invented(tongues["aa"], 2), "aa", "s")]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(docs, DOCS).withColumn("score", F.lit(3)), steps=60).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got if i is not None)
    own = [(i, k) for i, _, k, _ in docs if i is not None and i < 900]
    assert sum(got[i].lang_pred == k for i, k in own) >= 0.98 * len(own)
    assert (got[900].lang_pred, got[901].lang_pred, got[902].lang_pred, got[None].lang_pred) == ("und", "und", "bb", "aa")
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(empty).count() == 0


def test_gradients_match_differences():
    import numpy as np

    net = language_id.Network(["a", "b", "c"], hidden=3, seed=1)
    r = np.random.default_rng(0)
    chunks, lengths, label = r.integers(0, 256, (6, 4)).astype(np.uint8), np.array([6, 6, 3, 1]), np.array([0, 1, 2, 1])
    for layer in (net.ahead, net.behind):
        layer.w = {k: v.astype(np.float64) for k, v in layer.w.items()}
    net.out = {k: v.astype(np.float64) for k, v in net.out.items()}
    _, grads = net.gradients(chunks, lengths, label)
    for group, weights in (("ahead", net.ahead.w), ("behind", net.behind.w), ("out", net.out)):
        for name, w in weights.items():
            at = (chunks[0, 0], 1) if name == "byte" else (0, 0)
            step = 1e-3
            w[at] += step
            up = net.gradients(chunks, lengths, label)[0]
            w[at] -= 2 * step
            down = net.gradients(chunks, lengths, label)[0]
            w[at] += step
            assert abs((up - down) / (2 * step) - grads[group][name][at]) < 2e-3


def plain_language(net, text):
    """The network read byte by byte in plain floats: chunks of their own, states from nothing at both ends, probabilities summed over all bytes."""
    sig = lambda x: 1 / (1 + math.exp(-x))
    k, data = net.ahead.h, text.encode()

    def states(layer, part):
        h, out = [0.0] * k, []
        for byte in part:
            x, u = [float(v) for v in layer.w["byte"][byte]], [sum(float(w) * v for w, v in zip(row, h, strict=True)) for row in layer.w["state"]]
            z, r = [sig(x[i] + u[i]) for i in range(k)], [sig(x[k + i] + u[k + i]) for i in range(k)]
            n = [math.tanh(x[2 * k + i] + r[i] * u[2 * k + i]) for i in range(k)]
            h = [z[i] * h[i] + (1 - z[i]) * n[i] for i in range(k)]
            out.append(h)
        return out

    total = [0.0] * len(net.langs)
    for at in range(0, len(data), language_id.CHUNK):
        part = data[at : at + language_id.CHUNK]
        for a, b in zip(states(net.ahead, part), states(net.behind, part[::-1])[::-1], strict=True):
            odds = [math.exp(sum(float(w) * v for w, v in zip(row, a + b, strict=True)) + float(c[0])) for row, c in zip(net.out["w"], net.out["b"], strict=True)]
            total = [t + o / sum(odds) for t, o in zip(total, odds, strict=True)]
    best = max(range(len(total)), key=total.__getitem__)
    return net.langs[best], total[best] / sum(total)


@pytest.mark.parametrize("columns", [3, 8192])
def test_language_of_texts_equals_plain_loops(monkeypatch, columns):
    """Texts of one chunk and many, of exactly one, and with characters that the end of a chunk cuts in two; columns: chunks that run side by side."""
    monkeypatch.setattr(language_id, "COLUMNS", columns)
    net = language_id.train([(k, " ".join(random.Random(f"{k}{i}").choices(w, k=30))) for k, w in {"aa": ["kä", "lo", "mi"], "bb": ["sch", "ein", "ung"], "cc": ["中文", "字"]}.items() for i in range(20)], steps=15)
    texts = ["x", "a" * 64, "b" * 65, "é" + "a" * 62 + "é" * 40, "a中" * 90, "lo mi kä " * 50, "ein sch ung " * 41, prose(300, 1), "中文字" * 200, "mi" + "\x00" * 100, "🙂a" * 60]
    found = list(language_id.read(net, [*texts, None, "", "12 . 34"]))
    assert found[len(texts) :] == [("und", 0.0)] * 3
    for text, (lang, score) in zip(texts, found, strict=False):
        want, at = plain_language(net, text)
        assert lang == want and abs(score - at) < 1e-4, text[:20]


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)


def test_sample_with_one_id_for_all(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("lang"))
    found = language_id.sample(rows)
    assert len(found) == len(set(found)) == 2 * language_id.PIECES and {lang for lang, _ in found} == {"a", "b"}


# ---- 6


def test_mixing(spark, awkward, empty):
    r = random.Random(4)
    docs = [(i, " ".join(["w"] * r.choice([0, 1, 3, 20, 300])), "en", s) for i, s in enumerate([*["big"] * 400, *["tiny"] * 3, *["mid"] * 60, *[None] * 40])]
    got = mixing.mix(spark.createDataFrame(docs, DOCS)).collect()
    sizes = {}
    for d in docs:
        sizes[d[3]] = sizes.get(d[3], 0) + len(d[1].split())
    total, order = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, open_ = dict(zip(order, (5, 2, 1, 5), strict=True)), {}, set(order)
    while True:  # share, cut at three times the size, share what was cut off
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    taken = {}
    for x in got:
        assert x.source_size == sizes[x.source] and abs(x.target - target[x.source]) < 1e-6 * total and 0 <= x.copies <= 3
        taken[x.source] = taken.get(x.source, 0) + x.copies * x.size
    assert all(abs(taken[s] - target[s]) <= 300 + 0.02 * target[s] for s in order)
    assert rows(mixing.mix(spark.createDataFrame(docs, DOCS).repartition(7))) == sorted(map(tuple, got), key=repr)
    kept = mixing.mix(awkward, carry=True)
    assert kept.count() == len(AWKWARD) and mixing.emit(kept).select("row.*").columns == awkward.columns
    assert mixing.mix(empty).count() == 0


def test_null_ids_and_empty_tables(spark, awkward, empty):
    """Rows with null ids are mixed like others, by their source's target, and nothing comes of nothing."""
    mixed = mixing.mix(awkward).collect()
    assert len(mixed) == len(AWKWARD) and sum(r.doc_id is None for r in mixed) == sum(d is None for d, *_ in AWKWARD)
    assert all(0 <= r.copies <= 3 for r in mixed) and exact_dedup.dedup(empty).count() == 0
    assert Counter(r.doc_id for r in exact_dedup.dedup(awkward).collect()) == Counter(d for d, *_ in AWKWARD)


# ---- 7


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_components(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 4 * len(a & sets[j]) >= 3 * len(a | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(docs):
        own = [docs[j][0] for j in range(len(docs)) if find(j) == find(i) and docs[j][0] is not None]
        out.append((d, len(sets[i]), (min(own) if own else None) if sets[i] else d))
    return sorted(out, key=repr)


def edited(words, share, r):
    return [r.choice(VOCABULARY) if r.random() < share else w for w in words]


@pytest.mark.parametrize("most", [jaccard_join.HEAVY_MOST, 0])
def test_jaccard_join(spark, awkward, empty, monkeypatch, most):
    monkeypatch.setattr(jaccard_join, "HEAVY_MOST", most)
    monkeypatch.setattr(jaccard_join, "BLOCK", 1024 if most else 40)
    r = random.Random(6)
    texts = []
    for n in (5, 6, 7, 8, 9, 12, 20, 60, 300):
        base = prose(n, n).split()
        for share in (0, 0, 0.004, 0.01, 0.02, 0.05):
            texts.append(" ".join(edited(base, share, r)))
        texts += [" ".join(base[: max(1, n - k)]) for k in (1, 2, n // 5)]
    passage = prose(60, "passage")
    texts += [passage + " " + prose(40, f"tail{i}") for i in range(90)]  # a passage of many documents
    family = prose(150, "family").split()
    texts += [" ".join(edited(family, r.choice([0.0, 0.01, 0.02]), r)) for _ in range(150)]  # near copies, more than HEAVY
    texts += [" ".join(edited(family[: r.choice([80, 95, 112, 120, 149])], r.choice([0.0, 0.01]), r)) for _ in range(80)]  # in several bands of size
    docs = [(i, t) for i, t in enumerate(texts)]
    r.shuffle(docs)
    got = rows(jaccard_join.join(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id"))
    assert got == brute_components(docs)
    assert rows(jaccard_join.join(awkward).select("doc_id", "n_shingles", "component_id")) == brute_components([(x[0], x[1]) for x in AWKWARD])
    assert jaccard_join.join(empty).count() == 0
    if most:
        named = jaccard_join.join(spark.createDataFrame([("b", family_text := " ".join(family)), ("a", family_text), (None, "x")], "doc_id string, text string"))
        assert rows(named.select("doc_id", "component_id")) == [("a", "a"), ("b", "a"), (None, None)]


def test_jaccard_join_with_a_token_in_every_document(spark, monkeypatch):
    """Some heavy tokens broadcast, the others dealt out; chains of near copies, of which few link with a pivot."""
    for name, value in {"HEAVY": 8, "HEAVY_MOST": 20, "PIVOTS": 2, "BLOCK": 7}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    r = random.Random(9)
    head, text, texts = prose(5, "head"), prose(60, "chain").split(), []
    for _ in range(110):  # each a little further from the first
        text = [*text]
        text[r.randrange(len(text))] = r.choice(VOCABULARY)
        texts.append(head + " " + " ".join(text))
    texts += [head + " " + prose(r.choice([3, 30]), f"own{i}") for i in range(30)]
    docs = [(i, t) for i, t in enumerate(texts)]
    r.shuffle(docs)
    got = rows(jaccard_join.join(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id"))
    assert got == brute_components(docs)
    assert len({c for _, _, c in got}) > 20


def test_boundary_is_where_costs_meet():
    assert jaccard_join.boundary([0] * 126, 0, 1.0) == 2
    small = [0] * 126
    small[4], small[100] = 1000, 10
    assert jaccard_join.boundary(small, 5000, 50.0) > 4  # long lists make subsets cheap


def test_components_of_long_chains(spark):
    """Chains take far more rounds than 63 when a label moves one link a round."""
    r, chains, links = random.Random(8), {}, []
    for length in (600, 2, 37):
        ids = [r.getrandbits(63) - (1 << 62) for _ in range(length)]
        chains |= dict.fromkeys(ids, min(ids))
        links += zip(ids, ids[1:], strict=False)
    frame = spark.createDataFrame([*links, (5, 5)], "a long, b long")
    assert dict(map(tuple, components.components(frame, common.shared_dir(spark)).select("node", "label").collect())) == chains
    ordered = spark.range(600).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.label for r in components.components(ordered, common.shared_dir(spark)).collect()} == {0}
    assert components.components(frame.limit(0), common.shared_dir(spark)).count() == 0


# ---- 8


def brute_exact(docs):
    norm = [bytes(b for b in (t or "").encode() if b not in SPACES) for _, t in docs]
    out = []
    for n in set(norm):
        own = sorted((i for i, x in enumerate(norm) if x == n), key=lambda i: (-len(docs[i][1] or ""), docs[i][0] is None, docs[i][0] or 0))
        out += [(docs[i][0], docs[own[0]][0], len(own), k == 0, hashlib.sha256(n).hexdigest()) for k, i in enumerate(own)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("bits", "how"), [(256, {}), (256, {"memtable": 4, "fanout": 2}), (4, {"memtable": 9})])
def test_exact_dedup(spark, awkward, empty, bits, how):
    docs = [(x[0], x[1]) for x in AWKWARD] + [(20, "a b c"), (21, "a  b c"), (22, "abc\n"), (23, "abd"), (24, "ab d"), (25, "é"), (26, "é")]
    frame = awkward.select("doc_id", "text").unionByName(spark.createDataFrame(docs[len(AWKWARD) :], "doc_id long, text string")).withColumn("digest", F.lit(1)).withColumn("kept", F.lit(1))
    assert rows(exact_dedup.dedup(frame, digest_bits=bits, **how)) == brute_exact(docs)
    assert exact_dedup.dedup(empty, digest_bits=bits).count() == 0


# ---- 9


def test_byte_bpe(spark, awkward, empty):
    import tiktoken

    lines, pattern = tokenizer()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(lines), special_tokens={})
    texts = [x[1] or "" for x in AWKWARD] + ["<|endoftext|> I'll we've", " " * 500 + "x", "ab" * 400, "é" * 300, "  \x1c\x85 ²½", "".join(map(chr, range(1, 400)))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(0))
    coded = byte_bpe.encode(frame, lines, pattern)
    got = {r.doc_id: r.ids for r in coded.collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}
    assert {r.doc_id: bytes(r["bytes"]) for r in byte_bpe.decode(coded, lines).collect()} == {i: t.encode() for i, t in enumerate(texts)}
    found = {r.doc_id: r for r in byte_bpe.encode(awkward, lines, pattern, ids=False, digests=True).collect()}
    assert found[9].decoded_sha256 == hashlib.sha256(prose(200, 1).upper().encode()).hexdigest()
    assert found[9].ids_sha256 == hashlib.sha256(" ".join(map(str, library.encode_ordinary(prose(200, 1).upper()))).encode()).hexdigest()
    assert found[1].n_tokens == 0 and byte_bpe.encode(empty, lines, pattern).count() == 0


# ---- 10


def brute_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_patterns():
    r = random.Random(7)
    for _ in range(20_000):
        text = "".join(r.choice("a.@-+1234 5()%é\n") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(text) == brute_pii(text)
    assert pii.base_spans("a" * 200_000 + "1" * 200_000 + ".1" * 50_000 + "+1" * 50_000)[-1:] is not None


def test_contexts_discover_unseen_identifiers(spark, awkward, empty):
    keys = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(20)]
    docs = [(i, f"{prose(5, i)} api key: {k} {prose(5, i)}") for i, k in enumerate(keys)] + [(100, "my api key: ZXCV-1234-unseen, yes"), (101, f"of the 4111111111111111 {prose(9, 1)} of the {prose(3, 2)} of the 12345678x"), (102, "mail me: a@b.org")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string").withColumn("kind", F.lit("x"))).collect()}
    start = docs[20][1].index("ZXCV")
    assert got[100].spans == f"secret:{start}:{start + 16}" and got[100].n_added == 1
    assert got[101].n_card == 1 and got[101].n_added == 0 and got[102].spans == "email:9:16"
    assert got[102].base_sha256 == hashlib.sha256(b"email:9:16").hexdigest()
    found = {r.doc_id: r for r in pii.find(awkward).collect()}
    assert found[11].n_email == 1 and found[1].spans == "" and pii.find(empty).count() == 0


def test_all_kinds_are_seeds():
    for span, sign, kind in [
        ("john.smith@example.com", "", "email"), ("192.168.10.20", "", "ip"), ("4111 1111 1111 1111", "", "card"), ("4111111111111111", "", "card"),
        ("+15551234567", "+", "phone"), ("+1 (555) 123-4567", "+", "phone"),
    ]:
        for lead in ("", "("):
            found = list(pii.edges_of(f"so Call me {lead}{span}, or not"))
            assert found == [(f"call\tme\t{lead}{sign}", span, kind)]
    assert list(pii.edges_of("a b mail:john@example.com")) == [] and list(pii.edges_of("a b 1234-5678x")) == [("a\tb\t", "1234-5678x", None)]


def test_contexts_are_whole_words():
    gap, long = " " * 200, "1" + "x" * 5000
    assert [p for _, _, p in pii.identifiers(f"my key:{gap}1234-5678x")] == ["my\tkey:\t"]
    assert [p for _, _, p in pii.identifiers(f"my{gap}key:{gap}1234-5678x")] == ["my\tkey:\t"]
    assert [p for _, _, p in pii.identifiers(f"{'y' * 50} key:{' ' * 50}1234-5678x")] == [f"{hashlib.md5(b'y' * 50).hexdigest()}\tkey:\t"]
    assert list(pii.identifiers(f"my key: {long}")) == [(8, 8 + len(long), "my\tkey:\t")]


def brute_added(texts, support=5, confidence=0.8):
    """Over texts whose words stand between single spaces: sets and loops, until no pattern is added."""
    held = []
    for t in texts:
        base, at = brute_pii(t), 0
        words = t.split(" ")
        for k, w in enumerate(words):
            lead = len(w) - len(w.lstrip("\"(#:"))
            body = w[lead:].rstrip("\"),.")
            start, left = at + lead, (["", ""] + [x.lower() for x in words[:k]])[-2:]
            kind = next((kind for kind, s, e in base if s == start), None)
            inside = any(s < start + len(body) and start < e for _, s, e in base)
            if not kind and len(body) >= 32 and set(body) <= set("0123456789abcdef") and not body.isdigit():
                kind = "secret"
            ident = (len(body) >= 8 and any(c.isdigit() for c in body) and not inside) or kind
            held.append(((*left, w[:lead]), body if ident else None, kind, start, inside, len(held), t))
            at += len(w) + 1
    seeds = {body: kind for _, body, kind, *_ in held if kind}
    known, found = {b: (1.0, k) for b, k in seeds.items()}, {}
    while True:
        fresh = {}
        for p in {h[0] for h in held if h[1]}:
            after = [h[1] for h in held if h[0] == p]
            own = {b for b in after if b in known}
            worth = sum(known[b][0] for b in after if b in known) / len(after)
            if len(own) >= support and worth >= confidence:
                fresh[p] = (worth, max((sum(known[b][1] == k for b in own), k) for k in {known[b][1] for b in own})[1])
        if len(fresh) == len(found):
            break
        found = fresh
        for h in held:
            if h[0] in found and h[1] and h[1] not in seeds:
                known[h[1]] = max(known.get(h[1], (0, "")), found[h[0]])
    return {t: sorted((h[3], h[3] + len(h[1]), found[h[0]][1]) for h in held if h[6] is t and h[0] in found and h[1] and not h[4]) for t in texts}


def test_known_identifiers_induce_new_patterns(spark):
    r = random.Random(10)
    hexes, odd = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(60)], [f"QX-{1000 + i}-{'abcdefghijklmnopqrst'[i]}" for i in range(20)]
    texts = [f"{prose(3, i)} my token: {h} {prose(2, i)}" for i, h in enumerate(hexes)] + [f"{prose(2, -i)} my token: {o} {prose(2, i)}" for i, o in enumerate(odd[:6])]
    texts += [f'{prose(2, i)} session id "{o}" {prose(4, i)}' for i, o in enumerate(odd[:6] * 3)] + [f'{prose(5, 77)} session id "{odd[0]}", {prose(2, 1)}', f'see session id "{odd[16]}"']
    texts += [f'{prose(2, i)} ticket (#{o}) {prose(4, i)}' for i, o in enumerate([*odd[:2], *odd[15:17]])]  # too few known ones
    texts += [f"{prose(3, i)} of the {r.choice(hexes) if i % 3 == 0 else prose(1, i)} {prose(2, i)}" for i in range(40)] + [f"mail me at u{i}@example{i}.org or call" for i in range(7)] + ["mail me at u77-not-mail now"]
    texts = list(dict.fromkeys(texts))
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = brute_added(texts)
    for row in got:
        t = texts[row.doc_id]
        base = [f"{k}:{s}:{e}" for k, s, e in brute_pii(t)]
        added = sorted(tuple(map(int, x.split(":")[1:])) + (x.split(":")[0],) for x in row.spans.split(",") if x and x not in base)
        assert added == want[t], t
        assert row.n_added == len(added) and row.n_spans == len(added) + len(base)
    by = {texts[x.doc_id]: x for x in got}
    assert by[f'see session id "{odd[16]}"'].n_added == 1  # no seed stands after this pattern
    assert by["mail me at u77-not-mail now"].n_added == 1


def test_recall_of_planted_identifiers(spark):
    """At sf0.01 every key behind a marker is found, and documents without digits have no span."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = pii.find(docs).join(docs, "doc_id").collect()
    keyed = [x for x in rows if re.search(r'token = "[0-9a-f]{32,}"', x.text or "")]
    assert keyed and all(x.n_added for x in keyed)
    assert not any(x.n_spans for x in rows if not any(c.isdigit() for c in x.text or "") and "@" not in (x.text or ""))


def test_support_does_not_rise_with_the_corpus(spark):
    """More than 500,000 different seeds elsewhere leave a pattern with five."""
    ip = F.concat_ws(".", *[F.lit(100) + F.shiftright("id", k) % 128 for k in (14, 7, 0)])
    lists = spark.range(520_000).groupBy(F.expr("id div 1000").alias("doc_id")).agg(F.array_join(F.collect_list(F.concat(F.lit("1."), ip)), " ").alias("text"))
    keys = [(-i - 2, f"{prose(5, i)} api key: {hashlib.sha1(str(i).encode()).hexdigest()}") for i in range(5)]
    few = spark.createDataFrame([*keys, (-1, "my api key: ZXCV-1234-unseen, yes")], "doc_id long, text string")
    got = pii.find(lists.unionByName(few)).filter("doc_id = -1").collect()
    assert [(r.spans, r.n_added) for r in got] == [("secret:12:28", 1)]


def test_shared_folder_is_named_on_a_cluster(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
    Session.sparkContext.master = "local-cluster[3,2,1000]"
    with pytest.raises(RuntimeError):
        common.shared_dir(Session)


def test_shared_folder_follows_the_session(spark):
    assert common.shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
