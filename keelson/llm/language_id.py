"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time. Two gated recurrent layers read the bytes of a
text from both ends; at every byte their states give a probability for each language, and the mean over all bytes is the
document's. Texts are read whole, cut into chunks of CHUNK bytes that run side by side as columns of one matrix; states
start anew at each chunk.

Training reads a bounded sample, whatever the size of the corpus: PIECES pieces of PIECE characters for each language,
from documents picked by a hash of their id and text among those that are labelled and not held out. Documents with crc32(doc_id
as text) mod FOLDS = 0 are held out. Only text and label are learnt from; a prediction sees the text alone.

Defined results: a text that is null or has no letter is `und` with score 0; without any labelled document everything is
`und`; null labels are never learnt, a null id is never held out; equal texts get equal predictions, and of languages with
equal scores the first by name wins; an empty table gives an empty result; other columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import common

FOLDS = 5
PIECES, PIECE = 600, 256
HIDDEN, CHUNK = 8, 64
STEPS, BATCH, RATE = 400, 256, 0.02
#: Chunks that run side by side when texts are read.
COLUMNS = 8192

UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    """2 * sigmoid(2 x) - 1, in place."""
    x *= -2
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)
    x *= 2
    x -= 1
    return x


class Layer:
    """One direction. Rows: update gate, reset gate, candidate, HIDDEN each; columns of a state are chunks."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.w = {
            "byte": rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32),  # of each input byte
            "state": (rng.normal(0, 1, (3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32),
        }
        self.w["byte"][:, :hidden] += 1  # start by remembering
        self.h = hidden

    def step(self, byte: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        k = self.h
        x = np.ascontiguousarray(self.w["byte"][byte].T)
        u = self.w["state"] @ h
        gate = x[: 2 * k]
        gate += u[: 2 * k]
        np.clip(gate, -30, 30, out=gate)
        gate = _sigmoid(gate)
        z, r = gate[:k], gate[k:]
        n = r * u[2 * k :]
        n += x[2 * k :]
        np.clip(n, -15, 15, out=n)
        n = _tanh(n)
        out = h - n
        out *= z
        out += n
        if keep is not None:
            keep.append((byte, h, z, r, n, u[2 * k :]))
        return out

    def back(self, kept: list, d_states: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Gradients from those of all states, latest first."""
        k, grad = self.h, {name: np.zeros_like(w) for name, w in self.w.items()}
        carry = np.zeros_like(d_states[0])
        for (byte, h, z, r, n, u), d in zip(reversed(kept), reversed(d_states), strict=True):
            carry = carry + d
            dn = carry * (1 - z) * (1 - n * n)
            dz = carry * (h - n) * z * (1 - z)
            dr = dn * u * r * (1 - r)
            dx = np.concatenate([dz, dr, dn])
            du = np.concatenate([dz, dr, dn * r])
            np.add.at(grad["byte"], byte, dx.T)
            grad["state"] += du @ h.T
            carry = carry * z + self.w["state"].T @ du
        return grad


class Network:
    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.langs, self.ahead, self.behind = langs, Layer(hidden, rng), Layer(hidden, rng)
        self.out = {"w": rng.normal(0, 0.1, (len(langs), 2 * hidden)).astype(np.float32), "b": np.zeros((len(langs), 1), np.float32)}

    def states(self, layer: Layer, chunks: np.ndarray, keep: list | None = None) -> list[np.ndarray]:
        """chunks: (CHUNK, columns) of bytes, in reading order."""
        h, out = np.zeros((layer.h, chunks.shape[1]), np.float32), []
        for byte in chunks:
            h = layer.step(byte, h, keep)
            out.append(h)
        return out

    def _softmax(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = self.ahead.h
        p = self.out["w"][:, :k] @ a
        p += self.out["w"][:, k:] @ b
        p += self.out["b"]
        np.clip(p, -40, 40, out=p)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        return p

    def probabilities(self, chunks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums over the bytes of each column of the languages' probabilities; lengths: bytes of each column."""
        ahead = self.states(self.ahead, chunks)
        h, total = np.zeros_like(ahead[0]), np.zeros((len(self.langs), chunks.shape[1]), np.float32)
        for t in range(len(chunks) - 1, -1, -1):
            inside = (t < lengths).astype(np.float32)
            h = self.behind.step(chunks[t], h)
            h *= inside  # what follows the end of a text leaves no trace
            p = self._softmax(ahead[t], h)
            p *= inside
            total += p
        return total

    def gradients(self, chunks: np.ndarray, lengths: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        k, kept_a, kept_b = self.ahead.h, [], []
        ahead, behind = self.states(self.ahead, chunks, kept_a), self.states(self.behind, chunks[::-1], kept_b)[::-1]
        grad = {name: np.zeros_like(w) for name, w in self.out.items()}
        count, loss, d_a, d_b = float(lengths.sum()), 0.0, [], []
        column = np.arange(len(label))
        for t, (a, b) in enumerate(zip(ahead, behind, strict=True)):
            inside = (t < lengths).astype(np.float32)
            p = self._softmax(a, b)
            loss -= float((np.log(p[label, column] + 1e-9) * inside).sum())
            p[label, column] -= 1
            p *= inside / count
            grad["w"] += p @ np.concatenate([a, b]).T
            grad["b"] += p.sum(axis=1, keepdims=True)
            d_a.append(self.out["w"][:, :k].T @ p)
            d_b.append(self.out["w"][:, k:].T @ p)
        return loss / count, {"out": grad, "ahead": self.ahead.back(kept_a, d_a), "behind": self.behind.back(kept_b, d_b[::-1])}


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunks as columns, bytes of each column, text of each column)."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    many = -(-size // CHUNK)
    owner = np.repeat(np.arange(len(texts)), many)
    flat = np.zeros(int(many.sum()) * CHUNK, np.uint8)
    start = (np.cumsum(many) - many) * CHUNK
    for t, s in zip(texts, start.tolist(), strict=True):
        flat[s : s + len(t)] = np.frombuffer(t, np.uint8)
    nth = np.arange(len(owner)) - (start // CHUNK)[owner]
    return np.ascontiguousarray(flat.reshape(-1, CHUNK).T), np.minimum(CHUNK, size[owner] - nth * CHUNK), owner


def train(samples: list[tuple[str, str]], *, hidden: int = HIDDEN, steps: int = STEPS, seed: int = 3) -> Network:
    """samples: (language, text). Adam on batches of chunks, languages drawn equally often."""
    langs = sorted({lang for lang, _ in samples})
    net = Network(langs, hidden, seed)
    chunks, lengths, owner = cut([t.encode() for _, t in samples])
    label = np.array([langs.index(lang) for lang, _ in samples])[owner]
    pools = [np.flatnonzero((label == k) & (lengths >= CHUNK // 4)) for k in range(len(langs))]
    pools = [p if len(p) else np.flatnonzero(label == k) for k, p in enumerate(pools)]
    rng = np.random.default_rng(seed)
    weights = {"out": net.out, "ahead": net.ahead.w, "behind": net.behind.w}
    moment = {(g, n): (np.zeros_like(w), np.zeros_like(w)) for g, ws in weights.items() for n, w in ws.items()}
    each = max(1, BATCH // len(langs))
    for turn in range(1, steps + 1):
        pick = np.concatenate([rng.choice(p, each) for p in pools if len(p)])
        # columns may differ in length; all read CHUNK bytes, and the loss stops at their end
        _, grads = net.gradients(chunks[:, pick], lengths[pick], label[pick])
        rate = RATE * min(1, turn / 20) * (1 - 0.9 * turn / steps)
        for (g, n), (m, v) in moment.items():
            d = np.clip(grads[g][n], -1, 1)
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            weights[g][n] -= (rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-7)).astype(np.float32)
    return net


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """At most PIECES pieces of PIECE characters for each language."""
    own = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id")))
    # ids and texts decide which documents, so that rows that share an id are drawn apart
    draw = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(11)).alias("draw")
    room = F.greatest(F.length("text") - PIECE, F.lit(0)) + 1
    piece = F.substring(F.col("text"), F.pmod(F.xxhash64("doc_id", F.lit(12)), room).cast("int") + 1, F.lit(PIECE))
    place = F.row_number().over(W.partitionBy("lang").orderBy("draw", "doc_id", "piece"))
    rows = own.select("doc_id", "lang", draw, piece.alias("piece")).withColumn("place", place).filter(F.col("place") <= PIECES).collect()
    rows.sort(key=lambda r: (r["lang"], r["place"]))
    return [(r["lang"], r["piece"]) for r in rows]


def read(net: Network | None, texts: list[str | None]) -> Iterator[tuple[str, float]]:
    """(language, score) of each text."""
    known = [t is not None and any(map(str.isalpha, t)) for t in texts]
    if net is None or not any(known):
        yield from ((UNKNOWN, 0.0) for _ in texts)
        return
    chunks, lengths, owner = cut([t.encode() if ok else b"" for t, ok in zip(texts, known, strict=True)])
    total = np.zeros((len(texts), len(net.langs)))
    for s in range(0, len(owner), COLUMNS):
        part = slice(s, s + COLUMNS)
        sums = net.probabilities(chunks[:, part], lengths[part])
        np.add.at(total, owner[part], sums.T)
    for ok, row in zip(known, total, strict=True):
        yield (net.langs[int(row.argmax())], min(1.0, float(row.max() / row.sum()))) if ok else (UNKNOWN, 0.0)


def predict(docs: DataFrame, net: Network | None, carry: list[str] | None = None) -> DataFrame:
    """docs: text and the columns to carry (doc_id and held_out if none are named). Per row these columns, lang_pred, score."""
    if carry is None:
        docs = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
        carry = ["doc_id", "held_out"]
    frame = docs.select(*carry, "text") if "text" not in carry else docs.select(*carry)
    names = [*carry, "lang_pred", "score"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in common.slices(batch, "text"):
                part = batch.slice(start, end - start)
                found = list(read(net, part.column("text").to_pylist()))
                columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in carry), *columns], names)

    schema = T.StructType([frame.schema[n] for n in carry]).add("lang_pred", "string").add("score", "double")
    return frame.mapInArrow(work, schema)


def identify(docs: DataFrame, **how) -> DataFrame:
    learnt = sample(docs)
    return predict(docs, train(learnt, **how) if learnt else None)
