"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded; gated attention weighs the passages by what
the documents' labels teach; the weighted representation is scored. Encoder, attention and score are learned
together by gradient descent from document labels alone.

Defined cases: a null, empty or blank text is one empty passage; repeated rows are scored each; without labels of
both kinds every score is the share of label 1 (1 without labels: nothing is known against a document); an empty
table gives no rows; other columns are kept by keep_good and ignored by score.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingsmith.llm._learn import held_out, sample
from lingsmith.llm._text import raw, slices, words


@dataclass(frozen=True)
class Mil:
    """words: of a passage; hidden, gate: sizes of its encoding and of the attention; documents: the bound of the
    training sample."""

    words: int = 64
    sketch: int = 32
    hidden: int = 24
    gate: int = 12
    epochs: int = 40
    rate: float = 0.01
    decay: float = 1e-4
    documents: int = 8000


_CLASSES = np.zeros((6, 256), bool)
_CLASSES[0, [*range(97, 123)]] = True
_CLASSES[1, [*range(65, 91)]] = True
_CLASSES[2, [*range(48, 58)]] = True
_CLASSES[3, [*range(128, 256)]] = True
_CLASSES[4, [ord(c) for c in ".,;:?'\"-()"]] = True
_CLASSES[5, [b for b in range(33, 127) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or chr(b) in ".,;:?'\"-()")]] = True

N_STATS = 16


def passages(texts: pa.Array, p: Mil) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, encodings' inputs, row within) of the passages of slices of an array."""
    data, off = raw(texts)
    for i, j in slices(off):
        n, own, cut = j - i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        h, row, start, end = words(own, cut)
        count = np.bincount(row, minlength=n)
        first = np.concatenate([[0], np.cumsum(count)])
        sizes = np.maximum(1, -(-count // p.words))
        base = np.concatenate([[0], np.cumsum(sizes)])
        total, bag = int(base[-1]), np.repeat(np.arange(n), sizes)
        place = base[row] + (np.arange(len(h)) - first[row]) // p.words if len(h) else np.zeros(0, np.int64)
        x = np.zeros((total, N_STATS + p.sketch), np.float32)
        k = np.bincount(place, minlength=total).astype(np.float64)
        some = np.maximum(k, 1)
        if len(h):
            lead = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            tail = np.append(lead[1:], len(h)) - 1
            at, lo, hi = place[lead], start[lead], end[tail]
            size = np.maximum(hi - lo, 1)
            for c in range(6):
                runs = np.concatenate([[0], np.cumsum(_CLASSES[c][own])])
                x[at, c] = (runs[hi] - runs[lo]) / size
            letters = x[:, 0] + x[:, 1] + x[:, 3]
            x[:, 6] = x[:, 1] / np.maximum(letters, 1e-3)
            length = (end - start).astype(np.float64)
            mean = np.bincount(place, weights=length, minlength=total) / some
            x[:, 7] = mean / 10
            x[:, 8] = np.sqrt(np.maximum(0, np.bincount(place, weights=length * length, minlength=total) / some - mean * mean)) / 10
            again = np.append(False, (h[1:] == h[:-1]) & (place[1:] == place[:-1]))
            x[:, 9] = np.bincount(place[again], minlength=total) / some
            keys = np.unique(place.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
            x[:, 10] = np.bincount((keys >> np.uint64(40)).astype(np.int64), minlength=total) / some
            odd = ~(_CLASSES[0] | _CLASSES[1] | _CLASSES[2] | _CLASSES[3])
            x[:, 11] = np.bincount(place[odd[own[start]] & odd[own[end - 1]]], minlength=total) / some  # words without a letter
            x[:, 12] = np.bincount(place[_CLASSES[5][own[end - 1]]], minlength=total) / some
            x[:, 13] = np.bincount(place[_CLASSES[1][own[start]] & _CLASSES[1][own[end - 1]]], minlength=total) / some
            x[:, 14] = np.bincount(place[length >= 14], minlength=total) / some
            slot = ((h >> np.uint64(8)) % np.uint64(p.sketch)).astype(np.int64)
            sign = np.where(h & np.uint64(1), 1.0, -1.0)
            sums = np.bincount(place * p.sketch + slot, weights=sign, minlength=total * p.sketch).reshape(total, p.sketch)
            x[:, N_STATS:] = sums / np.sqrt(some)[:, None]
        x[:, 15] = np.log1p(k) / 5
        yield i, n, x, bag


NAMES = ("mean", "scale", "W", "b", "V", "U", "w", "c", "d")


def start_weights(p: Mil, x: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    size = x.shape[1]
    mean, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64)
    glorot = lambda a, b: rng.normal(0, np.sqrt(2 / (a + b)), (a, b))
    return {"mean": mean, "scale": np.maximum(scale, 0.02), "W": glorot(size, p.hidden), "b": np.zeros(p.hidden), "V": glorot(p.hidden, p.gate), "U": glorot(p.hidden, p.gate), "w": glorot(p.gate, 1)[:, 0], "c": glorot(p.hidden, 1)[:, 0], "d": np.zeros(1)}


def forward(m: dict[str, np.ndarray], x: np.ndarray, bag: np.ndarray, n: int):
    """Scores of n bags before the logistic function, with what the gradients need. Every bag has a passage."""
    u = np.clip((x - m["mean"]) / m["scale"], -8, 8)
    h = np.tanh(u @ m["W"] + m["b"])
    t, s = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    e = (t * s) @ m["w"]
    first = np.searchsorted(bag, np.arange(n))
    e = np.exp(e - np.maximum.reduceat(e, first)[bag])
    a = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(h * a[:, None], first)
    return z @ m["c"] + m["d"][0], (u, h, t, s, a, z)


def gradients(m: dict[str, np.ndarray], bag: np.ndarray, g: np.ndarray, kept) -> dict[str, np.ndarray]:
    """By the derivative g of the loss for each bag's score."""
    u, h, t, s, a, z = kept
    gz = g[:, None] * m["c"]
    own = gz[bag]
    ga = (own * h).sum(1)
    mean = (gz * z).sum(1)[bag]
    ge = a * (ga - mean)
    gt, gs = ge[:, None] * m["w"] * s * (1 - t * t), ge[:, None] * m["w"] * t * s * (1 - s)
    gh = (own * a[:, None] + gt @ m["V"].T + gs @ m["U"].T) * (1 - h * h)
    return {"W": u.T @ gh, "b": gh.sum(0), "V": h.T @ gt, "U": h.T @ gs, "w": (t * s).T @ ge, "c": z.T @ g, "d": np.array([g.sum()])}


def fit_mil(x: np.ndarray, bag: np.ndarray, y: np.ndarray, p: Mil) -> dict[str, np.ndarray]:
    """Adam over batches of 64 documents."""
    m = start_weights(p, x)
    first = np.searchsorted(bag, np.arange(len(y) + 1))
    rng = np.random.default_rng(13)
    moments = {k: (np.zeros_like(m[k]), np.zeros_like(m[k])) for k in NAMES[2:]}
    step, steps = 0, p.epochs * -(-len(y) // 64)
    for _ in range(p.epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 64):
            own = np.sort(order[at : at + 64])
            rows = np.concatenate([np.arange(first[k], first[k + 1]) for k in own])
            local = np.repeat(np.arange(len(own)), first[own + 1] - first[own])
            score, kept = forward(m, x[rows], local, len(own))
            g = (1 / (1 + np.exp(-np.clip(score, -35, 35))) - y[own]) / len(own)
            step += 1
            rate = p.rate * 0.5 * (1 + np.cos(np.pi * step / steps))
            for k, v in gradients(m, local, g, kept).items():
                v = v + p.decay * m[k]
                a, b = moments[k]
                a += 0.1 * (v - a)
                b += 0.001 * (v * v - b)
                m[k] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return m


def _examples(batches: Iterator[pa.RecordBatch], p: Mil) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, n, x, bag in passages(batch.column(1), p):
            cut = np.searchsorted(bag, np.arange(n + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0)[first : first + n], pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), batch.column(2)[first : first + n]], ["doc_id", "passages", "label"])


def _fit(batches: Iterator[pa.RecordBatch], p: Mil) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)))), key=lambda r: r[0])
    if not rows:
        return
    y = np.array([r[2] for r in rows], np.float64)
    if y.min() == y.max():
        m = {"share": np.array([y.mean()])}
    else:
        each = [np.frombuffer(r[1], np.float32).reshape(-1, N_STATS + p.sketch) for r in rows]
        m = fit_mil(np.concatenate(each), np.repeat(np.arange(len(each)), [len(e) for e in each]), y, p)
    out = io.BytesIO()
    np.savez(out, **m)
    yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])


def fit(docs: DataFrame, labels: DataFrame, p: Mil = Mil()) -> bytes:
    """The model, a few kilobytes, learned in one task from at most p.documents labelled documents, none held out."""
    few = sample(docs, labels, "quality", 4, 2, p.documents)
    rows = few.mapInArrow(lambda it: _examples(it, p), "doc_id long, passages binary, label int").repartition(1).mapInArrow(lambda it: _fit(it, p), "model binary").collect()
    return bytes(rows[0]["model"]) if rows else b""


def scores(texts: pa.Array, m: dict[str, np.ndarray], p: Mil) -> np.ndarray:
    if "share" in m:
        return np.full(len(texts), m["share"][0])
    out = np.zeros(len(texts))
    for first, n, x, bag in passages(texts, p):
        out[first : first + n] = 1 / (1 + np.exp(-np.clip(forward(m, x, bag, n)[0], -35, 35)))
    return out


def _loaded(model: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(model))) if model else {"share": np.ones(1)}


def _scored(batches: Iterator[pa.RecordBatch], model: bytes, p: Mil) -> Iterator[pa.RecordBatch]:
    m = _loaded(model)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), m, p))], ["doc_id", "score"])


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, p: Mil = Mil(), threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(rows, labels, p)
    found = rows.mapInArrow(lambda it: _scored(it, model, p), "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _kept(batches: Iterator[pa.RecordBatch], model: bytes, p: Mil, text_col: str, least: float) -> Iterator[pa.RecordBatch]:
    m = _loaded(model)
    for batch in batches:
        yield batch.filter(pa.array(scores(batch.column(batch.schema.get_field_index(text_col)), m, p) >= least))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, p: Mil = Mil(), least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is at least `least`."""
    model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, p)
    return docs.mapInArrow(lambda it: _kept(it, model, p, "text", least), docs.schema)
