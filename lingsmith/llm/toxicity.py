"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

A text's features are the set of its words, word pairs and pairs with one or two words between, A-Z lower-cased,
hashed. FTRL-proximal gives each coordinate a rate of its own and, by its L1 term, leaves most weights at zero:
the model is a short list that is sent to every task.

Defined cases: a null or empty text has no features and gets the score of the bias; repeated rows are scored each;
without labels of both kinds the model is empty and all scores are the share of label 1 (0 without labels); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingsmith.llm._learn import held_out, sample
from lingsmith.llm._text import NO_LETTER, mix, raw, slices, words


@dataclass(frozen=True)
class Ftrl:
    """alpha, beta: of the per-coordinate rates; l1, l2: penalties; bits: of a feature's hash; documents: the
    bound of the training sample."""

    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0
    bits: int = 20
    epochs: int = 8
    documents: int = 8000


def features(texts: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, feature, row within) of slices of an array; a feature may come several times."""
    data, off = raw(texts)
    shift = np.uint64(64 - bits)
    for i, j in slices(off):
        h, row, _, _ = words(data[off[i] : off[j]], off[i : j + 1] - off[i], NO_LETTER)
        kinds, rows = [mix(h) >> shift], [row]
        for gap in (1, 2, 3):
            if len(h) > gap:
                same = row[gap:] == row[:-gap]
                kinds.append((mix(h[:-gap] * np.uint64(2 * gap + 1) + mix(h[gap:])) >> shift)[same])
                rows.append(row[gap:][same])
        yield i, j - i, np.concatenate(kinds).astype(np.int64), np.concatenate(rows)


def _examples(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, n, feature, row in features(batch.column(1), bits):
            found = np.unique(row << bits | feature)
            cut = np.searchsorted(found, np.arange(n + 1) << bits)
            sets = [(found[a:b] & ((1 << bits) - 1)).astype("<u4").tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0)[first : first + n], pa.array(sets, pa.binary()), batch.column(2)[first : first + n]], ["doc_id", "features", "label"])


def fit_ftrl(examples: list[tuple[np.ndarray, int]], p: Ftrl) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and values of the weights that aren't zero, and the bias, learned one example at a time."""
    size = (1 << p.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    positive = sum(y for _, y in examples)
    if not examples or positive in (0, len(examples)):
        share = positive / len(examples) if examples else 0.0
        return np.zeros(0, np.int64), np.zeros(0), float(np.clip(np.log(max(share, 1e-6) / max(1 - share, 1e-6)), -12, 12))
    rng = np.random.default_rng(7)
    bias = size - 1

    def weights(i: np.ndarray) -> np.ndarray:
        own = z[i]
        l1 = np.where(i == bias, 0.0, p.l1)
        return np.where(np.abs(own) <= l1, 0.0, (np.sign(own) * l1 - own) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for k in rng.permutation(len(examples)):
            x, y = examples[k]
            i = np.append(x, bias)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha * w
            n[i] += g * g
    w = weights(np.arange(size))
    kept = np.flatnonzero(w[:-1])
    return kept, w[kept], float(w[-1])


def _fit(batches: Iterator[pa.RecordBatch], p: Ftrl) -> Iterator[pa.RecordBatch]:
    rows = [(d, np.frombuffer(x, "<u4").astype(np.int64), y) for b in batches for d, x, y in zip(*(b.column(i).to_pylist() for i in range(3)))]
    rows.sort(key=lambda r: r[0])
    at, w, bias = fit_ftrl([(x, y) for _, x, y in rows], p)
    yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i8").tobytes()], pa.binary()), pa.array([w.astype("<f8").tobytes()], pa.binary()), pa.array([bias])], ["at", "weight", "bias"])


def fit(docs: DataFrame, labels: DataFrame, params: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray, float]:
    """The model learned in one task from at most params.documents labelled documents that aren't held out."""
    few = sample(docs, labels, "toxic", 3, 1, params.documents)
    row = few.mapInArrow(lambda it: _examples(it, params.bits), "doc_id long, features binary, label int").repartition(1).mapInArrow(lambda it: _fit(it, params), "at binary, weight binary, bias double").collect()
    if not row:
        return np.zeros(0, np.int64), np.zeros(0), -12.0
    return np.frombuffer(row[0]["at"], "<i8"), np.frombuffer(row[0]["weight"], "<f8"), row[0]["bias"]


def _scored(batches: Iterator[pa.RecordBatch], model, bits: int) -> Iterator[pa.RecordBatch]:
    at, weight, bias = model
    dense = np.zeros(1 << bits, np.float32)
    dense[at] = weight
    used = dense != 0
    for batch in batches:
        out = np.full(batch.num_rows, bias)
        for first, n, feature, row in features(batch.column(1), bits):
            hit = used[feature]
            found = np.unique(row[hit] << bits | feature[hit])  # a set: each counts once
            out[first : first + n] += np.bincount(found >> bits, weights=dense[found & ((1 << bits) - 1)], minlength=n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], ["doc_id", "score"])


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, params: Ftrl = Ftrl(), threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(rows, labels, params)
    found = rows.mapInArrow(lambda it: _scored(it, model, params.bits), "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
