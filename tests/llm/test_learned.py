"""Held-out accuracy of the classifiers and their defined cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingsmith.llm import quality, toxicity
from lingsmith.llm.queries import op1_quality_mil, op6_toxicity_ftrl

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("query, label, divisor, remainder, least", [(op1_quality_mil, "quality", 4, 2, 0.97), (op6_toxicity_ftrl, "toxic", 3, 1, 0.95)])
def test_held_out(spark, query, label, divisor, remainder, least):
    df = query(spark, SF)
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = df.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % divisor == remainder) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert sum(r.predicted == r[label] for r in unseen) / len(unseen) >= least
    sure = [r[label] for r in unseen if r.predicted]
    assert sum(sure) / len(sure) >= 0.97


def test_odd(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "a b", 3), (4, "x" * 200_000, 3), (4, "x " * 50_000, 3), (4, "x " * 50_000, 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (4, None, None)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        got = module.score(spark, docs, labels).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
        assert module.score(spark, docs.limit(0), labels).count() == 0
        assert module.score(spark, docs, labels.limit(0)).count() == 6
    assert quality.keep_good(spark, docs, labels.limit(0)).columns == docs.columns


def test_gradients():
    """Against differences."""
    p = quality.Mil(hidden=5, gate=3)
    rng = np.random.default_rng(0)
    x, bag, y = rng.normal(size=(9, 7)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 2]), np.array([1.0, 0, 1])
    m = quality.start_weights(p, x)
    loss = lambda: float(np.sum(np.log1p(np.exp(-(2 * y - 1) * quality.forward(m, x, bag, 3)[0]))))
    score, kept = quality.forward(m, x, bag, 3)
    for k, g in quality.gradients(m, bag, 1 / (1 + np.exp(-score)) - y, kept).items():
        at = tuple(rng.integers(0, s) for s in m[k].shape)
        m[k][at] += 1e-6
        hi = loss()
        m[k][at] -= 2e-6
        lo = loss()
        m[k][at] += 1e-6
        assert abs((hi - lo) / 2e-6 - g[at]) < 1e-5
