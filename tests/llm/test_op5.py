"""Recall at 64 dimensions against brute force, and vectors of several lengths."""

import numpy as np
import pytest

pytest.importorskip("veldmark.llm")
from veldmark.llm import op5_itq  # noqa: E402


def near(rng, v, cosine):
    """A vector at that cosine from ``v``."""
    w = rng.normal(size=len(v))
    w -= v * (w @ v) / (v @ v)
    return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


def run(spark, vectors):
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    out = op5_itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    return {r.vec_id: (r.n_links, r.component_id) for r in out}


def test_recall_just_above_the_threshold(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 64))
    vectors = [*base, *(near(rng, v, c) for v, c in zip(base, rng.uniform(0.9801, 0.983, 300)))]
    unit = np.array([v / np.linalg.norm(v) for v in vectors])
    real = (unit @ unit.T >= 0.98).sum(1) - 1
    out = run(spark, vectors)
    found = np.array([out[i][0] for i in range(600)])
    assert real.sum() == 600 and (found <= real).all() and found.sum() >= 0.9 * real.sum()


def test_every_length_links(spark):
    rng = np.random.default_rng(9)
    vectors = []
    for n, k in ((64, 30), (32, 4), (16, 3), (3, 2), (2, 1), (1, 1)):
        for v in rng.normal(size=(k, n)) if n > 3 else np.eye(n)[:k]:
            vectors += [v, v * 2 if n == 1 else near(rng, v, 0.999)]
    out = run(spark, vectors)
    assert [out[i] for i in range(len(vectors))] == [(1, i - i % 2) for i in range(len(vectors))]
