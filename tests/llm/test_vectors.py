"""Nearest vectors against brute force."""

import numpy as np
import pytest

from helixframe.llm import vectors as V

SCHEMA = "vec_id long, owner_key string, vector array<float>, id string"


def brute(x, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_recall_and_cosines(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 64))
    x = (centres[rng.integers(0, 40, 3000)] + 0.6 * rng.standard_normal((3000, 64))) * rng.uniform(0.2, 5, (3000, 1))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, None, v.tolist(), "q") for i, v in enumerate(x)], SCHEMA)
    got = V.neighbours(df).collect()
    want = brute(x.astype(float))
    hit = sum(r["other_id"] in want[r["vec_id"]] for r in got)
    assert len(got) == 3000 * 5
    assert hit >= 0.97 * 3000 * 5
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert max(abs(r["cosine"] - u[r["vec_id"]] @ u[r["other_id"]]) for r in got[:500]) < 1e-5


def test_copies_ties_and_unusable(spark):
    rng = np.random.default_rng(4)
    hot = rng.standard_normal(64).tolist()
    rows = [(i, None, hot, None) for i in range(300)]
    rows += [(1000 + i, None, rng.standard_normal(64).tolist(), None) for i in range(600)]
    rows += [(2000, None, None, None), (2001, None, [0.0] * 64, None), (2002, None, [1.0] * 63, None), (2003, None, [float("nan")] + [1.0] * 63, None), (2004, None, [float("inf")] + [1.0] * 63, None), (None, None, hot, None), (2005, None, [None] + [1.0] * 63, None)]
    got = {}
    for r in V.neighbours(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["vec_id"], set()).add(r["other_id"])
    assert set(got) == set(range(300)) | set(range(1000, 1600))
    assert got[0] == {1, 2, 3, 4, 5} and got[250] == {0, 1, 2, 3, 4} and all(len(v) == 5 for v in got.values())


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few(spark, n):
    rows = [(i, None, np.eye(64)[i].tolist(), None) for i in range(n)]
    got = V.neighbours(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == n * (n - 1)


def test_long_list_is_cut(spark, monkeypatch):
    monkeypatch.setattr(V, "CELL", 50)
    rng = np.random.default_rng(6)
    x = (np.ones(64) + 0.2 * rng.standard_normal((800, 64))).astype(np.float32)
    got = V.neighbours(spark.createDataFrame([(i, None, v.tolist(), None) for i, v in enumerate(x)], SCHEMA)).collect()
    want = brute(x.astype(float))
    assert sum(r["other_id"] in want[r["vec_id"]] for r in got) >= 0.9 * 4000


def test_exact_search(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1500, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    got = {}
    for r in V.knn(df, 5, probes=None).collect():
        got.setdefault(r["id"], set()).add(r["other"])
    assert got == {i: set(w.tolist()) for i, w in enumerate(brute(x.astype(float)))}
