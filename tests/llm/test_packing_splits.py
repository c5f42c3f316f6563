"""Packing and splitting against their definitions on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm.graph import components
from helixframe.llm.packing import best_fit_rounds, pack
from helixframe.llm.ranks import salted_rank
from helixframe.llm.splits import SHARES, allocate, split_components

SCHEMA = "row_id long, n long, piece string, train_row string"


def check_packed(rows, want, cap):
    got, bins = {}, {}
    for r in rows:
        got.setdefault(r["row_id"], []).append((r["piece"], r["length"]))
        bins.setdefault(r["train_row"], []).append((r["position"], r["length"]))
    assert {k: sum(x for _, x in v) for k, v in got.items()} == want
    for k, v in got.items():
        assert sorted(p for p, _ in v) == list(range(len(v)))
        assert len(v) == 1 if want[k] <= cap else len(v) == -(-want[k] // cap)
    for v in bins.values():
        end = 0
        for pos, n in sorted(v):
            assert pos == end
            end += n
        assert end <= cap
    return len(bins)


def test_pack_random(spark):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 140, 3000)
    df = spark.createDataFrame([(i, int(n), None, "x") for i, n in enumerate(sizes)], SCHEMA)
    bins = check_packed(pack(df, "row_id", F.col("n"), 64).collect(), {i: int(n) for i, n in enumerate(sizes)}, 64)
    assert bins <= -(-int(sizes.sum()) // 64) * 1.06


def test_pack_hot_size_and_ties(spark):
    df = spark.range(2000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, 30).otherwise(F.col("id") % 17 + 1).alias("n"))
    want = {r["row_id"]: r["n"] for r in df.collect()}
    bins = check_packed(pack(df, "row_id", F.col("n"), 60).collect(), want, 60)
    assert bins <= -(-sum(want.values()) // 60) + 3


def test_pack_edges(spark):
    assert pack(spark.createDataFrame([], SCHEMA), "row_id", F.col("n"), 8).collect() == []
    df = spark.createDataFrame([(1, None, None, None), (2, 0, None, None), (3, -4, None, None), (4, 8, None, None), (5, 17, None, None)], SCHEMA)
    check_packed(pack(df, "row_id", F.col("n"), 8).collect(), {4: 8, 5: 17}, 8)
    same = spark.createDataFrame([(None, 5, "a", "b"), (7, 5, "a", "b"), (7, 5, "a", "b")], SCHEMA)
    assert len(pack(same, "row_id", F.col("n"), 8).collect()) == 3


def test_rounds_fill_small_items():
    plan = best_fit_rounds({1: 1000, 2: 500}, 10)
    assert plan.bins == 200


def test_salted_rank_dense(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id").withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    got = salted_rank(df, ["k"], ["id"], "r", 8).collect()
    for k in (None, 1, 2):
        r = sorted(x["r"] for x in got if x["k"] == k)
        assert r == list(range(len(r)))
    assert len(got) == 500


def test_components_chain_and_hub(spark):
    e = [(f"a{i:03d}", f"a{i + 1:03d}") for i in range(60)] + [("hub", f"z{i}") for i in range(50)] + [("s", "s"), (None, "q")]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(e, "u string, v string")).collect()}
    assert {got[f"a{i:03d}"] for i in range(61)} == {"a000"}
    assert {got[f"z{i}"] for i in range(50)} == {"hub"} and got["hub"] == "hub"
    assert "s" not in got and "q" not in got
    assert components(spark.createDataFrame([], "u string, v string")).collect() == []


@pytest.mark.parametrize("sizes,counts", [([1, 2, 50], [500, 100, 3]), ([400, 1], [1, 600]), ([7], [1])])
def test_allocate(sizes, counts):
    w = allocate(np.array(sizes), np.array(counts), np.array([0, 1, 0][: len(sizes)]), [0.8, 0.1, 0.1])
    assert w.sum(1).tolist() == counts
    total = np.dot(sizes, counts)
    rows = (w * np.array(sizes)[:, None]).sum(0)
    if len(sizes) > 1:
        assert abs(rows / total - [0.8, 0.1, 0.1]).max() < 0.02


def test_split_keeps_components(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.floor(F.col("id") / 7))).alias("component"), (F.col("id") % 2).alias("split2"))
    out = split_components(df, "component", F.col("split2")).collect()
    assert len(out) == 4000
    by = {}
    for r in out:
        by.setdefault(r["component"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by.values())
    n = {s: sum(r["split"] == s for r in out) / 4000 for s in SHARES}
    assert abs(n["train"] - 0.8) < 0.02 and abs(n["test"] - 0.1) < 0.02
    empty = spark.createDataFrame([], "component string, x string")
    assert split_components(empty, "component", F.col("x")).collect() == []


def test_components_of_texts_and_label_bound(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y"), ("q", "q"), (None, "z")], "u string, v string")
    assert {(r["node"], r["component"]) for r in components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    many = spark.range(100).select("id", F.col("id").cast("string").alias("l"))
    with pytest.raises(ValueError):
        split_components(many, "id", F.col("l"))
