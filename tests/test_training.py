"""Assays, samples, pairs, clusters and hard negatives on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import assays as A
from helixframe.operators import clustering as CL
from helixframe.operators import negatives as N
from helixframe.operators import pairs as TR
from helixframe.operators import sampling as S
from helixframe.operators import tasks as TK
from helixframe.operators.running import running

AA = "ACDEFGHIKLMNPQRSTVWY"


def test_scaling(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, "a", 10.0), (3, "b", 5.0), (4, "c", 2.0), (5, "c", 2.0), (6, "a", None)], "row_id long, g string, x double")
    got = {r["row_id"]: r["scaled"] for r in A.scaled_scores(df, "g", "x").collect()}
    assert got[3] is None and got[6] is None and got[4] == 0.5
    assert abs(got[1] + got[2] - 1) < 1e-9 and 0 <= got[1] < got[2] <= 1


def test_label_score(spark):
    df = spark.createDataFrame([("Benign",), ("pathogenic",), ("0",), ("1",), ("0.25",), ("Unknown",), (None,)], "a string")
    assert [r[0] for r in df.select(A.label_score("a")).collect()] == [1.0, 0.0, 1.0, 0.0, 0.25, None, None]


def test_fold(spark):
    df = spark.createDataFrame([(i, "big", f"s{i % 40}") for i in range(100)] + [(200 + i, "small", f"t{i}") for i in range(9)], "row_id long, g string, s string")
    f = A.fold_flags(df, "g", "s")
    n = {r["g"]: r["n"] for r in f.groupBy("g").agg(F.count_if("is_test").alias("n")).collect()}
    assert n == {"big": 20, "small": 0}
    kept = A.drop_test_sequences(f, "g", "s")
    bad = {r["s"] for r in f.where("is_test").collect()}
    assert not bad & {r["s"] for r in kept.where("g = 'big'").collect()} and kept.where("g = 'small'").count() == 9


def test_split_column(spark):
    df = spark.createDataFrame([(1, "g", "a", "test", "x"), (2, "g", "a", "train", "x"), (3, "g", "b", "train", "x")], "row_id long, g string, s string, stage string, fold string")
    assert A.split_column(df) == "stage" and A.split_column(df.drop("stage")) is None
    assert [r["row_id"] for r in A.drop_named_split(df, "stage", "g", "s").collect()] == [3]


def test_pairs_inside_caps(spark):
    df = spark.createDataFrame([(i, "g", i) for i in range(200)] + [(500 + i, "h", i) for i in range(4)], "row_id long, g string, x long")
    got = A.pairs_inside(df, "g", "x", "row_id", cap=50).collect()
    by = {}
    for r in got:
        assert r["left_id"] < r["right_id"]
        by.setdefault(r["g"], set()).add((r["left_id"], r["right_id"]))
    assert len(by["g"]) == 50 and len(by["h"]) == 6 and len(got) == 56
    assert A.pairs_inside(df.where("g = 'h'"), "g", "x", "row_id").count() == 6


def test_running_hot_group(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, "hot").alias("g"), (F.col("id") % 5).alias("v"))
    got = running(df, ["g"], ["id"], {"s": "v"}).collect()
    sums = {}
    for r in sorted(got, key=lambda r: r["id"]):
        sums[r["g"]] = sums.get(r["g"], 0) + r["v"]
        assert r["s"] == sums[r["g"]]
    assert len(got) == 1000


def test_samples(spark):
    df = spark.range(1000).select("id", (F.col("id") % 2).alias("g"))
    a = S.sample_per_group(df, ["g"], 30, 1, "id")
    assert {r["g"]: r["n"] for r in a.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()} == {0: 30, 1: 30}
    assert set(a.collect()) == set(S.sample_per_group(df.repartition(5), ["g"], 30, 1, "id").collect()) != set(S.sample_per_group(df, ["g"], 30, 2, "id").collect())
    s = S.random_split(df, 0.8, 1, "id")
    assert s.where("split = 'train'").count() == 800
    g = S.group_split(df.withColumn("c", F.floor(F.col("id") / 10)), "c", 0.8, 1)
    assert g.groupBy("c").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0 and g.where("split = 'train'").count() == 800
    folds = S.stratified_folds(df, "g", 4, 1, "id").groupBy("g", "fold").count().collect()
    assert all(r["count"] == 125 for r in folds) and len(folds) == 8


def test_split_rules():
    assert S.named_split(["Train", "my_valid_set"], "validation") == "my_valid_set"
    assert S.named_split(["train"], "test") is None
    assert S.split_strategy(False, False, True, "validation", False, False, True) == "validation_cv4_train"
    assert S.split_strategy(False, False, False, "test", False, True, True) == "test_random_split"
    assert S.split_strategy(True, True, True, "test", True, True, True) == "proteingym_unchanged"
    with pytest.raises(ValueError):
        TK.Task("x", "d", "l", "odd")


def test_token_mask(spark):
    df = spark.createDataFrame([(1, "ACDE-FGH" * 200)], "row_id long, s string")
    m = df.select(S.masked("s", "row_id", 0.2, 3)).first()[0]
    assert len(m) == 1600 and m.count("-") == 200 and 150 < m.count("#") < 400


def test_positive_pairs(spark):
    df = spark.createDataFrame([(i, f"S{i}", f"g{i // 20}") for i in range(200)] + [(900, None, "g0"), (901, "X", None)], "row_id long, s string, g string")
    assert TR.positive_pairs(df, "s", "g", "row_id", 30).count() == 1900
    assert TR.positive_pairs(df, "s", "g", "row_id", 5).count() == 100
    assert TR.positive_pairs(df, "s", "g", "row_id", 30, max_pairs=100).count() == 100
    n = TR.positive_pairs(df.withColumn("neg", F.when(F.col("row_id") % 2 == 0, "N")), "s", "g", "row_id", 5, negative="neg")
    assert n.where("sentence_2 is null").count() == 0 and n.where("sentence_2 = 'N'").count() > 0


def test_runs_across_partitions(spark):
    df = spark.createDataFrame([(i, "ab"[(i // 7) % 2]) for i in range(300)], "id long, g string")
    got = {r["id"]: r["run_id"] for r in TR.runs(df, "g", ["id"]).collect()}
    want, last, run = {}, None, 0
    for i in range(300):
        g = "ab"[(i // 7) % 2]
        run += g != last
        want[i], last = run, g
    assert got == want


def test_labels(spark):
    df = spark.createDataFrame([(i, f"s{i}", f"f{i % 5}") for i in range(150)] + [(200 + i, f"r{i}", f"x{i // 2}") for i in range(6)], "row_id long, s string, f string")
    a = TR.labelled_examples(df, "s", "f", "row_id", 10, 0)
    assert a.count() == 150 and a.select("label").distinct().count() == 5
    assert TR.labelled_examples(df, "s", "f", "row_id", 10, 5).count() == 25
    with pytest.raises(ValueError):
        TR.labelled_examples(df, "s", "f", "row_id", 1000)


def test_batches(spark):
    z = spark.createDataFrame([("a", 6000), ("b", 6000), ("c", 12000), ("d", 12000)], "source string, rows long")
    b = TR.divisible_batch(z, 128, 1024, 3).first()["batch"]
    assert 128 <= b <= 1024 and all((n // b) % 3 == 0 for n in (6000, 12000))
    assert tuple(TR.steps_per_epoch(z, 100).first()) == (4, 240, 240)
    assert tuple(TR.steps_per_epoch(z, 100, 7, round_robin=False).first()) == (4, 360, 52)
    i = TR.interleave(spark.range(100).select("id", F.when(F.col("id") < 30, "a").otherwise("b").alias("s")), "s", "id", 10)
    assert sorted({r["turn"] for r in i.collect()}) == list(range(6)) and i.count() == 60


def test_clusters(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice(AA) for _ in range(120)) for _ in range(20)]
    rows = [(i, b) for i, b in enumerate(base)] + [(100 + i, b[:115]) for i, b in enumerate(base)] + [(200 + i, b[:50]) for i, b in enumerate(base)] + [(300, None), (301, ""), (302, "AC")]
    got = {r["member"]: r["rep"] for r in CL.linear_clusters(spark.createDataFrame(rows, "id long, s string"), "id", "s").collect()}
    assert all(got[100 + i] == i and got[i] == i for i in range(20))
    assert all(got[200 + i] == 200 + i for i in range(20)) and got[302] == 302 and 300 not in got and 301 not in got
    two = {r["member"]: r["rep"] for r in CL.cascaded_clusters(spark.createDataFrame(rows, "id long, s string"), "id", "s").collect()}
    assert set(two) == set(got)
    corpus = spark.createDataFrame([(f"c{i}", s) for i, s in rows if s], "id string, s string")
    left = {r["id"] for r in CL.remove_benchmark(corpus, spark.createDataFrame([("b", base[3])], "id string, s string"), "id", "s").collect()}
    assert "c3" not in left and "c103" not in left and "c4" in left and "c203" in left
    assert CL.linear_clusters(spark.createDataFrame([], "id long, s string"), "id", "s").collect() == []


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(N, "SLICE", 7)
    rng = random.Random(2)
    core = "".join(rng.choice(AA) for _ in range(90))
    rows = [(i, "F", "".join(rng.choice(AA) if rng.random() < 0.05 else c for c in core)) for i in range(40)] + [(90, "F", "ACD"), (91, None, core), (92, "G", "A" * 60)]
    df = spark.createDataFrame(rows, "row_id long, f string, s string")
    prof = N.profile_table(df, "f", "s")
    odds = {(r["family"], r["pos"], r["aa"]): r["log_odds"] for r in prof.collect()}
    got = {r["row_id"]: r["hard_negative"] for r in N.hard_negatives(df, prof, "row_id", "f", "s").collect()}
    assert got[90] is None and 91 not in got and set(got) == {r[0] for r in rows if r[1]}
    for i, _, s in rows[:40]:
        n = got[i]
        at = [p for p in range(len(s)) if s[p] != n[p]]
        assert len(at) >= N.LEAST and len(n) == len(s)
        assert min(b - a for a, b in zip(at, at[1:])) >= max(N.LEAST, len(s) // N.SPACING)
        assert sum(odds["F", p, n[p]] - odds["F", p, s[p]] for p in at) <= N.THRESHOLD + 1e-6
    again = {r["row_id"]: r["hard_negative"] for r in N.hard_negatives(df.repartition(3), prof, "row_id", "f", "s").collect()}
    assert again == got


def test_random_split_counts_rows_of_odd_keys(spark):
    df = spark.createDataFrame([(None,)] * 4 + [(1,)] * 3 + [(2,), (3,), (4,)], "k int")
    n = {r["split"]: r["count"] for r in S.random_split(df, 0.8, 5, "k").groupBy("split").count().collect()}
    assert n == {"train": 8, "test": 2}
    assert S.random_split(df, 0.0, 5, "k").where("split = 'train'").isEmpty()
