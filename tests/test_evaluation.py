"""Vectors, metrics, probes and the ledger on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import ledger as L
from helixframe.operators import metrics as M
from helixframe.operators import probes as PR
from helixframe.operators import vectormath as V
from helixframe.streaming.ledger_stream import current, merge_stream


def test_pooling(spark):
    df = spark.createDataFrame([([[1.0, -2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "t array<array<double>>, m array<int>")
    r = df.select(V.mean_pool("t", "m"), V.attention_pool("t", "m", [0.0, 0.0]), V.gem_pool("t", "m", 1.0), V.gem_pool("t", "m", 3.0)).first()
    assert r[0] == [2.0, 1.0] and np.allclose(r[1], r[0]) and np.allclose(r[2], r[0], atol=1e-5)
    assert np.allclose(r[3], [14 ** (1 / 3), (56 / 2) ** (1 / 3)])
    with pytest.raises(ValueError):
        V.gem_pool("t", "m", 0.5)
    p = V.contextual_pool(df.withColumn("id", F.lit(1)), "id", "t", "m", np.zeros((2, 3)), np.zeros(3), np.zeros(3), "gelu").first()
    assert np.allclose(p["pooled"], [2.0, 1.0])


def test_zero_vector_has_no_cosine(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert df.select(V.cosine("a", "b")).first()[0] is None


def test_recall(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [0.0, 1.0], "b"), (4, [0.0, 1.0], "b")], "id long, v array<double>, label string")
    assert tuple(M.recall_at(V.block_neighbours(df, df, 30), df, [1, 10, 30]).first()) == (1.0, 1.0, 1.0)
    odd = df.withColumn("label", F.col("id").cast("string"))
    assert tuple(M.recall_at(V.block_neighbours(odd, odd, 30), odd, [1, 10]).first()) == (0.0, 0.0)
    one = df.where("id = 1")
    assert tuple(M.recall_at(V.block_neighbours(one, one, 30), one, [1]).first()) == (0.0,)


def test_auc_and_ap(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    assert M.roc_auc(df, F.col("y") == 1, "s").first()["auc"] == 0.75
    assert abs(M.average_precision(df, F.col("y") == 1, "s").first()["average_precision"] - 0.8333333) < 1e-6
    tied = spark.createDataFrame([(0.5, 0), (0.5, 1)], "s double, y int")
    assert M.roc_auc(tied, F.col("y") == 1, "s").first()["auc"] == 0.5
    assert M.roc_auc(tied.where("y = 1"), F.col("y") == 1, "s").first()["auc"] is None


def test_f1_and_spearman(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "d")], "t string, g string")
    r = M.f1_scores(df, "t", "g", positive="a").first()
    assert abs(r["f1_macro"] - (2 / 3 + 2 / 3) / 4) < 1e-9 and r["f1_micro"] == 0.5 and abs(r["f1_binary"] - 2 / 3) < 1e-9
    s = spark.createDataFrame([("g", 1.0, 2.0), ("g", 2.0, 4.0), ("g", 3.0, 9.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("g", None, 1.0)], "k string, a double, b double")
    assert {r["k"]: r["spearman"] for r in M.spearman(s, "a", "b", ["k"]).collect()} == {"g": 1.0, "c": 0.0}


def test_ridge_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((80, 4)) * [1, 5, 0.1, 2]
    y = x @ [1.0, -0.5, 3.0, 0.2] + 1 + 0.1 * rng.standard_normal(80)
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, v array<double>, y double")
    got = {r["query_id"]: r["guess"] for r in PR.ridge(df.where("id < 60"), df.where("id >= 60"), "y", 4).collect()}
    m, s = x[:60].mean(0), x[:60].std(0)
    z = (x - m) / s
    w = np.linalg.solve(z[:60].T @ z[:60] + np.eye(4), z[:60].T @ (y[:60] - y[:60].mean()))
    assert np.allclose([got[i] for i in range(60, 80)], z[60:] @ w + y[:60].mean(), atol=1e-6)


def test_probes_learn(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((160, 6))
    y = (x[:, 0] + x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, v array<double>, y int")
    tr, te = df.where("id < 120"), df.where("id >= 120")
    for g in (PR.logistic(tr, te, "y", 6), PR.knn_votes(tr, te, "y"), PR.boosted(tr, te, "y", True, rounds=8)):
        hit = np.mean([int(r["guess"]) == y[r["query_id"]] for r in g.collect()])
        assert hit > 0.7


LED = "Task string, Date string, Probe string, AUC double, MSE double, ord long"


def test_latest_and_compare(spark):
    a = spark.createDataFrame([("t", "2024-01-01", None, 0.80, None, 1), ("t", "2024-02-01", "linear", 0.88, None, 2), ("t", "2024-03-01", "knn", 0.5, None, 3), ("u", "2024-01-01", None, None, 2.0, 4), ("z", None, None, 0.1, None, 5), ("z", "2030-01-01", None, 0.9, None, 6)], LED)
    got = {(r["Task"], r["Probe"]): r["AUC"] for r in L.latest(a).collect()}
    assert got == {("t", "linear"): 0.88, ("t", "knn"): 0.5, ("u", "linear"): None, ("z", "linear"): 0.1}
    b = spark.createDataFrame([("t", "2024-01-01", None, 0.88, None, 1), ("u", "2024-01-01", None, None, 1.5, 2), ("w", "2024-01-01", None, 0.3, None, 3)], LED)
    c = {(r["Task"], r["Probe"]): r for r in L.compare(L.latest(a), L.latest(b), "A", "B", ["AUC", "MSE"]).collect()}
    assert c["t", "linear"]["Winner"] == "tie" and c["t", "linear"]["Delta"] == 0
    assert c["u", "linear"]["Winner"] == "B" and c["u", "linear"]["Delta"] == -0.5
    assert c["w", "linear"]["status"] == "only_b" and c["t", "knn"]["status"] == "only_a"
    r = {x["Task"]: x["RelativeDeltaPct"] for x in L.relative_table(L.latest(a), L.latest(b), ["AUC", "MSE"]).collect()}
    assert abs(r["u"] - 25.0) < 1e-9


def test_multi_seed_takes_common_metric(spark):
    rows = [("t", "baseline", 1, 0.5, 2.0), ("t", "baseline", 2, 0.7, 2.0), ("t", "new", 1, None, 1.5), ("u", "baseline", 1, 0.5, None), ("u", "new", 1, 0.6, None)]
    df = L.with_defaults(spark.createDataFrame(rows, "Task string, experiment string, seed int, AUC double, MSE double"))
    r = {x["Task"]: x for x in L.multi_seed_relative(df, "experiment", "baseline", ["AUC", "MSE"]).collect()}
    assert r["t"]["metric"] == "MSE" and abs(r["t"]["RelativeDeltaPct"] - 25) < 1e-9 and abs(r["u"]["RelativeDeltaPct"] - 20) < 1e-9
    s = L.experiment_summary(L.multi_seed_relative(df, "experiment", "baseline", ["AUC", "MSE"]), "experiment").first()
    assert s["tasks"] == 2 and s["wins"] == 2 and s["improved"] == 2


def test_trial_score(spark):
    rows = [("s", "a", 0.02, 0.8, None, None), ("s", "b", None, None, -0.01, 0.5), ("s", "c", 0.0, 0.0, None, None), ("s", "d", None, None, None, None)]
    df = spark.createDataFrame(rows, "stage string, Task string, delta_AUC double, baseline_AUC double, delta_Accuracy double, baseline_Accuracy double")
    p = L.primary_delta(df, ["stage", "Task"], ("AUC", "Accuracy"))
    assert {r["Task"]: round(r["pct_delta"], 6) for r in p.collect()} == {"a": 2.5, "b": -2.0, "c": 0.0}
    t = L.trial_score(p, "stage").first()
    assert (t["wins"], t["losses"], t["ties"], t["n_tasks"]) == (1, 1, 1, 3)


def test_upsert_and_markdown(spark):
    old = spark.createDataFrame([("t", 0.123456789, 1)], "Task string, AUC double, ord long")
    new = spark.createDataFrame([("t", 0.5, 0.2, 1), ("u", 0.25, None, 2)], "Task string, AUC double, F1 double, ord long")
    u = L.upsert(old, new, ["Task", "Probe"])
    assert {r["Task"]: (r["AUC"], r["F1"]) for r in u.collect()} == {"t": (0.5, 0.2), "u": (0.25, None)}
    assert L.markdown(u.select("Task", "F1").orderBy("Task")).splitlines()[-1] == "| u |  |"
    with pytest.raises(ValueError):
        L.markdown(spark.range(9), limit=5)
    assert L.valid_ledger(u) and not L.valid_ledger(u.limit(0)) and not L.valid_ledger(spark.range(1))


def test_ledger_stream(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/ledger"
    schema = "Task string, AUC double, ord long"
    for n, rows in enumerate([[("t", 0.1, 1), ("u", 0.2, 2)], [("t", 0.3, 3)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = merge_stream(spark.readStream.schema(schema).parquet(src), out, ["Task"], f"{tmp_path}/cp")
        q.awaitTermination()
        assert q.exception() is None
    assert {r["Task"]: r["AUC"] for r in spark.read.parquet(current(out)).collect()} == {"t": 0.3, "u": 0.2}
