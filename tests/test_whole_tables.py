"""Queries over whole tables: rows that a length, size or modulo bound used to leave out."""

from helixframe.operators import negatives as N
from helixframe.plans import corpus_queries as CQ
from helixframe.plans import more_queries as MQ
from helixframe.plans import training_queries as TQ

ASSAYS = "row_id long, DMS_id string, mutated_sequence string, target_seq string, DMS_score double, stage string"


def assays(spark, path, sizes):
    rows = [(1000 * k + i, g, f"ACD{'E' * (i % 7)}", "ACD", float(i * i % 11), None) for k, (g, n) in enumerate(sizes.items()) for i in range(n)]
    spark.createDataFrame(rows, ASSAYS).write.parquet(f"{path}/test_data_prep.parquet")
    return rows


def test_nan_to_zero_at_every_length(spark, tmp_path):
    nan = float("nan")
    spark.createDataFrame([(1, [nan, 2.0]), (2, [nan] * 64), (3, [1.0] * 63), (4, None), (5, [])], "vec_id long, vector array<float>").write.parquet(f"{tmp_path}/sequence_vectors.parquet")
    got = {r["vec_id"]: r["v"] for r in CQ.flt17_nan_to_zero(spark, str(tmp_path)).collect()}
    assert got == {1: [0.0, 2.0], 2: [0.0] * 64, 3: [1.0] * 63, 4: None, 5: []}


def test_profiles_of_long_families(spark):
    rows = [(i, "F", "ACDEFGHIKLMNPQRSTVWY" * 20 + "A" * i) for i in range(3)]
    df = spark.createDataFrame(rows, "row_id long, f string, s string")
    odds = {(r["pos"], r["aa"]): r["log_odds"] for r in N.profile_table(df, "f", "s").collect()}
    assert {p for p, _ in odds} == set(range(402)) and len(odds) == 402 * 20
    assert odds[399, "Y"] > 1 > 0 > odds[399, "A"]
    pool = N.candidate_pool(df, N.profile_table(df, "f", "s"), "row_id", "f", "s").where("row_id = 0")
    assert {r["pos"] for r in pool.select("pos").distinct().collect()} == set(range(400))


def test_pairs_inside_every_assay(spark, tmp_path):
    rows = assays(spark, tmp_path, {"BIG": 45, "SMALL": 5, "ONE": 1})
    want = sorted((a[1], a[0], b[0], abs(a[4] - b[4])) for a in rows for b in rows if a[1] == b[1] and a[0] < b[0])
    assert sorted(tuple(r) for r in TQ.jn18_pairs_inside(spark, str(tmp_path)).collect()) == want and len(want) == 1000


def test_member_lists_of_every_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(CQ, "MEMBERS", 30)
    rows = assays(spark, tmp_path, {"BIG": 70, "SMALL": 5})
    lists = sorted(CQ.agg7_member_lists(spark, str(tmp_path)).collect(), key=lambda r: (r["dms_id"], r["slice"]))
    assert [(r["dms_id"], r["slice"], len(r["ids"])) for r in lists] == [("BIG", 0, 30), ("BIG", 1, 30), ("BIG", 2, 10), ("SMALL", 0, 5)]
    assert [(i, r["dms_id"], m) for r in lists for i, m in zip(r["ids"], r["members"])] == [r[:3] for r in rows]


def test_gaps_of_every_customer(spark, tmp_path):
    spark.createDataFrame([(10, 5), (10, 1), (10, 12), (7, 3), (7, 4), (8, 9)], "o_custkey long, o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert {r["o_custkey"]: r["gaps"] for r in MQ.win14_adjacent_gaps(spark, str(tmp_path)).collect()} == {10: [4, 7], 7: [1]}
