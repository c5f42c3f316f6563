"""Whole preparations on small inputs, and the assay probe."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import pairs as TR
from helixframe.operators import probes as PR
from helixframe.plans import pipelines as PL

CONT = "row_id long, DMS_id string, mutated_sequence string, target_seq string, DMS_score double"
CLIN = "row_id long, mutated_sequence string, target_seq string, annotation string, protein_id string"


@pytest.fixture(scope="module")
def assays(spark):
    subs = spark.createDataFrame([(1, "A1", "MKA", "MKK", 0.1), (2, "A1", "MKC", "MKK", 0.9), (3, "GB1_X", "AAA", "AAC", 0.2), (4, "GB1_X", "AAD", "AAC", 0.3)], CONT)
    indels = spark.createDataFrame([(1, "I1", "MK", "MKKL", 1.0), (2, "I1", "MKKLL", "MKKL", 2.0), (3, "I1", "MKL", "MKKL", 3.0)], CONT)
    text = spark.createDataFrame([(1, "QA", "QQ", "Benign", "p1"), (2, "QC", "QQ", "Pathogenic", "p1"), (3, "QD", "QQ", "Unknown", "p1")], CLIN)
    numeric = spark.createDataFrame([(1, "WA", "WW", "0", "p2"), (2, "WC", "WW", "1", "p2")], CLIN)
    return [subs, indels], [text, numeric]


def test_scored_pairs(assays):
    cont, clin = assays
    d = PL.scored_pairs(cont, clin)
    rows = d.collect()
    assert len(rows) == 9 and len({r["sentence_1"] for r in rows}) == 4
    assert all(r["score"] is None or 0 <= r["score"] <= 1 for r in rows)
    by = {r["sentence_0"]: r["score"] for r in rows}
    assert by["QA"] > by["QC"] and by["WA"] == 1.0 and by["WC"] == 0.0
    assert PL.scored_pairs(cont, clin, exclude=False).count() == 11
    assert PL.scored_pairs(cont, clin, inside=2).count() == 12
    with pytest.raises(ValueError):
        PL.scored_pairs([], [])


def test_scored_pairs_folds(spark):
    ten = spark.createDataFrame([(i, "A", f"M{i}", "W", float(i)) for i in range(10)], CONT)
    assert PL.scored_pairs([ten], []).count() == 8
    staged = ten.where("row_id < 4").withColumn("stage", F.when(F.col("row_id") < 2, "test").otherwise("train"))
    assert PL.scored_pairs([staged], []).count() == 2
    # A pair of one assay's test fold is removed wherever else it occurs.
    other = spark.createDataFrame([(1, "B", "M0", "W", 1.0), (2, "B", "X", "W", 2.0)], CONT)
    assert {r["sentence_0"] for r in PL.scored_pairs([staged, other], []).collect()} == {"M2", "M3", "X"}


def test_family_and_structure(spark):
    r = spark.createDataFrame([(1, "ACD", "F1", "d"), (2, "ACE", "F1", "d"), (3, "ACF", "F2", "d"), (4, None, "F1", "d"), (5, "", "F1", "d"), (6, "AA", None, "d")], "row_id long, seq string, family string, domain_id string")
    p = spark.createDataFrame([("F1", "C1")], "family_id string, clan_id string")
    assert sorted((x["row_id"], x["clan_id"], x["group_id"]) for x in PL.family_corpus(r, p).collect()) == [(1, "C1", "F1"), (2, "C1", "F1")]
    prot = spark.createDataFrame([("a", "MK", 90.0, 0), ("b", "ML", 71.0, 0), ("c", "MM", 70.0, 0), ("d", "MN", 99.0, 1), ("e", "MO", 80.0, 0)], "repId string, sequence string, plddt double, fragment int")
    st = spark.createDataFrame([("R", "a"), ("R", "b"), ("R", "c"), ("S", "e")], "foldseek_rep string, entry_id string")
    got = PL.structural_corpus(prot, st)
    assert got.columns == ["sequence", "afdb50_cluster_id", "group_id"] and got.count() == 2


def test_interactions(spark):
    links = spark.createDataFrame([("a", "b", 900), ("b", "a", 900), ("a", "c", 399), ("a", "d", 500), ("a", "e", 800)], "protein1 string, protein2 string, combined_score int")
    seqs = spark.createDataFrame([("a", "M" * 12), ("b", "K" * 12), ("c", "L" * 12), ("d", "V" * 5), ("e", "W" * 12), ("z", "Q" * 20)], "id string, sequence string")
    clusters = spark.createDataFrame([("a", "A"), ("b", "B"), ("d", "D"), ("e", "A")], "member string, rep string")
    assert [tuple(r) for r in PL.interactions(links, seqs, clusters=clusters).collect()] == [("M" * 12, "K" * 12)]
    assert PL.interactions(links, seqs).count() >= 1
    bench = spark.createDataFrame([("bench", "K" * 12)], "id string, sequence string")
    assert ("M" * 12, "K" * 12) not in [tuple(r) for r in PL.interactions(links, seqs, benchmark=bench).collect()]


def test_assay_ridge(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g, n in (("big", 200), ("mid", 40), ("few", 8)):
        x = rng.standard_normal((n, 3))
        rows += [(len(rows) + i, g, f"{g}{i}", v.tolist(), float(v @ [1, 2, -1] + 0.05 * rng.standard_normal())) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id long, g string, s string, v array<double>, y double")
    got = {r["g"]: r for r in PR.assay_ridge(df, "g", "s", "v", "y", 3).collect()}
    assert set(got) == {"big", "mid"} and got["big"]["n"] == 40 and got["mid"]["n"] == 8
    assert got["big"]["spearman"] > 0.95


def test_batches_without_copies(spark):
    df = spark.createDataFrame([(i, f"t{i % 50}") for i in range(175)] + [(900, None)], "k long, t string")
    rows = TR.distinct_batches(df, "t", "k", 10).join(df, "k").collect()
    by = {}
    for r in rows:
        by.setdefault(r["batch_id"], []).append(r["t"])
    assert all(len(v) == 10 == len(set(v)) for v in by.values()) and sorted(by) == list(range(17))
    lab = TR.label_batches(df, "t", "k", 3, 4).collect()
    one = {}
    for r in lab:
        one.setdefault(r["batch_id"], []).append(r["t"])
    assert all(len(set(v)) * 3 == len(v) <= 12 for v in one.values())
    assert TR.file_budget(100, 3) == 33 and TR.file_budget(0, 3) == 0 and TR.step_estimate(10, 100) == 1
