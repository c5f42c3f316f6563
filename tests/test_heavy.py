"""Exact per-key totals under skew and odd input."""

from pyspark.sql import functions as F

from helixframe.operators.heavy import heavy_keys, keyed_totals
from helixframe.util import family_key, residues

SCHEMA = "row_id long, family_id string, group_id string, sequence string, field_name string, members int"


def totals(df):
    return keyed_totals(df, {"family_id": family_key("family_id"), "group_id": F.col("group_id")}, residues("sequence"))


def test_totals(spark):
    rows = [(i, " pf1.%d" % (i % 9), "g", "ACD" if i % 2 else "acd-E", "x", 1) for i in range(300)]
    rows += [(900, None, None, None, None, None), (901, "PF2", "h", "", None, None), (902, "pf2\t", "h", "  ", None, None), (903, "PF2.7", "h", "A" * 50_000, None, None), (903, "PF2.7", "h", "A" * 50_000, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r[0], r[1]): tuple(r)[2:] for r in totals(df).collect()}
    assert got[("family_id", "PF1")] == (300, 150 * 7, 2)
    assert got[("family_id", "PF2")] == (4, 100_000, 1)
    assert got[("family_id", None)] == (1, 0, 0)
    assert got[("group_id", "g")] == (300, 1050, 2)
    heavy = {(r[0], r[1]) for r in heavy_keys(totals(df), df.count()).collect()}
    assert heavy == {("family_id", "PF1"), ("group_id", "g")}


def test_empty(spark):
    assert totals(spark.createDataFrame([], SCHEMA)).collect() == []


def test_border_is_inside(spark):
    df = spark.createDataFrame([(i, "A" if i < 2 else f"B{i}", None, "ACD", None, None) for i in range(100)], SCHEMA)
    assert {r["key_value"] for r in heavy_keys(totals(df), 100).collect()} == {"A"}
    assert heavy_keys(totals(df), 101).collect() == []
