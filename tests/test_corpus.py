"""Corpus loading, links, functions, readers and writers on small inputs."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from helixframe.functions import portable as P
from helixframe.operators import corpus as C
from helixframe.operators import links as L
from helixframe.sources import readers as R
from helixframe.sources import sinks as W


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_aliases_first_wins(spark):
    df = spark.createDataFrame([(1, 2)], "seq int, primary int")
    assert C.normalize_columns(df, {"sequence": ("primary", "seq")}).columns == ["seq", "sequence"]
    assert C.normalize_columns(df.withColumnRenamed("seq", "sequence").withColumnRenamed("primary", "aa_seq")).columns == ["sequence", "aa_seq"]
    spelled = spark.createDataFrame([(1, 2, 3, 4)], "aa_seq int, uniref50_id int, family int, clan int")
    assert C.normalize_columns(spelled).columns == ["sequence", "cluster_id", "family_id", "clan_id"]
    with pytest.raises(ValueError, match="missing"):
        C.require_columns(df, ["seq", "label"])
    assert C.resolve(["Seq", "label"], ["sequence", "seq"]) == "Seq"


def test_lengths_are_bytes(spark):
    df = spark.createDataFrame([("é",), ("ab",), ("abc",), (None,)], "s string")
    assert rows(C.length_band(df, ["s"], 2, 2)) == [("ab",), ("é",)]
    assert rows(C.length_band(df, ["s"], 2, 4, closed=False)) == [("abc",)]


def test_prefix_exclusion_drops_null(spark):
    df = spark.createDataFrame([("AX",), ("BX",), (None,)], "i string")
    assert rows(C.exclude_prefixes(df, "i", ["A", "C"])) == [("BX",)]


def test_singletons_and_redundant_column(spark):
    df = spark.createDataFrame([("a", "x", "x"), ("b", "x", "x"), ("c", "y", "y"), ("d", None, None)], "s string, cluster_id string, group_id string")
    kept = C.frequent(df, "group_id", 2)
    assert rows(kept.select("s")) == [("a",), ("b",)]
    assert C.drop_redundant(kept, "cluster_id", "group_id").columns == ["s", "group_id"]
    assert "cluster_id" in C.drop_redundant(df.withColumn("group_id", F.lit("q")), "cluster_id", "group_id").columns


def test_check_clean(spark):
    ok = spark.createDataFrame([("a",)], "s string")
    assert C.check_clean(ok, ["s"]).count() == 1
    with pytest.raises(Exception, match="null or empty"):
        C.check_clean(spark.createDataFrame([("a",), ("",)], "s string"), ["s"]).collect()


def test_index_and_shuffle(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("k"))
    got = {r["id"]: r["row_idx"] for r in C.indexed(df, ["k", "id"]).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(500), key=lambda i: (i % 3, i))
    one, two = ([r["id"] for r in C.shuffled_within(df, ["k"], "id", s).collect()] for s in (1, 2))
    assert one != two and sorted(one) == sorted(two)


def test_hash_cap_is_exact(spark):
    df = spark.range(3000)
    for n in (0, 1, 17, 2999, 3000, 9999):
        assert P.hash_cap(df, n, 5, "id", buckets=4096).count() == (min(n, 3000) if n else 3000)
    a = {r[0] for r in P.hash_cap(df, 100, 5, "id").collect()}
    assert a == {r[0] for r in P.hash_cap(df.repartition(7), 100, 5, "id").collect()}
    assert a != {r[0] for r in P.hash_cap(df, 100, 6, "id").collect()} and max(a) > 150


def test_scalar_functions(spark):
    df = spark.createDataFrame([("['a', 'b'; c|d]", "0.7", " Yes ", "1, ,3", "a/b\\c")], "m string, c string, b string, i string, n string")
    r = df.select(P.multilabel("m"), P.class_label("c"), P.truthy("b"), P.int_list("i"), P.safe_name("n"), P.title(F.lit("two_words")), P.no_whitespace(F.lit(" A C\tD"))).first()
    assert tuple(r) == (["a", "b", "c", "d"], "0", True, [1, 3], "a_b_c", "Two Words", "ACD")
    assert df.select(P.class_label(F.lit("cat")), P.truthy(F.lit(None).cast("string"))).first() == ("cat", False)


def test_best_pairs_ties(spark):
    df = spark.createDataFrame([("a", "b", 5, 2), ("b", "a", 9, 7), ("b", "a", 9, 3), ("c", "a", 1, 1)], "x string, y string, score int, t int")
    assert rows(L.best_pairs(df, "x", "y", "score", ["t"])) == [("a", "b", 9, 3), ("a", "c", 1, 1)]


def test_decontaminate_by_member_and_rep(spark):
    c = spark.createDataFrame([("m1", "r1"), ("p", "r1"), ("m2", "p2"), ("m3", "r3"), ("r3", "r3")], "member string, rep string")
    p = spark.createDataFrame([("p",), ("p2",)], "id string")
    assert rows(L.decontaminate(c, p)) == [("m3", "r3"), ("r3", "r3")]


def test_compose_identity(spark):
    a = spark.createDataFrame([("m", "r"), ("n", "s")], "member string, rep string")
    assert rows(L.compose(a, spark.createDataFrame([("r", "q")], "member string, rep string"))) == [("m", "q"), ("n", "s")]


def test_structural_map(spark, tmp_path):
    path = f"{tmp_path}/m.tsv.gz"
    with gzip.open(path, "wt") as f:
        f.write("r1\te1\t1\t9\nr1\te2\t2\t9\nr2\te3\t1\t9\nr3\te4\t300\t9\n")
    assert R.structural_map(spark, path, (1,)).count() == 2
    assert R.structural_map(spark, path, (1, 2)).count() == 3


def test_links_reader(spark, tmp_path):
    path = f"{tmp_path}/l.txt.gz"
    with gzip.open(path, "wt") as f:
        f.write("protein1 protein2 combined_score\na b 400\nb c 399\nc d 12 900\n\n")
    assert rows(R.links(spark, path, 400)) == [("a", "b", 400), ("c", "d", 900)]


def test_fasta_family_and_plain(spark, tmp_path):
    path = f"{tmp_path}/x.fasta"
    with open(path, "w") as f:
        f.write(">P1/3-9 P1.1 PF00001.5;7tm;\nACD\nEF G\n>bad\nWWWW\n>P2/1-4 PF00002.1;x\nMK\r\n>P3 a PF3\n")
    assert rows(R.fasta(spark, path, family=True)) == [("P1/3-9", "PF00001", "ACDEFG"), ("P2/1-4", "PF00002", "MK")]
    assert rows(R.fasta(spark, path)) == [("P1/3-9", "ACDEFG"), ("P2/1-4", "MK"), ("bad", "WWWW")]
    out = f"{tmp_path}/o"
    W.fasta(R.fasta(spark, path), out, "id", "sequence")
    assert rows(R.fasta(spark, out)) == rows(R.fasta(spark, path))


def test_profile_library(spark, tmp_path):
    path = f"{tmp_path}/p.hmm"
    aa = list(R.AMINO)
    head = lambda acc: f"HMMER3/f [x]\nNAME  n\nACC   {acc}\nLENG  2\nHMM     {' '.join(aa)}\n     m->m m->i\n  COMPO {' '.join(['2.9'] * 20)}\n"
    node = lambda i, x: f"  {i} {' '.join(x)} 1 a - - -\n   {' '.join(['2.7'] * 20)}\n   0.1 0.2 0.3 0.4 0.5 0.6 0.7\n"
    with open(path, "w") as f:
        f.write(head("PF1.3") + node(1, ["0.5"] + ["*"] * 19) + node(2, ["2.9957"] * 20) + "//\n" + head("PF2.1") + node(1, ["1.0"] * 20) + "//\n")
    got = R.profiles(spark, path)
    assert got.count() == 60
    import math

    top = got.where("family_id = 'PF1' and pos = 0 and aa = 'A'").first()["log_odds"]
    assert abs(top - (math.log2(math.exp(-0.5)) - math.log2(R.BACKGROUND[0]))) < 1e-9
    assert abs(sum(R.BACKGROUND) - 1) < 1e-3


def test_paths(spark, tmp_path):
    os.makedirs(f"{tmp_path}/d/sub")
    for n in ("b", "a"):
        open(f"{tmp_path}/d/sub/{n}.parquet", "w").close()
    os.makedirs(f"{tmp_path}/empty")
    assert [os.path.basename(x) for x in R.expand_paths(["sub"], f"{tmp_path}/d")] == ["a.parquet", "b.parquet"]
    assert len(R.expand_paths([f"{tmp_path}/d/sub/*.parquet"], "")) == 2
    with pytest.raises(FileNotFoundError, match="nope.*empty"):
        R.expand_paths(["nope", f"{tmp_path}/empty"], f"{tmp_path}/d")
    with pytest.raises(FileNotFoundError):
        R.first_existing([f"{tmp_path}/q"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 1.1234567, "b"), (1, 2.5, None), (3, None, "c")], "k int, v double, s string")
    W.sorted_parquet(df, f"{tmp_path}/p", ["k"], 2)
    assert spark.read.parquet(f"{tmp_path}/p").count() == 3 and R.row_count(spark.read.parquet(f"{tmp_path}/p")) == 3
    W.csv(df, f"{tmp_path}/c")
    back = R.results(spark, f"{tmp_path}/c", ["v"])
    assert sorted(r["v"] for r in back.collect() if r["v"]) == [1.12346, 2.5]
    W.append_rows(df, f"{tmp_path}/a")
    W.append_rows(df, f"{tmp_path}/a")
    assert spark.read.option("header", True).csv(f"{tmp_path}/a").count() == 6
    W.report(df.orderBy("k"), f"{tmp_path}/r.md")
    assert open(f"{tmp_path}/r.md").read().splitlines()[2] == "| 1 | 2.5 |  |"
    with pytest.raises(ValueError):
        W.report(df, f"{tmp_path}/r.xls")


def test_once(spark, tmp_path):
    made = []
    make = lambda: (made.append(1), open(f"{tmp_path}/o", "w").close())
    src = f"{tmp_path}/in"
    open(src, "w").close()
    assert W.once(f"{tmp_path}/o", {"t": 1}, make, inputs=[src])
    assert not W.once(f"{tmp_path}/o", {"t": 1}, make, inputs=[src])
    assert W.once(f"{tmp_path}/o", {"t": 2}, make, inputs=[src])
    with open(src, "w") as f:
        f.write("changed")
    assert W.once(f"{tmp_path}/o", {"t": 2}, make, inputs=[src])
    assert W.once(f"{tmp_path}/o", {"t": 2}, make, inputs=[src], force=True) and len(made) == 4


def test_shards_stop_at_gap(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/s0")
    spark.range(5).write.parquet(f"{tmp_path}/s2")
    assert R.shards(spark, [f"{tmp_path}/s0", f"{tmp_path}/s1", f"{tmp_path}/s2"], {"k": "id"}).count() == 3
    assert R.columns_of(spark, f"{tmp_path}/s0") == ["id"] and not R.is_pair_table(spark, f"{tmp_path}/s0")
    assert R.tree(spark, str(tmp_path)).count() == 8
