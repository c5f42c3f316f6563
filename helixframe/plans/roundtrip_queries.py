"""Readers and writers (SRC, SNK): test tables written in a format, read back and compared with themselves."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from helixframe.functions.portable import hash_cap, sql_hash
from helixframe.operators import ledger as L
from helixframe.plans.common import DMS, T, dms
from helixframe.sources import files
from helixframe.sources import readers as R
from helixframe.sources import sinks as W
from helixframe.util import scratch

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _one(s, schema: str, *values):
    return s.createDataFrame([values], schema)


@query("SELECT p_partkey AS id, p_name AS name FROM part")
def src1_shards(s, d):
    # The second shard is missing, so the third is not read.
    return R.shards(s, [f"{d}/part.parquet", f"{d}/no_such_shard.parquet", f"{d}/part.parquet"], {"id": "p_partkey", "name": "p_name"})


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def src2_tree(s, d):
    at, t = scratch(s, "tree"), T(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    W.parquet(t.where("s_suppkey % 2 = 0"), f"{at}/even/a")
    W.parquet(t.where("s_suppkey % 2 = 1"), f"{at}/odd")
    return R.tree(s, at)


def _map_file(s, d):
    at = scratch(s, "map")
    flag = F.when(F.col("p_partkey") % 5 == 0, "bad").otherwise(F.col("p_size").cast("string"))
    T(s, d, "part").select("p_brand", "p_name", flag.alias("f"), F.lit("9606")).write.option("sep", "\t").option("compression", "gzip").csv(at)
    return at


@query("SELECT p_brand AS foldseek_rep, p_name AS entry_id, CAST(p_size AS TINYINT) AS clu_flag FROM part WHERE p_partkey % 5 <> 0 AND p_size IN (1, 2, 7)")
def src3_structural_map(s, d):
    return R.structural_map(s, _map_file(s, d), (1, 2, 7))


@query("SELECT p_name AS entry, p_brand AS rep FROM part")
def src4_headerless(s, d):
    return R.headerless(s, _map_file(s, d), "rep string, entry string, flag string, tax string", ["entry", "rep"])


@query("SELECT 'p' || l_partkey AS protein1, 's' || l_suppkey AS protein2, CAST(l_quantity * 20 AS INTEGER) AS combined_score FROM lineitem WHERE l_quantity * 20 >= 400")
def src8_links(s, d):
    at = scratch(s, "links")
    li = T(s, d, "lineitem")
    line = F.concat(F.lit("p"), "l_partkey", F.lit(" s"), "l_suppkey", F.lit("\t0  "), (F.col("l_quantity") * 20).cast("int"))
    s.createDataFrame([("protein1 protein2 odd combined_score",)], "value string").union(li.select(line)).write.option("compression", "gzip").text(at)
    return R.links(s, at, 400)


_BACK = ", ".join(repr(x) for x in R.BACKGROUND)


@query(f"""WITH e AS (SELECT 'PF' || n_nationkey AS family_id, p AS pos, j, (n_nationkey * 7 + p * 3 + j) % 20 / 4.0 + 1 AS x FROM nation, generate_series(0, 1) AS a(p), generate_series(0, 19) AS b(j))
SELECT family_id, CAST(pos AS INTEGER) AS pos, 'ACDEFGHIKLMNPQRSTVWY'[j + 1] AS aa, round(log2(exp(-x)) - log2(CAST([{_BACK}][j + 1] AS DOUBLE)), 6) AS log_odds FROM e""")
def src9_profiles(s, d):
    at = scratch(s, "profiles")
    node = lambda p: F.concat_ws(" ", F.lit(f"  {p + 1}"), *[F.format_string("%.5f", F.pmod(F.col("n_nationkey") * 7 + p * 3 + j, F.lit(20)) / 4.0 + 1) for j in range(20)], F.lit("1 - - -"))
    head = F.concat(F.lit("HMMER3/f\nACC   PF"), "n_nationkey", F.lit(".3\nHMM " + " ".join(R.AMINO)))
    T(s, d, "nation").select(F.concat_ws("\n", head, node(0), node(1), F.lit("//"))).write.text(at)
    return R.profiles(s, at).withColumn("log_odds", F.round("log_odds", 6))


@query("SELECT s_suppkey FROM supplier")
def src10_named_config(s, d):
    at = scratch(s, "configs")
    W.parquet(T(s, d, "supplier").select("s_suppkey"), f"{at}/data/small")
    return s.read.parquet(R.first_existing([f"{at}/small", f"{at}/data/small"]))


@query("SELECT n_nationkey, n_name FROM nation")
def src11_task_table(s, d):
    at = scratch(s, "task")
    W.parquet(T(s, d, "nation").select("n_nationkey", "n_name"), f"{at}/hub")
    return R.first_loaded([lambda: s.read.parquet(f"{at}/local"), lambda: s.read.parquet(f"{at}/hub")])


def _result_file(s, d):
    at = scratch(s, "results")
    odd = F.when(F.col("o_orderkey") % 7 == 0, " ").when(F.col("o_orderkey") % 11 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    W.csv(T(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("Task"), odd.alias("AUC")), at)
    return at


@query("SELECT CAST(o_orderkey AS VARCHAR) AS Task, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN o_totalprice END AS AUC FROM orders")
def src12_result_file(s, d):
    return R.results(s, _result_file(s, d), ["AUC"])


@query("SELECT count(AUC) AS numbers, count(*) - count(AUC) AS blanks FROM (SELECT CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN o_totalprice END AS AUC FROM orders)")
def src13_blank_numbers(s, d):
    return R.results(s, _result_file(s, d), ["AUC"]).agg(F.count("AUC").alias("numbers"), F.count_if(F.col("AUC").isNull()).alias("blanks"))


@query("SELECT column_name FROM (DESCRIBE part)")
def src14_schema_probe(s, d):
    return s.createDataFrame([(c,) for c in R.columns_of(s, f"{d}/part.parquet")], "column_name string")


@query("SELECT count(*) AS rows FROM lineitem")
def src15_row_count(s, d):
    return _one(s, "rows long", R.row_count(T(s, d, "lineitem")))


@query("SELECT sum(CAST(l_quantity AS BIGINT)) AS quantity, count(*) AS rows FROM lineitem")
def src16_batched_scan(s, d):
    def add(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(b.column(0).to_numpy().sum())]), pa.array([b.num_rows])], ["q", "n"])

    return T(s, d, "lineitem").select("l_quantity").mapInArrow(add, "q long, n long").agg(F.sum("q").alias("quantity"), F.sum("n").alias("rows"))


@query(f"SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY {sql_hash(17, 'l_orderkey', 'l_linenumber')}, l_orderkey, l_linenumber LIMIT 1200")
def src17_sampled_rows(s, d):
    return hash_cap(T(s, d, "lineitem").select("l_orderkey", "l_linenumber"), 1200, 17, "l_orderkey", "l_linenumber")


@query("SELECT unnest(['a.csv', 'b.csv', 'c.csv', 'c.csv']) AS name, unnest([1, 2, 3, 4]) AS place")
def src18_expanded_paths(s, d):
    at = scratch(s, "paths")
    for n in ("sub/b.csv", "sub/a.csv", "c.csv"):
        files.write_text(f"{at}/{n}", "x")
    found = R.expand_paths([f"{at}/sub/*.csv", "c.csv", f"{at}/c.csv"], at)
    return s.createDataFrame([(p.rsplit("/", 1)[1], i + 1) for i, p in enumerate(found)], "name string, place int")


@query("SELECT 't' AS Task, 2.0 AS AUC")
def src19_latest_result(s, d):
    at = scratch(s, "latest")
    files.write_text(f"{at}/org_model_old.csv", "Task,AUC\nt,1.0\n")
    files.write_text(f"{at}/org_model_new.csv", "Task,AUC\nt,2.0\n")
    files.touch(f"{at}/org_model_old.csv", 1_000)
    return R.results(s, R.latest_result("org/model", at), ["AUC"])


@query("SELECT count(*) AS rows, 0 AS unordered, 0 AS overlaps FROM orders")
def snk1_sorted_files(s, d):
    at = scratch(s, "sorted")
    W.sorted_parquet(T(s, d, "orders").select("o_custkey", "o_orderkey"), at, ["o_custkey", "o_orderkey"], 4)
    back = s.read.parquet(at).select("*", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i"))
    after = back.select(F.col("f").alias("g"), (F.col("i") - 1).alias("j"), F.struct("o_custkey", "o_orderkey").alias("next"))
    bad = back.join(after, (F.col("f") == F.col("g")) & (F.col("i") == F.col("j"))).agg(F.count_if(F.struct("o_custkey", "o_orderkey") > F.col("next")).cast("int").alias("unordered"))
    span = back.groupBy("f").agg(F.min(F.struct("o_custkey", "o_orderkey")).alias("lo"), F.max(F.struct("o_custkey", "o_orderkey")).alias("hi"))
    other = span.select(F.col("f").alias("f2"), F.col("lo").alias("lo2"))
    overlaps = span.join(other, (F.col("f") < F.col("f2")) & (F.col("hi") > F.col("lo2"))).agg(F.count(F.lit(1)).cast("int").alias("overlaps"))
    return back.agg(F.count(F.lit(1)).alias("rows")).crossJoin(bad).crossJoin(overlaps)


@query("SELECT * FROM customer")
def snk2_parquet(s, d):
    W.parquet(T(s, d, "customer"), at := scratch(s, "parquet"))
    return s.read.parquet(at)


@query("SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, round(l_extendedprice / 7, 5) AS price FROM lineitem")
def snk3_rounded_csv(s, d):
    W.csv(T(s, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") / 7).alias("price")), at := scratch(s, "csv"))
    return R.results(s, at, ["price"])


@query("SELECT r_name FROM region UNION ALL SELECT r_name FROM region")
def snk4_appended_rows(s, d):
    at, t = scratch(s, "append"), T(s, d, "region").select("r_name")
    W.append_rows(t, at)
    W.append_rows(t, at)
    return R.results(s, at, [])


@query("SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(max(o_orderkey) AS VARCHAR) AS ord, 'stored' AS at FROM orders GROUP BY 1 UNION ALL SELECT CAST(n_nationkey AS VARCHAR), '0', 'recovery' FROM nation")
def snk5_stored_ledger(s, d):
    at, t = scratch(s, "ledger"), T(s, d, "orders").select(F.col("o_custkey").cast("string").alias("o_custkey"), F.col("o_orderkey").alias("ord"))
    last = t.groupBy("o_custkey").agg(F.max("ord").alias("ord"))
    W.save_ledger(last.where("ord % 2 = 0"), at, ["o_custkey"], ["ord"])
    W.save_ledger(last, at, ["o_custkey"], ["ord"])
    odd = scratch(s, "odd")
    files.write_text(f"{odd}/part.csv", "something else\n1\n")
    saved = W.save_ledger(T(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("o_custkey"), F.lit(0).alias("ord")), odd, ["o_custkey"], ["ord"])
    read = lambda p, name: R.results(s, p, ["ord"]).select("o_custkey", F.col("ord").cast("bigint").cast("string").alias("ord"), F.lit(name).alias("at"))
    return read(at, "stored").union(read(saved, "recovery" if saved.endswith(".recovery") else "lost"))


@query(f"WITH {DMS} SELECT CAST(row_id AS VARCHAR) AS id, s0 AS sequence FROM dms WHERE s0 <> ''")
def snk6_fasta(s, d):
    W.fasta(dms(s, d), at := scratch(s, "fasta"), "row_id", "s0")
    return R.fasta(s, at)


@query("SELECT unnest(['| r_regionkey | r_name |', '| --- | --- |']) AS line UNION ALL SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region")
def snk7_markdown(s, d):
    text = L.markdown(T(s, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"))
    return s.createDataFrame([(x,) for x in text.split("\n")], "line string")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region UNION ALL SELECT 'lines', CAST(count(*) + 2 AS VARCHAR) FROM region")
def snk8_report_files(s, d):
    at, t = scratch(s, "report"), T(s, d, "region").select("r_regionkey", "r_name")
    W.report(t, f"{at}/r.csv")
    W.report(t, f"{at}/r.md")
    lines = len(files.read_text(f"{at}/r.md").strip().split("\n"))
    return R.results(s, f"{at}/r.csv", []).union(_one(s, "a string, b string", "lines", str(lines)))


@query("SELECT true AS first, false AS again, true AS other_settings, true AS forced")
def snk10_made_once(s, d):
    at = scratch(s, "once")
    make = lambda: W.parquet(T(s, d, "region"), at)
    return _one(s, "first boolean, again boolean, other_settings boolean, forced boolean", W.once(at, {"k": 1}, make), W.once(at, {"k": 1}, make), W.once(at, {"k": 2}, make), W.once(at, {"k": 2}, make, force=True))
