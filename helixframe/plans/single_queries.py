"""One query for each operator that the other modules only use inside larger ones, and invariants of random or fitted ones."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from helixframe.functions import portable as P
from helixframe.functions.portable import sql_hash
from helixframe.operators import assays as A
from helixframe.operators import clustering as CL
from helixframe.operators import corpus as C
from helixframe.operators import ledger as L
from helixframe.operators import links as K
from helixframe.operators import metrics as M
from helixframe.operators import negatives as N
from helixframe.operators import pairs as TR
from helixframe.operators import probes as PR
from helixframe.operators import sampling as S
from helixframe.operators import vectormath as V
from helixframe.plans.common import DMS, PF, TDP, T, dms, pf, tdp
from helixframe.plans.corpus_queries import _LINKS, _links
from helixframe.plans.evaluation_queries import _COS, _E, _KNN, _NN, _TT, emb
from helixframe.plans.ledger_queries import _ID, _LED, METRICS, _latest, led

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("SELECT p_partkey AS id, p_name AS label FROM part")
def prj2_select_alias(s, d):
    return T(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))


@query(f"WITH {PF} SELECT row_id, fam, fam AS group_id FROM pf")
def prj3_group_from_family(s, d):
    return pf(s, d).select("row_id", "fam", F.col("fam").alias("group_id"))


@query("SELECT s_suppkey, CAST(NULL AS DOUBLE) AS plddt, CAST(NULL AS VARCHAR) AS stage FROM supplier")
def prj8_typed_nulls(s, d):
    t = T(s, d, "supplier").select("s_suppkey")
    return t.select("*", F.lit(None).cast("double").alias("plddt"), F.lit(None).cast("string").alias("stage"))


@query("SELECT p_name, p_size FROM part")
def prj12_known_columns(s, d):
    t = T(s, d, "part")
    return t.select(*[c for c in ("p_name", "p_weight", "p_size") if c in t.columns])


_CLU = "c AS (SELECT p1, p2, score, x.p_brand AS clu1, y.p_brand AS clu2 FROM links JOIN part x ON x.p_partkey = p1 JOIN part y ON y.p_partkey = p2)"


@query(f"WITH {_LINKS}, {_CLU} SELECT p1, p2, score FROM c WHERE clu1 <> clu2")
def flt5_between_clusters(s, d):
    parts = T(s, d, "part").select("p_partkey", "p_brand")
    return K.cluster_links(_links(s, d), parts, "p1", "p2", "p_partkey", "p_brand").select("p1", "p2", "score")


@query(f"WITH {_LINKS}, {_CLU} SELECT clu1, clu2, count(*) AS n, sum(score) AS score FROM c WHERE clu1 <> clu2 GROUP BY 1, 2")
def jn4_both_ends(s, d):
    parts = T(s, d, "part").select("p_partkey", "p_brand")
    return K.cluster_links(_links(s, d), parts, "p1", "p2", "p_partkey", "p_brand").groupBy("clu1", "clu2").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))


@query("SELECT event_id FROM events WHERE user_id % 3 = 1 AND value > 10")
def flt10_row_mask(s, d):
    mask = (F.col("user_id") % 3 == 1) & (F.col("value") > 10)
    return T(s, d, "events").withColumn("_mask", mask).where("_mask").select("event_id")


@query(f"WITH {TDP} SELECT row_id, score FROM tdp WHERE score IS NOT NULL")
def flt15_scored_rows(s, d):
    return tdp(s, d).where(F.col("score").isNotNull()).select("row_id", "score")


@query(f"WITH {TDP} SELECT a.row_id FROM tdp a WHERE NOT EXISTS (SELECT 1 FROM tdp b WHERE b.score > 1 AND a.dms_id = b.dms_id AND a.mutant = b.mutant)")
def jn7_composite_anti(s, d):
    flagged = tdp(s, d).withColumn("is_test", F.coalesce(F.col("score") > 1, F.lit(False)))
    return A.drop_test_sequences(flagged, "dms_id", "mutant").select("row_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderpriority END AS v FROM orders")
def jn9_patch_union(s, d):
    t = T(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("v"))
    return N.patch_missing(t, t.where("v is null").select("o_orderkey", F.lit("new").alias("v")), "o_orderkey", "v")


@query("SELECT n_name, n FROM nation JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON n_nationkey = c_nationkey")
def jn10_counts_to_dimension(s, d):
    n = T(s, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return n.join(T(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def jn11_in_list(s, d):
    ids = T(s, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return K.keep_ids(T(s, d, "customer"), ids, "c_nationkey").select("c_custkey")


_SIDES = f"{_LED}, {_latest()}, k AS (SELECT {_ID}, count_if(Model = 'm0') AS a, count_if(Model = 'm1') AS b FROM t WHERE Model IN ('m0', 'm1') GROUP BY {_ID})"


def _sides(s, d):
    x = L.latest(led(s, d), ["Model"])
    return x.where("Model = 'm0'"), x.where("Model = 'm1'")


@query(f"WITH {_SIDES} SELECT {_ID}, a > 0 AS in_a, b > 0 AS in_b FROM k")
def jn15_key_union(s, d):
    a, b = _sides(s, d)
    both = a.select(*L.IDENTITY, F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(*L.IDENTITY, F.lit(0), F.lit(1)))
    return both.groupBy(*L.IDENTITY).agg((F.sum("a") > 0).alias("in_a"), (F.sum("b") > 0).alias("in_b"))


@query(f"WITH {_SIDES} SELECT {_ID} FROM k WHERE a > 0 AND b > 0")
def jn16_key_intersection(s, d):
    a, b = _sides(s, d)
    return a.select(*L.IDENTITY).intersect(b.select(*L.IDENTITY))


@query(f"WITH {_LED}, {_latest()} SELECT s.Model, s.Task, s.Probe, s.EvalSplit, s.ord AS stage_ord, b.ord AS baseline_ord FROM t s JOIN t b ON b.Model = 'm0' AND s.Model <> 'm0' AND s.Task = b.Task AND s.Probe = b.Probe AND s.EvalSplit = b.EvalSplit")
def jn17_stage_to_baseline(s, d):
    x = L.latest(led(s, d), ["Model"])
    b = x.where("Model = 'm0'").select(F.col("Task").alias("t2"), F.col("Probe").alias("p2"), F.col("EvalSplit").alias("e2"), F.col("ord").alias("baseline_ord"))
    j = x.where("Model <> 'm0'").join(b, (F.col("Task") == F.col("t2")) & (F.col("Probe") == F.col("p2")) & (F.col("EvalSplit") == F.col("e2")))
    return j.select("Model", "Task", "Probe", "EvalSplit", F.col("ord").alias("stage_ord"), "baseline_ord")


@query(f"WITH {_E}, {_TT}, {_KNN.replace('tr.label AS l', 'tr.id AS o')} SELECT q AS query_id, o AS other_id, CAST(r AS INTEGER) AS rank FROM k WHERE r <= 3")
def jn20_train_neighbours(s, d):
    e = emb(s, d)
    return V.block_neighbours(e.where("id % 5 = 0"), e.where("id % 5 > 0"), 3, metric="euclidean").select("query_id", "other_id", "rank")


_GROUP = "CASE problem_type WHEN 'binary' THEN 'Binary' WHEN 'multiclass' THEN 'Multiclass' WHEN 'multilabel' THEN 'Multilabel' WHEN 'regression' THEN 'Regression' WHEN 'retrieval' THEN 'Retrieval' ELSE 'Other' END"


@query(f"SELECT name AS \"Task\", {_GROUP} AS \"Group\" FROM task_config UNION ALL SELECT 'unlisted', 'Other'")
def jn22_task_groups(s, d):
    t = T(s, d, "task_config")
    names = t.select(F.col("name").alias("Task")).union(s.createDataFrame([("unlisted",)], "Task string"))
    return L.with_groups(names, t).select("Task", "Group")


@query(f"WITH {PF} SELECT count(*) AS n, count(DISTINCT group_id) AS groups FROM pf")
def agg2_count_and_distinct(s, d):
    return pf(s, d).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("group_id").alias("groups"))


@query(f"WITH {PF} SELECT clan_id, count(DISTINCT fam) AS families FROM pf GROUP BY 1")
def agg3_distinct_per_group(s, d):
    return pf(s, d).groupBy("clan_id", "fam").agg(F.lit(1)).groupBy("clan_id").agg(F.count("fam").alias("families"))


@query(f"WITH {PF} SELECT fam, median(length(seq)) AS median_length, count(*) AS n FROM pf GROUP BY 1")
def agg5_median_and_count(s, d):
    return pf(s, d).groupBy("fam").agg(F.median(F.length("seq")).alias("median_length"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {PF} SELECT fam, count(*) AS n FROM pf WHERE fam IS NOT NULL AND seq <> '' GROUP BY 1")
def agg8_label_counts(s, d):
    return pf(s, d).where("fam is not null and seq <> ''").groupBy("fam").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(printf('%.5f', avg(CASE WHEN NOT isnan(disorder_mean) THEN disorder_mean END)), 'N/A') AS disorder_mean_mean, 'N/A' AS never_mean FROM dataset_info")
def agg9_mean_text(s, d):
    return L.metric_means(T(s, d, "dataset_info").select("disorder_mean", F.lit(None).cast("double").alias("never")), ["disorder_mean", "never"])


@query("SELECT n_nationkey, round(avg(s_acctbal), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_pop(s_acctbal) ELSE 0 END, 6) AS std FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def agg10_population_std(s, d):
    t = T(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey"))
    return t.agg(F.round(F.avg("s_acctbal"), 6).alias("mean"), F.round(F.coalesce(F.stddev_pop("s_acctbal"), F.lit(0.0)), 6).alias("std"))


def _deltas(s, d):
    """A table of relative changes: experiment, the six identity columns and RelativeDeltaPct."""
    o = T(s, d, "orders")
    k = F.col("o_custkey")
    keys = [F.lit(v).alias(c) for c, v in L.DEFAULTS.items() if c != "Task"]
    return o.groupBy((k % 5).cast("string").alias("e"), (k % 40).cast("string").alias("Task")).agg(F.round(F.avg("o_totalprice") / 1000 - 150, 6).alias("RelativeDeltaPct")).select("e", "Task", *keys, "RelativeDeltaPct")


_DELTAS = "x AS (SELECT CAST(o_custkey % 5 AS VARCHAR) AS e, CAST(o_custkey % 40 AS VARCHAR) AS Task, round(avg(o_totalprice) / 1000 - 150, 6) AS v FROM orders GROUP BY 1, 2)"


@query(f"WITH {_DELTAS}, w AS (SELECT e, count(*) AS wins FROM (SELECT e, row_number() OVER (PARTITION BY Task ORDER BY v DESC, e) AS r FROM x) WHERE r = 1 GROUP BY 1) SELECT e, round(avg(v), 5) AS mean_delta, round(median(v), 5) AS median_delta, round(stddev_pop(v), 5) AS std_delta, count(*) AS tasks, max(coalesce(wins, 0)) AS wins FROM x LEFT JOIN w USING (e) GROUP BY 1")
def agg11_summary(s, d):
    r = L.experiment_summary(_deltas(s, d), "e")
    return r.select("e", *[F.round(c, 5).alias(c) for c in ("mean_delta", "median_delta", "std_delta")], "tasks", "wins")


@query(f"WITH {_DELTAS} SELECT e, count(*) AS wins FROM (SELECT e, row_number() OVER (PARTITION BY Task ORDER BY v DESC, e) AS r FROM x) WHERE r = 1 GROUP BY 1")
def agg12_winners(s, d):
    best = _deltas(s, d).groupBy("Task").agg(F.min(F.struct((-F.col("RelativeDeltaPct")).alias("a"), F.col("e"))).alias("b"))
    return best.groupBy(F.col("b.e").alias("e")).agg(F.count(F.lit(1)).alias("wins"))


@query(f"WITH {_DELTAS} SELECT CASE WHEN Task LIKE '%0' THEN 'Binary' WHEN Task LIKE '%1' THEN 'Retrieval' ELSE 'Other' END AS \"Group\", round(avg(v), 5) AS mean_delta, round(median(v), 5) AS median_delta, count(*) AS tasks FROM x GROUP BY 1")
def agg13_group_summary(s, d):
    x = _deltas(s, d)
    t = x.select(F.col("Task").alias("name")).distinct().withColumn("problem_type", F.when(F.col("name").endswith("0"), "binary").when(F.col("name").endswith("1"), "retrieval").otherwise("odd"))
    r = L.group_summary(L.with_groups(x, t))
    return r.select("Group", F.round("mean_delta", 5).alias("mean_delta"), F.round("median_delta", 5).alias("median_delta"), "tasks")


@query(f"WITH {_DELTAS} SELECT Task, " + ", ".join(f"round(coalesce(avg(CASE WHEN e = '{i}' THEN v END), 0), 6) AS \"{i}\"" for i in range(5)) + " FROM x GROUP BY 1")
def agg16_pivot(s, d):
    names = [str(i) for i in range(5)]
    p = L.pivot_mean(_deltas(s, d), "Task", "e", "RelativeDeltaPct", names)
    return p.select("Task", *[F.round(f"`{c}`", 6).alias(c) for c in names])


@query(f"WITH {TDP}, g AS (SELECT dms_id, avg(score) AS metric FROM tdp GROUP BY 1) SELECT round(avg(metric), 6) AS macro_mean, count(metric) AS groups FROM g")
def agg18_macro_mean(s, d):
    m = PR.macro(tdp(s, d).groupBy("dms_id").agg(F.avg("score").alias("metric")))
    return m.select(F.round("macro_mean", 6).alias("macro_mean"), "groups")


@query("""WITH p AS (SELECT o_custkey % 4 AS trial, (o_orderkey % 19 - 9) / 1000.0 AS delta, (o_orderkey % 19 - 9) / 10.0 AS pct FROM orders) SELECT CAST(trial AS VARCHAR) AS trial, round(avg(pct), 5) AS mean_pct, round(median(pct), 5) AS median_pct, round(stddev_pop(pct), 5) AS std_pct,
count_if(delta > 0.001) AS wins, count_if(delta < -0.001) AS losses, count(*) AS n_tasks FROM p GROUP BY 1""")
def agg19_trial_scores(s, d):
    step = F.pmod(F.col("o_orderkey"), F.lit(19)) - 9
    p = T(s, d, "orders").select((F.col("o_custkey") % 4).cast("string").alias("trial"), (step / 1000).alias("delta"), (step / 10).alias("pct_delta"))
    r = L.trial_score(p, "trial")
    return r.select("trial", *[F.round(c, 5).alias(c) for c in ("mean_pct", "median_pct", "std_pct")], "wins", "losses", "n_tasks")


@query(f"WITH {PF} SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY clan_id ORDER BY {sql_hash(13, 'clan_id', 'row_id')}, row_id) AS r FROM pf WHERE clan_id IS NOT NULL) WHERE r <= 12")
def win4_label_cap(s, d):
    return S.sample_per_group(pf(s, d).where("clan_id is not null").select("row_id", "clan_id"), ["clan_id"], 12, 13, "row_id").select("row_id")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def win6_last_by_date(s, d):
    t = T(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return L.keep_last(t, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def win7_last_appended(s, d):
    return L.keep_last(T(s, d, "events").select("user_id", "event_id"), ["user_id"], [F.col("event_id")])


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS rank FROM part QUALIFY row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) <= 20")
def win10_leaderboard(s, d):
    return L.leaderboard(T(s, d, "part").select("p_partkey", "p_retailprice"), "p_partkey", "p_retailprice", 20).select("p_partkey", "rank")


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE event_type <> 'click' GROUP BY 1")
def win11_last_match(s, d):
    return L.last_success(T(s, d, "events"), "user_id", "event_id", F.col("event_type") != "click", "value")


@query(f"WITH {_E}, {_NN} SELECT q AS query_id, min(CASE WHEN lq = lo THEN CAST(r AS INTEGER) END) AS first_same FROM n WHERE r <= 10 GROUP BY 1")
def win12_neighbour_rank(s, d):
    e = emb(s, d)
    n = V.block_neighbours(e, e, 10)
    own, other = e.select(F.col("id").alias("a"), F.col("label").alias("la")), e.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    j = n.join(own, F.col("query_id") == F.col("a")).join(other, F.col("other_id") == F.col("b"))
    return j.groupBy("query_id").agg(F.min(F.when(F.col("la") == F.col("lb"), F.col("rank"))).alias("first_same"))


@query("SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY round(value, 0)) + (count(*) OVER (PARTITION BY event_type, round(value, 0)) - 1) / 2.0 AS place FROM events WHERE value IS NOT NULL")
def win13_average_ranks(s, d):
    e = T(s, d, "events").where("value is not null").select("event_id", "event_type", F.round("value", 0).alias("v"))
    return M.average_ranks(e, "v", ["event_type"], "place").select("event_id", "place")


@query("SELECT row_id FROM dms_cosent ORDER BY row_id LIMIT 25")
def srt4_head_cap(s, d):
    return TR.scored_pairs(T(s, d, "dms_cosent"), "row_id", 25).select("row_id")


@query(f"WITH {_DELTAS} SELECT * FROM (SELECT 'gain' AS side, Task, e, v FROM x ORDER BY v DESC, Task, e LIMIT 3) UNION ALL SELECT * FROM (SELECT 'loss', Task, e, v FROM x ORDER BY v, Task, e LIMIT 3)")
def srt5_top_and_bottom(s, d):
    x = _deltas(s, d).select("Task", "e", F.col("RelativeDeltaPct").alias("v"))
    gain = x.orderBy(F.desc("v"), "Task", "e").limit(3).select(F.lit("gain").alias("side"), "Task", "e", "v")
    return gain.union(x.orderBy("v", "Task", "e").limit(3).select(F.lit("loss"), "Task", "e", "v"))


@query("SELECT dataset, arg_max(row_id, (loaded_at, row_id)) AS row_id FROM dataset_info WHERE loaded_at IS NOT NULL GROUP BY 1")
def srt6_latest_loaded(s, d):
    return T(s, d, "dataset_info").where("loaded_at is not null").groupBy("dataset").agg(F.max_by("row_id", F.struct("loaded_at", "row_id")).alias("row_id"))


@query("SELECT dataset, row_number() OVER (ORDER BY dataset) - 1 AS place FROM (SELECT DISTINCT dataset FROM dataset_info WHERE dataset IS NOT NULL)")
def srt7_sorted_distinct(s, d):
    return C.indexed(T(s, d, "dataset_info").where("dataset is not null").select("dataset").distinct(), ["dataset"], "place")


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
def set1_concat(s, d):
    n = T(s, d, "nation").select(F.col("n_name").alias("name"))
    return n.union(T(s, d, "region").select("r_name")).union(n)


@query(f"WITH {_LED} SELECT ord, Task, AUC, NULL AS F1 FROM l UNION ALL SELECT ord, Task, NULL, MSE FROM l")
def set3_ledger_concat(s, d):
    x = led(s, d)
    return x.select("ord", "Task", "AUC").unionByName(x.select("ord", "Task", F.col("MSE").alias("F1")), allowMissingColumns=True)


@query("WITH l AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS k FROM orders GROUP BY 1) SELECT o_custkey, list_filter(k, lambda x, i: list_position(k, x) = i) AS priorities FROM l")
def set6_distinct_in_order(s, d):
    k = F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"])
    return T(s, d, "orders").groupBy("o_custkey").agg(P.distinct_in_order(k).alias("priorities"))


@query("SELECT unnest(['train', 'validation', 'test', 'held']) AS wanted, unnest(['Train', 'dev', 'my_test_set', NULL]) AS found")
def smp10_named_splits(s, d):
    have = ["Train", "dev", "my_test_set"]
    return s.createDataFrame([(w, S.named_split(have, w)) for w in ("train", "validation", "test", "held")], "wanted string, found string")


@query("SELECT unnest(['sequence', 'family', 'none']) AS wanted, unnest(['sequence', 'family_id', NULL]) AS found")
def trn5_inferred_columns(s, d):
    have = T(s, d, "pfam_sorted").columns
    ask = {"sequence": ["Sequence", "seq"], "family": ["pfam", "FAMILY_ID"], "none": ["label"]}
    return s.createDataFrame([(k, C.resolve(have, v)) for k, v in ask.items()], "wanted string, found string")


@query("SELECT greatest(1, count(*) * 3 // (16 * 4)) AS steps FROM dataset_info")
def trn8_step_estimate(s, d):
    return s.createDataFrame([(TR.step_estimate(T(s, d, "dataset_info").count(), 16, 3, 4),)], "steps long")


@query("SELECT unnest([100, 0, 5]) AS cap, unnest([33, 0, 1]) AS budget")
def trn10_file_budget(s, d):
    return s.createDataFrame([(c, TR.file_budget(c, 3)) for c in (100, 0, 5)], "cap int, budget int")


@query(f"""WITH r AS (SELECT dataset, row_id, row_number() OVER (PARTITION BY dataset ORDER BY {sql_hash(42, 'row_id')}, row_id) AS pos FROM dataset_info WHERE dataset IS NOT NULL), b AS (SELECT *, CAST(floor((pos - 1) / 16.0) AS BIGINT) AS batch_id FROM r), f AS (SELECT dataset, batch_id FROM b GROUP BY 1, 2 HAVING count(*) = 16),
n AS (SELECT *, round((batch_id + 0.5) / count(*) OVER (PARTITION BY dataset), 12) AS share FROM f), t AS (SELECT dataset, batch_id, row_number() OVER (ORDER BY share, dataset, batch_id) - 1 AS turn FROM n) SELECT b.dataset, row_id, batch_id, turn FROM b JOIN t USING (dataset, batch_id)""")
def trn9_proportional(s, d):
    return TR.proportional(T(s, d, "dataset_info").select("dataset", "row_id"), "dataset", "row_id", 16)


@query(f"WITH {_E} SELECT a.id, round(-sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) ** 2))), 6) AS similarity FROM e a JOIN e b ON b.id = a.id + 2")
def vec4_negative_distance(s, d):
    a = emb(s, d)
    b = a.select((F.col("id") - 2).alias("j"), F.col("v").alias("w"))
    return a.join(b, F.col("id") == F.col("j")).select("id", F.round(V.negative_distance("v", "w"), 6).alias("similarity"))


@query(f"""WITH {_E}, {_TT}, {_KNN}, v AS (SELECT q, l, count(*) AS n FROM k WHERE r <= 3 GROUP BY 1, 2), g AS (SELECT q, l AS guess FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, l) AS x FROM v) WHERE x = 1), j AS (SELECT label AS t, guess AS p FROM g JOIN te ON q = id),
c AS (SELECT c, count_if(t = c AND p = c) AS tp, count_if(t <> c AND p = c) AS fp, count_if(t = c AND p <> c) AS fn FROM j, (SELECT DISTINCT t AS c FROM j UNION SELECT DISTINCT p FROM j) GROUP BY 1), m AS (SELECT q, avg(l) AS g FROM k WHERE r <= 3 GROUP BY 1)
SELECT 'multiclass' AS problem, 'Accuracy' AS metric, round(avg(CAST(t = p AS INTEGER)), 6) AS value FROM j UNION ALL SELECT 'multiclass', 'F1', round(avg(2.0 * tp / (2 * tp + fp + fn)), 6) FROM c UNION ALL SELECT 'regression', 'MSE', round(avg((label - g) ** 2), 6) FROM m JOIN te ON q = id""")
def prb9_by_problem_type(s, d):
    e = emb(s, d)
    train, test = e.where("id % 5 > 0"), e.where("id % 5 = 0")
    out = PR.evaluate(train, test, "multiclass").union(PR.evaluate(train, test, "regression").where("metric = 'MSE'"))
    return out.withColumn("value", F.round("value", 6))


@query(f"WITH {_LED} SELECT ord, Task, Samples, Probe, EvalMode, EvalSplit, EvalStrategy FROM f")
def led1_defaults(s, d):
    return L.with_defaults(led(s, d).select("ord", "Task", "Probe", "EvalSplit")).select("ord", *L.IDENTITY)


@query("SELECT true AS whole, false AS without_task, false AS empty")
def led22_valid_files(s, d):
    x = led(s, d)
    return s.createDataFrame([(L.valid_ledger(x), L.valid_ledger(x.drop("Task")), L.valid_ledger(x.where("ord < 0")))], "whole boolean, without_task boolean, empty boolean")


@query(f"""WITH {_DELTAS}, n AS (SELECT 'Experiment ' || e AS e, v, Task FROM x) SELECT 'gain' AS side, row_number() OVER (ORDER BY v DESC, Task, e) AS place, '- ' || e || ' / ' || Task || printf(': %+.2f%%', v) AS line FROM n QUALIFY row_number() OVER (ORDER BY v DESC, Task, e) <= 3
UNION ALL SELECT 'loss', row_number() OVER (ORDER BY v, Task, e), '- ' || e || ' / ' || Task || printf(': %+.2f%%', v) FROM n QUALIFY row_number() OVER (ORDER BY v, Task, e) <= 3""")
def led12_gains_and_losses(s, d):
    x = _deltas(s, d).withColumn("e", F.concat(F.lit("experiment_"), "e"))
    t = L.slide_text(x, L.experiment_summary(x, "e"), "e", "h").where("line like '- % / %'")
    place = F.when(F.col("n") > 8, F.col("n") - 8).otherwise(F.col("n") - 4)
    return t.select(F.when(F.col("n") > 8, "loss").otherwise("gain").alias("side"), place.cast("bigint").alias("place"), "line")


@query(f"WITH {TDP} SELECT row_id FROM tdp WHERE dms_id IS NOT NULL AND NOT starts_with(dms_id, 'A') AND NOT starts_with(dms_id, 'CA')")
def clu4_overlap_prefixes(s, d):
    return C.exclude_prefixes(tdp(s, d), "dms_id", ["A", "CA"]).select("row_id")


@query(f"WITH {_LINKS} SELECT p_partkey FROM part WHERE p_partkey IN (SELECT p1 FROM links UNION SELECT p2 FROM links)")
def clu5_endpoint_filter(s, d):
    return K.keep_ids(T(s, d, "part").select("p_partkey"), K.endpoints(_links(s, d), "p1", "p2", "p_partkey"), "p_partkey")


@query(f"WITH {DMS} SELECT row_id FROM dms a WHERE NOT EXISTS (SELECT 1 FROM dms b WHERE b.score > 0.9 AND a.s0 = b.s0 AND a.s1 = b.s1)")
def clu6_forbidden_pairs(s, d):
    t = dms(s, d)
    return A.forbid_pairs(t, t.where("score > 0.9"), ["s0", "s1"]).select("row_id")


def _broken(clusters, rows: int):
    """Faults of a clustering of so many rows: rows without or with several clusters, centres that don't hold themselves."""
    own = clusters.where("member = rep").select(F.col("rep").alias("r"))
    lost = clusters.join(own, F.col("rep") == F.col("r"), "left_anti").agg(F.count(F.lit(1)).alias("without_centre"))
    return clusters.agg((F.lit(rows) - F.count_distinct("member")).cast("bigint").alias("missing"), (F.count(F.lit(1)) - F.count_distinct("member")).alias("repeated")).crossJoin(lost)


@query("SELECT 0 AS missing, 0 AS repeated, 0 AS without_centre")
def clu1_invariants(s, d):
    t = dms(s, d).select("row_id", "s0")
    return _broken(CL.linear_clusters(t, "row_id", "s0"), t.where("s0 <> ''").count())


@query("SELECT 0 AS missing, 0 AS repeated, 0 AS without_centre")
def clu2_invariants(s, d):
    t = dms(s, d).select("row_id", "s0")
    return _broken(CL.cascaded_clusters(t, "row_id", "s0"), t.where("s0 <> ''").count())


@query(f"WITH {DMS}, b AS (SELECT DISTINCT s0 FROM dms WHERE row_id % 9 = 0 AND s0 <> ''), m AS (SELECT count(*) AS n FROM dms WHERE s0 IN (SELECT s0 FROM b) AND row_id % 9 > 0) SELECT n AS copies, 0 AS copies_kept FROM m")
def clu3_invariants(s, d):
    # Exact copies of benchmark sequences must all be gone, whatever else is.
    t = dms(s, d).where("s0 <> ''").select(F.col("row_id").cast("string").alias("id"), F.col("s0").alias("seq"))
    bench = t.where("id % 9 = 0")
    corpus = t.where("id % 9 > 0")
    copies = corpus.join(bench.select(F.col("seq").alias("b")).distinct(), F.col("seq") == F.col("b"), "left_semi")
    kept = CL.remove_benchmark(corpus, bench, "id", "seq").select(F.col("id").alias("k"))
    return copies.agg(F.count(F.lit(1)).alias("copies")).crossJoin(copies.join(kept, F.col("id") == F.col("k"), "left_semi").agg(F.count(F.lit(1)).cast("int").alias("copies_kept")))


@query(f"WITH {TDP}, n AS (SELECT dms_id, count(*) AS n FROM tdp WHERE dms_id IS NOT NULL GROUP BY 1) SELECT dms_id, least(50, n * (n - 1) // 2) AS pairs, 0 AS repeated FROM n WHERE n > 1")
def smp5_pair_counts(s, d):
    p = A.pairs_inside(tdp(s, d), "dms_id", "score", "row_id", cap=50)
    return p.groupBy("dms_id").agg(F.count(F.lit(1)).alias("pairs"), (F.count(F.lit(1)) - F.count_distinct("left_id", "right_id")).cast("int").alias("repeated"))


@query(f"WITH {PF} SELECT count(*) AS rows, count(DISTINCT coalesce(group_id, '~')) AS runs FROM pf")
def win9_runs_after_shuffle(s, d):
    # Sorted by key, every key is one run; the order inside is random.
    t = C.shuffled_within(pf(s, d).select("row_id", "group_id"), ["group_id"], "row_id").withColumn("at", F.monotonically_increasing_id())
    k = F.coalesce("group_id", F.lit("~"))
    span = t.groupBy(k.alias("k")).agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("n"))
    before = F.lag("hi").over(Window.orderBy("lo"))
    return span.withColumn("p", before).agg(F.sum("n").alias("rows"), F.count_if(F.col("p").isNull() | (F.col("p") < F.col("lo"))).alias("runs"))


@query(f"WITH {PF} SELECT count(*) AS rows, 0 AS other_length, 0 AS unchanged FROM pf WHERE fam IS NOT NULL AND seq <> ''")
def trn11_negative_invariants(s, d):
    rows = pf(s, d)
    n = N.hard_negatives(rows, N.profile_table(rows, "fam", "seq"), "row_id", "fam", "seq")
    j = n.join(rows.select(F.col("row_id").cast("string").alias("k"), "seq"), F.col("row_id").cast("string") == F.col("k"))
    return j.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.length("hard_negative") != F.length("seq")).cast("int").alias("other_length"), F.count_if(F.col("hard_negative") == F.col("seq")).cast("int").alias("unchanged"))


@query("""WITH t AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), w AS (SELECT id, v, exp(0.7 * tanh(0.5 * v[1] - 0.25 * v[2] + 0.1)) AS a, exp(0.7 * tanh(0.5 * v[5] - 0.25 * v[6] + 0.1)) AS b FROM t)
SELECT id, [round((a * v[1] + b * v[5]) / (a + b), 6), round((a * v[2] + b * v[6]) / (a + b), 6)] AS pooled FROM w""")
def vec6_small_scorer(s, d):
    import numpy as np

    e = emb(s, d).select("id", F.array(F.slice("v", 1, 2), F.slice("v", 5, 2), F.slice("v", 9, 2)).alias("t"), F.array(F.lit(1), F.lit(1), F.lit(0)).alias("m"))
    p = V.contextual_pool(e, "id", "t", "m", np.array([[0.5], [-0.25]]), np.array([0.1]), np.array([0.7]))
    return p.select("id", F.transform("pooled", lambda x: F.round(x, 6)).alias("pooled"))


@query(f"""WITH {_E}, {_TT}, m AS (SELECT avg(v[1]) AS mx, stddev_pop(v[1]) AS sx, avg(label) AS my, count(*) AS n FROM tr), b AS (SELECT sum((v[1] - mx) / sx * (label - my)) / (max(n) + 1.0) AS w FROM tr, m)
SELECT te.id AS query_id, round(my + w * (v[1] - mx) / sx, 4) AS guess FROM te, m, b""")
def prb2_ridge_one_dimension(s, d):
    # With one column the ridge solution is closed: sum(z * y) / (n + 1).
    e = emb(s, d).withColumn("v", F.slice("v", 1, 1))
    return PR.ridge(e.where("id % 5 > 0"), e.where("id % 5 = 0"), "label", 1).select("query_id", F.round("guess", 4).alias("guess"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id / 4.0 WHEN doc_id % 3 = 1 THEN CAST(doc_id AS DOUBLE) END AS target, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'x' END AS class, doc_id % 4 < 2 AS flag, [CAST(doc_id % 5 AS INTEGER), 7] AS numbers FROM documents""")
def fn_label_parsers(s, d):
    k = F.col("doc_id")
    text = F.when(k % 3 == 0, (k / 4).cast("string")).when(k % 3 == 1, F.concat(F.lit("['"), k, F.lit("', '1.5']"))).otherwise("none")
    cls = F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(".9"))).otherwise("x")
    flag = F.when(k % 4 == 0, " Yes").when(k % 4 == 1, "TRUE").when(k % 4 == 2, "off").otherwise(F.lit(None).cast("string"))
    return T(s, d, "documents").select("doc_id", P.number_or_first(text).alias("target"), P.class_label(cls).alias("class"), P.truthy(flag).alias("flag"), P.int_list(F.concat(k % 5, F.lit(" , ,7"))).alias("numbers"))
