"""Queries over a result ledger derived from the events table (LED, AGG9-19, WIN6-11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import ledger as L
from helixframe.plans.common import T

QUERIES, SQL = {}, {}
METRICS = ["AUC", "Accuracy", "Spearman", "MSE"]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def significant(c: str):
    """Eight significant digits as text: relative changes against a baseline of 0 are divided by the floor and are huge."""
    return F.format_string("%.7e", F.col(c) + F.lit(0.0))


def led(s, d):
    e = T(s, d, "events")
    u, i = F.col("user_id"), F.col("event_id")
    val = lambda m: F.round(((i * m) % 1000) / 1000, 5)
    return e.select(
        i.alias("ord"), F.concat(F.lit("m"), u % 3).alias("Model"), F.concat("event_type", F.lit("_"), u % 5).alias("Task"),
        F.when(i % 11 == 0, "bad").when(i % 7 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("Date"),
        F.when(u % 4 == 0, "knn").when(u % 4 == 1, "linear").alias("Probe"), F.when(i % 2 == 0, "test").otherwise("validation").alias("EvalSplit"), (u % 2).cast("string").alias("seed"),
        F.when(u % 5 < 2, val(37)).alias("AUC"), F.when((u % 5 == 2) & (i % 3 > 0), val(41)).alias("Accuracy"), F.when((u % 5 == 3) | (u % 5 == 2), val(43)).alias("Spearman"), F.when(u % 5 == 4, val(47)).alias("MSE"))


_LED = """l AS (SELECT event_id AS ord, 'm' || (user_id % 3) AS Model, event_type || '_' || (user_id % 5) AS Task, CASE WHEN event_id % 11 = 0 THEN 'bad' WHEN event_id % 7 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS Date,
CASE user_id % 4 WHEN 0 THEN 'knn' WHEN 1 THEN 'linear' END AS Probe, CASE WHEN event_id % 2 = 0 THEN 'test' ELSE 'validation' END AS EvalSplit, CAST(user_id % 2 AS VARCHAR) AS seed,
CASE WHEN user_id % 5 < 2 THEN round(((event_id * 37) % 1000) / 1000, 5) END AS AUC, CASE WHEN user_id % 5 = 2 AND event_id % 3 > 0 THEN round(((event_id * 41) % 1000) / 1000, 5) END AS Accuracy,
CASE WHEN user_id % 5 IN (2, 3) THEN round(((event_id * 43) % 1000) / 1000, 5) END AS Spearman, CASE WHEN user_id % 5 = 4 THEN round(((event_id * 47) % 1000) / 1000, 5) END AS MSE FROM events),
f AS (SELECT ord, Model, Task, Date, 'Full' AS Samples, coalesce(Probe, 'linear') AS Probe, 'standard' AS EvalMode, EvalSplit, 'test_split' AS EvalStrategy, seed, AUC, Accuracy, Spearman, MSE FROM l)"""
_ID = "Task, Samples, Probe, EvalMode, EvalSplit, EvalStrategy"


def _latest(extra="Model"):
    return f"t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_ID}, {extra} ORDER BY TRY_CAST(Date AS DATE) DESC NULLS FIRST, ord DESC) AS r FROM f) WHERE r = 1)"


def _long(source="t", keys=f"{_ID}, Model"):
    return " UNION ALL ".join(f"SELECT {keys}, '{m}' AS metric, {o} AS o, {m} AS value FROM {source} WHERE {m} IS NOT NULL" for o, m in enumerate(METRICS))


@query(f"WITH {_LED}, {_latest()} SELECT ord, Model, {_ID}, Date FROM t")
def led3_latest(s, d):
    return L.latest(led(s, d), ["Model"]).select("ord", "Model", *L.IDENTITY, "Date")


@query(f"WITH {_LED}, g AS (SELECT *, CASE WHEN ord % 4 = 0 THEN 1 ELSE 0 END AS gen FROM f) SELECT Model, {_ID}, seed, ord, AUC FROM (SELECT *, row_number() OVER (PARTITION BY Model, {_ID}, seed ORDER BY gen DESC, ord DESC) AS r FROM g) WHERE r = 1")
def led2_upsert(s, d):
    x = led(s, d)
    u = L.upsert(x.where("ord % 4 <> 0"), x.where("ord % 4 = 0"), ["Model", *L.IDENTITY, "seed"])
    return u.select("Model", *L.IDENTITY, "seed", "ord", "AUC")


_CMP = f"""x AS ({_long()}), c AS (SELECT a.Task, a.Samples, a.Probe, a.EvalMode, a.EvalSplit, a.EvalStrategy, a.metric, a.value AS a, b.value AS b, row_number() OVER (PARTITION BY a.Task, a.Samples, a.Probe, a.EvalMode, a.EvalSplit, a.EvalStrategy ORDER BY a.o) AS r
FROM x a JOIN x b ON a.Model = 'm0' AND b.Model = 'm1' AND a.metric = b.metric AND a.Task = b.Task AND a.Probe = b.Probe AND a.EvalSplit = b.EvalSplit), p AS (SELECT *, CASE WHEN metric = 'MSE' THEN b - a ELSE a - b END AS up FROM c WHERE r = 1)"""


@query(f"""WITH {_LED}, {_latest()}, {_CMP} SELECT {_ID}, 'compared' AS status, metric AS Metric, CASE WHEN up > 0 THEN 'm0' WHEN up < 0 THEN 'm1' ELSE 'tie' END AS Winner, round(CASE WHEN up >= 0 THEN a ELSE b END, 5) AS Best, round(CASE WHEN up >= 0 THEN b ELSE a END, 5) AS Other, round(CASE WHEN up >= 0 THEN a - b ELSE b - a END, 5) AS Delta FROM p
UNION ALL SELECT {_ID}, CASE WHEN min(Model) = 'm1' THEN 'only_b' WHEN max(Model) = 'm0' THEN 'only_a' ELSE 'no_common_metric' END, NULL, NULL, NULL, NULL, NULL FROM t WHERE Model IN ('m0', 'm1') AND (Task, Probe, EvalSplit) NOT IN (SELECT (Task, Probe, EvalSplit) FROM p) GROUP BY {_ID}""")
def led4_compare(s, d):
    x = L.latest(led(s, d), ["Model"])
    return L.compare(x.where("Model = 'm0'"), x.where("Model = 'm1'"), "m0", "m1", METRICS)


@query(f"WITH {_LED}, {_latest()}, {_CMP}, w AS (SELECT CASE WHEN up > 0 THEN 'm0' WHEN up < 0 THEN 'm1' ELSE 'tie' END AS Winner, count(*) AS n FROM p GROUP BY 1) SELECT Winner, n, round(100 * n / sum(n) OVER (), 6) AS percent FROM w")
def agg14_winner_shares(s, d):
    return L.winner_shares(led4_compare(s, d))


@query(f"WITH {_LED}, {_latest()} SELECT ord, concat_ws(' | ', Task, CASE WHEN Probe <> 'linear' THEN 'Probe=' || Probe END, CASE WHEN EvalSplit <> 'test' THEN 'EvalSplit=' || EvalSplit END) AS label FROM t")
def fn_identity_label(s, d):
    return L.latest(led(s, d), ["Model"]).select("ord", L.identity_label().alias("label"))


@query(f"WITH {_LED}, {_latest()}, {_CMP} SELECT {_ID}, metric, a AS baseline, b AS trained, printf('%.7e', CASE WHEN metric = 'MSE' THEN -1 ELSE 1 END * 100 * (b - a) / greatest(abs(a), 1e-12) + 0.0) AS delta FROM p")
def led5_relative_table(s, d):
    x = L.latest(led(s, d), ["Model"])
    r = L.relative_table(x.where("Model = 'm0'"), x.where("Model = 'm1'"), METRICS)
    return r.select(*L.IDENTITY, "metric", "baseline", "trained", significant("RelativeDeltaPct").alias("delta"))


_MS = f"""{_latest('Model, seed')}, x AS ({_long()}), g AS (SELECT {_ID}, Model, metric, o, avg(value) AS mean, coalesce(stddev_pop(value), 0) AS std, count(*) AS n FROM x GROUP BY ALL),
j AS (SELECT g.*, b.mean AS base, row_number() OVER (PARTITION BY g.Task, g.Probe, g.EvalSplit, g.Model ORDER BY g.o) AS r FROM g JOIN g b ON b.Model = 'm0' AND g.Model <> 'm0' AND b.metric = g.metric AND b.Task = g.Task AND b.Probe = g.Probe AND b.EvalSplit = g.EvalSplit),
m AS (SELECT *, CASE WHEN metric = 'MSE' THEN -1 ELSE 1 END * 100 * (mean - base) / greatest(abs(base), 1e-12) AS delta FROM j WHERE r = 1)"""


def _multi(s, d):
    return L.multi_seed_relative(L.latest(led(s, d), ["Model", "seed"]), "Model", "m0", METRICS)


@query(f"WITH {_LED}, {_MS} SELECT {_ID}, Model, metric, n, round(base, 6) AS baseline_mean, round(mean, 6) AS mean, round(std, 6) AS std, printf('%.7e', delta + 0.0) AS delta FROM m")
def led6_multi_seed(s, d):
    r = _multi(s, d)
    return r.select(*L.IDENTITY, "Model", "metric", "n", F.round("baseline_mean", 6).alias("baseline_mean"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), significant("RelativeDeltaPct").alias("delta"))


@query(f"WITH {_LED}, {_MS}, k AS (SELECT * FROM m), w AS (SELECT Model, count(*) AS wins FROM (SELECT Model, row_number() OVER (PARTITION BY {_ID} ORDER BY delta DESC, Model) AS r FROM k) WHERE r = 1 GROUP BY 1) SELECT Model, printf('%.7e', avg(delta) + 0.0) AS mean_delta, printf('%.7e', median(delta) + 0.0) AS median_delta, printf('%.7e', stddev_pop(delta) + 0.0) AS std_delta, count(*) AS tasks, count_if(delta > 0) AS improved, count_if(delta < 0) AS worse, max(coalesce(wins, 0)) AS wins FROM k LEFT JOIN w USING (Model) GROUP BY 1")
def led7_experiment_summary(s, d):
    r = L.experiment_summary(_multi(s, d), "Model")
    return r.select("Model", *[significant(c).alias(c) for c in ("mean_delta", "median_delta", "std_delta")], "tasks", "improved", "worse", "wins")


@query("SELECT Model, upper(Model[1]) || Model[2:] AS label, row_number() OVER (ORDER BY CASE Model WHEN 'm2' THEN 0 WHEN 'm1' THEN 1 ELSE 2 END, Model) AS place FROM (SELECT DISTINCT 'm' || (user_id % 3) AS Model FROM events) WHERE Model IN ('m1', 'm2')")
def led8_experiment_order(s, d):
    r = L.experiment_order(led(s, d), "Model", ["m2", "m1"])
    return r.select("Model", "label", F.col("place").cast("bigint").alias("place"))


@query(f"WITH {_LED}, {_MS} SELECT Task, round(coalesce(avg(CASE WHEN Model = 'm1' THEN mean END), 0), 6) AS m1, round(coalesce(avg(CASE WHEN Model = 'm2' THEN mean END), 0), 6) AS m2 FROM m GROUP BY 1")
def led9_task_pivot(s, d):
    p = L.pivot_mean(_multi(s, d), "Task", "Model", "mean", ["m1", "m2"])
    return p.select("Task", F.round("m1", 6).alias("m1"), F.round("m2", 6).alias("m2"))


@query(f"WITH {_LED}, {_MS}, a AS (SELECT Model, metric, avg(mean) AS v FROM m GROUP BY 1, 2), p AS (SELECT Model, " + ", ".join(f"round(max(CASE WHEN metric = '{m}' THEN v END), 6) AS {m}" for m in METRICS) + ", avg(v) AS row_mean, max(abs(v)) AS top FROM a GROUP BY 1) SELECT Model, AUC, Accuracy, Spearman, MSE, row_number() OVER (ORDER BY row_mean DESC) AS place, round(greatest(max(top) OVER (), 1), 6) AS abs_max FROM p")
def led10_heatmap(s, d):
    from pyspark.sql import Window

    p = L.pivot_mean(_multi(s, d), "Model", "metric", "mean", METRICS, fill=None)
    vals = F.filter(F.array(*METRICS), lambda x: x.isNotNull())
    p = p.withColumn("_m", F.aggregate(vals, F.lit(0.0), lambda a, x: a + x) / F.size(vals)).withColumn("_t", F.array_max(F.transform(vals, F.abs)))
    place = F.row_number().over(Window.orderBy(F.desc("_m"))).cast("bigint").alias("place")
    return p.select("Model", *[F.round(m, 6).alias(m) for m in METRICS], place, F.round(F.greatest(F.max("_t").over(Window.partitionBy()), F.lit(1.0)), 6).alias("abs_max"))


@query(f"WITH {_LED}, {_MS} SELECT CASE WHEN Task LIKE '%0' THEN 'Binary' WHEN Task LIKE '%1' THEN 'Multiclass' WHEN Task LIKE '%4' THEN 'Regression' ELSE 'Other' END AS \"Group\", printf('%.7e', avg(delta) + 0.0) AS mean_delta, printf('%.7e', median(delta) + 0.0) AS median_delta, count(*) AS tasks FROM m GROUP BY 1")
def led11_group_summary(s, d):
    t = led(s, d).select(F.col("Task").alias("name")).distinct().withColumn("problem_type", F.when(F.col("name").endswith("0"), "binary").when(F.col("name").endswith("1"), "multiclass").when(F.col("name").endswith("4"), "regression").otherwise("odd"))
    r = L.group_summary(L.with_groups(_multi(s, d), t))
    return r.select("Group", significant("mean_delta").alias("mean_delta"), significant("median_delta").alias("median_delta"), "tasks")


@query(None)
def led12_slide_text(s, d):
    m = _multi(s, d)
    return L.slide_text(m, L.experiment_summary(m, "Model"), "Model", "Ablation summary")


@query(f"WITH {_LED} SELECT Model, ord, MSE AS loss FROM l WHERE Model IN ('m1', 'm2') AND MSE IS NOT NULL ORDER BY loss, ord")
def led13_loss_summary(s, d):
    return led(s, d).where(F.col("Model").isin("m1", "m2") & F.col("MSE").isNotNull()).select("Model", "ord", F.col("MSE").alias("loss")).orderBy("loss", "ord")


_ST = f"""{_latest()}, st AS (SELECT * FROM t WHERE Model <> 'm0'), b AS (SELECT * FROM t WHERE Model = 'm0'), j AS (SELECT st.Model, st.Task, st.Probe, st.EvalSplit, """ + ", ".join(f"st.{m}, b.{m} AS baseline_{m}, st.{m} - b.{m} AS delta_{m}" for m in METRICS) + """ FROM st JOIN b ON st.Task = b.Task AND st.Probe = b.Probe AND st.EvalSplit = b.EvalSplit)"""
_NOTE = ", ".join(f"CASE WHEN delta_{m} IS NOT NULL THEN '{m} ' || CASE WHEN delta_{m} = 0 THEN 'unchanged' WHEN delta_{m} {'<' if m == 'MSE' else '>'} 0 THEN 'improved' ELSE 'worse' END || printf(' (%+.5f)', delta_{m}) END" for m in METRICS)


def _delta(s, d):
    x = L.latest(led(s, d), ["Model"])
    return L.delta_report(x.where("Model <> 'm0'"), x.where("Model = 'm0'"), "Model", ["Task", "Probe", "EvalSplit"], METRICS)


@query(f"WITH {_LED}, {_ST} SELECT Model, Task, Probe, EvalSplit, " + ", ".join(f"{m}, baseline_{m}, round(delta_{m}, 6) AS delta_{m}" for m in METRICS) + f", coalesce(nullif(concat_ws('; ', {_NOTE}), ''), 'no comparable metrics') AS \"Desc\" FROM j")
def led14_delta_report(s, d):
    r = _delta(s, d)
    return r.select(*[F.round(c, 6).alias(c) if c.startswith("delta_") else F.col(c) for c in r.columns])


@query(f"WITH {_LED}, {_ST}, x AS (" + " UNION ALL ".join(f"SELECT Model, Task, Probe, EvalSplit, '{m}' AS metric, '{'lower' if m == 'MSE' else 'higher'}_is_better' AS better_direction, baseline_{m} AS baseline_value, {m} AS stage_value, delta_{m} AS delta, CASE WHEN delta_{m} = 0 THEN 'unchanged' WHEN delta_{m} {'<' if m == 'MSE' else '>'} 0 THEN 'improved' ELSE 'worse' END AS status FROM j WHERE delta_{m} IS NOT NULL AND Model = 'm1'" for m in METRICS) + ") SELECT Task, Probe, EvalSplit, metric, better_direction, baseline_value, stage_value, round(delta, 6) AS delta, status, metric || ' ' || status || printf('; stage1=%.5f, baseline=%.5f, delta=%+.5f', stage_value, baseline_value, delta) AS \"Desc\" FROM x")
def led15_readable_report(s, d):
    x = L.latest(led(s, d), ["Model"])
    r = L.readable_report(x.where("Model = 'm1'"), x.where("Model = 'm0'"), ["Task", "Probe", "EvalSplit"], METRICS)
    return r.withColumn("delta", F.round("delta", 6))


@query(f"WITH {_LED} SELECT " + ", ".join(f"coalesce(printf('%.5f', avg({m})), 'N/A') AS {m}_mean" for m in METRICS) + ", 'N/A' AS F1_mean FROM l")
def led16_metric_means(s, d):
    return L.metric_means(led(s, d).withColumn("F1", F.lit(None).cast("double")), [*METRICS, "F1"])


@query(f"WITH {_LED} SELECT Task, ord AS batch FROM (SELECT Task, ord, row_number() OVER (PARTITION BY Task ORDER BY ord DESC) AS r FROM l WHERE ord % 5 > 0) WHERE r = 1")
def led17_last_success(s, d):
    x = led(s, d).withColumn("batch", F.col("ord"))
    return L.last_success(x, "Task", "ord", F.col("ord") % 5 > 0, "batch")


_PRIM = f"""{_ST}, p AS (SELECT Model, Task, Probe, EvalSplit, CASE WHEN delta_AUC IS NOT NULL THEN 'AUC' WHEN delta_Accuracy IS NOT NULL THEN 'Accuracy' ELSE 'Spearman' END AS metric, coalesce(delta_AUC, delta_Accuracy, delta_Spearman) AS delta, CASE WHEN delta_AUC IS NOT NULL THEN baseline_AUC WHEN delta_Accuracy IS NOT NULL THEN baseline_Accuracy ELSE baseline_Spearman END AS baseline FROM j WHERE coalesce(delta_AUC, delta_Accuracy, delta_Spearman) IS NOT NULL),
k AS (SELECT *, CASE WHEN abs(baseline) > 1e-12 THEN delta / abs(baseline) * 100 ELSE delta * 100 END AS pct FROM p)"""


def _primary(s, d):
    return L.primary_delta(_delta(s, d), ["Model", "Task", "Probe", "EvalSplit"], ("AUC", "Accuracy", "Spearman"))


@query(f"WITH {_LED}, {_PRIM} SELECT Model, Task, Probe, EvalSplit, metric, round(delta, 6) AS delta, baseline, round(pct, 4) AS pct_delta FROM k")
def led18_primary_delta(s, d):
    return _primary(s, d).withColumn("delta", F.round("delta", 6)).withColumn("pct_delta", F.round("pct_delta", 4))


_SCORE = "z AS (SELECT Model, avg(pct) AS mean_pct, median(pct) AS median_pct, coalesce(stddev_pop(pct), 0) AS std_pct, count_if(delta > 0.001) AS wins, count_if(delta < -0.001) AS losses, count(*) AS n_tasks FROM k GROUP BY 1)"


@query(f"WITH {_LED}, {_PRIM}, {_SCORE} SELECT Model, round(mean_pct, 3) AS mean_pct, round(median_pct, 3) AS median_pct, round(std_pct, 3) AS std_pct, wins, losses, n_tasks, n_tasks - wins - losses AS ties, round(mean_pct - 0.1 * std_pct, 3) AS objective FROM z")
def led19_trial_score(s, d):
    r = L.trial_score(_primary(s, d), "Model")
    return r.select(*[F.round(c, 3).alias(c) if c in ("mean_pct", "median_pct", "std_pct", "objective") else F.col(c) for c in r.columns])


@query(f"WITH {_LED}, a AS (SELECT Model, max_by(AUC, ord) AS v FROM l WHERE AUC IS NOT NULL GROUP BY 1) SELECT x.Model, round(100 * (x.v - b.v) / abs(b.v), 4) AS mean_pct FROM a x JOIN a b ON b.Model = 'm0' AND x.Model <> 'm0' WHERE abs(b.v) > 1e-12")
def led20_summary_percent(s, d):
    return L.summary_percent(led(s, d).where("AUC is not null"), "m0", "Model", "ord", METRICS).withColumn("mean_pct", F.round("mean_pct", 4))


@query(f"WITH {_LED}, g AS (SELECT Task, avg(AUC) AS v FROM l GROUP BY 1), t AS (SELECT Task, v FROM g WHERE v IS NOT NULL ORDER BY v DESC, Task LIMIT 5) SELECT Task, round(v, 6) AS v, CAST(row_number() OVER (ORDER BY v DESC, Task) AS INTEGER) AS rank FROM t")
def led21_leaderboard(s, d):
    g = led(s, d).groupBy("Task").agg(F.avg("AUC").alias("v"))
    return L.leaderboard(g, "Task", "v", 5).withColumn("v", F.round("v", 6))


@query("""SELECT count(*) AS rows, count(*) FILTER (WHERE sentence_0 IS NULL) AS null_0, count(*) FILTER (WHERE sentence_1 IS NULL) AS null_1, count(*) FILTER (WHERE score IS NULL OR isnan(score)) AS null_score, count(DISTINCT sentence_0) AS unique_0,
round(min(CASE WHEN NOT isnan(score) THEN score END), 6) AS least, round(max(CASE WHEN NOT isnan(score) THEN score END), 6) AS greatest, count(*) FILTER (WHERE score < 0 OR (score > 1 AND NOT isnan(score))) AS outside FROM dms_cosent""")
def led23_validation_report(s, d):
    t = T(s, d, "dms_cosent").withColumn("v", F.when(~F.isnan("score"), F.col("score")))
    return t.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("sentence_0").isNull()).alias("null_0"), F.count_if(F.col("sentence_1").isNull()).alias("null_1"), F.count_if(F.col("v").isNull()).alias("null_score"), F.count_distinct("sentence_0").alias("unique_0"),
                 F.round(F.min("v"), 6).alias("least"), F.round(F.max("v"), 6).alias("greatest"), F.count_if((F.col("v") < 0) | (F.col("v") > 1)).alias("outside"))
