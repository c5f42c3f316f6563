"""Ledger of evaluation results: defaults, latest rows, upserts, comparisons and reports.

A ledger row names a task and how it was run (the identity) and has sparse metric columns; inside this module rows are
turned to the long form (identity, metric, value). Reports are small by nature, one row a task, run and metric.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.portable import finite, title

# Identity columns with their defaults, metrics in order of preference, task groups.
IDENTITY = ("Task", "Samples", "Probe", "EvalMode", "EvalSplit", "EvalStrategy")
DEFAULTS = {"Samples": "Full", "Probe": "linear", "EvalMode": "standard", "EvalSplit": "test", "EvalStrategy": "test_split"}
METRICS = ("AUC", "F1_Macro", "F1_Weighted", "F1", "AP", "Accuracy", "Spearman", "MSE", "Recall@10", "Recall@1", "Recall@30", "F1_Micro")
SEARCH_METRICS = ("AUC", "Accuracy", "Spearman", "F1")
LOWER_IS_BETTER = ("MSE",)
GROUPS = {"binary": "Binary", "multiclass": "Multiclass", "multilabel": "Multilabel", "regression": "Regression", "retrieval": "Retrieval"}
GROUP_ORDER = ("Binary", "Multiclass", "Multilabel", "Regression", "Retrieval", "Other")
EXPERIMENT_ORDER = ("baseline", "mlm_only", "jepa_masked_l1", "jepa_all_position", "jepa_global_pool", "jepa_cls", "jepa_hybrid")
EPSILON = 1e-12


# Display names of experiments that are not the capitalised name.
EXPERIMENT_NAMES = {
    "baseline": "Baseline",
    "mlm_only": "MLM Only",
    "jepa_masked_l1": "JEPA Masked L1",
    "jepa_all_position": "JEPA All Position",
    "jepa_global_pool": "JEPA Global Pool",
    "jepa_cls": "JEPA CLS",
    "jepa_hybrid": "JEPA Hybrid",
}


def display_name(c: str) -> Column:
    """LED8: the fixed display name of an experiment, else its name capitalised."""
    return reduce(lambda acc, kv: F.when(F.col(c) == kv[0], F.lit(kv[1])).otherwise(acc), EXPERIMENT_NAMES.items(), title(c))


def q(c: str) -> Column:
    return F.col(f"`{c}`")


def ranked(c: Column, order: tuple[str, ...] | list[str]) -> Column:
    """Place in a fixed order; unknown values after all known."""
    return reduce(lambda acc, iv: F.when(c == iv[1], F.lit(iv[0])).otherwise(acc), reversed(list(enumerate(order))), F.lit(len(order)))


def with_defaults(df: DataFrame, defaults: dict[str, str] = DEFAULTS) -> DataFrame:
    """PRJ6 / LED1: identity columns as text, missing ones added, nulls and blanks filled."""
    return df.withColumns({c: F.coalesce(F.when(F.trim(q(c).cast("string")) != "", q(c).cast("string")), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """WIN6 / WIN7: of rows of equal keys the last by ``order``; an aggregate, so no key's rows meet in a sort."""
    row = F.struct(*[q(c) for c in df.columns])
    picked = df.groupBy(*[q(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return picked.select("_row.*")


def latest(df: DataFrame, extra: list[str] | None = None, date: str = "Date", order: str = "ord") -> DataFrame:
    """LED3: defaults filled and the latest row of each identity (and extra columns).

    Dates are texts; one that can't be read counts as the most recent. Equal dates: later in append order wins.
    """
    d = F.try_to_timestamp(F.col(date), F.lit("yyyy-MM-dd"))
    return keep_last(with_defaults(df), [*IDENTITY, *(extra or [])], [d.isNull().cast("int"), F.coalesce(d, F.lit("1970-01-01").cast("timestamp")), F.col(order)])


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    """SNK3: floating columns rounded."""
    return df.select(*[F.round(q(c), digits).alias(c) if t in ("double", "float") else q(c) for c, t in df.dtypes])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """LED2 / SNK5: both ledgers under the union of their columns, the new row replacing the old of the same key."""
    both = with_defaults(old).withColumn("_gen", F.lit(0)).unionByName(with_defaults(new).withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    return rounded(keep_last(both, keys, [F.col("_gen"), F.col(order)]).drop("_gen"))


def present(df: DataFrame, metrics: tuple[str, ...] = METRICS) -> list[str]:
    return [m for m in metrics if m in df.columns]


def long_form(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Unpivot: keys, metric, value; unusable values are dropped."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), q(m).try_cast("double").alias("value") if dict(df.dtypes)[m] == "string" else q(m).cast("double").alias("value")) for m in metrics])
    return df.select(*[q(k) for k in keys], F.explode(pairs).alias("_x")).select(*[q(k) for k in keys], "_x.*").where(finite("value"))


def better(metric: Column, value: Column) -> Column:
    """The value turned so that more is better."""
    return F.when(metric.isin(*LOWER_IS_BETTER), -value).otherwise(value)


def relative_percent(metric: Column, base: Column, value: Column) -> Column:
    """Change in percent of the base, positive when better."""
    d = 100 * (value - base) / F.greatest(F.abs(base), F.lit(EPSILON))
    return F.when(metric.isin(*LOWER_IS_BETTER), -d).otherwise(d)


def status(metric: Column, delta: Column) -> Column:
    up = better(metric, delta)
    return F.when(delta == 0, "unchanged").when(up > 0, "improved").otherwise("worse")


def first_common(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """JN15 / JN16: for each key on both sides the first metric with a usable value on both: keys, metric, a, b."""
    x = long_form(a, keys, metrics).select(*[q(k).alias(f"_x{i}") for i, k in enumerate(keys)], F.col("metric"), F.col("value").alias("a"))
    y = long_form(b, keys, metrics).select(*[q(k).alias(f"_y{i}") for i, k in enumerate(keys)], F.col("metric").alias("_m"), F.col("value").alias("b"))
    on = F.col("metric") == F.col("_m")
    for i in range(len(keys)):
        on = on & F.col(f"_x{i}").eqNullSafe(F.col(f"_y{i}"))
    j = x.join(y, on)
    pick = F.min(F.struct(ranked(F.col("metric"), metrics).alias("_o"), "metric", "a", "b")).alias("_p")
    out = j.groupBy(*[f"_x{i}" for i in range(len(keys))]).agg(pick)
    return out.select(*[F.col(f"_x{i}").alias(k) for i, k in enumerate(keys)], "_p.metric", "_p.a", "_p.b")


def compare(a: DataFrame, b: DataFrame, name_a: str, name_b: str, metrics: list[str], digits: int = 5) -> DataFrame:
    """LED4: identity, status, Metric, Winner, Best, Other, Delta for two latest ledgers.

    status: ``compared``, ``only_a``, ``only_b`` or ``no_common_metric``. Winner by the turned value, ``tie`` when
    equal; Delta = Best - Other in raw units, so negative where less is better.
    """
    keys = list(IDENTITY)
    c = first_common(a, b, keys, metrics)
    up = better(F.col("metric"), F.col("a")) - better(F.col("metric"), F.col("b"))
    best, other = F.when(up >= 0, F.col("a")).otherwise(F.col("b")), F.when(up >= 0, F.col("b")).otherwise(F.col("a"))
    done = c.select(*keys, F.lit("compared").alias("status"), F.col("metric").alias("Metric"), F.when(up > 0, name_a).when(up < 0, name_b).otherwise("tie").alias("Winner"),
                    F.round(best, digits).alias("Best"), F.round(other, digits).alias("Other"), F.round(best - other, digits).alias("Delta"))
    ka = a.select(*keys).distinct().withColumn("_a", F.lit(1))
    kb = b.select(*[q(k).alias(f"_y{i}") for i, k in enumerate(keys)]).distinct().withColumn("_b", F.lit(1))
    kc = c.select(*[q(k).alias(f"_z{i}") for i, k in enumerate(keys)]).withColumn("_c", F.lit(1))
    on = reduce(lambda x, y: x & y, [q(k) == F.col(f"_y{i}") for i, k in enumerate(keys)])
    full = ka.join(kb, on, "full_outer").select(*[F.coalesce(q(k), F.col(f"_y{i}")).alias(k) for i, k in enumerate(keys)], "_a", "_b")
    on = reduce(lambda x, y: x & y, [q(k) == F.col(f"_z{i}") for i, k in enumerate(keys)])
    rest = full.join(kc, on, "left_anti")
    st = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("no_common_metric")
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    return done.union(rest.select(*keys, st.alias("status"), none("string", "Metric"), none("string", "Winner"), none("double", "Best"), none("double", "Other"), none("double", "Delta")))


def winner_shares(compared: DataFrame) -> DataFrame:
    """AGG14: tasks won by each side and their percentage."""
    c = compared.where("status = 'compared'").groupBy("Winner").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def identity_label(defaults: dict[str, str] = DEFAULTS) -> Column:
    """Text of an identity without its default parts, joined by ' | '."""
    return F.concat_ws(" | ", F.col("Task"), *[F.when(F.col(c) != v, F.concat(F.lit(f"{c}="), F.col(c))) for c, v in defaults.items()])


def with_groups(df: DataFrame, tasks: DataFrame, task: str = "Task") -> DataFrame:
    """JN22: task group by the task table (name, problem_type); unknown tasks are Other."""
    g = reduce(lambda acc, kv: F.when(F.col("problem_type") == kv[0], kv[1]).otherwise(acc), GROUPS.items(), F.lit("Other"))
    t = tasks.select(F.col("name").alias("_t"), g.alias("_g")).dropDuplicates(["_t"])
    return df.join(t, F.col(task) == F.col("_t"), "left").withColumn("Group", F.coalesce("_g", F.lit("Other"))).drop("_t", "_g")


def relative_table(base: DataFrame, trained: DataFrame, metrics: list[str]) -> DataFrame:
    """LED5: identity, metric, baseline, trained, RelativeDeltaPct, for keys on both sides."""
    c = first_common(base, trained, list(IDENTITY), metrics)
    return c.select(*IDENTITY, "metric", F.col("a").alias("baseline"), F.col("b").alias("trained"), relative_percent(F.col("metric"), F.col("a"), F.col("b")).alias("RelativeDeltaPct"))


def multi_seed_relative(df: DataFrame, experiment: str, baseline: str, metrics: list[str], include_baseline: bool = False) -> DataFrame:
    """LED6 / AGG10: experiments against the baseline over seeds.

    Output: Task identity, experiment, metric, baseline_mean, mean, std (population, 0 for one value), n, RelativeDeltaPct.
    The metric of a pair is the first with a value on both sides.
    """
    keys = list(IDENTITY)
    s = long_form(df, [*keys, experiment], metrics).groupBy(*keys, experiment, "metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("n"))
    b = s.where(F.col(experiment) == baseline).select(*[q(k).alias(f"_y{i}") for i, k in enumerate(keys)], F.col("metric").alias("_m"), F.col("mean").alias("baseline_mean"))
    on = reduce(lambda x, y: x & y, [q(k) == F.col(f"_y{i}") for i, k in enumerate(keys)]) & (F.col("metric") == F.col("_m"))
    j = (s if include_baseline else s.where(F.col(experiment) != baseline)).join(b, on)
    pick = F.min(F.struct(ranked(F.col("metric"), metrics).alias("_o"), "metric", "baseline_mean", "mean", "std", "n")).alias("_p")
    p = j.groupBy(*keys, experiment).agg(pick).select(*keys, experiment, "_p.metric", "_p.baseline_mean", "_p.mean", "_p.std", "_p.n")
    return p.withColumn("RelativeDeltaPct", relative_percent(F.col("metric"), F.col("baseline_mean"), F.col("mean")))


def experiment_summary(tasks: DataFrame, experiment: str) -> DataFrame:
    """LED7 / AGG11 / AGG12: mean, median, deviation, tasks, improved, worse and tasks won by each experiment.

    A task is won by the experiment of largest delta; ties go to the first name.
    """
    r = F.col("RelativeDeltaPct")
    a = tasks.groupBy(experiment).agg(
        F.avg(r).alias("mean_delta"), F.median(r).alias("median_delta"), F.coalesce(F.stddev_pop(r), F.lit(0.0)).alias("std_delta"), F.count(r).alias("tasks"), F.count_if(r > 0).alias("improved"), F.count_if(r < 0).alias("worse"))
    w = tasks.groupBy(*IDENTITY).agg(F.min(F.struct((-r).alias("_d"), F.col(experiment).alias("_e"))).alias("_w")).groupBy(F.col("_w._e").alias("_e")).agg(F.count(F.lit(1)).alias("wins"))
    return a.join(w, F.col(experiment) == F.col("_e"), "left").withColumn("wins", F.coalesce("wins", F.lit(0))).drop("_e")


def experiment_order(df: DataFrame, experiment: str, explicit: list[str] | None = None, baseline: str | None = None) -> DataFrame:
    """LED8: experiments with their place: the explicit list, else the usual order and then names; baseline left out when given."""
    names = df.select(experiment).where(F.col(experiment).isNotNull()).distinct()
    if explicit:
        names = names.where(F.col(experiment).isin(*explicit))
    if baseline:
        names = names.where(F.col(experiment) != baseline)
    w = Window.orderBy(ranked(F.col(experiment), tuple(explicit or EXPERIMENT_ORDER)), experiment)
    return names.select(experiment, display_name(experiment).alias("label"), F.row_number().over(w).alias("place"))


def pivot_mean(df: DataFrame, row: str, column: str, value: str, names: list[str], fill: float | None = 0.0) -> DataFrame:
    """LED9 / AGG16: mean by row and column for a stated list of columns; missing cells filled."""
    p = df.groupBy(row).pivot(column, names).agg(F.avg(value))
    return p if fill is None else p.na.fill(fill)


def group_summary(df: DataFrame) -> DataFrame:
    """LED11 / AGG13: mean and median change and tasks by group."""
    return df.groupBy("Group").agg(F.avg("RelativeDeltaPct").alias("mean_delta"), F.median("RelativeDeltaPct").alias("median_delta"), F.count(F.lit(1)).alias("tasks"))


def metric_means(df: DataFrame, metrics: list[str]) -> DataFrame:
    """LED16 / AGG9: mean of each metric over its usable values as text with five decimals, N/A without any."""
    one = df.agg(*[F.avg(F.when(finite(q(m)), q(m))).alias(m) for m in metrics])
    return one.select(*[F.when(q(m).isNull(), "N/A").otherwise(F.format_string("%.5f", q(m))).alias(f"{m}_mean") for m in metrics])


def last_success(df: DataFrame, key: str, order: str, ok: Column, value: str) -> DataFrame:
    """LED17 / WIN11: value of the last successful row of each key."""
    return df.where(ok).groupBy(key).agg(F.max_by(value, order).alias(value))


def delta_report(stages: DataFrame, baseline: DataFrame, stage: str, keys: list[str], metrics: list[str]) -> DataFrame:
    """LED14 / JN17: stage, keys, for each metric its value, baseline and delta, and a text of all changes."""
    b = baseline.select(*[q(k).alias(f"_y{i}") for i, k in enumerate(keys)], *[q(m).alias(f"baseline_{m}") for m in metrics])
    on = reduce(lambda x, y: x & y, [q(k) == F.col(f"_y{i}") for i, k in enumerate(keys)])
    j = stages.join(b, on)
    for m in metrics:
        j = j.withColumn(f"delta_{m}", q(m) - q(f"baseline_{m}"))
    note = lambda m: F.when(finite(q(f"delta_{m}")), F.format_string(f"{m} %s (%+.5f)", status(F.lit(m), q(f"delta_{m}")), q(f"delta_{m}")))
    text = F.array_join(F.filter(F.array(*[note(m) for m in metrics]), lambda x: x.isNotNull()), "; ")
    cols = [c for m in metrics for c in (m, f"baseline_{m}", f"delta_{m}")]
    return j.select(stage, *keys, *[q(c) for c in cols], F.when(text == "", "no comparable metrics").otherwise(text).alias("Desc"))


def readable_report(stage: DataFrame, baseline: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """LED15: one row a key and metric with values on both sides, direction, status and text."""
    x = long_form(stage, keys, metrics).withColumnRenamed("value", "stage_value")
    y = long_form(baseline, keys, metrics).select(*[q(k).alias(f"_y{i}") for i, k in enumerate(keys)], F.col("metric").alias("_m"), F.col("value").alias("baseline_value"))
    on = reduce(lambda a, b: a & b, [q(k) == F.col(f"_y{i}") for i, k in enumerate(keys)]) & (F.col("metric") == F.col("_m"))
    d = F.col("stage_value") - F.col("baseline_value")
    j = x.join(y, on).withColumn("delta", d).withColumn("status", status(F.col("metric"), F.col("delta")))
    text = F.format_string("%s %s; stage1=%.5f, baseline=%.5f, delta=%+.5f", F.col("metric"), F.col("status"), F.col("stage_value"), F.col("baseline_value"), F.col("delta"))
    side = F.when(F.col("metric").isin(*LOWER_IS_BETTER), "lower_is_better").otherwise("higher_is_better")
    return j.select(*keys, "metric", side.alias("better_direction"), "baseline_value", "stage_value", "delta", "status", text.alias("Desc"))


def primary_delta(df: DataFrame, keys: list[str], metrics: tuple[str, ...] = SEARCH_METRICS) -> DataFrame:
    """LED18: of each row the first metric with delta and baseline: keys, metric, delta, baseline, pct_delta.

    Percent of the baseline's size; where that is next to nothing, a hundred times the raw delta. Rows without go.
    """
    ok = lambda m: finite(q(f"delta_{m}")) & finite(q(f"baseline_{m}"))
    pick = F.coalesce(*[F.when(ok(m), F.struct(F.lit(m).alias("metric"), q(f"delta_{m}").alias("delta"), q(f"baseline_{m}").alias("baseline"))) for m in metrics])
    d = df.select(*[q(k) for k in keys], pick.alias("_p")).where("_p is not null").select(*keys, "_p.*")
    size = F.abs("baseline")
    return d.withColumn("pct_delta", F.when(size > EPSILON, F.col("delta") / F.greatest(size, F.lit(EPSILON)) * 100).otherwise(F.col("delta") * 100))


def trial_score(primary: DataFrame, by: str, epsilon: float = 1e-3, penalty: float = 0.10) -> DataFrame:
    """LED19 / AGG19: objective = mean - penalty * population deviation, with wins, losses and ties by raw delta."""
    p = F.col("pct_delta")
    a = primary.groupBy(by).agg(
        F.avg(p).alias("mean_pct"), F.median(p).alias("median_pct"), F.coalesce(F.stddev_pop(p), F.lit(0.0)).alias("std_pct"),
        F.count_if(F.col("delta") > epsilon).alias("wins"), F.count_if(F.col("delta") < -epsilon).alias("losses"), F.count(F.lit(1)).alias("n_tasks"))
    return a.withColumn("ties", F.col("n_tasks") - F.col("wins") - F.col("losses")).withColumn("objective", F.col("mean_pct") - penalty * F.col("std_pct"))


def leaderboard(scores: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """LED21 / WIN10: the k best with their rank; ties by key."""
    top = scores.where(finite(value)).orderBy(F.desc(value), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), key)))


def summary_percent(df: DataFrame, baseline: str, by: str, order: str, metrics: list[str]) -> DataFrame:
    """LED20: mean percent change of the last row of each run's summary means against the baseline's last row: run, mean_pct."""
    last = df.groupBy(by).agg(*[F.max_by(q(m), order).alias(m) for m in metrics])
    x = long_form(last, [by], metrics)
    b = x.where(F.col(by) == baseline).select(F.col("metric").alias("_m"), F.col("value").alias("_b"))
    j = x.where(F.col(by) != baseline).join(F.broadcast(b), F.col("metric") == F.col("_m")).where(F.abs("_b") > EPSILON)
    return j.groupBy(by).agg(F.avg(100 * (F.col("value") - F.col("_b")) / F.abs("_b")).alias("mean_pct"))


def valid_ledger(df: DataFrame) -> bool:
    """LED22: has the Task column and at least one row."""
    return "Task" in df.columns and df.limit(1).count() == 1


def markdown(df: DataFrame, limit: int = 200) -> str:
    """SNK7: a Markdown table of a small result; more than ``limit`` rows is an error, not a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write a table instead")
    line = lambda x: "| " + " | ".join("" if v is None else str(v) for v in x) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows]])


def slide_text(tasks: DataFrame, summary: DataFrame, experiment: str, heading: str) -> DataFrame:
    """LED12 / SRT5: numbered lines of a short report: best mean change, most wins, three largest gains and losses."""
    by = lambda *o: summary.orderBy(*o).limit(1)
    head = by(F.desc("mean_delta"), experiment).select(F.lit(2).alias("n"), F.format_string("- Best mean change: %s (%+.2f%% across %d tasks).", display_name(experiment), "mean_delta", "tasks").alias("line"))
    wins = by(F.desc("wins"), experiment).select(F.lit(3).alias("n"), F.format_string("- Most task wins: %s (%d wins).", display_name(experiment), "wins").alias("line"))
    item = F.format_string("- %s / %s: %+.2f%%", display_name(experiment), "Task", "RelativeDeltaPct").alias("line")

    def three(order, at):
        top = tasks.orderBy(order, "Task", experiment).limit(3)
        return top.select((F.row_number().over(Window.orderBy(order, "Task", experiment)) + at).alias("n"), item)

    lit = lambda n, t: summary.sparkSession.createDataFrame([(n, t)], "n int, line string")
    return lit(1, f"# {heading}").union(head).union(wins).union(lit(4, "## Biggest gains")).union(three(F.desc("RelativeDeltaPct"), 4)).union(lit(8, "## Biggest losses")).union(three(F.asc("RelativeDeltaPct"), 8))
