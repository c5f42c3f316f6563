"""Evaluation metrics as aggregates: classification, ranking, regression, retrieval; whole or by group.

Ranks that cross a group are aggregates over distinct values, not over rows: equal values share a rank, so a group
with most rows is first combined to its distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.running import running


def average_ranks(df: DataFrame, value: str, group: list[str], name: str) -> DataFrame:
    """WIN13: average rank of each row's value within the group (1-based, ties share their mean)."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    r = running(counts, group, [value], {"_w": "_n"}).withColumn("_r", F.col("_w") - (F.col("_n") - 1) / 2)
    keys = [F.col(g).alias(f"_k{i}") for i, g in enumerate(group)]
    r = r.select(*keys, F.col(value).alias("_v"), F.col("_r").alias(name))
    on = F.col(value) == F.col("_v")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_k{i}"))
    return df.join(r, on).drop("_v", *[f"_k{i}" for i in range(len(group))])


def accuracy(truth: Column | str, guess: Column | str) -> Column:
    """MET1: share of equal pairs; an aggregate. Null guesses are wrong."""
    t, g = (F.col(x) if isinstance(x, str) else x for x in (truth, guess))
    return F.avg(F.coalesce((t == g).cast("int"), F.lit(0)))


def confusion(df: DataFrame, truth: str, guess: str, group: list[str]) -> DataFrame:
    """Pairs of classes and how often they met."""
    return df.groupBy(*group, truth, guess).agg(F.count(F.lit(1)).alias("n"))


def f1_scores(df: DataFrame, truth: str, guess: str, group: list[str] | None = None, positive: str | None = None) -> DataFrame:
    """MET2: f1_macro, f1_weighted, f1_micro (and f1_binary of ``positive``), a class without hits counting 0.

    Classes are those met as truth or as guess. Computed from the confusion counts.
    """
    group = group or []
    c = confusion(df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()), truth, guess, group)
    tp = F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)
    t = c.select(*group, F.col(truth).cast("string").alias("_c"), tp.alias("tp"), F.lit(0).cast("bigint").alias("fp"), F.col("n").alias("support"))
    g = c.select(*group, F.col(guess).cast("string").alias("_c"), F.lit(0).cast("bigint").alias("tp"), F.when(F.col(truth) == F.col(guess), 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("bigint").alias("support"))
    per = t.union(g).groupBy(*group, "_c").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("support").alias("support"))
    per = per.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("support") - F.col("tp")), F.lit(0.0)))
    aggs = [
        F.avg("f1").alias("f1_macro"), F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"),
        F.try_divide(F.sum("tp"), F.sum("support")).alias("f1_micro")]
    if positive is not None:
        aggs.append(F.coalesce(F.max(F.when(F.col("_c") == positive, F.col("f1"))), F.lit(0.0)).alias("f1_binary"))
    return per.groupBy(*group).agg(*aggs) if group else per.agg(*aggs)


def roc_auc(df: DataFrame, truth: Column, score: str, group: list[str] | None = None) -> DataFrame:
    """MET3: area under the ROC curve by rank sum, ties at their average rank; null where a side is missing.

    ``truth``: a boolean column. Works on counts by distinct score.
    """
    group = group or []
    c = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).groupBy(*group, score).agg(F.count_if(truth).alias("_p"), F.count_if(~truth).alias("_n"))
    r = running(c, group, [score], {"_below": "_n"})
    r = r.withColumn("_w", F.col("_p") * (F.col("_below") - F.col("_n") / 2))
    a = F.try_divide(F.sum("_w"), (F.sum("_p") * F.sum("_n")).cast("double")).alias("auc")
    return r.groupBy(*group).agg(a) if group else r.agg(a)


def one_vs_rest_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """MET3: AUC of each class against all others on one score: class, auc; classes without a rest are skipped.

    Counts by (class, score) meet the counts of all classes by score, so rows are not repeated for each class.
    """
    ok = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    own = ok.groupBy(F.col(label).alias("class"), F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_p"))
    every = running(own.groupBy("_s").agg(F.sum("_p").alias("_n")), [], ["_s"], {"_upto": "_n"}).withColumnRenamed("_s", "_t")
    j = running(own.withColumnRenamed("_p", "_k"), ["class"], ["_s"], {"_own": "_k"}).withColumnRenamed("_k", "_p").join(every, F.col("_s") == F.col("_t"))
    rest = (F.col("_upto") - F.col("_n")) - (F.col("_own") - F.col("_p")) + (F.col("_n") - F.col("_p")) / 2
    total = ok.count()
    c = j.groupBy("class").agg(F.sum(F.col("_p") * rest).alias("_w"), F.sum("_p").alias("_k"))
    return c.select("class", F.try_divide("_w", (F.col("_k") * (F.lit(total) - F.col("_k"))).cast("double")).alias("auc")).where("auc is not null")


def average_precision(df: DataFrame, truth: Column, score: str, group: list[str] | None = None) -> DataFrame:
    """MET4: sum of precision times recall step over distinct thresholds, equal scores together; null without positives."""
    group = group or []
    c = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).groupBy(*group, score).agg(F.count_if(truth).alias("_p"), F.count(F.lit(1)).alias("_n"))
    c = c.withColumn("_down", -F.col(score))
    r = running(c.withColumnRenamed("_p", "_hit"), group, ["_down"], {"_tp": "_hit", "_all": "_n"}).withColumnRenamed("_hit", "_p")
    r = r.withColumn("_w", F.col("_p") * F.col("_tp") / F.col("_all"))
    a = F.try_divide(F.sum("_w"), F.sum("_p").cast("double")).alias("average_precision")
    return r.groupBy(*group).agg(a) if group else r.agg(a)


def spearman(df: DataFrame, a: str, b: str, group: list[str]) -> DataFrame:
    """MET5: rank correlation by group, rows with a null or NaN left out; undefined is 0."""
    ok = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(F.col(a).cast("double")) & ~F.isnan(F.col(b).cast("double")))
    r = average_ranks(average_ranks(ok.select(*group, a, b), a, group, "_ra"), b, group, "_rb")
    c = F.try_divide(F.covar_pop("_ra", "_rb"), F.stddev_pop("_ra") * F.stddev_pop("_rb"))
    return r.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.coalesce(c, F.lit(0.0)).alias("spearman"))


def mse(truth: Column | str, guess: Column | str) -> Column:
    """MET6: mean squared error; an aggregate."""
    t, g = (F.col(x) if isinstance(x, str) else x for x in (truth, guess))
    return F.avg(F.pow(t.cast("double") - g.cast("double"), F.lit(2.0)))


def recall_at(neighbours: DataFrame, labels: DataFrame, ks: list[int], key: str = "id", label: str = "label") -> DataFrame:
    """MET7: share of all rows with a same-label row among their first k neighbours, as recall_at_k columns.

    ``neighbours``: query_id, other_id, rank. Every labelled row is a query, also one whose label has no other row.
    Fewer than two rows: 0.
    """
    a = labels.select(F.col(key).alias("_q"), F.col(label).alias("_lq"))
    b = labels.select(F.col(key).alias("_o"), F.col(label).alias("_lo"))
    j = neighbours.join(a, F.col("query_id") == F.col("_q")).join(b, F.col("other_id") == F.col("_o")).where("_lq = _lo")
    first = j.groupBy("_q").agg(F.min("rank").alias("_r")).select(F.col("_q").alias("_z"), "_r")
    per = a.join(first, F.col("_q") == F.col("_z"), "left")
    return per.agg(*[F.coalesce(F.avg(F.when(F.col("_r") <= k, 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"recall_at_{k}") for k in ks])


def multilabel_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """MET8: subset accuracy and F1 (macro, micro) of label arrays; rows without true labels are left out."""
    d = df.where(F.size(truth) > 0).select(F.array_distinct(truth).alias("t"), F.array_distinct(F.coalesce(F.col(guess), F.array().cast("array<string>"))).alias("g"))
    same = d.agg(F.avg((F.sort_array("t") == F.sort_array("g")).cast("int")).alias("subset_accuracy"))
    c = d.select(F.explode(F.array_union("t", "g")).alias("c"), "t", "g").groupBy("c").agg(
        F.count_if(F.array_contains("t", F.col("c")) & F.array_contains("g", F.col("c"))).alias("tp"), F.count_if(~F.array_contains("t", F.col("c"))).alias("fp"), F.count_if(~F.array_contains("g", F.col("c"))).alias("fn"))
    f = c.agg(F.avg(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1_macro"), (2 * F.sum("tp") / (2 * F.sum("tp") + F.sum("fp") + F.sum("fn"))).alias("f1_micro"))
    return same.withColumn("_j", F.lit(1)).join(f.withColumn("_k", F.lit(1)), F.col("_j") == F.col("_k")).drop("_j", "_k")
