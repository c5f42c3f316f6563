"""Seeded samples, folds and splits. All orders are hash orders: the same rows in every run, on every cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.portable import hash_cap, hash_flag, stable_hash
from helixframe.operators.running import running


def group_place(df: DataFrame, group: str, order: str, name: str = "_place") -> DataFrame:
    """0-based place of a row in its group by ``order`` (unique in the group); a hot group spreads over tasks."""
    return running(df.withColumn("__one", F.lit(1)), [group], [order], {name: "__one"}).withColumn(name, F.col(name) - 1).drop("__one")


def sample_per_group(df: DataFrame, group: list[str], n: int, seed: int, *keys: str) -> DataFrame:
    """WIN3 / WIN4: n rows of each group in hash order; n <= 0 means all.

    A rank over the whole group would put a hot group into one task, so rows are first cut to those that can be among
    the n: each slice of the group (by hash prefix) keeps its own first n, the final rank runs over those.
    """
    if n <= 0:
        return df
    h = df.withColumn("_h", stable_hash(seed, *group, *keys)).withColumn("_s", F.substring("_h", -2, 2))
    part = h.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_s").orderBy("_h", *keys))).where(F.col("_r") <= n)
    return part.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("_h", *keys))).where(F.col("_r") <= n).drop("_h", "_s", "_r")


def shuffled(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """SMP1: all rows in hash order (range-partitioned sort)."""
    return df.orderBy(stable_hash(seed, *keys), *keys)


def sample_rows(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """SMP2 / SMP3 / SMP4: exactly n rows in hash order: no prefix of the input is favoured; n <= 0 or n >= rows: all."""
    return hash_cap(df, n, seed, *keys)


def random_split(df: DataFrame, share: float, seed: int, *keys: str, name: str = "split") -> DataFrame:
    """SMP8: train / test with exactly floor(share * rows) training rows, also where keys are null or repeated."""
    take = int(df.count() * share)
    return hash_flag(df, take, seed, *keys, name="_in").withColumn(name, F.when(F.col("_in"), "train").otherwise("test")).drop("_in")


def group_split(df: DataFrame, group: str, share: float, seed: int, name: str = "split") -> DataFrame:
    """SMP9: groups, not rows, are split: floor(share * groups) of them train. Null is a group."""
    groups = random_split(df.select(F.coalesce(F.col(group).cast("string"), F.lit("~")).alias("_g")).distinct(), share, seed, "_g", name=name)
    return df.join(groups, F.coalesce(F.col(group).cast("string"), F.lit("~")) == F.col("_g")).drop("_g")


def stratified_folds(df: DataFrame, label: str, k: int, seed: int, *keys: str, name: str = "fold") -> DataFrame:
    """SMP12: fold 0..k-1; dealt out inside each label when every label has at least k rows, else over all rows.

    Ranks are salted by hash prefix, so neither the one big label nor the unstratified case needs one task for all.
    """
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    by = F.coalesce(F.col(label).cast("string"), F.lit("~")) if least is not None and least >= k else F.lit("all")
    h = df.withColumn("_l", by).withColumn("_h", stable_hash(seed, *keys)).withColumn("_s", F.substring("_h", 1, 2))
    counts = h.groupBy("_l", "_s").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_l").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("_l").alias("_m"), F.col("_s").alias("_t"), before.alias("_start"))
    inner = F.row_number().over(Window.partitionBy("_l", "_s").orderBy("_h", *keys)) - 1
    j = h.withColumn("_i", inner).join(starts, (F.col("_l") == F.col("_m")) & (F.col("_s") == F.col("_t")))
    return j.withColumn(name, F.pmod(F.col("_i") + F.col("_start"), F.lit(k)).cast("int")).drop("_l", "_h", "_s", "_m", "_t", "_start", "_i")


def named_split(available: list[str], wanted: str, aliases: dict[str, tuple[str, ...]] | None = None) -> str | None:
    """SMP10: split by exact name, then an alias, then as part of a name, all in lower case."""
    low = {a.lower(): a for a in available}
    names = [wanted.lower(), *(aliases or {"validation": ("valid", "val", "dev", "eval")}).get(wanted.lower(), ())]
    return next((low[n] for n in names if n in low), None) or next((low[a] for n in names for a in low if n in a), None)


def split_strategy(per_assay: bool, retrieval: bool, split_column: bool, wanted: str, rows_found: bool, auto_split: bool, has_test: bool) -> str:
    """SMP11: which strategy a task's evaluation data comes from; the first rule that fits."""
    if per_assay:
        return "proteingym_unchanged"
    if retrieval:
        return "retrieval_unchanged"
    if split_column:
        return "test_split_column" if wanted == "test" else "validation_split_column" if rows_found else "validation_cv4_train"
    if wanted == "validation":
        return "validation_split" if rows_found else "validation_cv4_train"
    return "test_random_split" if auto_split or not has_test else "test_split"


def strategy_column(tasks: DataFrame, wanted: str) -> DataFrame:
    """SMP11 over a task table (task_config): name and the strategy of the wanted split."""
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    col: Column = (
        F.when(F.col("problem_type") == "retrieval", "retrieval_unchanged")
        .when(has("split_column") & F.lit(wanted == "test"), "test_split_column")
        .when(has("split_column") & has("validation_split"), "validation_split_column")
        .when(has("split_column"), "validation_cv4_train")
        .when(F.lit(wanted == "validation") & has("validation_split"), "validation_split")
        .when(F.lit(wanted == "validation"), "validation_cv4_train")
        .when(F.coalesce("auto_split", F.lit(False)) | ~has("test_split"), "test_random_split")
        .otherwise("test_split")
    )
    return tasks.select("name", col.alias("strategy"))


def masked(c: str, key: str, rate: float, seed: int, mark: str = "#") -> Column:
    """SMP13: letters replaced by a mark where the hash of (seed, key, position) falls under the rate."""
    limit = int(rate * 0xFFFF)
    spot = lambda ch, i: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), (i + 1).cast("string")).cast("binary")), 1, 4), 16, 10).cast("int")
    return F.array_join(F.transform(F.split(c, ""), lambda ch, i: F.when(ch.rlike("[A-Z]") & (spot(ch, i) < limit), F.lit(mark)).otherwise(ch)), "")


def top_groups_sample(df: DataFrame, group: str, groups: int, per_group: int, seed: int, *keys: str) -> DataFrame:
    """SMP14: the largest groups (ties by name), and up to ``per_group`` rows of each in hash order."""
    top = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), group).limit(groups).select(F.col(group).alias("_g"))
    return sample_per_group(df.join(top, F.col(group) == F.col("_g"), "left_semi"), [group], per_group, seed, *keys)
