"""Scored assays: per-assay scaling, label maps, test-fold removal and pairs inside an assay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.portable import stable_hash
from helixframe.operators.corpus import split_form

# Clinical labels as scores, harmless above harmful.
CLINICAL = {"benign": 1.0, "pathogenic": 0.0, "0": 1.0, "1": 0.0}
SPLIT_COLUMNS = ("stage", "split", "set", "fold")


def scaled_scores(df: DataFrame, group: str, score: str, name: str = "scaled") -> DataFrame:
    """WIN1: z-score within the group, clipped at three deviations and brought to [0, 1].

    Means and deviations are a small aggregate joined back, so a group with most rows is never sorted in one task.
    A group of one row has no deviation: its result is null. A constant group scores 0.5. Null scores stay null; null
    groups form a group.
    """
    st = df.groupBy(F.col(group).alias("_g")).agg(F.avg(score).alias("_m"), F.stddev_samp(score).alias("_s"))
    j = df.join(st, F.col(group).eqNullSafe(F.col("_g")))
    z = (F.col(score) - F.col("_m")) / F.greatest(F.col("_s"), F.lit(1e-8))
    clipped = F.least(F.greatest(z, F.lit(-3.0)), F.lit(3.0))
    return j.withColumn(name, F.when(F.col("_s").isNotNull() & F.col(score).isNotNull(), (clipped + 3) / 6)).drop("_g", "_m", "_s")


def label_score(c: Column | str, table: dict[str, float] = CLINICAL) -> Column:
    """PRJ9 / T3: mapped label, else the text as a number, else null. Labels compare trimmed and lower-cased."""
    c = F.col(c) if isinstance(c, str) else c
    key = F.lower(F.trim(c))
    hit = F.lit(None).cast("double")
    for k, v in table.items():
        hit = F.when(key == k, F.lit(v)).otherwise(hit)
    return F.coalesce(hit, c.try_cast("double"))


def fold_flags(df: DataFrame, group: str, item: str, seed: int = 42, least: int = 10, share: float = 0.8, name: str = "is_test") -> DataFrame:
    """SMP6: test rows of each group: those after the first ``floor(share * n)`` items in hash order.

    Groups of under ``least`` rows have no test rows. The order is by hash of (group, item, row position key), so both
    the corpus side and the benchmark side get the same fold from this one function. ``df`` needs ``row_id`` for ties.
    The rank inside a group is salted by the hash itself: rows are counted by hash prefix, only the prefix at the
    border is ranked row by row.
    """
    h = df.withColumn("_h", stable_hash(seed, group, item, "row_id")).withColumn("_b", F.substring("_h", 1, 3))
    counts = h.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(group)
    run = counts.withColumn("_all", F.sum("_n").over(w)).withColumn("_before", F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = run.select(F.col(group).alias("_g"), F.col("_b").alias("_c"), "_n", "_all", "_before")
    j = h.join(run, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_c")))
    place = F.row_number().over(Window.partitionBy(group, "_b").orderBy("_h", "row_id")) + F.col("_before")
    test = (F.col("_all") >= least) & (place > F.floor(F.col("_all") * share))
    return j.withColumn(name, test).drop("_h", "_b", "_g", "_c", "_n", "_all", "_before")


def drop_test_sequences(df: DataFrame, group: str, item: str, flag: str = "is_test") -> DataFrame:
    """SMP6 / JN7: rows whose item is a test item of their group are removed, wherever it recurs in the group."""
    bad = df.where(flag).select(F.col(group).alias("_g"), F.col(item).alias("_i")).distinct()
    return df.join(bad, (F.col(group) == F.col("_g")) & (F.col(item) == F.col("_i")), "left_anti").drop(flag)


def split_column(df: DataFrame, column: str | None = None, known: tuple[str, ...] = ("train", "test", "val", "valid", "validation")) -> str | None:
    """SMP7: the first usual split column that holds a recognised value."""
    for c in [column] if column else SPLIT_COLUMNS:
        if c in df.columns and df.where(split_form(c).isin(*known)).limit(1).count():
            return c
    return None


def drop_named_split(df: DataFrame, column: str, group: str, item: str, names: tuple[str, ...] = ("test",)) -> DataFrame:
    """SMP7: explicit variant: rows of the named splits, and rows that repeat their items in the group, are removed."""
    return drop_test_sequences(df.withColumn("is_test", split_form(column).isin(*names)), group, item)


def forbid_pairs(pairs: DataFrame, forbidden: DataFrame, keys: list[str]) -> DataFrame:
    """JN8 / CLU6: pairs on the forbidden list are removed, whatever split they come from."""
    f = forbidden.select(*[F.col(k).alias(f"_f{i}") for i, k in enumerate(keys)]).distinct()
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_f{i}"))
    return pairs.join(f, on, "left_anti")


def pairs_inside(df: DataFrame, group: str, item: str, order: str, cap: int = 0, seed: int = 42) -> DataFrame:
    """JN18 / SMP5: unordered pairs of rows of a group: group, left, right (by ``order``), hash.

    cap <= 0, or at least as large as n(n-1)/2: all pairs, which is what is asked for then. Otherwise ``cap``
    different pairs a group without building the others: 4 * cap + 64 seeded draws of two members, their distinct pairs
    ordered by hash, the first ``cap`` kept. A group with no more pairs than draws has all its pairs listed instead.
    The draws of a larger group give ``cap`` distinct pairs with overwhelming likelihood, but not by proof.
    """
    base = df.select(F.col(group).alias("_g"), F.col(item).alias("_i"), F.col(order).alias("_o")).where(F.col(group).isNotNull())
    if cap <= 0:
        b = base.select(F.col("_g").alias("_g2"), F.col("_i").alias("_i2"), F.col("_o").alias("_o2"))
        j = base.join(b, (F.col("_g") == F.col("_g2")) & (F.col("_o") < F.col("_o2")))
        return j.select(F.col("_g").alias(group), F.col("_o").alias("left_id"), F.col("_o2").alias("right_id"), F.col("_i").alias("left"), F.col("_i2").alias("right"))
    from helixframe.operators.sampling import group_place

    placed = group_place(base, "_g", "_o")
    n = placed.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    tries = 4 * cap + 64
    few = n.where(F.col("_n") * (F.col("_n") - 1) / 2 <= tries)
    many = n.where(F.col("_n") * (F.col("_n") - 1) / 2 > tries)
    i = F.explode(F.sequence(F.lit(0), F.col("_n") - 2)).alias("_x")
    all_pairs = few.select("_g", "_n", i).select("_g", F.col("_x"), F.explode(F.sequence(F.col("_x") + 1, F.col("_n") - 1)).alias("_y"))
    draws = many.select("_g", "_n", F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("_d"))
    pick = lambda s: F.pmod(F.xxhash64(F.lit(seed), F.lit(s), F.col("_g"), F.col("_d")), F.col("_n"))
    drawn = draws.select("_g", pick(1).alias("a"), pick(2).alias("b")).where("a <> b").select("_g", F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y")).distinct()
    ranked = all_pairs.union(drawn).withColumn("_h", stable_hash(seed, "_g", "_x", "_y"))
    kept = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy("_h", "_x", "_y"))).where(F.col("_r") <= cap)
    one = placed.select(F.col("_g").alias("g1"), F.col("_place").alias("p1"), F.col("_o").alias("left_id"), F.col("_i").alias("left"))
    two = placed.select(F.col("_g").alias("g2"), F.col("_place").alias("p2"), F.col("_o").alias("right_id"), F.col("_i").alias("right"))
    j = kept.join(one, (F.col("_g") == F.col("g1")) & (F.col("_x") == F.col("p1"))).join(two, (F.col("_g") == F.col("g2")) & (F.col("_y") == F.col("p2")))
    return j.select(F.col("_g").alias(group), "left_id", "right_id", "left", "right")
