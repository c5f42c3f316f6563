"""Column functions that give the same value in every engine, so that samples and orders can be checked by SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_hash(seed: int, *keys: Column | str) -> Column:
    """32 hex digits that depend on the seed and the keys only; nulls count as the text '~'."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("~")) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))


def sql_hash(seed: int, *keys: str) -> str:
    """The DuckDB expression of ``stable_hash``."""
    return "md5(concat_ws('|', '%d', %s))" % (seed, ", ".join(f"coalesce(CAST({k} AS VARCHAR), '~')" for k in keys))


def nan_to_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def finite(c: Column | str) -> Column:
    """True for numbers that are neither null nor NaN nor infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def truthy(c: Column | str) -> Column:
    """Text switches: 1, true, yes and on count as true, everything else (null too) as false."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "on"), F.lit(False))


def int_list(c: Column | str) -> Column:
    """Comma list of whole numbers, blanks skipped."""
    c = F.col(c) if isinstance(c, str) else c
    return F.transform(F.filter(F.split(c, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))


def multilabel(c: Column | str) -> Column:
    """Labels of a list written as text with brackets, quotes and any of the separators , ; | ."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(F.translate(c, "[]'\"", ""), "[,;|]", " ")
    return F.filter(F.split(bare, r"\s+"), lambda x: x != "")


def class_label(c: Column | str) -> Column:
    """Class as text: numbers lose their fraction (towards zero), all else is kept."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.try_cast("double").cast("bigint").cast("string"), c)


def number_or_first(c: Column | str) -> Column:
    """A regression target: the text as a number, else the first entry of a list written as text, else null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.try_cast("double"), F.try_element_at(multilabel(c), F.lit(1)).try_cast("double"))


def distinct_in_order(c: Column | str) -> Column:
    """SET6: a list without repeats, each value at its first place."""
    return F.array_distinct(F.col(c) if isinstance(c, str) else c)


def title(c: Column | str) -> Column:
    """Display name: underscores to spaces, words capitalised."""
    c = F.col(c) if isinstance(c, str) else c
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def safe_name(c: Column | str) -> Column:
    """A name fit for a file: slashes of both kinds become underscores."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(c, "/\\", "__")


def no_whitespace(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"\s+", "")


def mapped(c: Column | str, table: dict[str, str]) -> Column:
    """Dictionary replacement; values without an entry are kept, null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return reduce(lambda acc, kv: F.when(c == kv[0], F.lit(kv[1])).otherwise(acc), reversed(list(table.items())), c)


def signature(df: DataFrame, key: str, digits: int = 12) -> DataFrame:
    """Digest of the sorted distinct values of a bounded column, for output names and staleness checks."""
    joined = F.array_join(F.sort_array(F.collect_set(F.col(key).cast("string"))), "\n")
    return df.agg(F.substring(F.sha2(joined.cast("binary"), 256), 1, digits).alias("signature"))


def hash_cap(df: DataFrame, n: int, seed: int, *keys: str, buckets: int = 4096) -> DataFrame:
    """Exactly the n rows (all, if fewer) first in the order of ``stable_hash``, then keys, without a global sort.

    Rows are counted by the first hex digits of their hash, as many as ``buckets`` needs; whole buckets below the cut are kept by a filter and
    only the bucket at the cut is ranked. n <= 0 means no cap. Needs keys that are unique for a result that is the
    same in every run.
    """
    if n <= 0:
        return df
    return hash_flag(df, n, seed, *keys, name="_kept", buckets=buckets).where("_kept").drop("_kept")


def hash_flag(df: DataFrame, n: int, seed: int, *keys: str, name: str, buckets: int = 4096) -> DataFrame:
    """All rows, with a flag for the n that ``hash_cap`` keeps. Rows of null or repeated keys are counted one by one."""
    h = df.withColumn("_h", stable_hash(seed, *keys)).withColumn("_b", F.substring("_h", 1, len(f"{max(buckets, 2) - 1:x}")))
    counts = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    below = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    cut = counts.select(F.col("_b").alias("_c"), F.coalesce(below, F.lit(0)).alias("_before"), "_n")
    j = h.join(F.broadcast(cut), F.col("_b") == F.col("_c"))
    border = (F.col("_before") < n) & (F.col("_before") + F.col("_n") > n)
    whole = j.where(~border).withColumn(name, F.col("_before") + F.col("_n") <= n)
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", *keys)) + F.col("_before")
    edge = j.where(border).withColumn("_r", place).withColumn(name, F.col("_r") <= n).drop("_r")
    return whole.unionByName(edge).drop("_h", "_b", "_c", "_before", "_n")
