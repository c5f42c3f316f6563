"""Loading steps of a sequence corpus: aliases, checks, filters, hierarchy, order and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.util import materialize

# Accepted spellings of the canonical columns.
ALIASES = {
    "sequence": ("seq", "sequence_aa", "aa_seq"),
    "cluster_id": ("ur50_id", "uniref50_id", "repId", "RepId"),
    "family_id": ("family",),
    "clan_id": ("clan",),
}


def normalize_columns(df: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """PRJ1: rename known aliases; only where the canonical name is free, and the first alias present wins."""
    for target, names in aliases.items():
        if target not in df.columns:
            hit = next((n for n in names if n in df.columns), None)
            if hit:
                df = df.withColumnRenamed(hit, target)
    return df


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Raise when columns are missing, naming all of them."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; present: {df.columns}")
    return df


def resolve(columns: list[str], candidates: list[str]) -> str | None:
    """First candidate among the columns, exact spelling before any case (SRC14, column inference)."""
    low = {c.lower(): c for c in reversed(columns)}
    return next((c for c in candidates if c in columns), None) or next((low[c.lower()] for c in candidates if c.lower() in low), None)


def valid_rows(df: DataFrame, seq: str = "sequence", group: str | None = "group_id") -> DataFrame:
    """FLT1: sequence neither null nor empty, group not null."""
    ok = F.col(seq).isNotNull() & (F.octet_length(seq) > 0)
    return df.where(ok & F.col(group).isNotNull()) if group else df.where(ok)


def length_band(df: DataFrame, columns: list[str], low: int, high: int, closed: bool = True) -> DataFrame:
    """FLT6 / FLT7: byte length of every column within the band."""
    n = [F.octet_length(c) for c in columns]
    return df.where(reduce(lambda a, b: a & b, [(x.between(low, high) if closed else ((x > low) & (x < high))) for x in n]))


def exclude_prefixes(df: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    """FLT8 / CLU4: rows whose id starts with none of the prefixes; a null id is dropped."""
    return df.where(~reduce(lambda a, b: a | b, [F.col(column).startswith(p) for p in prefixes], F.col(column).startswith(prefixes[0])))


def split_form(c: Column | str) -> Column:
    """Split names in compared form: trimmed, lower-cased, null as empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.lower(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")), F.lit(""))


def in_splits(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """FLT9: rows whose split is one of the names."""
    return df.where(split_form(column).isin([n.strip().lower() for n in names]))


def frequent(df: DataFrame, group: str, least: int) -> DataFrame:
    """FLT12 / FLT13 / JN6: rows of groups with at least ``least`` rows, by aggregate and semi join. Null groups go."""
    big = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(F.col(group).alias("_g"))
    return df.join(big, F.col(group) == F.col("_g"), "left_semi")


def check_clean(df: DataFrame, columns: list[str]) -> DataFrame:
    """FLT16: the same rows; running them raises when a value is null or empty."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.col(c).cast("string") == "") for c in columns])
    return df.where(F.when(bad, F.raise_error(F.lit("null or empty value in " + ", ".join(columns)))).otherwise(F.lit(True)).cast("boolean"))


def attach_parent(df: DataFrame, parents: DataFrame, key: str, parent: str) -> DataFrame:
    """JN3 / PRJ5: left join to the hierarchy; without an entry the key is its own parent."""
    p = parents.select(F.col(key).alias("_k"), F.col(parent).alias("_p")).dropDuplicates(["_k"])
    base = df.drop(parent) if parent in df.columns else df
    return base.join(p, F.col(key) == F.col("_k"), "left").withColumn(parent, F.coalesce("_p", key)).drop("_k", "_p")


def drop_redundant(df: DataFrame, column: str, other: str) -> DataFrame:
    """PRJ4: drop a column that nowhere differs from another (null pairs don't count as a difference)."""
    if column in df.columns and other in df.columns and df.where(F.col(column) != F.col(other)).limit(1).count() == 0:
        return df.drop(column)
    return df


def sorted_by(df: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """SRT1: total order by the hierarchy, range-partitioned by the engine; ties by further keys."""
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys + tie])


def shuffled_within(df: DataFrame, keys: list[str], tie: str, seed: int = 42) -> DataFrame:
    """WIN9: sorted by key, in hash order inside a key. A real shuffle inside the key, unlike a stable re-sort."""
    from helixframe.functions.portable import stable_hash

    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys], stable_hash(seed, tie), tie)


def indexed(df: DataFrame, order: list[str], name: str = "row_idx") -> DataFrame:
    """PRJ10: 0-based index in a stated total order, without one task seeing all rows.

    Rows are range-partitioned; the sizes of the partitions before (one number each) are added to the position inside
    the partition. The partitioned rows are stored first, as ranges are sampled and two runs may cut them differently.
    """
    cols = [F.col(c).asc_nulls_last() for c in order]
    parted = materialize(df.repartitionByRange(*cols).withColumn("__part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("__part").orderBy(*cols)
    placed = parted.withColumn("__pos", F.row_number().over(w))
    sizes = parted.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    start = sizes.select(F.col("__part").alias("__part2"), F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(start), F.col("__part") == F.col("__part2")).withColumn(name, F.col("__pos") - 1 + F.col("__start")).drop("__part", "__part2", "__start", "__pos")


def match_rate(df: DataFrame, ids: DataFrame, key: str, sample: int = 10_000) -> DataFrame:
    """JN2: share of the first ``sample`` rows (by key) whose key is known: sampled, matched, match_rate."""
    part = df.select(key).orderBy(F.col(key).asc_nulls_last()).limit(sample)
    known = ids.select(F.col(key).alias("_k")).distinct().withColumn("_hit", F.lit(1))
    j = part.join(known, F.col(key) == F.col("_k"), "left")
    return j.agg(F.count(F.lit(1)).alias("sampled"), F.count("_hit").alias("matched"), F.round(F.count("_hit") / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("match_rate"))


def parent_statistics(df: DataFrame, child: str, parent: str) -> DataFrame:
    """AGG3 / AGG21: parents, orphans (child is its own parent) and parents of several children, with shares in percent.

    Several children of one parent are counted exactly; a null child counts as a value.
    """
    per = df.groupBy(parent).agg((F.count_distinct(child) + F.max(F.col(child).isNull().cast("int"))).alias("n"), F.count(F.lit(1)).alias("rows"), F.max((F.col(child) == F.col(parent)).cast("int")).alias("own"))
    return per.agg(
        F.count(F.lit(1)).alias("parents"), F.sum("rows").alias("rows"), F.count_if(F.col("own") == 1).alias("orphans"), F.count_if(F.col("n") > 1).alias("multi"),
        F.round(100 * F.count_if(F.col("n") > 1) / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("multi_percent"))


def length_statistics(df: DataFrame, column: str) -> DataFrame:
    """AGG6: count, least, greatest and mean byte length."""
    n = F.octet_length(column)
    return df.agg(F.count(n).alias("n"), F.min(n).alias("least"), F.max(n).alias("greatest"), F.round(F.avg(n), 6).alias("mean"))


def median_tolerance(df: DataFrame, models: DataFrame, group: str, seq: str, tolerance: float = 0.10) -> DataFrame:
    """TRN12 / AGG5 / JN10 / FLT11: groups whose median byte length is within the tolerance of their model's length.

    ``models``: group, model_length. Output: group, median_length, members, model_length.
    """
    m = df.where(F.col(seq).isNotNull()).groupBy(F.col(group).alias("_g")).agg(F.median(F.octet_length(seq)).alias("median_length"), F.count(F.lit(1)).alias("members"))
    j = m.join(models, F.col("_g") == F.col(group))
    rel = F.abs(F.col("median_length") - F.col("model_length")) / F.greatest(F.col("model_length"), F.lit(1))
    return j.where(rel <= tolerance).select(group, "median_length", "members", "model_length")


def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG20: column and its nulls, in one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])).alias("x")).select("x.*")


def drop_null_columns(df: DataFrame) -> DataFrame:
    """PRJ14: without the columns that hold no value, found in one pass."""
    if not df.columns:
        return df
    have = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if have[i]])


def informative_columns(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """PRJ13: without the columns that hold their default in every row, found in one pass."""
    have = [c for c in defaults if c in df.columns]
    if not have:
        return df
    odd = df.agg(*[F.max((~F.col(f"`{c}`").eqNullSafe(F.lit(defaults[c]))).cast("int")).alias(f"c{i}") for i, c in enumerate(have)]).first()
    return df.drop(*[c for i, c in enumerate(have) if not odd[i]])


def adjacent_gaps(positions: Column) -> Column:
    """WIN14: differences between neighbours of the sorted positions of an array."""
    s = F.array_sort(positions)
    return F.zip_with(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: a - b)
