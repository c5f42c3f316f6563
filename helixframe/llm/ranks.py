"""Dense ranks inside groups of which one may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def salted_rank(df: DataFrame, keys: list[str], order: list[str], rank: str, salts: int = 64) -> DataFrame:
    """Add ``rank``: 0, 1, 2, ... within ``keys``, dense and the same in every run.

    Ranks are dense but follow ``order`` only inside a slice: a group is cut into ``salts`` slices by the hash of
    ``order``; ranks are counted inside a slice and moved by the
    size of the slices before it, so a hot group never sits in one task. The table of slices has at most
    groups x salts rows and is joined by whatever way its size suggests.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_salt").alias("_s"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start")
    )
    inner = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)) - 1
    on = (F.col("_salt") == F.col("_s")) & F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    ranked = salted.withColumn("_in", inner).join(starts, on)
    return ranked.withColumn(rank, F.col("_in") + F.col("_start")).drop("_in", "_start", "_salt", "_s", *[f"_k_{k}" for k in keys])
