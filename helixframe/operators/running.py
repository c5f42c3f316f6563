"""Running sums inside groups of which one may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.util import materialize


def running(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add the running sum (this row included) of each value column under its new name, within ``group`` by ``order``.

    Rows are range-partitioned by group and order, so a hot group spreads over tasks; sums run inside a partition and
    the totals of the group's partitions before (partitions x groups rows at most) are added. The partitioned rows are
    stored first, as ranges are sampled and two runs may cut them differently. Nulls come last.
    """
    cols = [F.col(c).asc_nulls_last() for c in [*group, *order]]
    p = materialize(df.repartitionByRange(*cols).withColumn("__part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("__part", *group).orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = p.groupBy("__part", *group).agg(*[F.sum(v).alias(f"__s{i}") for i, v in enumerate(sums.values())])
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    start = part.select(
        F.col("__part").alias("__part2"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        *[F.coalesce(F.sum(f"__s{i}").over(before), F.lit(0)).alias(f"__b{i}") for i in range(len(sums))])
    on = F.col("__part") == F.col("__part2")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    j = p.select("*", *[F.sum(v).over(w).alias(f"__w{i}") for i, v in enumerate(sums.values())]).join(start, on)
    return j.select(*df.columns, *[(F.col(f"__w{i}") + F.col(f"__b{i}")).alias(n) for i, n in enumerate(sums)])
