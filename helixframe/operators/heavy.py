"""Per-key results over tables in which a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_totals(df: DataFrame, keys: dict[str, F.Column], item: F.Column) -> DataFrame:
    """Exact members, residues and distinct items of every value of several key fields.

    Method: map-side combining in two algebraic steps. Step one groups by (field, key, item digest); its partial
    aggregates are bounded hash tables in each task (the engine spills them) and the digest in the key spreads a hot
    key over all reducers. Step two adds up what is left by (field, key): at most one row of a key from each map task
    is shuffled, however many rows the key holds.

    ``keys`` maps the field name of the output to the key expression; ``item`` is the text that is measured.
    Output: field_name, key_value, members, residues, distinct_sequences.

    Defined results: a null key is a group of its own (key_value null); a null item counts as a member with 0 residues
    and is no distinct item; an empty item has 0 residues and is no distinct item either; repeated rows count each
    time as members; an empty table gives no rows. Distinct items are told apart by their 128-bit digest.
    Only the named expressions are read, so other columns of any name don't matter.
    """
    src = df.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), c.cast("string").alias("key_value")) for n, c in keys.items()])).alias("_k"),
        item.alias("_item"),
    )
    length = F.coalesce(F.octet_length("_item"), F.lit(0)).cast("long")
    fine = (
        src.select("_k.field_name", "_k.key_value", F.when(length > 0, F.unhex(F.md5(F.col("_item").cast("binary")))).alias("_d"), length.alias("_n"))
        .groupBy("field_name", "key_value", "_d")
        .agg(F.count(F.lit(1)).alias("_m"), F.sum("_n").alias("_r"))
    )
    return fine.groupBy("field_name", "key_value").agg(
        F.sum("_m").alias("members"), F.sum("_r").alias("residues"), F.count("_d").alias("distinct_sequences")
    )


def heavy_keys(totals: DataFrame, total_rows: int, share_percent: int = 2) -> DataFrame:
    """The non-null keys that hold at least ``share_percent`` of all rows (an exact test on whole numbers)."""
    return totals.where(F.col("key_value").isNotNull() & (F.col("members") * 100 >= F.lit(total_rows) * share_percent))
