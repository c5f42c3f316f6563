"""Queries of problem 2: keys that hold most records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.heavy import heavy_keys, keyed_totals
from helixframe.util import family_key, residues, table


def _totals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "pfam_sorted")
    return rows, keyed_totals(rows, {"family_id": family_key("family_id"), "group_id": F.col("group_id")}, residues("sequence"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, totals = _totals(spark, sf_dir)
    return heavy_keys(totals, rows.count()).select("field_name", "key_value")


def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir)[1]


_BASE = r"""
WITH r AS (
  SELECT upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) AS s,
         split_part(upper(regexp_replace(family_id, '^\s+|\s+$', '', 'g')), '.', 1) AS fam, group_id AS grp
  FROM pfam_sorted),
k AS (SELECT 'family_id' AS field_name, fam AS key_value, s FROM r UNION ALL SELECT 'group_id', grp, s FROM r)
"""

QUERIES = {"p2_found": p2_found, "p2_totals": p2_totals}
SQL = {
    "p2_found": _BASE
    + """SELECT field_name, key_value FROM k WHERE key_value IS NOT NULL GROUP BY 1, 2
    HAVING count(*) * 100 >= 2 * (SELECT count(*) FROM pfam_sorted)""",
    "p2_totals": _BASE
    + """SELECT field_name, key_value, count(*) AS members, CAST(coalesce(sum(length(s)), 0) AS BIGINT) AS residues,
    count(DISTINCT nullif(s, '')) AS distinct_sequences FROM k GROUP BY 1, 2""",
}
