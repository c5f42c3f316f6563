"""Views and SQL fragments shared by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.util import family_key, residues, table

T = table


def pf(spark: SparkSession, d: str) -> DataFrame:
    """pfam_sorted with residues and accession in compared form."""
    return T(spark, d, "pfam_sorted").select("row_id", residues("sequence").alias("seq"), family_key("family_id").alias("fam"), "domain_id", "clan_id", "group_id")


def tdp(spark: SparkSession, d: str) -> DataFrame:
    """test_data_prep with assay ids in compared form and NaN scores as null."""
    return T(spark, d, "test_data_prep").select(
        "row_id", F.upper(F.regexp_replace("DMS_id", r"^\s+|\s+$", "")).alias("dms_id"), residues("mutated_sequence").alias("mutant"), residues("target_seq").alias("target"),
        F.when(~F.isnan("DMS_score"), F.col("DMS_score")).alias("score"), "stage")


def dms(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "dms_cosent").select("row_id", residues("sentence_0").alias("s0"), residues("sentence_1").alias("s1"), F.when(~F.isnan("score"), F.col("score")).alias("score"))


SEQ = "upper(regexp_replace({c}, '[^A-Za-z]', '', 'g'))"
PF = rf"""pf AS (SELECT row_id, {SEQ.format(c='sequence')} AS seq, split_part(upper(regexp_replace(family_id, '^\s+|\s+$', '', 'g')), '.', 1) AS fam,
  domain_id, clan_id, group_id FROM pfam_sorted)"""
TDP = rf"""tdp AS (SELECT row_id, upper(regexp_replace(DMS_id, '^\s+|\s+$', '', 'g')) AS dms_id, {SEQ.format(c='mutated_sequence')} AS mutant,
  {SEQ.format(c='target_seq')} AS target, CASE WHEN NOT isnan(DMS_score) THEN DMS_score END AS score, stage FROM test_data_prep)"""
DMS = f"dms AS (SELECT row_id, {SEQ.format(c='sentence_0')} AS s0, {SEQ.format(c='sentence_1')} AS s1, CASE WHEN NOT isnan(score) THEN score END AS score FROM dms_cosent)"
