"""Interaction links: endpoint filters, cluster lookups, canonical pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def endpoints(links: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """JN12: all ids that occur at either end."""
    return links.select(F.col(a).alias(name)).union(links.select(F.col(b))).where(F.col(name).isNotNull()).distinct()


def keep_ids(df: DataFrame, ids: DataFrame, key: str, inside: bool = True) -> DataFrame:
    """SRC7 / JN11 / CLU5: rows whose key is (not) among the ids, by semi or anti join."""
    k = ids.select(F.col(key).alias("_k"))
    return df.join(k, F.col(key) == F.col("_k"), "left_semi" if inside else "left_anti")


def cluster_links(links: DataFrame, clusters: DataFrame, a: str, b: str, item: str, cluster: str) -> DataFrame:
    """JN4 / FLT5: links with the cluster of both ends (``clu1``, ``clu2``); links inside a cluster are dropped."""
    one = clusters.select(F.col(item).alias("_i1"), F.col(cluster).alias("clu1"))
    two = clusters.select(F.col(item).alias("_i2"), F.col(cluster).alias("clu2"))
    j = links.join(one, F.col(a) == F.col("_i1")).join(two, F.col(b) == F.col("_i2"))
    return j.where(F.col("clu1") != F.col("clu2")).drop("_i1", "_i2")


def best_pairs(links: DataFrame, a: str, b: str, score: str, tie: list[str]) -> DataFrame:
    """WIN5: one row for each unordered pair ``lo`` < ``hi``: the one of best score, ties by further keys.

    Done as an aggregate (max of a struct of score and negated tie keys can't hold text, so min of a struct with the
    negated score), which combines before the shuffle and so survives a pair that holds most links.
    """
    s = links.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b))
    pick = F.min(F.struct((-F.col(score)).alias("_neg"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(tie)])).alias("_m")
    out = s.groupBy("lo", "hi").agg(pick)
    return out.select("lo", "hi", (-F.col("_m._neg")).alias(score), *[F.col(f"_m._t{i}").alias(t) for i, t in enumerate(tie)])


def attach_both(pairs: DataFrame, texts: DataFrame, a: str, b: str, key: str, text: str) -> DataFrame:
    """JN5: ``seq1`` and ``seq2`` of both ends; pairs without either text are dropped."""
    one = texts.select(F.col(key).alias("_k1"), F.col(text).alias("seq1"))
    two = texts.select(F.col(key).alias("_k2"), F.col(text).alias("seq2"))
    return pairs.join(one, F.col(a) == F.col("_k1")).join(two, F.col(b) == F.col("_k2")).drop("_k1", "_k2")


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """JN14: member -> rep of a two-stage clustering. Both sides: member, rep; a rep without an entry stays."""
    s = second.select(F.col("member").alias("_m"), F.col("rep").alias("_r"))
    return first.join(s, F.col("rep") == F.col("_m"), "left").select("member", F.coalesce("_r", "rep").alias("rep"))


def decontaminate(clusters: DataFrame, protected: DataFrame) -> DataFrame:
    """JN13 / CLU3: members of clusters that no protected id touches, as a member or as the representative.

    ``clusters``: member, rep; ``protected``: id. Protected ids themselves are no corpus rows and are left out.
    The flag is an aggregate by cluster, so a cluster that holds most members is combined before the shuffle.
    """
    p = protected.select(F.col("id").alias("_p")).distinct().withColumn("_hit", F.lit(1))
    ends = clusters.select("member", "rep").union(clusters.select(F.col("rep"), F.col("rep")))
    bad = ends.join(p, F.col("member") == F.col("_p")).select(F.col("rep").alias("_bad")).distinct()
    clean = clusters.join(bad, F.col("rep") == F.col("_bad"), "left_anti")
    return clean.join(p, F.col("member") == F.col("_p"), "left_anti").select("member", "rep")
