"""Whole preparations, put together from the operators: DataFrames in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.portable import hash_cap
from helixframe.operators import assays as A
from helixframe.operators import corpus as C
from helixframe.operators import links as L
from helixframe.operators.clustering import cascaded_clusters, linear_clusters, remove_benchmark
from helixframe.operators.negatives import hard_negatives, patch_missing
from helixframe.operators.sampling import sample_per_group

# Prefixes of the assays that a common benchmark holds.
OVERLAP_PREFIXES = ["GB1_", "GFP_AEQVI_"]


def family_corpus(records: DataFrame, parents: DataFrame | None = None, cluster: bool = False, share: float = 0.7) -> DataFrame:
    """Family corpus: row_id, sequence, family_id, domain_id, clan_id, group_id, only valid rows of groups of two or more.

    ``records``: row_id, sequence, family_id, domain_id; ``parents``: family_id, clan_id. A family without a parent is
    its own; the family is the group. With ``cluster`` only cluster representatives stay.
    """
    df = C.require_columns(C.normalize_columns(records), ["row_id", "sequence", "family_id"])
    if cluster:
        reps = linear_clusters(df, "row_id", "sequence", share).select(F.col("rep")).distinct()
        df = df.join(reps, F.col("row_id") == F.col("rep"), "left_semi")
    df = C.attach_parent(df, parents, "family_id", "clan_id") if parents is not None else df.withColumn("clan_id", F.col("family_id"))
    df = C.valid_rows(df.withColumn("group_id", F.col("family_id")))
    return C.frequent(df, "group_id", 2)


def structural_corpus(proteins: DataFrame, structure: DataFrame, limit_rows: int = 0) -> DataFrame:
    """Structure-clustered corpus: sequence, cluster_id, afdb50_cluster_id, group_id.

    ``proteins``: repId, sequence, plddt, fragment; ``structure``: foldseek_rep, entry_id. Quality gate, inner join of
    representative to map entry, one row each match; the structural representative is the group, singletons go.
    """
    good = proteins.where((F.col("plddt") > 70) & (F.col("fragment") == 0)).select("repId", "sequence")
    j = good.join(structure.select("foldseek_rep", "entry_id"), F.col("repId") == F.col("entry_id"))
    df = j.select("sequence", F.col("foldseek_rep").alias("cluster_id"), F.col("repId").alias("afdb50_cluster_id")).withColumn("group_id", F.col("cluster_id"))
    df = hash_cap(C.valid_rows(df), limit_rows, 42, "afdb50_cluster_id", "cluster_id", "sequence")
    return C.drop_redundant(C.frequent(df, "group_id", 2), "cluster_id", "group_id")


def interactions(links: DataFrame, sequences: DataFrame, benchmark: DataFrame | None = None, clusters: DataFrame | None = None, least_score: int = 400, max_rows: int = 0, low: int = 10, high: int = 1024) -> DataFrame:
    """Interaction pairs between clusters: seq1, seq2, in hash order.

    ``links``: protein1, protein2, combined_score; ``sequences``: id, sequence; ``clusters``: member, rep (made here
    where not given). Score threshold, endpoint filter before the clustering, removal of what a benchmark's clusters
    touch, links between different clusters only, the best link of each pair of clusters (ties by the proteins), cap by
    score, both sequences, length band, shuffle.
    """
    strong = links.where(F.col("combined_score") >= least_score)
    seqs = L.keep_ids(sequences.select("id", "sequence"), L.endpoints(strong, "protein1", "protein2", "id"), "id")
    if benchmark is not None:
        seqs = remove_benchmark(seqs, benchmark.select("id", "sequence"), "id", "sequence")
    clusters = cascaded_clusters(seqs, "id", "sequence") if clusters is None else clusters
    best = L.best_pairs(L.cluster_links(strong, clusters, "protein1", "protein2", "member", "rep"), "clu1", "clu2", "combined_score", ["protein1", "protein2"])
    if max_rows > 0:
        best = best.orderBy(F.desc("combined_score"), "protein1", "protein2").limit(max_rows)
    pairs = C.length_band(L.attach_both(best, seqs, "protein1", "protein2", "id", "sequence"), ["seq1", "seq2"], low, high)
    return C.check_clean(pairs.select("seq1", "seq2"), ["seq1", "seq2"])


def scored_pairs(continuous: list[DataFrame], clinical: list[DataFrame], exclude: bool = True, drop_fold: bool = True, least: int = 1, cap: int = 0, inside: int = 0) -> DataFrame:
    """Scored pairs (mutant, wild type, score in [0, 1]) of all assays: sentence_0, sentence_1, score.

    ``continuous``: row_id, DMS_id, mutated_sequence, target_seq, DMS_score; ``clinical``: row_id, mutated_sequence,
    target_seq, annotation, protein_id. Benchmark assays by prefix, test folds, small assays and, last, every pair of a
    test fold are removed; ``cap`` rows an assay; ``inside`` pairs of two mutants of an assay (score 1 - |difference|).
    """
    parts, forbidden = [], []

    def without_test(df: DataFrame, group: str) -> DataFrame:
        column = A.split_column(df) if drop_fold else None
        if not drop_fold:
            return df
        flagged = df.withColumn("is_test", C.split_form(column) == "test") if column else A.fold_flags(df, group, "mutated_sequence")
        forbidden.append(flagged.where("is_test").select(F.col("mutated_sequence").alias("sentence_0"), F.col("target_seq").alias("sentence_1")))
        return A.drop_test_sequences(flagged, group, "mutated_sequence")

    for df in continuous:
        df = C.exclude_prefixes(df, "DMS_id", OVERLAP_PREFIXES) if exclude else df
        df = A.scaled_scores(without_test(df, "DMS_id"), "DMS_id", "DMS_score", "score")
        df = sample_per_group(C.frequent(df, "DMS_id", least) if least > 1 else df, ["DMS_id"], cap, 42, "row_id")
        parts.append(df.select(F.col("mutated_sequence").alias("sentence_0"), F.col("target_seq").alias("sentence_1"), "score"))
        if inside > 0:
            p = A.pairs_inside(df.withColumn("_both", F.struct("mutated_sequence", "score")), "DMS_id", "_both", "row_id", inside)
            parts.append(p.select(F.col("left.mutated_sequence").alias("sentence_0"), F.col("right.mutated_sequence").alias("sentence_1"), (1 - F.abs(F.col("left.score") - F.col("right.score"))).alias("score")))
    for df in clinical:
        df = without_test(df, "protein_id").withColumn("score", A.label_score("annotation")).where("score is not null")
        parts.append(df.select(F.col("mutated_sequence").alias("sentence_0"), F.col("target_seq").alias("sentence_1"), "score"))
    if not parts:
        raise ValueError("no assays given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if forbidden:
        bad = forbidden[0]
        for f in forbidden[1:]:
            bad = bad.unionByName(f)
        out = A.forbid_pairs(out, bad, ["sentence_0", "sentence_1"])
    return out


def with_hard_negatives(corpus: DataFrame, profiles: DataFrame, per_family: int = 100, max_rows: int = 0, tolerance: float = 0.10, missing_only: bool = False, threshold: float = -16.0) -> DataFrame:
    """Corpus rows with hard_negative (null where none was found).

    Families whose median length fits their profile's, sequences of 6 to 1,023 residues, at most ``per_family`` rows of
    a family (hash order) and ``max_rows`` in all. With ``missing_only`` all rows stay and only null values are filled.
    """
    if missing_only:
        need = corpus.where("hard_negative is null")
        return patch_missing(corpus, hard_negatives(need, profiles, "row_id", "family_id", "sequence", threshold=threshold), "row_id")
    models = profiles.groupBy(F.col("family").alias("family_id")).agg((F.max("pos") + 1).alias("model_length"))
    fit = C.median_tolerance(corpus, models, "family_id", "sequence", tolerance).select(F.col("family_id").alias("_f"))
    df = C.length_band(corpus.join(fit, F.col("family_id") == F.col("_f"), "left_semi"), ["sequence"], 5, 1024, closed=False)
    df = hash_cap(sample_per_group(df, ["family_id"], per_family, 42, "row_id"), max_rows, 42, "row_id")
    made = hard_negatives(df, profiles, "row_id", "family_id", "sequence", threshold=threshold).select(F.col("row_id").alias("_r"), "hard_negative")
    return df.join(made, F.col("row_id") == F.col("_r"), "left").drop("_r")
