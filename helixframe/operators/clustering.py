"""Sequence clusters by shared k-mers, and removal of what a benchmark's clusters touch.

An aligner is not at hand on a cluster of plain executors: identity and coverage are measured on k-mer sets, so the
thresholds are shares of k-mers, not of aligned residues.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import kernels as K
from helixframe.operators.links import compose, decontaminate
from helixframe.util import materialize, release, spread


def least_kmers(df: DataFrame, key: str, seq: str, k: int, picks: int) -> DataFrame:
    """The ``picks`` least-hashed distinct runs of k bytes of each text, one row each: key, h. No row for shorter texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for big in batches for p in K.steps(big)):
            rec, h = K.byte_runs(*K.text_bytes(b.column(1)), k)
            rec, h, _ = K.unique_pairs(rec, h)
            n = np.bincount(rec, minlength=b.num_rows)
            keep = np.arange(len(rec)) - (np.cumsum(n) - n)[rec] < picks
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rec[keep])), pa.array(h[keep].view(np.int64))], ["key", "h"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, seq).mapInArrow(run, f"key {kind}, h long")


def held_share(df: DataFrame, a: str, b: str, keep: list[str], k: int) -> DataFrame:
    """``keep`` and ``share``: the part of the distinct runs of k bytes of text ``a`` that text ``b`` has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in (p for big in batches for p in K.steps(big)):
            sides = []
            for c in (0, 1):
                rec, h = K.byte_runs(*K.text_bytes(p.column(c)), k)
                sides.append(K.unique_pairs(rec, h)[:2])
            both = [np.concatenate(x) for x in zip(*sides)]
            rec, _, times = K.unique_pairs(*both)
            common = np.bincount(rec[times == 2], minlength=p.num_rows)
            share = common / np.maximum(np.bincount(sides[0][0], minlength=p.num_rows), 1)
            yield pa.RecordBatch.from_arrays([*(p.column(i + 2) for i in range(len(keep))), pa.array(share)], [*keep, "share"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(a, b, *keep).mapInArrow(run, f"{schema}, share double")


def linear_clusters(df: DataFrame, key: str, seq: str, share: float = 0.5, coverage: float = 0.8, k: int = 6, picks: int = 20) -> DataFrame:
    """CLU1: member, rep: one row a row of ``df`` with a sequence, in time linear in the k-mers.

    Each sequence gives its ``picks`` least-hashed k-mers; of the sequences with one such k-mer the longest (ties: the
    least key) is the centre, all others are compared with that centre only. A member joins the longest centre of
    which it holds ``share`` of its k-mers and at least ``coverage`` of the length; centres that joined others pass
    their members on. Centres are found by an aggregate, so a k-mer that most rows share costs no more than any other.
    Sequences without a partner, also those shorter than k, represent themselves. Null and empty ones have no row.
    """
    base = df.where(F.col(key).isNotNull() & (F.length(seq) > 0)).select(F.col(key).alias("member"), F.col(seq).alias("_s"), F.length(seq).alias("_n"))
    base = materialize(spread(base), "sequences")
    least = least_kmers(base, "member", "_s", k, picks)
    picked = least.join(base.select(F.col("member").alias("_m"), "_n"), F.col("key") == F.col("_m")).select(F.col("key").alias("member"), "_n", F.col("h").alias("_k"))
    picked = materialize(picked, "kmers")
    centre = picked.groupBy("_k").agg(F.min(F.struct((-F.col("_n")).alias("a"), F.col("member").alias("b"))).alias("_c")).select(F.col("_k").alias("_q"), F.col("_c.b").alias("_rep"))
    cand = picked.join(centre, F.col("_k") == F.col("_q")).where("member <> _rep").select("member", "_rep").distinct()
    a = base.select(F.col("member").alias("_m"), F.col("_s").alias("_sa"), F.col("_n").alias("_na"))
    b = base.select(F.col("member").alias("_r"), F.col("_s").alias("_sb"), F.col("_n").alias("_nb"))
    j = cand.join(a, F.col("member") == F.col("_m")).join(b, F.col("_rep") == F.col("_r"))
    j = j.where((F.col("_na") >= coverage * F.col("_nb")) & ((F.col("_nb") > F.col("_na")) | ((F.col("_nb") == F.col("_na")) & (F.col("_rep") < F.col("member")))))
    ok = held_share(j, "_sa", "_sb", ["member", "_rep", "_nb"], k).where(F.col("share") >= share)
    best = ok.groupBy("member").agg(F.min(F.struct((-F.col("_nb")).alias("a"), F.col("_rep").alias("b"))).alias("_x")).select(F.col("member").alias("_m"), F.col("_x.b").alias("_to"))
    out = materialize(base.join(best, F.col("member") == F.col("_m"), "left").select("member", F.coalesce("_to", "member").alias("rep")), "clusters")
    while True:
        moved = out.join(out.select(F.col("member").alias("_m"), F.col("rep").alias("_r")), F.col("rep") == F.col("_m")).where("rep <> _r").limit(1).count()
        if not moved:
            return out
        nxt = materialize(compose(out, out), "clusters")
        release(out)
        out = nxt


def cascaded_clusters(df: DataFrame, key: str, seq: str, first: float = 0.65, second: float = 0.5, k: int = 6) -> DataFrame:
    """CLU2: a strict stage, then a loose stage over its representatives, composed to member -> rep."""
    one = linear_clusters(df, key, seq, first, 0.85, k)
    reps = one.select("rep").distinct()
    left = df.join(reps, F.col(key) == F.col("rep"), "left_semi")
    return compose(one, linear_clusters(left, key, seq, second, 0.75, k))


def remove_benchmark(corpus: DataFrame, benchmark: DataFrame, key: str, seq: str, share: float = 0.5, coverage: float = 0.8, k: int = 6) -> DataFrame:
    """CLU3: corpus rows in no cluster that a benchmark sequence touches. Keys of both sides must differ."""
    both = corpus.select(key, seq).union(benchmark.select(key, seq))
    clusters = linear_clusters(both, key, seq, share, coverage, k)
    clean = decontaminate(clusters, benchmark.select(F.col(key).alias("id"))).select("member")
    return corpus.join(clean, F.col(key) == F.col("member"), "left_semi")
