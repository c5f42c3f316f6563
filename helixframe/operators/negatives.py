"""Hard negatives: members of a family made unlikely by substitutions its profile dislikes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Total log-odds drop, least substitutions, divisor of the length for spacing.
THRESHOLD, LEAST, SPACING = -16.0, 6, 8
POOL_LIMIT = -1.0
AMINO = "ACDEFGHIKLMNPQRSTVWY"
#: Rows of a family in one task; a larger family is cut into slices, each with a copy of the profile.
SLICE = 20_000


def profile_table(df: DataFrame, family: str, seq: str) -> DataFrame:
    """Position-specific log-odds of each family's own members: family, pos, aa, log_odds (half a count added to each cell).

    For families without a profile library; every position up to the longest member's last is counted.
    """
    cells = df.where(F.col(family).isNotNull() & F.col(seq).isNotNull()).select(F.col(family).alias("family"), F.posexplode(F.split(F.col(seq), "")).alias("pos", "aa")).where(F.col("aa").rlike("[ACDEFGHIKLMNPQRSTVWY]"))
    n = cells.groupBy("family", "pos", "aa").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(F.col("family").alias("_f"), F.col("pos").alias("_p")).agg(F.sum("n").alias("_t"))
    grid = total.select("_f", "_p", "_t", F.explode(F.array(*[F.lit(a) for a in AMINO])).alias("_a"))
    j = grid.join(n, (F.col("family") == F.col("_f")) & (F.col("pos") == F.col("_p")) & (F.col("aa") == F.col("_a")), "left")
    odds = F.log2((F.coalesce("n", F.lit(0)) + 0.5) / (F.col("_t") + 10.0)) - F.log2(F.lit(0.05))
    return j.select(F.col("_f").alias("family"), F.col("_p").alias("pos"), F.col("_a").alias("aa"), odds.alias("log_odds"))


def candidate_pool(df: DataFrame, profiles: DataFrame, key: str, family: str, seq: str, limit: float = POOL_LIMIT) -> DataFrame:
    """Substitutions whose log-odds fall by more than ``-limit``: key, pos, aa, drop. One row a candidate, no Python."""
    own = df.where(F.col(family).isNotNull() & F.col(seq).isNotNull()).select(F.col(key).alias("key"), F.col(family).alias("_f"), F.posexplode(F.split(F.col(seq), "")).alias("_p", "_wt"))
    a = profiles.select(F.col("family").alias("_fa"), F.col("pos").alias("_pa"), F.col("aa").alias("_aa"), F.col("log_odds").alias("_own"))
    b = profiles.select(F.col("family").alias("_fb"), F.col("pos").alias("pos"), "aa", F.col("log_odds").alias("_to"))
    j = own.join(a, (F.col("_f") == F.col("_fa")) & (F.col("_p") == F.col("_pa")) & (F.col("_wt") == F.col("_aa"))).join(b, (F.col("_f") == F.col("_fb")) & (F.col("_p") == F.col("pos")))
    return j.where((F.col("aa") != F.col("_wt")) & (F.col("_to") - F.col("_own") < limit)).select(F.col("key").alias(key), "pos", "aa", (F.col("_to") - F.col("_own")).alias("drop"))


def draw(seq: str, odds: np.ndarray, seed: int, threshold: float = THRESHOLD, least: int = LEAST, tries: int = 16) -> str | None:
    """One hard negative of a sequence, or None.

    Candidates (position, residue) with a drop under POOL_LIMIT are taken in seeded random order, each position once
    and at least max(least, length // SPACING) apart, until at least ``least`` are taken and their drops sum to the
    threshold. Orders are drawn anew up to ``tries`` times; later tries prefer larger drops.
    """
    n = min(len(seq), len(odds))
    if n < 5:
        return None
    wild = np.array([AMINO.find(c) for c in seq[:n]])
    known = wild >= 0
    drop = odds[:n] - odds[np.arange(n), np.maximum(wild, 0)][:, None]
    drop[~known] = 0
    pos, aa = np.nonzero(drop < POOL_LIMIT)
    score = drop[pos, aa]
    if not len(pos):
        return None
    apart = max(least, len(seq) // SPACING)
    rng = np.random.default_rng(seed)
    for t in range(tries):
        order = np.argsort(-rng.exponential(size=len(pos)) * np.abs(score) ** (t / 4), kind="stable")
        taken: list[int] = []
        total = 0.0
        free = np.ones(n, bool)
        for c in order.tolist():
            p = pos[c]
            if not free[p]:
                continue
            taken.append(c)
            total += score[c]
            free[max(0, p - apart + 1) : p + apart] = False
            if len(taken) >= least and total <= threshold:
                out = list(seq)
                for x in taken:
                    out[pos[x]] = AMINO[aa[x]]
                return "".join(out)
    return None


def hard_negatives(df: DataFrame, profiles: DataFrame, key: str, family: str, seq: str, seed: int = 42, threshold: float = THRESHOLD) -> DataFrame:
    """TRN11: key and hard_negative (null where none was found) for rows of families with a profile.

    ``profiles``: family, pos, aa, log_odds. The draw is seeded by the row's key, so it doesn't depend on the order or
    the partitioning. A family with most rows is cut into slices of about SLICE rows, each meeting a copy of the
    family's profile.
    """
    rows = df.where(F.col(family).isNotNull() & (F.length(seq) > 0)).select(F.col(key).cast("string").alias("_key"), F.col(family).alias("_f"), F.col(seq).alias("_s"))
    size = rows.groupBy(F.col("_f").alias("_g")).agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("_slices"))
    cut = rows.join(size, F.col("_f") == F.col("_g")).select("_key", "_f", "_s", F.pmod(F.xxhash64("_key"), F.col("_slices")).cast("int").alias("_slice"))
    prof = profiles.join(size, F.col("family") == F.col("_g")).select(F.col("family").alias("_f"), "pos", "aa", "log_odds", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice"))

    def make(a: pa.Table, b: pa.Table) -> pa.Table:
        keys, out = a.column("_key").to_pylist(), []
        if b.num_rows:
            pos = b.column("pos").to_numpy()
            odds = np.zeros((int(pos.max()) + 1, len(AMINO)))
            odds[pos, [AMINO.index(x) for x in b.column("aa").to_pylist()]] = b.column("log_odds").to_numpy()
            out = [draw(s, odds, xxhash.xxh64_intdigest(k, seed), threshold) for k, s in zip(keys, a.column("_s").to_pylist())]
        else:
            keys = []
        return pa.table({"key": pa.array(keys, pa.string()), "hard_negative": pa.array(out, pa.string())})

    done = cut.groupBy("_f", "_slice").cogroup(prof.groupBy("_f", "_slice")).applyInArrow(make, "key string, hard_negative string")
    kind = df.schema[key].dataType.simpleString()
    return done.select(F.col("key").cast(kind).alias(key), "hard_negative")


def patch_missing(df: DataFrame, made: DataFrame, key: str, column: str = "hard_negative") -> DataFrame:
    """TRN13 / JN9: rows without a value take the newly made one, all others stay as they are."""
    m = made.select(F.col(key).alias("_k"), F.col(column).alias("_v"))
    need = df.where(F.col(column).isNull()).join(m, F.col(key) == F.col("_k"), "left").withColumn(column, F.col("_v")).drop("_k", "_v")
    return df.where(F.col(column).isNotNull()).unionByName(need)
