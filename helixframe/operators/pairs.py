"""Training sets: positive pairs, labelled examples, self-pairs, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.portable import hash_cap, nan_to_null
from helixframe.operators.sampling import sample_per_group
from helixframe.util import materialize


def runs(df: DataFrame, group: str, order: list[str], name: str = "run_id") -> DataFrame:
    """WIN8 / T1: number of the run of equal neighbouring groups, in a stated order of all rows.

    The order is cut into range partitions; a run starts where the row before differs. Only the last group and the
    number of starts of each partition cross partitions, so no task sees all rows.
    """
    cols = [F.col(c).asc_nulls_last() for c in order]
    p = materialize(df.repartitionByRange(*cols).withColumn("_p", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("_p").orderBy(*cols)
    q = p.withColumn("_first", F.row_number().over(w) == 1).withColumn("_start", (~F.lag(group).over(w).eqNullSafe(F.col(group))).cast("int"))
    q = q.withColumn("_run", F.sum(F.when(F.col("_first"), 0).otherwise(F.col("_start"))).over(w))
    ends = q.groupBy("_p").agg(F.max("_run").alias("_n"), F.min_by(group, F.struct(*order)).alias("_g0"), F.max_by(group, F.struct(*order)).alias("_g1"))
    v = Window.orderBy("_p")
    join = F.when(F.lag("_p").over(v).isNull() | ~F.lag("_g1").over(v).eqNullSafe(F.col("_g0")), 1).otherwise(0)
    base = ends.withColumn("_j", join).withColumn("_m", F.coalesce(F.lag("_n").over(v), F.lit(0)) + F.col("_j"))
    base = base.select(F.col("_p").alias("_b"), (F.sum("_m").over(v.rowsBetween(Window.unboundedPreceding, 0))).alias("_base"))
    return q.join(F.broadcast(base), F.col("_p") == F.col("_b")).withColumn(name, F.col("_run") + F.col("_base")).drop("_p", "_first", "_start", "_run", "_b", "_base")


def positive_pairs(df: DataFrame, seq: str, group: str, key: str, per_group: int = 30, max_pairs: int = 0, negative: str | None = None, seed: int = 42) -> DataFrame:
    """TRN1: pairs of sequences of one group: group, id_0, id_1, sentence_0, sentence_1[, sentence_2].

    At most ``per_group`` sequences of a group are paired (hash order), so a group gives at most C(per_group, 2) pairs
    whatever its size; ``max_pairs`` caps the whole (0: none). ``sentence_2`` is the anchor's negative, empty where it
    has none. Rows without sequence or group take no part.
    """
    base = df.where(F.col(seq).isNotNull() & (F.length(seq) > 0) & F.col(group).isNotNull())
    cols = [F.col(key).alias("id_0"), F.col(group).alias("_g0"), F.col(seq).alias("sentence_0")]
    extra = [F.coalesce(F.col(negative), F.lit("")).alias("sentence_2")] if negative else []
    kept = sample_per_group(base, [group], per_group, seed, key)
    a = kept.select(*cols, *extra)
    b = kept.select(F.col(key).alias("id_1"), F.col(group).alias("_g1"), F.col(seq).alias("sentence_1"))
    j = a.join(b, (F.col("_g0") == F.col("_g1")) & (F.col("id_0") < F.col("id_1")))
    out = j.select(F.col("_g0").alias(group), "id_0", "id_1", "sentence_0", "sentence_1", *(["sentence_2"] if negative else []))
    return hash_cap(out, max_pairs, seed, "id_0", "id_1")


def labelled_examples(df: DataFrame, seq: str, label: str, key: str, least: int = 6, per_label: int = 25, max_rows: int = 0, seed: int = 42) -> DataFrame:
    """TRN2: key, sentence, label (0-based, by sorted name), class_name. Labels under ``least`` rows go; 0 means no cap.

    Label counts are those of the rows after ``max_rows``. Raises where no label survives.
    """
    from helixframe.operators.corpus import indexed

    rows = hash_cap(df.where(F.col(seq).isNotNull() & (F.length(seq) > 0) & F.col(label).isNotNull()).select(key, seq, label), max_rows, seed, key)
    names = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    if names.limit(1).count() == 0:
        raise ValueError("no label has enough rows")
    coded = indexed(names.select(F.col(label).alias("class_name")), ["class_name"], "label_id")
    j = rows.join(coded, F.col(label) == F.col("class_name"))
    kept = sample_per_group(j, ["class_name"], per_label, seed, key)
    return kept.select(key, F.col(seq).alias("sentence"), F.col("label_id").alias("label"), "class_name")


def self_pairs(df: DataFrame, seq: str, key: str, max_rows: int = 0, seed: int = 42) -> DataFrame:
    """TRN3: each sequence with itself: key, sentence_0, sentence_1, is_simcse."""
    rows = hash_cap(df.where(F.col(seq).isNotNull() & (F.length(seq) > 0)).select(key, seq), max_rows, seed, key)
    return rows.select(key, F.col(seq).alias("sentence_0"), F.col(seq).alias("sentence_1"), F.lit(True).alias("is_simcse"))


def scored_pairs(df: DataFrame, key: str, max_rows: int = 0) -> DataFrame:
    """TRN4: the first rows by key with the three columns only; a NaN score is null."""
    out = df.select(key, "sentence_0", "sentence_1", nan_to_null("score").alias("score"))
    return out.orderBy(key).limit(max_rows) if max_rows > 0 else out


def steps_per_epoch(sizes: DataFrame, batch: int, ranks: int = 1, drop_last: bool = True, round_robin: bool = True) -> DataFrame:
    """TRN6: sources, steps (all ranks) and steps_per_rank from (source, rows)."""
    q = F.col("rows") / F.lit(batch)
    b = sizes.select((F.floor(q) if drop_last else F.ceil(q)).alias("b"))
    total = F.min("b") * F.count(F.lit(1)) if round_robin else F.sum("b")
    return b.agg(F.count(F.lit(1)).alias("sources"), total.alias("steps")).withColumn("steps_per_rank", F.greatest(F.ceil(F.col("steps") / ranks), F.lit(1)))


def divisible_batch(sizes: DataFrame, target: int, limit: int, ranks: int) -> DataFrame:
    """TRN7: least batch in [target, limit] for which every source's whole batches divide by the ranks, null if none."""
    b = sizes.select("rows", F.explode(F.sequence(F.lit(target), F.lit(limit))).alias("batch"))
    ok = b.groupBy("batch").agg(F.max(F.pmod(F.floor(F.col("rows") / F.col("batch")), F.lit(ranks))).alias("rest"), F.min(F.floor(F.col("rows") / F.col("batch"))).alias("n"))
    return ok.where("rest = 0 and n > 0").agg(F.min("batch").alias("batch"))


def interleave(df: DataFrame, source: str, key: str, batch: int, seed: int = 42) -> DataFrame:
    """TRN9: batch_id inside the source and position of the batch in the round-robin order over sources.

    Rows of a source are dealt to batches in hash order; turn = batch_id * sources + rank of the source.
    Sources that run out end the rounds, so only batches that every source has, and full ones, are kept.
    """
    from helixframe.operators.corpus import indexed
    from helixframe.functions.portable import stable_hash

    names = df.select(source).distinct().withColumn("_k", F.dense_rank().over(Window.orderBy(source)) - 1).select(F.col(source).alias("_src"), "_k")
    place = indexed(df.withColumn("_h", stable_hash(seed, key)), [source, "_h", key], "_idx")
    size = df.groupBy(source).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(source).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    size = size.withColumn("_full", F.floor(F.min("_n").over(Window.partitionBy()) / batch)).withColumn("_s", F.count(F.lit(1)).over(Window.partitionBy()))
    size = size.select(F.col(source).alias("_z"), "_before", "_full", "_s")
    j = place.join(size, F.col(source) == F.col("_z")).join(names, F.col(source) == F.col("_src"))
    j = j.withColumn("batch_id", F.floor((F.col("_idx") - F.col("_before")) / batch)).where("batch_id < _full")
    return j.select(source, key, "batch_id", (F.col("batch_id") * F.col("_s") + F.col("_k")).alias("turn"))


def proportional(df: DataFrame, source: str, key: str, batch: int, seed: int = 42) -> DataFrame:
    """TRN9: batches of all sources spread evenly over the epoch: batch_id inside the source and turn over all.

    Every source gives all its full batches; the b-th of n stands at the share (b + 1/2) / n of the epoch, ties by
    source, so a source comes up in proportion to its rows. Null sources are left out.
    """
    from helixframe.functions.portable import stable_hash
    from helixframe.operators.corpus import indexed
    from helixframe.operators.running import running

    one = df.where(F.col(source).isNotNull()).select(source, key, stable_hash(seed, key).alias("_h")).withColumn("__one", F.lit(1))
    dealt = running(one, [source], ["_h", key], {"_at": "__one"}).withColumn("batch_id", F.floor((F.col("_at") - 1) / batch))
    full = dealt.groupBy(F.col(source).alias("_s"), F.col("batch_id").alias("_b")).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") == batch)
    many = full.groupBy(F.col("_s").alias("_z")).agg(F.count(F.lit(1)).alias("_n"))
    share = full.join(many, F.col("_s") == F.col("_z")).select("_s", "_b", F.round((F.col("_b") + 0.5) / F.col("_n"), 12).alias("_share"))
    turn = indexed(share, ["_share", "_s", "_b"], "turn").select("_s", "_b", "turn")
    return dealt.join(turn, (F.col(source) == F.col("_s")) & (F.col("batch_id") == F.col("_b"))).select(source, key, "batch_id", "turn")


def distinct_batches(df: DataFrame, text: str, key: str, batch: int, seed: int = 42) -> DataFrame:
    """TRN9: full batches in which no text repeats: key, batch_id.

    The n-th copy of a text (in hash order) goes to block n; a block has each text once and is cut into batches, its
    incomplete rest is left out as the last batch of an epoch is.
    """
    from helixframe.functions.portable import stable_hash
    from helixframe.operators.running import running

    one = df.where(F.col(text).isNotNull()).select(key, F.md5(F.col(text).cast("binary")).alias("_t"), stable_hash(seed, key).alias("_h")).withColumn("__one", F.lit(1))
    copies = running(one, ["_t"], ["_h", key], {"_block": "__one"}).select(key, "_h", "_block", "__one")
    placed = running(copies, ["_block"], ["_h", key], {"_at": "__one"})
    size = copies.groupBy(F.col("_block").alias("_b")).agg(F.floor(F.count(F.lit(1)) / batch).alias("_full"))
    first = size.withColumn("_first", F.coalesce(F.sum("_full").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    j = placed.join(first, F.col("_block") == F.col("_b")).withColumn("_n", F.floor((F.col("_at") - 1) / batch)).where("_n < _full")
    return j.select(key, (F.col("_first") + F.col("_n")).alias("batch_id"))


def label_batches(df: DataFrame, label: str, key: str, per_label: int, labels: int, seed: int = 42) -> DataFrame:
    """TRN9: batches of ``labels`` labels with ``per_label`` rows each: key, label, batch_id.

    Rows of a label are dealt to sets of ``per_label`` in hash order; complete sets of different labels, in the order of
    their number and hash, make the batches.
    """
    from helixframe.functions.portable import stable_hash
    from helixframe.operators.corpus import indexed
    from helixframe.operators.running import running

    one = df.where(F.col(label).isNotNull()).select(key, label, stable_hash(seed, key).alias("_h")).withColumn("__one", F.lit(1))
    dealt = running(one, [label], ["_h", key], {"_at": "__one"}).withColumn("_set", F.floor((F.col("_at") - 1) / per_label))
    full = dealt.groupBy(F.col(label).alias("_l"), F.col("_set").alias("_s")).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") == per_label)
    order = indexed(full.withColumn("_o", stable_hash(seed, "_l", "_s")), ["_s", "_o", "_l"], "_i").select("_l", "_s", F.floor(F.col("_i") / labels).alias("batch_id"))
    return dealt.join(order, (F.col(label) == F.col("_l")) & (F.col("_set") == F.col("_s"))).select(key, label, "batch_id")


def file_budget(cap: int, files: int) -> int:
    """TRN10: rows a file may give of a common cap; 0 stays no cap."""
    return cap // max(1, files) if cap > 0 else 0


def step_estimate(rows: int, batch: int, epochs: int = 1, ranks: int = 1) -> int:
    """TRN8: optimizer steps from the rows, at least one."""
    return max(1, rows * epochs // max(1, batch * ranks))
