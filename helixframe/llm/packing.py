"""Problem 1: placing items of varying length in containers of fixed capacity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.ranks import salted_rank
from helixframe.util import materialize, residues, table

CAPACITY = 1024


class Plan:
    """What the rounds decided: which interval of a gap class takes which interval of a size class.

    A gap class g is a queue of containers with g free units, numbered as they enter. A row of ``chunks`` says: numbers
    [from, from + n) of class g take items [item, item + n) of size s and enter class g - s at number ``to``.
    """

    def __init__(self, bins: int, capacity: int, chunks: list[tuple[int, int, int, int, int, int]]):
        a = np.array(chunks, dtype=np.int64).reshape(-1, 6)
        key = (a[:, 0] << 44) | a[:, 1]
        a = a[np.argsort(key, kind="stable")]
        self.bins, self.capacity = bins, capacity
        self.key, self.n, self.size, self.item, self.to = np.sort(key), a[:, 2].copy(), a[:, 3].copy(), a[:, 4].copy(), a[:, 5].copy()

    def contents(self, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """size, item number in its size class, container and offset of everything placed in ``bins``."""
        out = []
        gap, at, who = np.full(len(bins), self.capacity, np.int64), bins.astype(np.int64), bins.astype(np.int64)
        while len(who) and len(self.key):
            k = np.searchsorted(self.key, (gap << 44) | at, side="right") - 1
            low = np.maximum(k, 0)
            step = at - (self.key[low] & ((1 << 44) - 1))
            hit = (k >= 0) & ((self.key[low] >> 44) == gap) & (step < self.n[low])
            gap, at, who, low, step = gap[hit], at[hit], who[hit], low[hit], step[hit]
            out.append((self.size[low], self.item[low] + step, who, self.capacity - gap))
            gap, at = gap - self.size[low], self.to[low] + step
        if not out:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate(c) for c in zip(*out))


def best_fit_rounds(sizes: dict[int, int], capacity: int) -> Plan:
    """Bulk-synchronous best fit over range-sorted size and gap classes.

    Each round sorts the unplaced items and the gaps by size and sweeps upwards: a gap takes the largest waiting item
    that fits (so each item goes to its nearest successor among the gaps); of several items and gaps of equal size the
    one of lower rank comes first. Then gaps shrink and the next round begins. When nothing fits any more, as many
    containers are opened as the waiting items fill at least. Sizes are whole numbers up to the capacity, so items and
    gaps of equal size are swept as one interval of ranks: a round costs O(capacity), whatever the number of items.
    """
    wait = np.zeros(capacity + 1, np.int64)
    for s, n in sizes.items():
        wait[s] += n
    used = np.zeros(capacity + 1, np.int64)
    head, tail = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
    chunks: list[tuple[int, int, int, int, int, int]] = []
    weight = np.arange(capacity + 1)
    while wait.any():
        free = tail - head
        placed = False
        stack: list[int] = []
        for v in np.flatnonzero((wait > 0) | (free > 0)).tolist():
            if wait[v] > 0 and v:
                stack.append(v)
            n = int(free[v])
            while n and stack:
                s = stack[-1]
                m = min(n, int(wait[s]))
                left = v - s
                chunks.append((v, int(head[v]), m, s, int(used[s]), int(tail[left])))
                head[v] += m
                tail[left] += m
                used[s] += m
                wait[s] -= m
                n -= m
                placed = True
                if not wait[s]:
                    stack.pop()
        if not placed:
            tail[capacity] += max(1, -(-int((wait * weight).sum()) // capacity))
    bins = sum(c[2] for c in chunks if c[0] == capacity)
    return Plan(bins, capacity, chunks)


def pack(items: DataFrame, id_col: str, length: F.Column, capacity: int = CAPACITY) -> DataFrame:
    """Place every item of positive length in containers of ``capacity``; only longer items are cut.

    Method: bulk-synchronous best fit (``best_fit_rounds``). Items are range-sorted into size classes and ranked there;
    only the class counts (at most ``capacity`` numbers) reach the driver. The rounds' decisions are intervals of
    ranks, which all tasks follow on their own: containers derive their contents from the plan, and one join on
    (size, rank) brings items and places together. Two shuffles in all, of ids and lengths.

    Output: the id, piece (0-based), train_row, position (offset in the container), length of the piece.
    Defined results: null, zero or negative lengths have no row; an item longer than the capacity is cut into full
    pieces and a rest; ties in length are broken by a hash of
    id and piece, then by them; repeated ids are items of their own; a null id is
    packed like any other; an empty table gives no rows.
    """
    spark = items.sparkSession
    n = F.col("_n")
    parts = (
        items.select(F.col(id_col).alias("_id"), length.cast("long").alias("_n"))
        .where(n > 0)
        .select("_id", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / capacity).cast("int"))).alias("piece"), "_n")
        .select("_id", "piece", F.least(n - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("_size"))
    )
    parts = materialize(parts, "pieces")
    counts = {r["_size"]: r["n"] for r in parts.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit_rounds(counts, capacity)
    ranked = salted_rank(parts, ["_size"], ["_id", "piece"], "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank, row, offset = plan.contents(b.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(size.astype(np.int32)), pa.array(rank), pa.array(row), pa.array(offset.astype(np.int32))], ["_s", "_r", "train_row", "position"])

    places = spark.range(plan.bins).mapInArrow(place, "_s int, _r long, train_row long, position int")
    joined = ranked.join(places, (F.col("_size") == F.col("_s")) & (F.col("_rank") == F.col("_r")))
    return joined.select(F.col("_id").alias(id_col), "piece", "train_row", "position", F.col("_size").alias("length"))


def p1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row and position of every record of dataset_info."""
    return pack(table(spark, sf_dir, "dataset_info"), "row_id", F.length(residues("sequence")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that the packing had to cut."""
    return p1_rows(spark, sf_dir).where("piece > 0").select("row_id").distinct()


def p1_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the training rows are filled."""
    rows = p1_rows(spark, sf_dir).groupBy("train_row").agg(F.sum("length").alias("used"))
    return rows.agg(
        F.count(F.lit(1)).alias("train_rows"), F.sum("used").alias("residues"), (F.lit(CAPACITY) * F.count(F.lit(1)) - F.sum("used")).alias("padding")
    )


QUERIES = {"p1_found": p1_found, "p1_rows": p1_rows, "p1_fill": p1_fill}
SQL = {"p1_found": "SELECT row_id FROM dataset_info WHERE length(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) > 1024"}
