"""Problem 5: the most similar vectors of every vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm import kernels as K
from helixframe.util import materialize, table

DIM, NEIGHBOURS = 64, 5
#: Rows the quantiser is fitted on at most (as few as SEEN for a small table); it gets about 2 * sqrt(rows) lists, at
#: most an eighth of the rows it is fitted on. Every row is indexed.
SAMPLE, SEEN = 262_144, 65_536
PROBES = 24
#: Members a cell may have; a longer list is cut into several cells, all of which are probed.
CELL = 8_192
#: Queries of a group that are meant to meet in one task call; more are dealt to slices, each with the group's members.
VISITS = 400_000
#: Cells of a group, which is scanned in one task call (bits of a mask).
GROUP = 24
#: Column blocks of the rotated vectors, and the width of the test by which candidates are abandoned.
BLOCKS, EPSILON = (16, 32, 64), 2.1
SEED = 7

_MEMBER = np.dtype([("cell", "<i4"), ("near", "<f4"), ("v", "<f4", (DIM,))])
_QUERY = np.dtype([("mask", "<u8"), ("reach", "<f4"), ("v", "<f4", (DIM,))])


def rotation(dim: int = DIM, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every run."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def matrix(col: pa.Array, dim: int = DIM) -> np.ndarray:
    """An array<float> column of fixed length as unit vectors, rotated."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    scale = np.abs(flat).max(axis=1, keepdims=True)
    flat = flat / scale
    return ((flat / np.linalg.norm(flat, axis=1, keepdims=True)) @ rotation(dim).astype(np.float64)).astype(np.float32)


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.maximum(d, 0, out=d)


def block_rows(centres: int) -> int:
    """Rows whose distances to so many centres are held at a time."""
    return max(64, 4_000_000 // max(1, centres))


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    block = block_rows(len(centres))
    lists, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.float32)
    for i in range(0, len(x), block):
        d = square_distances(x[i : i + block], centres)
        lists[i : i + block] = d.argmin(1)
        far[i : i + block] = np.sqrt(d.min(1))
    return lists, far


def fit_centres(x: np.ndarray, n: int, rounds: int = 6, seed: int = SEED) -> np.ndarray:
    """k-means on a bounded sample; an empty list is restarted at the farthest point."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(rounds):
        of, far = nearest(x, centres)
        size = np.bincount(of, minlength=len(centres))
        order = np.argsort(of, kind="stable")
        at = np.r_[0, np.cumsum(size)][:-1]
        full = size > 0
        centres[full] = np.add.reduceat(x[order], at[full], axis=0) / size[full][:, None]
        if (~full).any():
            centres[~full] = x[np.argsort(-far)[: int((~full).sum())]]
    return centres


def group_cells(centres: np.ndarray, most: int = GROUP) -> np.ndarray:
    """Group number of each cell: neighbouring cells together, by halving along the widest axis."""
    out, stack, n = np.zeros(len(centres), np.int64), [np.arange(len(centres))], 0
    while stack:
        part = stack.pop()
        if len(part) <= most:
            out[part] = n
            n += 1
            continue
        x = centres[part]
        order = np.argsort(x[:, np.argmax(x.var(0))], kind="stable")
        stack += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    return out


def best(query: np.ndarray, other: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least distances of each query, ties by the other's number."""
    o = np.lexsort((other, dist, query))
    query, other, dist = query[o], other[o], dist[o]
    start = np.zeros(len(query), np.int64)
    at = K.first_of(query)
    start[at] = at
    keep = np.arange(len(query)) - np.maximum.accumulate(start) < k
    return query[keep], other[keep], dist[keep]


def scan(q: np.ndarray, reach: np.ndarray, m: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adaptive dimension scan of a cell: (query, member, squared distance) of what is not abandoned.

    After each column block the partial distance, scaled to all dimensions, is tested against the query's reach: the
    candidate is given up when it exceeds reach^2 * (1 + epsilon / sqrt(dimensions seen))^2; an infinite epsilon gives
    none up before all dimensions are seen.
    """
    limit = reach.astype(np.float64) ** 2
    allow = lambda b: limit * (b / DIM) * (1 + epsilon / np.sqrt(b)) ** 2
    first = BLOCKS[0]
    part = square_distances(q[:, :first], m[:, :first])
    i, j = np.nonzero(part <= allow(first)[:, None])
    d = part[i, j].astype(np.float64)
    for low, high in zip(BLOCKS, BLOCKS[1:]):
        step = q[i, low:high] - m[j, low:high]
        d += np.einsum("ij,ij->i", step, step)
        ok = d <= (allow(high) if high < DIM else limit)[i]
        i, j, d = i[ok], j[ok], d[ok]
    step = q[i, :first] - m[j, :first]
    d = np.einsum("ij,ij->i", step, step).astype(np.float64)
    for low, high in zip(BLOCKS, BLOCKS[1:]):
        step = q[i, low:high] - m[j, low:high]
        d += np.einsum("ij,ij->i", step, step)
    return i, j, d


def usable(v: str = "vector") -> F.Column:
    """Not null, DIM finite values, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(v).isNotNull() & (F.size(v) == DIM) & fine & F.exists(v, lambda x: x != 0)


def knn(reps: DataFrame, k: int = NEIGHBOURS, probes: int | None = PROBES) -> DataFrame:
    """The k nearest others by cosine of every row of ``reps`` (id long, vector of DIM finite values): id, other, dist.

    ``dist`` is the squared distance of the unit vectors, 2 - 2 cosine. ``reps`` should be a stored table without two
    equal vectors.

    Method: inverted lists with adaptive dimension scan. The lists' centres are fitted on at most SAMPLE rows; every
    row is put in its list, lists longer than CELL are cut into cells. First each vector is compared with its own
    cell, which gives its reach, the distance of its k-th neighbour so far. Then it visits the cells of its ``probes``
    nearest lists, except where the triangle inequality shows that none can lie within reach, and scans them block
    by block of the rotated columns (``scan``). A vector is sent once to each group of neighbouring cells; a group that
    many vectors visit is scanned in slices of the visitors by several tasks. Lists grow with the square root of the
    rows until SAMPLE / 8 (some 270 million rows), from there on with the rows. ``probes`` None is the exact way: all
    lists are visited that the triangle inequality leaves, and no candidate is given up early.
    Measured recall: see the README. Fewer than k others give fewer rows; one row gives none.
    """
    spark = reps.sparkSession
    total = reps.count()
    schema = "id long, other long, dist double"
    if total < 2:
        return spark.createDataFrame([], schema)
    wanted = int(min(SAMPLE, max(SEEN, 32 * total**0.5)))
    share = min(1.0, 1.2 * wanted / total)
    seen = reps.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(share * (1 << 40))).limit(wanted) if share < 1 else reps.limit(wanted)
    sample = matrix(seen.select("vector").toArrow().column("vector").combine_chunks())
    lists = int(min(max(1, 2 * total**0.5), max(1, len(sample) // 8)))
    epsilon, most = (np.inf, lists) if probes is None else (EPSILON, probes)
    centres = fit_centres(sample, lists)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, _ = nearest(matrix(b.column(1)), centres)
            size = np.bincount(of, minlength=len(centres))
            at = np.flatnonzero(size)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(size[at])], ["l", "n"])

    size = np.zeros(len(centres), np.int64)
    for r in reps.select("id", "vector").mapInArrow(assign, "l long, n long").groupBy("l").agg(F.sum("n").alias("n")).collect():
        size[r["l"]] = r["n"]
    cuts = np.maximum(1, -(-size // CELL))
    base = np.r_[0, np.cumsum(cuts)][:-1]
    cell_list = np.repeat(np.arange(len(centres)), cuts)
    group = group_cells(centres[cell_list])
    n_groups = int(group.max()) + 1
    order = np.lexsort((np.arange(len(group)), group))
    bit = np.zeros(len(group), np.int64)
    bit[order] = np.arange(len(group)) - np.r_[0, np.cumsum(np.bincount(group, minlength=n_groups))][group[order]]

    slices = max(1, -(-total * min(most, n_groups) // (n_groups * VISITS)))
    n_parts = n_groups * slices

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(), matrix(b.column(1))
            of, far = nearest(x, centres)
            cell = base[of] + (K.mix64(ids) % cuts[of].astype(np.uint64)).astype(np.int64)
            out = np.empty(len(ids), _MEMBER)
            out["cell"], out["near"], out["v"] = cell, far, x
            yield K.pack_buckets(group[cell], n_groups, ids, out)

    packed = reps.select("id", "vector").mapInArrow(members, K.PACKED)
    own_schema = "id long, cell int, near float, reach float, others array<long>, dists array<double>, v binary"

    def own(t: pa.Table) -> pa.Table:
        ids, m = K.unpack_bucket(t, _MEMBER)
        o = np.argsort(m["cell"], kind="stable")
        ids, m = ids[o], m[o]
        starts = K.first_of(m["cell"])
        reach = np.full(len(ids), 2.01, np.float32)
        q_all, o_all, d_all = [], [], []
        for s, e in zip(starts, np.r_[starts[1:], len(m)]):
            x = m["v"][s:e]
            for i in range(0, e - s, 1024):
                d = square_distances(x[i : i + 1024], x)
                rows = np.arange(len(d))
                d[rows, i + rows] = np.inf
                near = np.argpartition(d, min(k + 3, d.shape[1] - 1), axis=1)[:, : k + 3]
                a, c = np.repeat(rows, near.shape[1]), near.ravel()
                ok = np.isfinite(d[a, c])
                a, c = a[ok], c[ok]
                step = x[i + a].astype(np.float64) - x[c]
                q, c, dist = best(s + i + a, s + c, np.einsum("ij,ij->i", step, step), k)
                q_all.append(q)
                o_all.append(c)
                d_all.append(dist)
        q, c, d = (np.concatenate(y) for y in (q_all, o_all, d_all))
        n = np.bincount(q, minlength=len(ids))
        last = np.cumsum(n) - 1
        whole = n == k
        reach[whole] = np.sqrt(d[last[whole]]) * (1 + 1e-5) + 1e-6
        off = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
        v = np.ascontiguousarray(m["v"])
        return pa.table({
            "id": pa.array(ids), "cell": pa.array(m["cell"].astype(np.int32)), "near": pa.array(m["near"].astype(np.float32)), "reach": pa.array(reach),
            "others": pa.ListArray.from_arrays(off, pa.array(ids[c])), "dists": pa.ListArray.from_arrays(off, pa.array(d)), "v": pa.array([r.tobytes() for r in v], pa.binary())})

    stored = materialize(packed.groupBy("bucket").applyInArrow(own, own_schema), "cells")
    radius = np.zeros(len(cell_list), np.float32)
    for r in stored.groupBy("cell").agg(F.max("near").alias("r")).collect():
        radius[r["cell"]] = r["r"]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step_ = min(2048, block_rows(len(centres)))
            for i in range(0, b.num_rows, step_):
                part = b.slice(i, step_)
                ids, cell, reach = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_numpy()
                v = np.frombuffer(b"".join(part.column(3).to_pylist()), np.float32).reshape(-1, DIM)
                mem = np.empty(len(ids), _MEMBER)
                mem["cell"], mem["near"], mem["v"] = cell, 0, v
                for s in range(slices):
                    yield K.pack_buckets(group[cell] * slices + s, n_parts, ids, mem, 0)
                d = np.sqrt(square_distances(v, centres))
                p = min(most, len(centres))
                near = np.argpartition(d, p - 1, axis=1)[:, :p]
                row, li = np.repeat(np.arange(len(ids)), p), near.ravel()
                times = cuts[li]
                step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, c = np.repeat(row, times), np.repeat(base[li], times) + step
                ok = (c != cell[row]) & (d[row, cell_list[c]] - radius[c] <= reach[row] + 1e-4)
                row, c = row[ok], c[ok]
                if not len(row):
                    continue
                key = row * n_groups + group[c]
                o = np.argsort(key, kind="stable")
                at = K.first_of(key[o])
                mask = np.bitwise_or.reduceat(np.uint64(1) << bit[c[o]].astype(np.uint64), at)
                row, g = row[o][at], group[c[o][at]]
                qs = np.empty(len(row), _QUERY)
                qs["mask"], qs["reach"], qs["v"] = mask, reach[row], v[row]
                slice_ = (K.mix64(ids[row]) % np.uint64(slices)).astype(np.int64)
                yield K.pack_buckets(g * slices + slice_, n_parts, ids[row], qs, n_parts)

    def search(t: pa.Table) -> pa.Table:
        kind = np.array(t.column("bucket").to_pylist()) >= n_parts
        ids, m = K.unpack_bucket(t.filter(pa.array(~kind)), _MEMBER)
        qid, q = K.unpack_bucket(t.filter(pa.array(kind)), _QUERY)
        out = [[], [], []]
        if len(q):
            x_all = np.ascontiguousarray(q["v"])
            for cell in np.unique(m["cell"]).tolist():
                mine = np.flatnonzero(m["cell"] == cell)
                x = np.ascontiguousarray(m["v"][mine])
                ask = np.flatnonzero((q["mask"] >> np.uint64(bit[cell])) & np.uint64(1))
                size_ = max(64, 2_000_000 // max(1, len(x)))
                for s in range(0, len(ask), size_):
                    a = ask[s : s + size_]
                    i, j, d = scan(x_all[a], q["reach"][a], x, epsilon)
                    i, j, d = best(a[i], ids[mine[j]], d, k)
                    for store, y in zip(out, (i, j, d)):
                        store.append(y)
        i, j, d = (np.concatenate(y) if y else np.zeros(0, t_) for y, t_ in zip(out, (np.int64, np.int64, np.float64)))
        i, j, d = best(i, j, d, k)
        return pa.table({"id": pa.array(qid[i] if len(i) else np.zeros(0, np.int64)), "other": pa.array(j), "dist": pa.array(d)})

    work = stored.select("id", "cell", "reach", "v").mapInArrow(visit, K.PACKED)
    more = work.groupBy(F.pmod("bucket", F.lit(n_parts)).alias("g")).applyInArrow(search, schema)
    near = stored.select("id", F.explode(F.arrays_zip("others", "dists")).alias("x")).select("id", F.col("x.others").alias("other"), F.col("x.dists").alias("dist"))
    both = near.union(more).groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("dist", "other"))), 1, k).alias("x"))
    return both.select("id", F.explode("x").alias("x")).select("id", F.col("x.other").alias("other"), F.col("x.dist").alias("dist"))


def neighbours(df: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The k most similar other usable vectors of each usable vector: vec_id, other_id, cosine.

    Equal vectors are folded before the search and unfolded after it, so a vector that a third of all rows repeat costs
    one place in the index. Ties go to the smaller id. Null, short, long, non-finite and all-zero vectors, and null ids
    have no rows and are nobody's neighbour.
    """
    rows = df.where(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.transform("vector", lambda x: x + F.lit(0.0).cast("float")).alias("vector"))
    reps = materialize(rows.groupBy("vector").agg(F.min("id").alias("id")).select("id", "vector"), "vectors")
    digest = lambda: F.md5(F.concat_ws(",", F.transform("vector", lambda x: x.cast("string"))).cast("binary"))
    members = rows.select("id", digest().alias("_d")).join(reps.select(F.col("id").alias("rep"), digest().alias("_e")), F.col("_d") == F.col("_e")).select("rep", "id")
    members = materialize(members, "members")
    # The k + 1 least ids of each fold: first of each slice of it, then of those, so no fold meets in one task.
    few = members
    for keys in (["rep", "_s"], ["rep"]):
        few = few.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(64)))
        few = few.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("_r") <= k + 1)
    first = few.select(F.col("rep").alias("_of"), F.col("id").alias("other"))
    reach = knn(reps, k).union(reps.select("id", F.col("id"), F.lit(0.0)).toDF("id", "other", "dist")).select("id", F.col("other").alias("_c"), "dist")
    top = (
        reach.join(first, F.col("_c") == F.col("_of")).groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("dist", "other"))), 1, k + 1).alias("x"))
        .select(F.col("id").alias("_r"), "x")
    )
    each = members.join(top, F.col("rep") == F.col("_r")).select("id", F.explode(F.slice(F.filter("x", lambda y: y["other"] != F.col("id")), 1, k)).alias("x"))
    return each.select(F.col("id").alias("vec_id"), F.col("x.other").alias("other_id"), (1 - F.col("x.dist") / 2).alias("cosine"))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "sequence_vectors"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = p5_neighbours(spark, sf_dir)
    return n.select(F.least("vec_id", "other_id").alias("vec_id_a"), F.greatest("vec_id", "other_id").alias("vec_id_b")).distinct()


QUERIES = {"p5_found": p5_found, "p5_neighbours": p5_neighbours}
SQL = {
    "p5_found": """
WITH u AS (SELECT vec_id AS id, CAST(vector AS DOUBLE[]) AS v FROM sequence_vectors WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
w AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM u),
r AS (SELECT a.id AS x, b.id AS y, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.v, b.v) / (a.n * b.n), 9) DESC, b.id) AS r FROM w a JOIN w b ON a.id <> b.id)
SELECT DISTINCT least(x, y) AS vec_id_a, greatest(x, y) AS vec_id_b FROM r WHERE r <= 5"""
}
