"""Vector columns: products, pooling, neighbours. Dense vectors are array<float> or array<double>."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """VEC3: cosine; null where a vector is null or all zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def negative_distance(a: Column | str, b: Column | str) -> Column:
    """VEC4: minus the Euclidean distance."""
    return -F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def prefix(v: Column | str, n: int) -> Column:
    """VEC8: the first n dimensions."""
    return F.slice(_c(v), 1, n)


def concat_pair(a: Column | str, b: Column | str) -> Column:
    """VEC1: vector of a pair: both vectors one after the other."""
    return F.concat(_c(a), _c(b))


def _weighted(tokens: Column | str, weights: Column) -> Column:
    """Sum of token vectors times weights, by dimension."""
    t = _c(tokens)
    dims = F.sequence(F.lit(0), F.greatest(F.size(F.get(t, F.lit(0))) - 1, F.lit(0)))
    return F.transform(dims, lambda d: F.aggregate(F.zip_with(t, weights, lambda v, w: F.get(v, d).cast("double") * w), F.lit(0.0), lambda s, x: s + x))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean_pool(tokens: Column | str, mask: Column | str) -> Column:
    """VEC2: mean of the unmasked token vectors, with a floor of 1e-9 under their number."""
    w = F.transform(_c(mask), lambda m: m.cast("double"))
    return F.transform(_weighted(tokens, w), lambda x: x / F.greatest(_total(w), F.lit(1e-9)))


def attention_pool(tokens: Column | str, mask: Column | str, weights: list[float]) -> Column:
    """VEC5: softmax of token . weights over unmasked tokens; zero weights give the masked mean."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    score = F.zip_with(_c(tokens), _c(mask), lambda t, m: F.when(m > 0, dot(t, w)))
    top = F.array_max(score)
    e = F.transform(score, lambda s: F.coalesce(F.exp(s - top), F.lit(0.0)))
    return F.transform(_weighted(tokens, e), lambda x: x / F.greatest(_total(e), F.lit(1e-9)))


def gem_pool(tokens: Column | str, mask: Column | str, p: float, eps: float = 1e-6) -> Column:
    """VEC7: generalised mean with p >= 1: signed powers, magnitude floor eps before the power."""
    if p < 1:
        raise ValueError("p must be at least 1")
    raised = F.transform(_c(tokens), lambda t: F.transform(t, lambda x: F.signum(x.cast("double")) * F.pow(F.greatest(F.abs(x.cast("double")), F.lit(eps)), F.lit(p))))
    return F.transform(mean_pool(raised, mask), lambda x: F.signum(x) * F.pow(F.greatest(F.abs(x), F.lit(eps if p == 1 else eps**p)), F.lit(1.0 / p)))


def contextual_pool(df: DataFrame, key: str, tokens: str, mask: str, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, act: str = "tanh") -> DataFrame:
    """VEC6: token scores by a two-layer scorer, softmax over unmasked tokens; key and pooled vector.

    Arrow batches through NumPy; ``act`` is tanh, silu or gelu. Rows without an unmasked token give zeros; null tokens null.
    """
    fn = {
        "tanh": np.tanh,
        "silu": lambda x: x / (1 + np.exp(-x)),
        "gelu": lambda x: 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3))),
    }[act]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if not t:
                    out.append(None)
                    continue
                x, keep = np.array(t, float), np.array(m) > 0
                s = fn(x @ w1 + b1) @ w2
                e = np.where(keep, np.exp(s - (s[keep].max() if keep.any() else 0)), 0)
                out.append((e @ x / max(e.sum(), 1e-9)).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], [key, "pooled"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, tokens, mask).mapInArrow(run, f"`{key}` {kind}, pooled array<double>")


def block_neighbours(queries: DataFrame, gallery: DataFrame, k: int, key: str = "id", vector: str = "v", metric: str = "cosine", blocks: int = 8) -> DataFrame:
    """JN19 / JN20: the k nearest gallery rows of each query, exactly: query_id, other_id, similarity, rank.

    The gallery is cut into blocks by hash and every query visits every block, as blocked matrix products; a block
    returns its best k, so what is merged is k rows a query and block. Self is excluded by key. Ties: smaller id.
    The work is queries x gallery by nature: meant for a bounded query set (an evaluation set) against all rows.
    metric: cosine, or euclidean (minus the distance). Null and zero vectors take no part.
    """
    usable = lambda d: d.select(F.col(key).alias("id"), F.transform(_c(vector), lambda x: x.cast("double")).alias("v")).where(F.col("v").isNotNull() & (norm("v") > 0))
    g = usable(gallery).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    q = usable(queries).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "other_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        qi, gi = left.column("id").to_numpy(), right.column("id").to_numpy()
        order = np.argsort(gi, kind="stable")
        qv, gv = (np.array(t.column("v").to_pylist()) for t in (left, right))
        gi, gv = gi[order], gv[order]
        if metric == "cosine":
            qv, gv = qv / np.linalg.norm(qv, axis=1, keepdims=True), gv / np.linalg.norm(gv, axis=1, keepdims=True)
        parts = []
        for i in range(0, len(qi), 1024):
            a = qv[i : i + 1024]
            s = a @ gv.T if metric == "cosine" else -np.sqrt(np.maximum((a * a).sum(1)[:, None] + (gv * gv).sum(1)[None] - 2 * a @ gv.T, 0))
            s = np.round(s, 12)
            s[qi[i : i + 1024][:, None] == gi[None]] = -np.inf
            near = np.argsort(-s, axis=1, kind="stable")[:, :k]
            row = np.repeat(np.arange(len(a)), near.shape[1])
            val = s[row, near.ravel()]
            ok = np.isfinite(val)
            parts.append((qi[i + row[ok]], gi[near.ravel()[ok]], val[ok]))
        a, b, c = (np.concatenate(x) for x in zip(*parts))
        return pa.table({"query_id": a, "other_id": b, "similarity": c})

    found = q.groupBy("b").cogroup(g.groupBy("b")).applyInArrow(search, "query_id long, other_id long, similarity double")
    best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("n"), F.col("other_id")))), 1, k).alias("x"))
    return best.select("query_id", F.posexplode("x").alias("p", "y")).select("query_id", F.col("y.other_id").alias("other_id"), (-F.col("y.n")).alias("similarity"), (F.col("p") + 1).alias("rank"))


def encode_unique(df: DataFrame, text: str, encode) -> DataFrame:
    """VEC1 / JN21: run ``encode`` (DataFrame of distinct texts -> text, vector) once a distinct text, join back to all rows.

    Multiplicity is kept; null texts have a null vector.
    """
    vec = encode(df.select(text).where(F.col(text).isNotNull()).distinct()).select(F.col(text).alias("_t"), "vector")
    return df.join(vec, F.col(text) == F.col("_t"), "left").drop("_t")
