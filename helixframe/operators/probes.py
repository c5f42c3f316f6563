"""Probes on vectors: nearest neighbours, ridge and logistic models, per-assay scores."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators import metrics as M
from helixframe.operators.corpus import indexed
from helixframe.operators.vectormath import block_neighbours, cosine


def effective_probe(problem: Column, mode: Column, requested: Column) -> Column:
    """PRB6: retrieval, multilabel and zero-shot tasks are recorded as linear whatever was asked for."""
    return F.when((problem == "retrieval") | (problem == "multilabel") | (mode == "zero_shot"), F.lit("linear")).otherwise(requested)


def encode_labels(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """PRB4: class numbers over the labels of both sides, by sorted name: label, code."""
    names = train.select(label).union(test.select(label)).where(F.col(label).isNotNull()).distinct()
    return indexed(names, [label], "code")


def keep_top_labels(df: DataFrame, train: DataFrame, labels: str, k: int) -> DataFrame:
    """PRB5 / T9: label arrays cut to the k labels most frequent in training (ties by name)."""
    top = train.select(F.explode(labels).alias("l")).groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(k)
    kept = top.agg(F.collect_list("l").alias("_top")).withColumn("_k", F.lit(1))
    return df.withColumn("_j", F.lit(1)).join(F.broadcast(kept), F.col("_j") == F.col("_k")).withColumn(labels, F.array_intersect(labels, "_top")).drop("_j", "_k", "_top")


def knn_votes(train: DataFrame, test: DataFrame, label: str, k: int = 3, key: str = "id", vector: str = "v", metric: str = "euclidean") -> DataFrame:
    """PRB1: label with most votes among the k nearest training rows (ties: smallest label): query_id, guess."""
    n = block_neighbours(test, train, k, key, vector, metric)
    j = n.join(train.select(F.col(key).alias("_t"), F.col(label).alias("_l")), F.col("other_id") == F.col("_t"))
    v = j.groupBy("query_id", "_l").agg(F.count(F.lit(1)).alias("_n"))
    return v.groupBy("query_id").agg(F.min(F.struct((-F.col("_n")).alias("a"), F.col("_l").alias("b"))).alias("x")).select("query_id", F.col("x.b").alias("guess"))


def knn_means(train: DataFrame, test: DataFrame, target: str, k: int = 3, key: str = "id", vector: str = "v", metric: str = "euclidean") -> DataFrame:
    """PRB1: mean target of the k nearest training rows: query_id, guess."""
    n = block_neighbours(test, train, k, key, vector, metric)
    j = n.join(train.select(F.col(key).alias("_t"), F.col(target).alias("_y")), F.col("other_id") == F.col("_t"))
    return j.groupBy("query_id").agg(F.avg("_y").alias("guess"))


def standardized(train: DataFrame, dfs: list[DataFrame], vector: str, dim: int) -> list[DataFrame]:
    """Vectors minus the training mean over the training population deviation, in one aggregate pass."""
    m = train.agg(*[F.avg(F.get(vector, F.lit(i))).alias(f"m{i}") for i in range(dim)], *[F.stddev_pop(F.get(vector, F.lit(i))).alias(f"s{i}") for i in range(dim)]).first()
    mean = F.array(*[F.lit(float(m[f"m{i}"])) for i in range(dim)])
    std = F.array(*[F.lit(float(m[f"s{i}"]) or 1.0) for i in range(dim)])
    return [d.withColumn(vector, F.zip_with(F.zip_with(vector, mean, lambda x, y: x - y), std, lambda x, y: x / y)) for d in dfs]


def ridge(train: DataFrame, test: DataFrame, target: str, dim: int, alpha: float = 1.0, key: str = "id", vector: str = "v") -> DataFrame:
    """PRB2: ridge regression on standardised vectors with an unpenalised intercept: query_id, guess.

    The normal-equation solver's penalty is scaled by the target's deviation and the rows so that it equals ``alpha``.
    """
    a, b = standardized(train, [train, test], vector, dim)
    n, sd = train.agg(F.count(F.lit(1)), F.stddev_pop(target)).first()
    lr = LinearRegression(solver="normal", standardization=False, elasticNetParam=0.0, regParam=alpha * (sd or 1.0) / max(n, 1), featuresCol="_f", labelCol=target, predictionCol="guess")
    vec = lambda d: d.withColumn("_f", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return lr.fit(vec(a)).transform(vec(b)).select(F.col(key).alias("query_id"), "guess")


def logistic(train: DataFrame, test: DataFrame, label: str, dim: int, c: float = 1.0, key: str = "id", vector: str = "v", one_vs_rest: bool = False) -> DataFrame:
    """PRB2: L2 logistic regression on standardised vectors: query_id, guess (label number). Approximate by nature."""
    a, b = standardized(train, [train, test], vector, dim)
    vec = lambda d: d.withColumn("_f", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    lr = LogisticRegression(regParam=1.0 / (c * max(train.count(), 1)), elasticNetParam=0.0, standardization=False, featuresCol="_f", labelCol=label, predictionCol="guess")
    model = OneVsRest(classifier=lr, featuresCol="_f", labelCol=label, predictionCol="guess") if one_vs_rest else lr
    return model.fit(vec(a.withColumn(label, F.col(label).cast("double")))).transform(vec(b)).select(F.col(key).alias("query_id"), F.col("guess").cast("int").alias("guess"))


def boosted(train: DataFrame, test: DataFrame, target: str, classify: bool, key: str = "id", vector: str = "v", rounds: int = 20) -> DataFrame:
    """PRB3: gradient-boosted trees (binary classes or a number): query_id, guess."""
    vec = lambda d: d.withColumn("_f", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    kind = GBTClassifier if classify else GBTRegressor
    m = kind(featuresCol="_f", labelCol=target, predictionCol="guess", maxIter=rounds, maxDepth=4, seed=42)
    return m.fit(vec(train.withColumn(target, F.col(target).cast("double")))).transform(vec(test)).select(F.col(key).alias("query_id"), "guess")


def zero_shot(df: DataFrame, group: str, a: str, b: str, score: str, classify: bool = False) -> DataFrame:
    """PRB8 / AGG18: per group, similarity of both vectors against the score; groups under two rows are skipped.

    Spearman (undefined: 0), or AUC of score > 0.5 (undefined: skipped): group, n or nothing, metric.
    """
    s = df.withColumn("_sim", cosine(a, b)).where(F.col("_sim").isNotNull() & F.col(score).isNotNull())
    if classify:
        return M.roc_auc(s, F.col(score) > 0.5, "_sim", [group]).where("auc is not null").withColumnRenamed("auc", "metric")
    return M.spearman(s, "_sim", score, [group]).where("n >= 2").withColumnRenamed("spearman", "metric")


def macro(per_group: DataFrame, metric: str = "metric") -> DataFrame:
    """AGG17 / AGG18: mean of the finite values over groups and how many there were."""
    m = F.when(F.col(metric).isNotNull() & ~F.isnan(metric) & (F.abs(metric) < float("inf")), F.col(metric))
    return per_group.agg(F.avg(m).alias("macro_mean"), F.count(m).alias("groups"))


def evaluate(train: DataFrame, test: DataFrame, problem: str, label: str = "label", k: int = 3, key: str = "id", vector: str = "v") -> DataFrame:
    """PRB9: a task's vectors through the probe and the metrics of its problem type: problem, metric, value.

    binary, multiclass: nearest-neighbour votes, Accuracy and F1 (macro); regression: neighbour means, Spearman and
    MSE; retrieval: Recall@1, 10 and 30 of the test rows among themselves; multilabel: the label array of the nearest
    training row, subset accuracy and F1 (macro and micro). An unknown type is an error.
    """
    truth = test.select(F.col(key).alias("_q"), F.col(label).alias("_y"))
    if problem in ("binary", "multiclass"):
        j = knn_votes(train, test, label, k, key, vector).join(truth, F.col("query_id") == F.col("_q"))
        f = M.f1_scores(j, "_y", "guess").select(F.col("f1_macro").alias("F1"))
        row = j.agg(M.accuracy("_y", "guess").alias("Accuracy")).crossJoin(f)
    elif problem == "regression":
        j = knn_means(train, test, label, k, key, vector).join(truth, F.col("query_id") == F.col("_q"))
        s = M.spearman(j.withColumn("_g", F.lit(1)), "guess", "_y", ["_g"]).select(F.col("spearman").alias("Spearman"))
        row = j.agg(M.mse("_y", "guess").alias("MSE")).crossJoin(s)
    elif problem == "retrieval":
        row = M.recall_at(block_neighbours(test, test, 30, key, vector), test, [1, 10, 30], key, label)
    elif problem == "multilabel":
        n = block_neighbours(test, train, 1, key, vector, "euclidean")
        j = n.join(train.select(F.col(key).alias("_t"), F.col(label).alias("guess")), F.col("other_id") == F.col("_t")).join(truth, F.col("query_id") == F.col("_q"))
        row = M.multilabel_scores(j, "_y", "guess")
    else:
        raise ValueError(f"unknown problem type {problem!r}")
    return row.select(F.explode(F.array(*[F.struct(F.lit(problem).alias("problem"), F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])).alias("x")).select("x.*")


def assay_ridge(df: DataFrame, group: str, item: str, vector: str, score: str, dim: int, alpha: float = 1.0) -> DataFrame:
    """PRB7: one ridge model an assay on its training rows, Spearman on its test rows: group, n, spearman.

    Folds as everywhere (``fold_flags``; needs row_id): assays of under ten rows have no test rows and no result. Each
    task sends the sums of products of its rows of an assay, dim x dim numbers whatever the rows; the models are solved
    from the added sums, so an assay that holds most rows is no burden. Vectors are standardised as for ``ridge``.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    from helixframe.operators.assays import fold_flags

    ok = df.where(F.col(vector).isNotNull() & F.col(score).isNotNull() & F.col(group).isNotNull())
    f = fold_flags(ok.select("row_id", group, item, F.transform(vector, lambda x: x.cast("double")).alias("_v"), F.col(score).cast("double").alias("_y")), group, item)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            g, y = np.array(b.column(0).to_pylist()), b.column(2).to_numpy()
            x = b.column(1).flatten().to_numpy().reshape(-1, dim)
            z = np.hstack([np.ones((len(y), 1)), x, y[:, None]])
            for name in np.unique(g):
                part = z[g == name]
                held[str(name)] = held.get(str(name), 0) + part.T @ part
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([m.tobytes() for m in held.values()], pa.binary())], ["g", "m"])

    def solve(t: pa.Table) -> pa.Table:
        m = sum(np.frombuffer(x, np.float64).reshape(dim + 2, dim + 2) for x in t.column("m").to_pylist())
        n = m[0, 0]
        mean, my = m[0, 1 : dim + 1] / n, m[0, dim + 1] / n
        cov = m[1 : dim + 1, 1 : dim + 1] - n * np.outer(mean, mean)
        std = np.sqrt(np.maximum(np.diag(cov) / n, 0))
        std[std < 1e-12] = 1
        w = np.linalg.solve(cov / np.outer(std, std) + alpha * np.eye(dim), (m[1 : dim + 1, dim + 1] - n * mean * my) / std) / std
        return pa.table({"_g": t.column("g").slice(0, 1), "_w": pa.array([w.tolist()], pa.list_(pa.float64())), "_b": [float(my - mean @ w)]})

    train = f.where("not is_test").select(F.col(group).cast("string"), "_v", "_y")
    models = train.mapInArrow(sums, "g string, m binary").groupBy("g").applyInArrow(solve, "_g string, _w array<double>, _b double")
    from helixframe.operators.vectormath import dot

    test = f.where("is_test").join(models, F.col(group).cast("string") == F.col("_g")).select(group, F.round(dot("_v", "_w") + F.col("_b"), 9).alias("_p"), "_y")
    return M.spearman(test, "_p", "_y", [group])


def plane(df: DataFrame, key: str, vector: str, dims: int = 2) -> DataFrame:
    """VEC9: projection on the first principal components, the stand-in for a neighbour embedding: key, point."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    v = df.where(F.col(vector).isNotNull()).withColumn("_f", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return PCA(k=dims, inputCol="_f", outputCol="_o").fit(v).transform(v).select(key, vector_to_array("_o").alias("point"))
