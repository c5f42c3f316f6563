"""Problem 3: splits with given shares in which related records stay together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.graph import components
from helixframe.llm.ranks import salted_rank
from helixframe.util import materialize, residues, strip, table

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Labels a split can balance at most.
LABELS = 64


def allocate(size: np.ndarray, count: np.ndarray, label: np.ndarray, shares: list[float]) -> np.ndarray:
    """Min-cost flow from bundles of components to splits, rounded to whole components.

    ``size``: rows of a component of the bundle, ``count``: its components, ``label``: its main label as a number.
    Rows flow bundle -> (label, split) -> split -> sink. Up to the quota an arc is free; beyond it each row costs 1 at
    the split and 0.25 at the label, and a component larger than a split's quota pays for what cannot fit. Shortest
    augmenting paths on the residual graph, in which all bundles of a label form one arc between two splits (the
    cheapest bundle that could move). Returns components of each bundle by split; rows of the result add up to count.
    """
    size, count = size.astype(float), count.astype(np.int64)
    k_n, labels = len(shares), sorted(set(label.tolist()))
    at = {x: i for i, x in enumerate(labels)}
    lab = np.array([at[x] for x in label.tolist()], int)
    supply, l_n = size * count, len(labels)
    total = supply.sum()
    quota = np.array(shares) * total
    l_total = np.array([supply[lab == i].sum() for i in range(l_n)])
    l_quota = np.outer(l_total, shares)
    cost = 4.0 * np.maximum(0, size[:, None] - quota[None, :]) / np.maximum(size[:, None], 1)
    flow, l_flow, s_flow = np.zeros((len(size), k_n)), np.zeros((l_n, k_n)), np.zeros(k_n)
    sink, eps = l_n * k_n + k_n, 1e-7 * max(1.0, total)
    of_label = [np.flatnonzero(lab == i) for i in range(l_n)]

    def arcs():
        for i in range(l_n):
            own = of_label[i]
            for k in range(k_n):
                node, split = i * k_n + k, l_n * k_n + k
                room = l_quota[i, k] - l_flow[i, k]
                yield (node, split, 0.0, room, None) if room > eps else (node, split, 0.25, np.inf, None)
                if l_flow[i, k] > eps:
                    yield (split, node, -0.25, -room, None) if room < -eps else (split, node, 0.0, l_flow[i, k], None)
                moving = own[flow[own, k] > eps]
                if len(moving):
                    for j in range(k_n):
                        if j != k:
                            d = cost[moving, j] - cost[moving, k]
                            m = int(moving[np.argmin(d)])
                            yield node, i * k_n + j, float(d.min()), flow[m, k], m
        for k in range(k_n):
            room = quota[k] - s_flow[k]
            yield (l_n * k_n + k, sink, 0.0, room, None) if room > eps else (l_n * k_n + k, sink, 1.0, np.inf, None)

    for b in np.argsort(-size, kind="stable").tolist():
        left = supply[b]
        while left > eps:
            dist, prev = np.full(sink + 1, np.inf), [None] * (sink + 1)
            i = lab[b]
            for k in range(k_n):
                dist[i * k_n + k] = cost[b, k]
            net = list(arcs())
            for _ in range(sink + 1):
                changed = False
                for x in net:
                    if dist[x[0]] + x[2] < dist[x[1]] - 1e-9:
                        dist[x[1]], prev[x[1]], changed = dist[x[0]] + x[2], x, True
                if not changed:
                    break
            path, node = [], sink
            while prev[node] is not None and len(path) <= sink:
                path.append(prev[node])
                node = prev[node][0]
            push = min([left, *(x[3] for x in path)])
            first = node - i * k_n
            flow[b, first] += push
            for u, _, _, _, m in path:
                if m is not None:
                    flow[m, u % k_n] -= push
            for _, v, _, _, m in path:
                if m is not None:
                    flow[m, v % k_n] += push
            left -= push
            s_flow[:] = flow.sum(0)
            for x in range(l_n):
                l_flow[x] = flow[of_label[x]].sum(0)
    whole = np.floor(flow / np.maximum(size[:, None], 1) + 1e-6).astype(np.int64)
    whole = np.minimum(whole, count[:, None])
    owed = quota - (whole * size[:, None]).sum(0)
    for b in np.argsort(-size, kind="stable").tolist():
        for _ in range(int(count[b] - whole[b].sum())):
            k = int(np.argmax(owed))
            whole[b, k] += 1
            owed[k] -= size[b]
    return whole


def split_components(rows: DataFrame, component: str, label: F.Column, shares: dict[str, float] = SHARES, seed: int = 42) -> DataFrame:
    """Give every row the split of its component: the input's columns and ``split`` (one there before is replaced).

    Components of identical size and label profile (share of each label in quarters) form a bundle; n rows have fewer
    than 1.5 * sqrt(n) different component sizes, and only bundles, not components, reach the driver.
    ``allocate`` solves the quotas, and the members of a bundle go to its splits in the order of their hash.
    Rows of one component never part, so a component larger than a quota makes its split larger than asked.
    ``label``: a column of at most LABELS values, more are an error. A null component is a component; an empty table gives no rows.
    """
    names = list(shares)
    rows = rows.withColumn("__label", label.cast("string")).drop("split")
    if rows.select("__label").distinct().limit(LABELS + 1).count() > LABELS:
        raise ValueError(f"more than {LABELS} labels to balance")
    by_label = rows.groupBy(component, "__label").agg(F.count(F.lit(1)).alias("_c"))
    comps = by_label.groupBy(component).agg(
        F.sum("_c").alias("_size"),
        F.max(F.struct(F.col("_c"), F.col("__label"))).getField("__label").alias("_main"),
        F.sort_array(F.collect_list(F.struct("__label", "_c"))).alias("_profile"),
    )
    quarters = F.array_join(F.transform("_profile", lambda x: F.concat(F.coalesce(x["__label"], F.lit("-")), F.lit(":"), F.round(x["_c"] * 4 / F.col("_size")).cast("int"))), ",")
    comps = materialize(comps.select(component, F.col("_size").alias("_step"), "_main", quarters.alias("_quarters")), "components")
    bundles = comps.groupBy("_step", "_quarters", "_main").agg(F.count(F.lit(1)).alias("n")).orderBy("_step", "_quarters", "_main").collect()
    if not bundles:
        return rows.drop("__label").withColumn("split", F.lit(None).cast("string"))
    number = {x: i for i, x in enumerate(sorted({r["_main"] or "" for r in bundles}))}
    whole = allocate(
        np.array([r["_step"] for r in bundles]), np.array([r["n"] for r in bundles]), np.array([number[r["_main"] or ""] for r in bundles]), list(shares.values())
    )
    ends = np.cumsum(whole, axis=1)
    bounds = comps.sparkSession.createDataFrame(
        [(r["_step"], r["_quarters"], r["_main"], [int(x) for x in e]) for r, e in zip(bundles, ends)], "b_step long, b_quarters string, b_main string, _ends array<long>"
    )
    ranked = salted_rank(comps.withColumn("_h", F.xxhash64(F.lit(seed), F.col(component))), ["_step", "_quarters", "_main"], ["_h", component], "_rank")
    pick = F.element_at(F.array(*[F.lit(x) for x in names]), (F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))) + 1).cast("int"))
    chosen = ranked.join(
        bounds, (F.col("_step") == F.col("b_step")) & (F.col("_quarters") == F.col("b_quarters")) & F.col("_main").eqNullSafe(F.col("b_main"))
    ).select(F.col(component).alias("__of"), pick.alias("split"))
    return rows.drop("__label").join(chosen, F.col(component).eqNullSafe(F.col("__of"))).drop("__of")


def assay_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """test_data_prep with the component of each row: row_id, dms_id, component, label.

    Rows are tied by DMS_id (trimmed, upper-cased) and by the residues of target_seq, directly or through others. A row
    without an id follows its target; without both (blank counts as none) it is a component of its own.
    """
    t = table(spark, sf_dir, "test_data_prep")
    key, seq = F.upper(strip("DMS_id")), residues("target_seq")
    rows = t.select(
        F.col("row_id"), F.when(key != "", key).alias("dms_id"), F.when(seq != "", F.md5(seq.cast("binary"))).alias("_d"),
        F.when(F.col("DMS_score").isNull() | F.isnan("DMS_score"), "none").when(F.col("DMS_score") >= 0, "high").otherwise("low").alias("label"),
    )
    held = rows.where("dms_id is not null and _d is not null").select("dms_id", "_d").distinct()
    lead = held.groupBy("_d").agg(F.min("dms_id").alias("_lead"))
    lead = materialize(lead, "leads")
    edges = held.join(lead.withColumnRenamed("_d", "_e"), F.col("_d") == F.col("_e")).select(F.col("dms_id").alias("u"), F.col("_lead").alias("v"))
    of = components(edges)
    by_id, by_seq = of.select(F.col("node").alias("_n1"), F.col("component").alias("_c1")), of.select(F.col("node").alias("_n2"), F.col("component").alias("_c2"))
    led = lead.join(by_seq, F.col("_lead") == F.col("_n2"), "left").select(F.col("_d").alias("_e"), F.coalesce("_c2", "_lead").alias("_c2"))
    return (
        rows.join(by_id, F.col("dms_id") == F.col("_n1"), "left").join(led, F.col("_d") == F.col("_e"), "left")
        .select("row_id", "dms_id", "label", F.coalesce(
            F.concat(F.lit("id:"), F.coalesce("_c1", "dms_id")), F.concat(F.lit("id:"), F.col("_c2")), F.concat(F.lit("seq:"), F.col("_d")),
            F.concat(F.lit("row:"), F.col("row_id").cast("string"))).alias("component"))
    )


def assay_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(assay_components(spark, sf_dir), "assays")
    return split_components(rows, "component", F.col("label"))


def family_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pfam_sorted with a split for each group_id; a row without one is a component of its own."""
    t = table(spark, sf_dir, "pfam_sorted")
    rows = t.select(
        "row_id", F.coalesce(F.concat(F.lit("g:"), F.col("group_id")), F.concat(F.lit("row:"), F.col("row_id").cast("string"))).alias("component"),
        F.when(F.col("clan_id").isNull(), "no clan").otherwise("clan").alias("label"),
    )
    return split_components(rows, "component", F.col("label"))


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["row_id", "component", "split"]
    a = assay_splits(spark, sf_dir).select(F.lit("test_data_prep").alias("table_name"), *cols)
    return a.unionByName(family_splits(spark, sf_dir).select(F.lit("pfam_sorted").alias("table_name"), *cols))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of assays that one component, and so one split, holds."""
    ids = assay_splits(spark, sf_dir).where("dms_id is not null").select("dms_id", "component", "split").distinct()
    ids = materialize(ids, "ids")
    a = ids.select(F.col("dms_id").alias("dms_id_a"), F.col("component").alias("_ca"))
    b = ids.select(F.col("dms_id").alias("dms_id_b"), F.col("component").alias("_cb"))
    return a.join(b, (F.col("_ca") == F.col("_cb")) & (F.col("dms_id_a") < F.col("dms_id_b"))).select("dms_id_a", "dms_id_b")


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = p3_splits(spark, sf_dir).groupBy("table_name", "split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("component").alias("components"))
    return s


QUERIES = {"p3_found": p3_found, "p3_splits": p3_splits, "p3_shares": p3_shares}
SQL = {
    "p3_found": r"""
WITH RECURSIVE r AS (
  SELECT DISTINCT nullif(upper(regexp_replace(DMS_id, '^\s+|\s+$', '', 'g')), '') AS i,
         nullif(upper(regexp_replace(target_seq, '[^A-Za-z]', '', 'g')), '') AS s FROM test_data_prep),
h AS (SELECT i, s FROM r WHERE i IS NOT NULL AND s IS NOT NULL),
e AS (SELECT DISTINCT a.i AS x, b.i AS y FROM h a JOIN h b ON a.s = b.s),
c AS (SELECT x, y FROM e UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x)
SELECT x AS dms_id_a, y AS dms_id_b FROM c WHERE x < y"""
}
