"""Queries over vectors, metrics and probes (VEC, MET, PRB, JN19-21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions.portable import sql_hash, stable_hash
from helixframe.operators import metrics as M
from helixframe.operators import probes as PR
from helixframe.operators import sampling as S
from helixframe.operators import vectormath as V
from helixframe.plans.common import DMS, PF, TDP, T, dms, pf, tdp

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def emb(s, d):
    return T(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


_E = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
_COS = "(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)))"
_NN = f"""n AS (SELECT a.id AS q, b.id AS o, a.label AS lq, b.label AS lo, {_COS} AS sim, row_number() OVER (PARTITION BY a.id ORDER BY round({_COS}, 12) DESC, b.id) AS r FROM e a JOIN e b ON a.id <> b.id)"""


@query(f"WITH {_E} SELECT a.id, round({_COS}, 6) AS cosine, round(-sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) ** 2))), 6) AS neg_distance FROM e a JOIN e b ON b.id = a.id + 1")
def vec3_aligned_similarity(s, d):
    a = emb(s, d)
    b = a.select((F.col("id") - 1).alias("j"), F.col("v").alias("w"))
    return a.join(b, F.col("id") == F.col("j")).select("id", F.round(V.cosine("v", "w"), 6).alias("cosine"), F.round(V.negative_distance("v", "w"), 6).alias("neg_distance"))


@query("WITH t AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT id, [round(((v[1] + v[5] * (id % 2)) / (1 + id % 2)), 6), round((v[2] + v[6] * (id % 2)) / (1 + id % 2), 6)] AS pooled FROM t")
def vec2_mean_pool(s, d):
    e = emb(s, d)
    tokens = F.array(F.slice("v", 1, 2), F.slice("v", 5, 2), F.slice("v", 9, 2))
    mask = F.array(F.lit(1), (F.col("id") % 2).cast("int"), F.lit(0))
    return e.select("id", F.transform(V.mean_pool(tokens, mask), lambda x: F.round(x, 6)).alias("pooled"))


@query("""WITH t AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), w AS (SELECT id, v, exp(0.5 * v[1] - 0.25 * v[2]) AS a, exp(0.5 * v[5] - 0.25 * v[6]) AS b FROM t)
SELECT id, [round((a * v[1] + b * v[5]) / (a + b), 6), round((a * v[2] + b * v[6]) / (a + b), 6)] AS pooled FROM w""")
def vec5_attention_pool(s, d):
    tokens = F.array(F.slice("v", 1, 2), F.slice("v", 5, 2), F.slice("v", 9, 2))
    return emb(s, d).select("id", F.transform(V.attention_pool(tokens, F.array(F.lit(1), F.lit(1), F.lit(0)), [0.5, -0.25]), lambda x: F.round(x, 6)).alias("pooled"))


@query("""WITH t AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT id, list_transform([1, 2], lambda i: (sign(v[i]) * greatest(abs(v[i]), 1e-6) ** 3 + sign(v[i + 4]) * greatest(abs(v[i + 4]), 1e-6) ** 3) / 2) AS m FROM t)
SELECT id, list_transform(m, lambda x: round(sign(x) * greatest(abs(x), 1e-18) ** (1.0 / 3), 6)) AS pooled FROM m""")
def vec7_generalised_mean(s, d):
    tokens = F.array(F.slice("v", 1, 2), F.slice("v", 5, 2))
    return emb(s, d).select("id", F.transform(V.gem_pool(tokens, F.array(F.lit(1), F.lit(1)), 3.0), lambda x: F.round(x, 6)).alias("pooled"))


@query(None)
def vec6_contextual_pool(s, d):
    import numpy as np

    rng = np.random.default_rng(0)
    e = emb(s, d).select("id", F.array(F.slice("v", 1, 8), F.slice("v", 9, 8)).alias("t"), F.array(F.lit(1), F.lit(1)).alias("m"))
    return V.contextual_pool(e, "id", "t", "m", rng.standard_normal((8, 4)), np.zeros(4), rng.standard_normal(4))


@query(f"WITH {_E}, p AS (SELECT a.id, unnest([8, 16, 32, 64]) AS dims, a.v AS x, b.v AS y FROM e a JOIN e b ON b.id = a.id + 1) SELECT id, dims, round(list_dot_product(x[:dims], y[:dims]) / sqrt(list_dot_product(x[:dims], x[:dims]) * list_dot_product(y[:dims], y[:dims])), 6) AS cosine FROM p")
def vec8_prefix_cosine(s, d):
    a = emb(s, d)
    b = a.select((F.col("id") - 1).alias("j"), F.col("v").alias("w"))
    j = a.join(b, F.col("id") == F.col("j"))
    return j.select("id", F.explode(F.array(*[F.struct(F.lit(n).alias("dims"), F.round(V.cosine(V.prefix("v", n), V.prefix("w", n)), 6).alias("cosine")) for n in (8, 16, 32, 64)])).alias("x")).select("id", "x.*")


@query("SELECT row_id, [length(x.s), length(x.s) - length(replace(x.s, 'A', ''))] AS vector FROM (SELECT row_id, upper(regexp_replace(sentence_0, '[^A-Za-z]', '', 'g')) AS s FROM dms_cosent) x")
def vec1_encode_unique(s, d):
    enc = lambda u: u.select("s0", F.array(F.length("s0"), F.length("s0") - F.length(F.replace("s0", F.lit("A"), F.lit("")))).alias("vector"))
    out = V.encode_unique(dms(s, d).select("row_id", "s0"), "s0", enc)
    return out.select("row_id", F.when(F.col("s0").isNotNull(), F.col("vector")).otherwise(F.array(F.lit(None).cast("int"), F.lit(None).cast("int"))).alias("vector"))


@query(f"WITH {_E}, {_NN} SELECT q AS query_id, o AS other_id, CAST(r AS INTEGER) AS rank, round(sim, 6) AS similarity FROM n WHERE r <= 5")
def jn19_cosine_neighbours(s, d):
    e = emb(s, d)
    return V.block_neighbours(e, e, 5).select("query_id", "other_id", "rank", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_E}, {_NN}, f AS (SELECT q, min(CASE WHEN lq = lo THEN r END) AS r FROM n GROUP BY 1) SELECT " + ", ".join(f"round(avg(CASE WHEN r <= {k} THEN 1.0 ELSE 0 END), 6) AS recall_at_{k}" for k in (1, 10, 30)) + " FROM f")
def met7_recall_at_k(s, d):
    e = emb(s, d)
    r = M.recall_at(V.block_neighbours(e, e, 30), e, [1, 10, 30])
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


_TT = f"tr AS (SELECT * FROM e WHERE id % 5 > 0), te AS (SELECT * FROM e WHERE id % 5 = 0)"
_KNN = """k AS (SELECT te.id AS q, tr.label AS l, row_number() OVER (PARTITION BY te.id ORDER BY round(sqrt(greatest(list_sum(list_transform(list_zip(te.v, tr.v), lambda x: (x[1] - x[2]) ** 2)), 0)), 12), tr.id) AS r FROM te JOIN tr ON true)"""


@query(f"WITH {_E}, {_TT}, {_KNN}, v AS (SELECT q, l, count(*) AS n FROM k WHERE r <= 3 GROUP BY 1, 2) SELECT q AS query_id, l AS guess FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, l) AS x FROM v) WHERE x = 1")
def prb1_knn_classify(s, d):
    e = emb(s, d)
    return PR.knn_votes(e.where("id % 5 > 0"), e.where("id % 5 = 0"), "label")


@query(f"WITH {_E}, {_TT}, {_KNN} SELECT q AS query_id, round(avg(l), 6) AS guess FROM k WHERE r <= 3 GROUP BY 1")
def prb1_knn_regress(s, d):
    e = emb(s, d)
    return PR.knn_means(e.where("id % 5 > 0"), e.where("id % 5 = 0"), "label").select("query_id", F.round("guess", 6).alias("guess"))


@query(None)
def prb2_ridge(s, d):
    e = emb(s, d)
    return PR.ridge(e.where("id % 5 > 0"), e.where("id % 5 = 0"), "label", 64).select("query_id", F.round("guess", 5).alias("guess"))


@query(None)
def prb2_logistic(s, d):
    e = emb(s, d).withColumn("y", (F.col("label") >= 5).cast("double"))
    return PR.logistic(e.where("id % 5 > 0"), e.where("id % 5 = 0"), "y", 64)


@query(None)
def prb3_boosted(s, d):
    e = emb(s, d).withColumn("y", (F.col("label") >= 5).cast("double"))
    return PR.boosted(e.where("id % 5 > 0"), e.where("id % 5 = 0"), "y", True, rounds=5)


@query("WITH u AS (SELECT dataset AS label FROM dataset_info WHERE row_id % 2 = 0 UNION SELECT dataset FROM dataset_info WHERE row_id % 2 = 1) SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS code FROM u WHERE label IS NOT NULL")
def prb4_encode_labels(s, d):
    t = T(s, d, "dataset_info").select("row_id", F.col("dataset").alias("label"))
    return PR.encode_labels(t.where("row_id % 2 = 0").select("label"), t.where("row_id % 2 = 1").select("label"), "label")


@query("""WITH l AS (SELECT doc_id, list_sort(list_distinct(list(lower(subject_area)))) AS labels FROM subject_labels WHERE subject_area IS NOT NULL GROUP BY 1),
top AS (SELECT x FROM (SELECT unnest(labels) AS x FROM l WHERE doc_id % 3 > 0) GROUP BY 1 ORDER BY count(*) DESC, x LIMIT 4)
SELECT doc_id, list_filter(labels, lambda y: list_contains(k.t, y)) AS labels FROM l, (SELECT list(x) AS t FROM top) k""")
def prb5_top_labels(s, d):
    t = T(s, d, "subject_labels").where("subject_area is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.lower("subject_area"))).alias("labels"))
    return PR.keep_top_labels(t, t.where("doc_id % 3 > 0"), "labels", 4)


@query("SELECT name, CASE WHEN problem_type IN ('retrieval', 'multilabel') THEN 'linear' ELSE 'knn' END AS probe FROM task_config")
def prb6_effective_probe(s, d):
    return T(s, d, "task_config").select("name", PR.effective_probe(F.col("problem_type"), F.lit("probe"), F.lit("knn")).alias("probe"))


def _guess(s, d):
    t = T(s, d, "lineitem").select("l_returnflag", F.when(F.col("l_quantity") > 40, "R").when(F.col("l_discount") > 0.05, "A").otherwise("N").alias("guess"), "l_linestatus")
    return t


_GUESS = "g AS (SELECT l_returnflag AS t, CASE WHEN l_quantity > 40 THEN 'R' WHEN l_discount > 0.05 THEN 'A' ELSE 'N' END AS p, l_linestatus FROM lineitem)"


@query(f"WITH {_GUESS} SELECT l_linestatus, round(avg(CAST(t = p AS INTEGER)), 6) AS accuracy FROM g GROUP BY 1")
def met1_accuracy(s, d):
    return _guess(s, d).groupBy("l_linestatus").agg(F.round(M.accuracy("l_returnflag", "guess"), 6).alias("accuracy"))


@query(f"""WITH {_GUESS}, c AS (SELECT c, count_if(t = c AND p = c) AS tp, count_if(t <> c AND p = c) AS fp, count_if(t = c AND p <> c) AS fn FROM g, (SELECT DISTINCT t AS c FROM g UNION SELECT DISTINCT p FROM g) GROUP BY 1), f AS (SELECT *, 2.0 * tp / (2 * tp + fp + fn) AS f1 FROM c)
SELECT round(avg(f1), 6) AS f1_macro, round(sum(f1 * (tp + fn)) / sum(tp + fn), 6) AS f1_weighted, round(sum(tp) / sum(tp + fn), 6) AS f1_micro, round(max(CASE WHEN c = 'R' THEN f1 END), 6) AS f1_binary FROM f""")
def met2_f1(s, d):
    r = M.f1_scores(_guess(s, d), "l_returnflag", "guess", positive="R")
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query(f"WITH {_GUESS} SELECT t AS truth, p AS guess, count(*) AS n FROM g GROUP BY 1, 2")
def met2_confusion(s, d):
    return M.confusion(_guess(s, d).withColumnRenamed("l_returnflag", "truth"), "truth", "guess", [])


@query("""WITH x AS (SELECT event_type AS g, value AS s, user_id % 3 = 0 AS y FROM events), r AS (SELECT g, y, rank() OVER (PARTITION BY g ORDER BY s) + (count(*) OVER (PARTITION BY g, s) - 1) / 2.0 AS r FROM x)
SELECT g AS event_type, round((sum(r) FILTER (WHERE y) - count_if(y) * (count_if(y) + 1) / 2.0) / (count_if(y) * count_if(NOT y)), 6) AS auc FROM r GROUP BY 1""")
def met3_roc_auc(s, d):
    e = T(s, d, "events")
    return M.roc_auc(e, F.col("user_id") % 3 == 0, "value", ["event_type"]).select("event_type", F.round("auc", 6).alias("auc"))


@query("""WITH x AS (SELECT p_brand AS c, CAST(p_size AS DOUBLE) * (1 + p_partkey % 7) AS s FROM part), k AS (SELECT DISTINCT c AS k FROM x), r AS (SELECT k, c = k AS y, rank() OVER (PARTITION BY k ORDER BY s) + (count(*) OVER (PARTITION BY k, s) - 1) / 2.0 AS r FROM x, k),
a AS (SELECT k, (sum(r) FILTER (WHERE y) - count_if(y) * (count_if(y) + 1) / 2.0) / (count_if(y) * count_if(NOT y)) AS auc FROM r GROUP BY 1) SELECT round(avg(auc), 6) AS auc_macro FROM a""")
def met3_one_vs_rest(s, d):
    p = T(s, d, "part").select("p_brand", (F.col("p_size").cast("double") * (1 + F.col("p_partkey") % 7)).alias("s"))
    return M.one_vs_rest_auc(p, "p_brand", "s").agg(F.round(F.avg("auc"), 6).alias("auc_macro"))


@query("""WITH x AS (SELECT event_type AS g, value AS s, user_id % 3 = 0 AS y FROM events), c AS (SELECT g, s, count_if(y) AS p, count(*) AS n FROM x GROUP BY 1, 2), w AS (SELECT g, p, p * sum(p) OVER o / sum(n) OVER o AS w FROM c WINDOW o AS (PARTITION BY g ORDER BY s DESC))
SELECT g AS event_type, round(sum(w) / sum(p), 6) AS average_precision FROM w GROUP BY 1""")
def met4_average_precision(s, d):
    return M.average_precision(T(s, d, "events"), F.col("user_id") % 3 == 0, "value", ["event_type"]).select("event_type", F.round("average_precision", 6).alias("average_precision"))


@query(f"""WITH {TDP}, x AS (SELECT dms_id, score AS a, length(mutant) AS b FROM tdp WHERE score IS NOT NULL AND mutant IS NOT NULL), r AS (SELECT dms_id, rank() OVER (PARTITION BY dms_id ORDER BY a) + (count(*) OVER (PARTITION BY dms_id, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY dms_id ORDER BY b) + (count(*) OVER (PARTITION BY dms_id, b) - 1) / 2.0 AS rb FROM x)
SELECT dms_id, count(*) AS n, round(coalesce(CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END, 0), 6) + 0.0 AS spearman FROM r GROUP BY 1""")
def met5_spearman(s, d):
    t = tdp(s, d).withColumn("len", F.length("mutant"))
    return M.spearman(t, "score", "len", ["dms_id"]).select("dms_id", "n", (F.round("spearman", 6) + F.lit(0.0)).alias("spearman"))


@query(f"WITH {DMS} SELECT round(avg((score - length(s0) / 1000.0) ** 2), 6) AS mse FROM dms WHERE score IS NOT NULL AND s0 IS NOT NULL")
def met6_mse(s, d):
    return dms(s, d).where("score is not null and s0 is not null").agg(F.round(M.mse("score", F.length("s0") / 1000), 6).alias("mse"))


@query("""WITH x AS (SELECT row_id, list_sort(list_distinct(list_filter([CASE WHEN length(s) > 200 THEN 'long' END, CASE WHEN s LIKE '%W%' THEN 'w' END, CASE WHEN s LIKE 'M%' THEN 'm' END], lambda y: y IS NOT NULL))) AS t,
list_sort(list_distinct(list_filter([CASE WHEN length(s) > 220 THEN 'long' END, CASE WHEN s LIKE '%WW%' THEN 'w' END, CASE WHEN s LIKE 'MA%' THEN 'm' END], lambda y: y IS NOT NULL))) AS g FROM (SELECT row_id, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) AS s FROM dataset_info) WHERE s IS NOT NULL), k AS (SELECT * FROM x WHERE len(t) > 0),
c AS (SELECT c, count_if(list_contains(t, c) AND list_contains(g, c)) AS tp, count_if(NOT list_contains(t, c) AND list_contains(g, c)) AS fp, count_if(list_contains(t, c) AND NOT list_contains(g, c)) AS fn FROM k, (SELECT unnest(['long', 'm', 'w']) AS c) GROUP BY 1)
SELECT (SELECT round(avg(CAST(t = g AS INTEGER)), 6) FROM k) AS subset_accuracy, round(avg(2.0 * tp / (2 * tp + fp + fn)), 6) AS f1_macro, round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1_micro FROM c""")
def met8_multilabel(s, d):
    from helixframe.util import residues

    x = T(s, d, "dataset_info").select(residues("sequence").alias("s")).where("s is not null")
    arr = lambda n, w, m: F.filter(F.array(F.when(F.length("s") > n, "long"), F.when(F.col("s").contains(w), "w"), F.when(F.col("s").startswith(m), "m")), lambda y: y.isNotNull())
    r = M.multilabel_scores(x.select(arr(200, "W", "M").alias("t"), arr(220, "WW", "MA").alias("g")), "t", "g")
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


_ZS = f"""p AS (SELECT a.label, {_COS} AS sim, CAST((a.id * 7) % 11 AS DOUBLE) AS y FROM e a JOIN e b ON b.id = a.id + 1)"""


@query(f"""WITH {_E}, {_ZS}, r AS (SELECT label, rank() OVER (PARTITION BY label ORDER BY sim) + (count(*) OVER (PARTITION BY label, sim) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY label ORDER BY y) + (count(*) OVER (PARTITION BY label, y) - 1) / 2.0 AS rb FROM p),
g AS (SELECT label, count(*) AS n, corr(ra, rb) AS m FROM r GROUP BY 1 HAVING count(*) >= 2) SELECT round(avg(m), 6) AS macro_mean, count(m) AS groups FROM g""")
def prb8_zero_shot(s, d):
    a = emb(s, d)
    b = a.select((F.col("id") - 1).alias("j"), F.col("v").alias("w"))
    x = a.join(b, F.col("id") == F.col("j")).withColumn("y", ((F.col("id") * 7) % 11).cast("double"))
    m = PR.macro(PR.zero_shot(x, "label", "v", "w", "y"))
    return m.select(F.round("macro_mean", 6).alias("macro_mean"), "groups")


@query(f"WITH {_E}, f AS (SELECT id, label, (row_number() OVER (PARTITION BY label ORDER BY {sql_hash(1, 'id')}, id) - 1) % 4 AS fold FROM e), k AS (SELECT fold, avg(CAST(label % 2 = (id % 2) AS INTEGER)) AS m FROM f GROUP BY 1) SELECT round(avg(m), 6) AS macro_mean, count(m) AS groups FROM k")
def agg17_fold_means(s, d):
    e = emb(s, d).select("id", F.col("label").cast("string").alias("l"), "label")
    f = S.stratified_folds(e, "l", 4, 1, "id")
    return PR.macro(f.groupBy("fold").agg(F.avg((F.col("label") % 2 == F.col("id") % 2).cast("int")).alias("metric"))).select(F.round("macro_mean", 6).alias("macro_mean"), "groups")
