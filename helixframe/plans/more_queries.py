"""Remaining projections, filters, batches and reports, and whole preparations."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions.portable import sql_hash, stable_hash
from helixframe.operators import corpus as C
from helixframe.operators import ledger as L
from helixframe.operators import metrics as M
from helixframe.operators import pairs as TR
from helixframe.operators import probes as PR
from helixframe.plans import pipelines as PL
from helixframe.plans.common import PF, TDP, T, pf, tdp
from helixframe.plans.evaluation_queries import emb

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT row_id, dataset, coalesce(nullif(trim(split_name), ''), 'test') AS EvalSplit, 'linear' AS Probe FROM dataset_info")
def prj6_default_columns(s, d):
    df = T(s, d, "dataset_info").select("row_id", "dataset", F.trim("split_name").alias("EvalSplit"))
    return L.with_defaults(df, {"EvalSplit": "test", "Probe": "linear"})


@query("SELECT name, problem_type, validation_split FROM task_config")
def prj13_informative_columns(s, d):
    t = T(s, d, "task_config").select("name", "problem_type", "validation_split", F.lit("x").alias("same"), F.lit(None).cast("string").alias("none"))
    return C.informative_columns(t, {"same": "x", "none": None, "problem_type": "odd"})


@query("SELECT row_id, entry_id FROM dataset_info")
def prj14_drop_null_columns(s, d):
    return C.drop_null_columns(T(s, d, "dataset_info").select("row_id", "entry_id", F.lit(None).cast("double").alias("blank")))


@query("SELECT row_id, sequence FROM dataset_info")
def prj4_drop_redundant(s, d):
    return C.drop_redundant(T(s, d, "dataset_info").select("row_id", "sequence", F.col("sequence").alias("copy")), "copy", "sequence")


@query("SELECT entry_id, seq_length AS baseline_length, disorder_mean AS baseline_disorder FROM dataset_info WHERE disorder_mean IS NOT NULL AND NOT isnan(disorder_mean)")
def prj11_prefixed_columns(s, d):
    return T(s, d, "dataset_info").where(F.col("disorder_mean").isNotNull() & ~F.isnan("disorder_mean")).select("entry_id", F.col("seq_length").alias("baseline_length"), F.col("disorder_mean").alias("baseline_disorder"))


@query("SELECT row_id FROM dataset_info WHERE abs(seq_length - num_residues_scored) / greatest(num_residues_scored, 1) <= 0.05")
def flt11_relative_tolerance(s, d):
    return T(s, d, "dataset_info").where(F.abs(F.col("seq_length") - F.col("num_residues_scored")) / F.greatest("num_residues_scored", F.lit(1)) <= 0.05).select("row_id")


@query(f"WITH {PF} SELECT row_id, seq FROM pf WHERE seq IS NOT NULL AND seq <> ''")
def flt16_checked_rows(s, d):
    return C.check_clean(pf(s, d).where("seq <> ''").select("row_id", "seq"), ["seq"])


@query("SELECT e.vec_id, i.dataset FROM sequence_vectors e LEFT JOIN (SELECT entry_id, min(dataset) AS dataset FROM dataset_info GROUP BY 1) i ON e.owner_key = i.entry_id")
def jn21_lookup_by_key(s, d):
    i = T(s, d, "dataset_info").groupBy("entry_id").agg(F.min("dataset").alias("dataset"))
    e = T(s, d, "sequence_vectors").select("vec_id", "owner_key")
    return e.join(i, e.owner_key == i.entry_id, "left").select("vec_id", "dataset")


@query("SELECT dataset, max_by(row_id, (measured, row_id)) AS latest FROM (SELECT dataset, row_id, released_at AS measured FROM dataset_info WHERE released_at IS NOT NULL) GROUP BY 1")
def jn23_latest_row(s, d):
    return T(s, d, "dataset_info").where("released_at is not null").groupBy("dataset").agg(F.max_by("row_id", F.struct("released_at", "row_id")).alias("latest"))


@query("SELECT o_custkey, list_transform(generate_series(1, len(k) - 1), lambda i: k[i + 1] - k[i]) AS gaps FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS k FROM orders GROUP BY 1) WHERE len(k) > 1")
def win14_adjacent_gaps(s, d):
    k = T(s, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("k")).where("size(k) > 1")
    return k.select("o_custkey", C.adjacent_gaps(F.col("k")).alias("gaps"))


@query("""WITH h AS (SELECT row_id, md5(upper(regexp_replace(sentence_0, '[^A-Za-z]', '', 'g'))) AS t FROM dms_cosent WHERE sentence_0 IS NOT NULL), b AS (SELECT row_id, row_number() OVER (PARTITION BY t ORDER BY %s, row_id) AS block FROM h),
p AS (SELECT row_id, block, row_number() OVER (PARTITION BY block ORDER BY %s, row_id) AS pos, floor(count(*) OVER (PARTITION BY block) / 16.0) AS f FROM b), z AS (SELECT block, max(f) AS f FROM p GROUP BY 1), c AS (SELECT block, coalesce(sum(f) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM z)
SELECT row_id, CAST(first + floor((pos - 1) / 16.0) AS BIGINT) AS batch_id FROM p JOIN c USING (block) WHERE floor((pos - 1) / 16.0) < f""" % (sql_hash(42, "row_id"), sql_hash(42, "row_id")))
def trn9_distinct_batches(s, d):
    from helixframe.util import residues

    return TR.distinct_batches(T(s, d, "dms_cosent").select("row_id", residues("sentence_0").alias("t")), "t", "row_id", 16)


@query(f"""WITH r AS (SELECT row_id, dataset, floor((row_number() OVER (PARTITION BY dataset ORDER BY {sql_hash(42, 'row_id')}, row_id) - 1) / 4.0) AS st FROM dataset_info WHERE dataset IS NOT NULL), f AS (SELECT dataset, st FROM r GROUP BY 1, 2 HAVING count(*) = 4),
o AS (SELECT dataset, st, floor((row_number() OVER (ORDER BY st, {sql_hash(42, 'dataset', 'CAST(st AS BIGINT)')}, dataset) - 1) / 3.0) AS b FROM f) SELECT row_id, dataset, CAST(b AS BIGINT) AS batch_id FROM r JOIN o USING (dataset, st)""")
def trn9_label_batches(s, d):
    return TR.label_batches(T(s, d, "dataset_info").select("row_id", "dataset"), "dataset", "row_id", 4, 3)


@query(None)
def prb7_assay_ridge(s, d):
    aa = "ACDEFGHIKLMNPQRSTVWY"
    n = F.greatest(F.length("mutant"), F.lit(1))
    comp = F.array(*[(F.length("mutant") - F.length(F.replace("mutant", F.lit(a), F.lit("")))) / n for a in aa])
    t = tdp(s, d).where("mutant <> '' and dms_id is not null").withColumn("v", comp)
    return PR.assay_ridge(t, "dms_id", "mutant", "v", "score", 20)


@query(None)
def vec9_plane(s, d):
    return PR.plane(emb(s, d), "id", "v")


@query("SELECT name AS \"Task\", CASE problem_type WHEN 'binary' THEN 'Binary' WHEN 'multiclass' THEN 'Multiclass' WHEN 'multilabel' THEN 'Multilabel' WHEN 'regression' THEN 'Regression' WHEN 'retrieval' THEN 'Retrieval' ELSE 'Other' END AS \"Group\", row_number() OVER (ORDER BY CASE problem_type WHEN 'binary' THEN 0 WHEN 'multiclass' THEN 1 WHEN 'multilabel' THEN 2 WHEN 'regression' THEN 3 WHEN 'retrieval' THEN 4 ELSE 5 END, name) AS place FROM task_config")
def srt3_group_order(s, d):
    from pyspark.sql import Window

    t = L.with_groups(T(s, d, "task_config").select(F.col("name").alias("Task")), T(s, d, "task_config"))
    w = Window.orderBy(L.ranked(F.col("Group"), L.GROUP_ORDER), "Task")
    return t.select("Task", "Group", F.row_number().over(w).cast("bigint").alias("place"))


@query("""SELECT doc_id, '{"kind":"' || kind || '","lang":"' || coalesce(lang, '-') || '"}' AS js, substr(sha256(coalesce(source, '')), 1, 12) AS digest, abs(doc_id % 7 - 3) AS a, greatest(doc_id % 5, 2) AS g, round(log2(doc_id + 1), 6) AS l, ceil(doc_id / 7.0) AS c,
regexp_extract('x/models_' || kind, 'models_(.*)$', 1) AS short FROM documents WHERE kind IS NOT NULL""")
def fn_json_hash_math(s, d):
    t = T(s, d, "documents").where("kind is not null")
    js = F.to_json(F.struct("kind", F.coalesce("lang", F.lit("-")).alias("lang")))
    k = F.col("doc_id")
    return t.select("doc_id", js.alias("js"), F.substring(F.sha2(F.coalesce("source", F.lit("")).cast("binary"), 256), 1, 12).alias("digest"), F.abs(k % 7 - 3).alias("a"), F.greatest(k % 5, F.lit(2)).alias("g"), F.round(F.log2(k + 1), 6).alias("l"),
                    F.ceil(k / 7).cast("double").alias("c"), F.regexp_extract(F.concat(F.lit("x/models_"), "kind"), "models_(.*)$", 1).alias("short"))


_SP = f"""{TDP}, a AS (SELECT * FROM tdp WHERE NOT starts_with(dms_id, 'B')), bad AS (SELECT DISTINCT dms_id, mutant FROM a WHERE coalesce(lower(trim(stage)), '') = 'test'), pairs AS (SELECT DISTINCT mutant, target FROM a WHERE coalesce(lower(trim(stage)), '') = 'test'),
k AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.dms_id = a.dms_id AND bad.mutant = a.mutant)), g AS (SELECT dms_id, avg(score) AS m, stddev_samp(score) AS s FROM k GROUP BY 1)"""


@query(f"WITH {_SP} SELECT mutant AS sentence_0, target AS sentence_1, round(CASE WHEN s IS NOT NULL AND score IS NOT NULL THEN (least(greatest((score - m) / greatest(s, 1e-8), -3.0), 3.0) + 3) / 6 END, 6) AS score FROM k JOIN g USING (dms_id) WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE pairs.mutant = k.mutant AND pairs.target = k.target)")
def etl_scored_pairs(s, d):
    t = C.exclude_prefixes(tdp(s, d), "dms_id", ["B"]).select("row_id", F.col("dms_id").alias("DMS_id"), F.col("mutant").alias("mutated_sequence"), F.col("target").alias("target_seq"), F.col("score").alias("DMS_score"), "stage")
    return PL.scored_pairs([t], []).withColumn("score", F.round("score", 6))


@query(f"WITH {PF}, c AS (SELECT fam, min(clan_id) AS clan FROM pf WHERE clan_id IS NOT NULL GROUP BY 1) SELECT row_id, fam AS family_id, coalesce(clan, fam) AS clan_id FROM pf LEFT JOIN c USING (fam) WHERE seq <> '' AND fam IS NOT NULL AND fam IN (SELECT fam FROM pf WHERE seq <> '' GROUP BY 1 HAVING count(*) >= 2)")
def etl_family_corpus(s, d):
    r = pf(s, d)
    parents = r.where("clan_id is not null and fam is not null").groupBy(F.col("fam").alias("family_id")).agg(F.min("clan_id").alias("clan_id"))
    return PL.family_corpus(r.select("row_id", F.col("seq").alias("sequence"), F.col("fam").alias("family_id"), "domain_id"), parents).select("row_id", "family_id", "clan_id")


@query(None)
def etl_hard_negatives(s, d):
    from helixframe.operators.negatives import profile_table

    r = pf(s, d)
    corpus = r.where("fam is not null and seq <> ''").select("row_id", F.col("seq").alias("sequence"), F.col("fam").alias("family_id"))
    return PL.with_hard_negatives(corpus, profile_table(r, "fam", "seq"), per_family=50, tolerance=0.5).select("row_id", "family_id", "hard_negative")
