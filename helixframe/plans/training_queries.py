"""Queries over assays, samples and training sets (WIN, SMP, JN7-8, JN18, TRN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions.portable import hash_cap, sql_hash
from helixframe.operators import assays as A
from helixframe.operators import pairs as TR
from helixframe.operators import sampling as S
from helixframe.plans.common import DMS, PF, TDP, T, dms, pf, tdp

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_Z = "CASE WHEN s IS NOT NULL AND score IS NOT NULL THEN (least(greatest((score - m) / greatest(s, 1e-8), -3.0), 3.0) + 3) / 6 END"


@query(f"WITH {TDP}, g AS (SELECT dms_id, avg(score) AS m, stddev_samp(score) AS s FROM tdp GROUP BY 1) SELECT row_id, round({_Z}, 6) AS scaled FROM tdp JOIN g ON tdp.dms_id IS NOT DISTINCT FROM g.dms_id")
def win1_assay_scale(s, d):
    return A.scaled_scores(tdp(s, d), "dms_id", "score").select("row_id", F.round("scaled", 6).alias("scaled"))


@query("""SELECT o_orderkey, coalesce(CASE lower(trim(x)) WHEN 'benign' THEN 1.0 WHEN 'pathogenic' THEN 0.0 WHEN '0' THEN 1.0 WHEN '1' THEN 0.0 END, TRY_CAST(x AS DOUBLE)) AS score
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN ' Benign' WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Pathogenic' ELSE '0.25' END ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Unknown' ELSE '1' END END AS x FROM orders)
WHERE coalesce(CASE lower(trim(x)) WHEN 'benign' THEN 1.0 WHEN 'pathogenic' THEN 0.0 WHEN '0' THEN 1.0 WHEN '1' THEN 0.0 END, TRY_CAST(x AS DOUBLE)) IS NOT NULL""")
def prj9_label_scores(s, d):
    even = F.col("o_orderkey") % 2 == 0
    x = F.when(F.col("o_orderstatus") == "F", " Benign").when(F.col("o_orderstatus") == "O", F.when(even, "Pathogenic").otherwise("0.25")).otherwise(F.when(even, "Unknown").otherwise("1"))
    return T(s, d, "orders").select("o_orderkey", A.label_score(x).alias("score")).where("score is not null")


_FOLD = f"""f AS (SELECT *, coalesce(count(*) OVER w >= 10 AND row_number() OVER (PARTITION BY dms_id ORDER BY {sql_hash(42, 'dms_id', 'mutant', 'row_id')}, row_id) > floor(count(*) OVER w * 0.8), false) AS is_test
FROM tdp WINDOW w AS (PARTITION BY dms_id))"""


@query(f"WITH {TDP}, {_FOLD} SELECT row_id, is_test FROM f")
def smp6_fold_flags(s, d):
    return A.fold_flags(tdp(s, d), "dms_id", "mutant").select("row_id", "is_test")


@query(f"WITH {TDP}, {_FOLD}, bad AS (SELECT DISTINCT dms_id, mutant FROM f WHERE is_test) SELECT row_id FROM f WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.dms_id = f.dms_id AND bad.mutant = f.mutant)")
def smp6_drop_test_fold(s, d):
    return A.drop_test_sequences(A.fold_flags(tdp(s, d), "dms_id", "mutant"), "dms_id", "mutant").select("row_id")


@query(rf"WITH {TDP}, bad AS (SELECT DISTINCT dms_id, mutant FROM tdp WHERE lower(trim(stage)) = 'test') SELECT row_id FROM tdp WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.dms_id = tdp.dms_id AND bad.mutant = tdp.mutant)")
def smp7_drop_named_split(s, d):
    return A.drop_named_split(tdp(s, d), "stage", "dms_id", "mutant").select("row_id")


@query(f"WITH {TDP}, {_FOLD} SELECT row_id, mutant AS sentence_0, target AS sentence_1 FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.is_test AND g.mutant = f.mutant AND g.target = f.target)")
def jn8_forbidden_pairs(s, d):
    f = A.fold_flags(tdp(s, d), "dms_id", "mutant")
    bad = f.where("is_test").select(F.col("mutant").alias("sentence_0"), F.col("target").alias("sentence_1"))
    return A.forbid_pairs(f.select("row_id", F.col("mutant").alias("sentence_0"), F.col("target").alias("sentence_1")), bad, ["sentence_0", "sentence_1"])


@query(f"WITH {TDP}, t AS (SELECT * FROM tdp WHERE dms_id IS NOT NULL) SELECT a.dms_id, a.row_id AS left_id, b.row_id AS right_id, round(abs(a.score - b.score), 6) AS gap FROM t a JOIN t b ON a.dms_id = b.dms_id AND a.row_id < b.row_id")
def jn18_pairs_inside(s, d):
    return A.pairs_inside(tdp(s, d), "dms_id", "score", "row_id").select("dms_id", "left_id", "right_id", F.round(F.abs(F.col("left") - F.col("right")), 6).alias("gap"))


@query(None)
def smp5_capped_pairs_inside(s, d):
    return A.pairs_inside(tdp(s, d), "dms_id", "score", "row_id", cap=50).select("dms_id", "left_id", "right_id")


@query(f"WITH {PF} SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY fam ORDER BY row_id) AS r FROM pf WHERE fam IS NOT NULL) WHERE r <= 5")
def win2_first_rows(s, d):
    t = S.group_place(pf(s, d).where("fam is not null").select("row_id", "fam"), "fam", "row_id")
    return t.where("_place < 5").select("row_id")


@query(f"WITH {PF} SELECT row_id, fam FROM (SELECT row_id, fam, row_number() OVER (PARTITION BY fam ORDER BY {sql_hash(7, 'fam', 'row_id')}, row_id) AS r FROM pf WHERE fam IS NOT NULL) WHERE r <= 25")
def win3_random_rows(s, d):
    return S.sample_per_group(pf(s, d).where("fam is not null").select("row_id", "fam"), ["fam"], 25, 7, "row_id")


@query(f"WITH {PF} SELECT row_id, row_number() OVER (ORDER BY {sql_hash(42, 'row_id')}, row_id) AS place FROM pf")
def smp1_shuffle(s, d):
    from helixframe.functions.portable import stable_hash
    from helixframe.operators.corpus import indexed

    t = pf(s, d).select("row_id", stable_hash(42, "row_id").alias("h"))
    return indexed(t, ["h", "row_id"], "place").select("row_id", (F.col("place") + 1).alias("place"))


@query(f"WITH {PF} SELECT row_id FROM pf ORDER BY {sql_hash(11, 'row_id')}, row_id LIMIT 1500")
def smp2_global_cap(s, d):
    return S.sample_rows(pf(s, d).select("row_id"), 1500, 11, "row_id")


@query(f"SELECT row_id, split_name FROM (SELECT row_id, split_name, row_number() OVER (PARTITION BY dataset, split_name ORDER BY {sql_hash(5, 'dataset', 'split_name', 'row_id')}, row_id) AS r FROM dataset_info) WHERE r <= 40")
def smp3_cap_per_split(s, d):
    return S.sample_per_group(T(s, d, "dataset_info").select("row_id", "dataset", "split_name"), ["dataset", "split_name"], 40, 5, "row_id").select("row_id", "split_name")


@query(f"WITH {DMS} SELECT row_id, s0 AS seq1, s1 AS seq2 FROM dms WHERE s1 <> '' ORDER BY {sql_hash(40, 'row_id')}, row_id LIMIT 700")
def smp4_capped_pairs(s, d):
    return hash_cap(dms(s, d).where("s1 <> ''").select("row_id", F.col("s0").alias("seq1"), F.col("s1").alias("seq2")), 700, 40, "row_id")


@query(f"WITH {PF}, n AS (SELECT floor(count(*) * 0.8) AS k FROM pf) SELECT row_id, CASE WHEN row_number() OVER (ORDER BY {sql_hash(3, 'row_id')}, row_id) <= k THEN 'train' ELSE 'test' END AS split FROM pf, n")
def smp8_random_split(s, d):
    return S.random_split(pf(s, d).select("row_id"), 0.8, 3, "row_id")


@query(f"WITH {PF}, g AS (SELECT DISTINCT coalesce(clan_id, '~') AS c FROM pf), n AS (SELECT floor(count(*) * 0.8) AS k FROM g), r AS (SELECT c, CASE WHEN row_number() OVER (ORDER BY {sql_hash(3, 'c')}, c) <= k THEN 'train' ELSE 'test' END AS split FROM g, n) SELECT row_id, split FROM pf JOIN r ON coalesce(clan_id, '~') = c")
def smp9_group_split(s, d):
    return S.group_split(pf(s, d).select("row_id", "clan_id"), "clan_id", 0.8, 3).select("row_id", "split")


@query(f"SELECT row_id, CAST((row_number() OVER (PARTITION BY CASE WHEN (SELECT min(n) FROM (SELECT count(*) AS n FROM dataset_info GROUP BY dataset)) >= 4 THEN dataset END ORDER BY {sql_hash(9, 'row_id')}, row_id) - 1) % 4 AS INTEGER) AS fold FROM dataset_info")
def smp12_stratified_folds(s, d):
    return S.stratified_folds(T(s, d, "dataset_info").select("row_id", "dataset"), "dataset", 4, 9, "row_id").select("row_id", "fold")


def _strategy(w):
    return f"""SELECT name, CASE WHEN problem_type = 'retrieval' THEN 'retrieval_unchanged' WHEN has_col AND '{w}' = 'test' THEN 'test_split_column' WHEN has_col AND has_val THEN 'validation_split_column' WHEN has_col THEN 'validation_cv4_train'
WHEN '{w}' = 'validation' AND has_val THEN 'validation_split' WHEN '{w}' = 'validation' THEN 'validation_cv4_train' WHEN coalesce(auto_split, false) OR NOT has_test THEN 'test_random_split' ELSE 'test_split' END AS strategy
FROM (SELECT *, coalesce(trim(split_column) <> '', false) AS has_col, coalesce(trim(validation_split) <> '', false) AS has_val, coalesce(trim(test_split) <> '', false) AS has_test FROM task_config)"""


@query(_strategy("validation"))
def smp11_strategy_validation(s, d):
    return S.strategy_column(T(s, d, "task_config"), "validation")


@query(_strategy("test"))
def smp11_strategy_test(s, d):
    return S.strategy_column(T(s, d, "task_config"), "test")


@query(f"WITH {DMS} SELECT row_id, array_to_string(list_transform(generate_series(1, length(s0)), lambda i: CASE WHEN CAST('0x' || substr(md5(concat_ws('|', '41', CAST(row_id AS VARCHAR), CAST(i AS VARCHAR))), 1, 4) AS INTEGER) < 3276 THEN '#' ELSE s0[i] END), '') AS masked FROM dms WHERE s0 <> ''")
def smp13_token_mask(s, d):
    return dms(s, d).where("s0 <> ''").select("row_id", S.masked("s0", "row_id", 0.05, 41).alias("masked"))


@query(f"WITH {PF}, top AS (SELECT fam FROM pf WHERE fam IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, fam LIMIT 10) SELECT row_id, fam FROM (SELECT row_id, fam, row_number() OVER (PARTITION BY fam ORDER BY {sql_hash(42, 'fam', 'row_id')}, row_id) AS r FROM pf WHERE fam IN (SELECT fam FROM top)) WHERE r <= 30")
def smp14_top_groups(s, d):
    return S.top_groups_sample(pf(s, d).select("row_id", "fam"), "fam", 10, 30, 42, "row_id")


_POS = f"""k AS (SELECT row_id, group_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {sql_hash(42, 'group_id', 'row_id')}, row_id) AS r FROM pf WHERE seq <> '' AND group_id IS NOT NULL) WHERE r <= 8)"""


@query(f"WITH {PF}, {_POS} SELECT a.group_id, a.row_id AS id_0, b.row_id AS id_1, a.seq AS sentence_0, b.seq AS sentence_1 FROM k a JOIN k b ON a.group_id = b.group_id AND a.row_id < b.row_id")
def trn1_positive_pairs(s, d):
    return TR.positive_pairs(pf(s, d), "seq", "group_id", "row_id", per_group=8)


@query(f"WITH {PF}, {_POS}, p AS (SELECT a.row_id AS id_0, b.row_id AS id_1, CASE WHEN a.row_id % 3 = 0 THEN '' ELSE reverse(a.seq) END AS sentence_2 FROM k a JOIN k b ON a.group_id = b.group_id AND a.row_id < b.row_id) SELECT * FROM p ORDER BY {sql_hash(42, 'id_0', 'id_1')}, id_0, id_1 LIMIT 900")
def trn1_pairs_with_negatives(s, d):
    t = pf(s, d).withColumn("hard_negative", F.when(F.col("row_id") % 3 != 0, F.reverse("seq")))
    return TR.positive_pairs(t, "seq", "group_id", "row_id", per_group=8, max_pairs=900, negative="hard_negative").select("id_0", "id_1", "sentence_2")


@query(f"WITH {PF}, o AS (SELECT row_id, group_id, CASE WHEN group_id IS DISTINCT FROM lag(group_id) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS st FROM pf WINDOW w AS (ORDER BY clan_id NULLS LAST, row_id)) , r AS (SELECT pf.row_id, pf.group_id, sum(st) OVER (ORDER BY pf.clan_id NULLS LAST, pf.row_id) AS run_id FROM pf JOIN o USING (row_id)) SELECT run_id, group_id, count(*) AS n FROM r GROUP BY 1, 2")
def win8_runs(s, d):
    t = TR.runs(pf(s, d).select("row_id", "group_id", "clan_id"), "group_id", ["clan_id", "row_id"])
    return t.groupBy("run_id", "group_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PF}, c AS (SELECT fam AS class_name, dense_rank() OVER (ORDER BY fam) - 1 AS label FROM (SELECT fam FROM pf WHERE seq <> '' AND fam IS NOT NULL GROUP BY 1 HAVING count(*) >= 6))
SELECT row_id, sentence, label, class_name FROM (SELECT row_id, seq AS sentence, label, class_name, row_number() OVER (PARTITION BY class_name ORDER BY {sql_hash(42, 'class_name', 'row_id')}, row_id) AS r FROM pf JOIN c ON fam = class_name WHERE seq <> '') WHERE r <= 25""")
def trn2_labelled_examples(s, d):
    return TR.labelled_examples(pf(s, d), "seq", "fam", "row_id")


@query(f"WITH {DMS} SELECT row_id, s0 AS sentence_0, s0 AS sentence_1, true AS is_simcse FROM dms WHERE s0 <> '' ORDER BY {sql_hash(42, 'row_id')}, row_id LIMIT 1000")
def trn3_self_pairs(s, d):
    return TR.self_pairs(dms(s, d), "s0", "row_id", 1000)


@query("SELECT row_id, sentence_0, sentence_1, CASE WHEN NOT isnan(score) THEN score END AS score FROM dms_cosent ORDER BY row_id LIMIT 300")
def trn4_scored_pairs(s, d):
    return TR.scored_pairs(T(s, d, "dms_cosent"), "row_id", 300)


def _sizes(s, d):
    return T(s, d, "dataset_info").groupBy(F.col("dataset").alias("source")).agg(F.count(F.lit(1)).alias("rows"))


_SIZES = "z AS (SELECT dataset AS source, count(*) AS rows FROM dataset_info GROUP BY 1)"


@query(f"WITH {_SIZES}, b AS (SELECT floor(rows / 16.0) AS b FROM z) SELECT count(*) AS sources, CAST(min(b) * count(*) AS BIGINT) AS steps, CAST(greatest(ceil(min(b) * count(*) / 3), 1) AS BIGINT) AS steps_per_rank FROM b")
def trn6_steps_per_epoch(s, d):
    return TR.steps_per_epoch(_sizes(s, d), 16, 3)


@query(f"WITH {_SIZES}, b AS (SELECT batch, max(floor(rows / batch) % 3) AS rest, min(floor(rows / batch)) AS n FROM z, generate_series(4, 64) AS t(batch) GROUP BY 1) SELECT min(batch) AS batch FROM b WHERE rest = 0 AND n > 0")
def trn7_divisible_batch(s, d):
    return TR.divisible_batch(_sizes(s, d), 4, 64, 3)


@query(f"""WITH z AS (SELECT dataset, count(*) AS n, dense_rank() OVER (ORDER BY dataset) - 1 AS k FROM dataset_info GROUP BY 1), m AS (SELECT floor(min(n) / 8.0) AS f, count(*) AS c FROM z),
r AS (SELECT dataset, row_id, floor((row_number() OVER (PARTITION BY dataset ORDER BY {sql_hash(42, 'row_id')}, row_id) - 1) / 8.0) AS batch_id FROM dataset_info)
SELECT r.dataset, row_id, CAST(batch_id AS BIGINT) AS batch_id, CAST(batch_id * c + k AS BIGINT) AS turn FROM r JOIN z USING (dataset), m WHERE batch_id < f""")
def trn9_round_robin(s, d):
    return TR.interleave(T(s, d, "dataset_info").select("dataset", "row_id"), "dataset", "row_id", 8)
