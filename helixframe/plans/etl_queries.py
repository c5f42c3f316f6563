"""Queries over FASTA records, clusters, hard negatives and task preparation (SRC5, CLU, TRN11-13, SMP11)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from helixframe.functions.portable import sql_hash
from helixframe.operators import clustering as CL
from helixframe.operators import negatives as N
from helixframe.operators import tasks as TK
from helixframe.plans.common import PF, T, dms, pf
from helixframe.sources.readers import parse_fasta
from helixframe.util import residues

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(r"""WITH r AS (SELECT regexp_split_to_array(substr(text, 2), '\r?\n') AS l FROM documents WHERE starts_with(text, '>')),
p AS (SELECT regexp_split_to_array(trim(l[1], chr(32)), '\s+')[1] AS id, regexp_replace(array_to_string(l[2:], ''), '\s+', '', 'g') AS sequence FROM r) SELECT id, sequence FROM p WHERE sequence <> '' AND id <> ''""")
def src6_fasta_records(s, d):
    return parse_fasta(T(s, d, "documents").where(F.col("text").startswith(">")).select("text"), "text")


@query(r"""WITH r AS (SELECT domain_id || ' U.1 ' || family_id || ';x' AS h, sequence FROM pfam_sorted WHERE domain_id IS NOT NULL AND family_id IS NOT NULL AND sequence IS NOT NULL),
p AS (SELECT regexp_split_to_array(trim(h, chr(32)), '\s+') AS t, regexp_replace(sequence, '\s+', '', 'g') AS sequence FROM r)
SELECT t[1] AS domain_id, split_part(split_part(t[3], ';', 1), '.', 1) AS family_id, sequence FROM p WHERE sequence <> ''""")
def src5_family_fasta(s, d):
    rec = F.concat(F.lit(">"), F.col("domain_id"), F.lit(" U.1 "), F.col("family_id"), F.lit(";x\n"), F.col("sequence"))
    return parse_fasta(T(s, d, "pfam_sorted").select(rec.alias("value")).where("value is not null"), family=True)


@query(None)
def clu1_linear_clusters(s, d):
    return CL.linear_clusters(pf(s, d), "row_id", "seq")


@query(None)
def clu2_cascaded_clusters(s, d):
    return CL.cascaded_clusters(dms(s, d).select("row_id", "s0"), "row_id", "s0")


@query(None)
def clu3_benchmark_removal(s, d):
    corpus = dms(s, d).where("s0 <> ''").select(F.concat(F.lit("c"), F.col("row_id")).alias("id"), F.col("s0").alias("seq"))
    bench = T(s, d, "dataset_info").where(F.lower(F.trim("split_name")) == "test").select(F.concat(F.lit("b"), F.col("row_id")).alias("id"), residues("sequence").alias("seq"))
    return CL.remove_benchmark(corpus, bench, "id", "seq").select("id")


_PROFILE = f"""{PF}, c AS (SELECT fam, i - 1 AS pos, seq[i] AS aa FROM (SELECT fam, seq, unnest(generate_series(1, length(seq))) AS i FROM pf WHERE fam IS NOT NULL AND seq IS NOT NULL)),
k AS (SELECT fam, pos, aa, count(*) AS n FROM c WHERE contains('ACDEFGHIKLMNPQRSTVWY', aa) GROUP BY ALL), t AS (SELECT fam, pos, sum(n) AS t FROM k GROUP BY ALL), a AS (SELECT unnest(string_split('ACDEFGHIKLMNPQRSTVWY', '')) AS aa),
p AS (SELECT t.fam, t.pos, a.aa, log2((coalesce(n, 0) + 0.5) / (t.t + 10.0)) - log2(0.05) AS lo FROM t CROSS JOIN a LEFT JOIN k ON k.fam = t.fam AND k.pos = t.pos AND k.aa = a.aa)"""


@query(f"WITH {_PROFILE} SELECT fam AS family, CAST(pos AS INTEGER) AS pos, aa, round(lo, 6) AS log_odds FROM p")
def trn11_profiles(s, d):
    return N.profile_table(pf(s, d), "fam", "seq").withColumn("log_odds", F.round("log_odds", 6))


@query(f"WITH {_PROFILE} SELECT row_id, count(*) AS candidates, round(min(m.lo - o.lo), 6) AS largest_drop FROM (SELECT row_id, fam, seq, unnest(generate_series(1, length(seq))) AS i FROM pf WHERE fam IS NOT NULL) x JOIN p o ON o.fam = x.fam AND o.pos = i - 1 AND o.aa = seq[i] JOIN p m ON m.fam = x.fam AND m.pos = i - 1 AND m.aa <> seq[i] WHERE m.lo - o.lo < -1.0 GROUP BY 1")
def trn11_candidate_pool(s, d):
    rows = pf(s, d)
    pool = N.candidate_pool(rows, N.profile_table(rows, "fam", "seq"), "row_id", "fam", "seq")
    return pool.groupBy("row_id").agg(F.count(F.lit(1)).alias("candidates"), F.round(F.min("drop"), 6).alias("largest_drop"))


@query(None)
def trn11_hard_negatives(s, d):
    rows = pf(s, d)
    return N.hard_negatives(rows, N.profile_table(rows, "fam", "seq"), "row_id", "fam", "seq")


@query(f"WITH {PF} SELECT row_id, CASE WHEN row_id % 3 = 0 THEN seq WHEN row_id % 2 = 0 THEN reverse(seq) END AS hard_negative FROM pf WHERE seq <> ''")
def trn13_patch_missing(s, d):
    rows = pf(s, d).where("seq <> ''")
    have = rows.select("row_id", F.when(F.col("row_id") % 3 == 0, F.col("seq")).alias("hard_negative"))
    made = rows.where("row_id % 2 = 0").select("row_id", F.reverse("seq").alias("hard_negative"))
    return N.patch_missing(have, made, "row_id")


def _prepared(s, d, wanted):
    rows = T(s, d, "dataset_info").select("row_id", "dataset", "split_name")
    out = None
    for t in TK.registry(T(s, d, "task_config")).values():
        # dataset_info has no column by the name that a task of task_config states, so its named splits are used.
        p = TK.prepare(rows, replace(t, split_column=t.split_column if t.split_column in rows.columns else None), wanted)
        out = p if out is None else out.unionByName(p)
    return out


_ROWS = r"x AS (SELECT row_id, dataset, coalesce(lower(regexp_replace(split_name, '^\s+|\s+$', '', 'g')), '') AS sp FROM dataset_info), c AS (SELECT name, dataset, lower(train_split) AS tr, lower(test_split) AS te, lower(validation_split) AS va, auto_split FROM task_config)"


@query(f"""WITH {_ROWS}, h AS (SELECT c.*, EXISTS (SELECT 1 FROM x WHERE x.dataset = c.dataset AND sp = va) AS have FROM c)
SELECT name AS task, row_id, CASE WHEN sp = tr THEN 'train' ELSE 'eval' END AS part, CAST(NULL AS INTEGER) AS fold, 'validation_split' AS strategy FROM h JOIN x USING (dataset) WHERE have AND sp IN (tr, va)
UNION ALL SELECT name, row_id, 'cv', CAST((row_number() OVER (PARTITION BY name ORDER BY {sql_hash(42, 'row_id')}, row_id) - 1) % 4 AS INTEGER), 'validation_cv4_train' FROM h JOIN x USING (dataset) WHERE NOT have AND sp = tr""")
def smp11_prepared_validation(s, d):
    return _prepared(s, d, "validation")


@query(f"""WITH {_ROWS} SELECT name AS task, row_id, CASE WHEN sp = tr THEN 'train' ELSE 'eval' END AS part, CAST(NULL AS INTEGER) AS fold, 'test_split' AS strategy FROM c JOIN x USING (dataset) WHERE NOT auto_split AND sp IN (tr, te)
UNION ALL SELECT name, row_id, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY {sql_hash(42, 'row_id')}, row_id) <= floor(count(*) OVER (PARTITION BY name) * 0.8) THEN 'train' ELSE 'eval' END, NULL, 'test_random_split' FROM c JOIN x USING (dataset) WHERE auto_split""")
def smp11_prepared_test(s, d):
    return _prepared(s, d, "test")


def _assay_task(s, d, wanted, **settings):
    rows = T(s, d, "test_data_prep").select("row_id", "stage", F.lit("assays").alias("dataset"), F.lit("train").alias("split_name"))
    return TK.prepare(rows, TK.Task(name="t", dataset="assays", label_col="DMS_score", **({"problem_type": "regression"} | settings)), wanted)


_STAGE = "st AS (SELECT row_id, lower(trim(stage)) AS v FROM test_data_prep)"
_PARTS = "CAST(NULL AS INTEGER) AS fold"


@query(f"WITH {_STAGE} SELECT 't' AS task, row_id, CASE v WHEN 'train' THEN 'train' ELSE 'eval' END AS part, {_PARTS}, 'test_split_column' AS strategy FROM st WHERE v IN ('train', 'test')")
def smp11_column_test(s, d):
    return _assay_task(s, d, "test", split_column="stage")


@query(f"WITH {_STAGE} SELECT 't' AS task, row_id, CASE v WHEN 'train' THEN 'train' ELSE 'eval' END AS part, {_PARTS}, 'validation_split_column' AS strategy FROM st WHERE v IN ('train', 'test')")
def smp11_column_validation(s, d):
    return _assay_task(s, d, "validation", split_column="stage", validation_column_values=("Test ",))


@query(f"WITH {_STAGE} SELECT 't' AS task, row_id, 'cv' AS part, CAST((row_number() OVER (ORDER BY {sql_hash(42, 'row_id')}, row_id) - 1) % 4 AS INTEGER) AS fold, 'validation_cv4_train' AS strategy FROM st WHERE v = 'train'")
def smp11_column_folds(s, d):
    return _assay_task(s, d, "validation", split_column="stage", validation_column_values=("no such value",))


@query(f"SELECT 't' AS task, row_id, 'eval' AS part, {_PARTS}, 'proteingym_unchanged' AS strategy FROM test_data_prep")
def smp11_assay_mode(s, d):
    return _assay_task(s, d, "test", eval_mode="proteingym_supervised", group_by="DMS_id")


@query(f"SELECT 't' AS task, row_id, 'eval' AS part, {_PARTS}, 'retrieval_unchanged' AS strategy FROM test_data_prep")
def smp11_retrieval(s, d):
    return _assay_task(s, d, "validation", problem_type="retrieval")


@query("SELECT o_orderkey, replace(o_orderpriority, ' ', '') AS seq, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.0 END AS y FROM orders")
def smp11_task_labels(s, d):
    task = TK.Task("t", "orders", "y", "regression", label_map={"F": 1.0, "O": 0.0}, remove_sequence_whitespace=True)
    return TK.labelled(T(s, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("seq"), F.col("o_orderstatus").alias("y")), task, "seq")


@query("""WITH x AS (SELECT row_id, CASE WHEN row_id % 5 > 0 THEN 'train' ELSE 'eval' END AS part, [dataset, coalesce(lower(trim(split_name)), 'none')] AS y FROM dataset_info),
top AS (SELECT l FROM (SELECT unnest(y) AS l FROM x WHERE part = 'train') GROUP BY 1 ORDER BY count(*) DESC, l LIMIT 3) SELECT row_id, list_sort(list_distinct(list_filter(y, lambda l: list_contains(k, l)))) AS y FROM x, (SELECT list(l) AS k FROM top)""")
def smp11_top_labels(s, d):
    task = TK.Task("t", "x", "y", "multilabel", top_k_labels=3)
    text = F.concat(F.lit("['"), "dataset", F.lit("', '"), F.coalesce(F.lower(F.trim("split_name")), F.lit("none")), F.lit("']"))
    rows = T(s, d, "dataset_info").select("row_id", F.when(F.col("row_id") % 5 > 0, "train").otherwise("eval").alias("part"), text.alias("y"), F.lit("A").alias("seq"))
    return TK.labelled(rows, task, "seq").select("row_id", F.sort_array("y").alias("y"))
