"""Queries over corpus loading, filters, links and clusters (SRC, PRJ, FLT, JN, AGG, SRT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import portable as P
from helixframe.operators import corpus as C
from helixframe.operators import links as L
from helixframe.operators.sampling import group_place
from helixframe.plans.common import DMS, PF, TDP, T, dms, pf, tdp

QUERIES, SQL = {}, {}
#: Members in one list of agg7_member_lists.
MEMBERS = 1000


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {PF} SELECT row_id FROM pf WHERE length(seq) > 0 AND group_id IS NOT NULL")
def flt1_valid_rows(s, d):
    return C.valid_rows(pf(s, d), "seq").select("row_id")


@query("SELECT row_id FROM dataset_info WHERE num_residues_scored > 70 AND seq_length - num_residues_scored = 0")
def flt2_quality_gate(s, d):
    return T(s, d, "dataset_info").where("num_residues_scored > 70 and seq_length - num_residues_scored = 0").select("row_id")


@query("SELECT p_partkey, TRY_CAST(CAST(p_size * 7 AS VARCHAR) AS TINYINT) AS flag FROM part WHERE TRY_CAST(CAST(p_size * 7 AS VARCHAR) AS TINYINT) IN (7, 14, 21)")
def flt3_flag_membership(s, d):
    flag = (F.col("p_size") * 7).cast("string").try_cast("tinyint")
    return T(s, d, "part").select("p_partkey", flag.alias("flag")).where(F.col("flag").isin(7, 14, 21))


@query(f"WITH {DMS} SELECT row_id, score FROM dms WHERE score >= 0.4")
def flt4_score_threshold(s, d):
    return dms(s, d).where("score >= 0.4").select("row_id", "score")


@query(f"WITH {DMS} SELECT row_id FROM dms WHERE length(s0) BETWEEN 100 AND 300 AND length(s1) BETWEEN 100 AND 300")
def flt6_length_band(s, d):
    return C.length_band(dms(s, d), ["s0", "s1"], 100, 300).select("row_id")


@query(f"WITH {PF} SELECT row_id FROM pf WHERE length(seq) > 5 AND length(seq) < 1024")
def flt7_open_band(s, d):
    return C.length_band(pf(s, d), ["seq"], 5, 1024, closed=False).select("row_id")


@query(f"WITH {TDP} SELECT row_id, dms_id FROM tdp WHERE NOT (starts_with(dms_id, 'B') OR starts_with(dms_id, 'NE'))")
def flt8_prefix_exclusion(s, d):
    return C.exclude_prefixes(tdp(s, d), "dms_id", ["B", "NE"]).select("row_id", "dms_id")


@query(r"SELECT row_id FROM dataset_info WHERE coalesce(lower(regexp_replace(split_name, '^\s+|\s+$', '', 'g')), '') IN ('test', 'holdout')")
def flt9_split_values(s, d):
    return C.in_splits(T(s, d, "dataset_info"), "split_name", ["Test", "holdout"]).select("row_id")


@query(f"WITH {PF}, m AS (SELECT fam, median(length(seq)) AS median_length, count(*) AS members FROM pf WHERE seq IS NOT NULL GROUP BY 1), k AS (SELECT fam, max(length(seq)) AS model_length FROM pf GROUP BY 1) SELECT fam, median_length, members, model_length FROM m JOIN k USING (fam) WHERE abs(median_length - model_length) / greatest(model_length, 1) <= 0.1")
def trn12_median_tolerance(s, d):
    rows = pf(s, d)
    models = rows.where("fam is not null").groupBy("fam").agg(F.max(F.length("seq")).alias("model_length"))
    return C.median_tolerance(rows, models, "fam", "seq", 0.1)


@query(f"WITH {PF} SELECT row_id, fam FROM pf WHERE fam IN (SELECT fam FROM pf GROUP BY fam HAVING count(*) >= 6)")
def flt12_rare_label_filter(s, d):
    return C.frequent(pf(s, d), "fam", 6).select("row_id", "fam")


@query(f"WITH {TDP} SELECT row_id FROM tdp WHERE dms_id IN (SELECT dms_id FROM tdp GROUP BY 1 HAVING count(*) >= 10)")
def flt13_small_assays(s, d):
    return C.frequent(tdp(s, d), "dms_id", 10).select("row_id")


@query("SELECT row_id, score FROM dms_cosent WHERE score IS NOT NULL AND isfinite(score)")
def flt14_finite_scores(s, d):
    return T(s, d, "dms_cosent").where(P.finite("score")).select("row_id", "score")


@query("SELECT vec_id, list_transform(vector, lambda x: CASE WHEN isnan(x) THEN 0 ELSE x END) AS v FROM sequence_vectors")
def flt17_nan_to_zero(s, d):
    v = F.transform("vector", lambda x: F.when(F.isnan(x), F.lit(0.0).cast("float")).otherwise(x))
    return T(s, d, "sequence_vectors").select("vec_id", v.alias("v"))


@query(f"WITH {PF} SELECT row_id AS corpus_id, seq AS sequence, fam AS family_id FROM pf")
def prj1_aliases(s, d):
    raw = pf(s, d).select(F.col("row_id").alias("corpus_id"), F.col("seq").alias("aa_seq"), F.col("fam").alias("family"))
    return C.normalize_columns(raw)


@query(f"WITH {PF} SELECT row_id, coalesce(clan_id, fam) AS clan_id, coalesce(clan_id, fam) || '/' || fam AS group_id FROM pf WHERE fam IS NOT NULL")
def prj5_null_fill(s, d):
    r = pf(s, d).where("fam is not null").withColumn("clan_id", F.coalesce("clan_id", "fam"))
    return r.select("row_id", "clan_id", F.concat_ws("/", "clan_id", "fam").alias("group_id"))


@query("SELECT p_partkey, TRY_CAST(replace(p_type, 'PROMO', '12') AS DOUBLE) AS v, CAST(NULL AS DOUBLE) AS missing, CASE p_brand WHEN 'Brand#11' THEN 'eleven' WHEN 'Brand#12' THEN 'twelve' ELSE p_brand END AS brand FROM part")
def prj7_casts_and_maps(s, d):
    return T(s, d, "part").select("p_partkey", F.replace("p_type", F.lit("PROMO"), F.lit("12")).try_cast("double").alias("v"), F.lit(None).cast("double").alias("missing"), P.mapped("p_brand", {"Brand#11": "eleven", "Brand#12": "twelve"}).alias("brand"))


@query(f"WITH {PF} SELECT row_id, row_number() OVER (ORDER BY fam NULLS LAST, row_id) - 1 AS row_idx FROM pf")
def prj10_row_index(s, d):
    return C.indexed(pf(s, d).select("row_id", "fam"), ["fam", "row_id"]).select("row_id", "row_idx")


@query(f"WITH {PF}, c AS (SELECT fam, min(clan_id) AS clan FROM pf WHERE fam < 'PF06' GROUP BY 1) SELECT pf.row_id, coalesce(c.clan, pf.fam) AS clan_id FROM pf LEFT JOIN c ON pf.fam = c.fam")
def jn3_hierarchy_join(s, d):
    rows = pf(s, d)
    clans = rows.where("fam < 'PF06'").groupBy("fam").agg(F.min("clan_id").alias("clan_id"))
    return C.attach_parent(rows, clans, "fam", "clan_id").select("row_id", "clan_id")


@query(f"WITH {PF}, v AS (SELECT DISTINCT entry_id AS k FROM dataset_info WHERE row_id % 3 > 0), f AS (SELECT entry_id AS k FROM dataset_info ORDER BY 1 NULLS LAST LIMIT 10000) SELECT count(*) AS sampled, count(v.k) AS matched, round(count(v.k) / greatest(count(*), 1), 6) AS match_rate FROM f LEFT JOIN v ON f.k = v.k")
def jn2_match_rate(s, d):
    t = T(s, d, "dataset_info")
    return C.match_rate(t, t.where("row_id % 3 > 0"), "entry_id")


@query(f"WITH {PF} SELECT row_id FROM pf WHERE group_id IN (SELECT group_id FROM pf GROUP BY 1 HAVING count(*) >= 2)")
def jn6_drop_singletons(s, d):
    return C.frequent(pf(s, d), "group_id", 2).select("row_id")


@query("SELECT e.vec_id, i.dataset, i.split_name FROM sequence_vectors e JOIN dataset_info i ON e.owner_key = i.entry_id WHERE e.owner_table = 'dataset_info' AND i.seq_length > 50")
def jn1_corpus_to_map(s, d):
    e = T(s, d, "sequence_vectors").where("owner_table = 'dataset_info'").select("vec_id", "owner_key")
    i = T(s, d, "dataset_info").where("seq_length > 50").select("entry_id", "dataset", "split_name")
    return e.join(i, e.owner_key == i.entry_id).select("vec_id", "dataset", "split_name")


_LINKS = "links AS (SELECT a.l_partkey AS p1, b.l_partkey AS p2, CAST(a.l_quantity + b.l_quantity AS BIGINT) AS score FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"


def _links(s, d):
    li = T(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    a = li.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p1"), F.col("l_quantity").alias("q1"))
    b = li.select(F.col("l_orderkey").alias("o2"), F.col("l_partkey").alias("p2"), F.col("l_quantity").alias("q2"))
    return a.join(b, (F.col("o") == F.col("o2")) & (F.col("p1") < F.col("p2"))).select("p1", "p2", (F.col("q1") + F.col("q2")).cast("bigint").alias("score"))


@query(f"WITH {_LINKS} SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT p1 FROM links WHERE score >= 80 UNION SELECT p2 FROM links WHERE score >= 80)")
def jn12_endpoint_semi_join(s, d):
    ids = L.endpoints(_links(s, d).where("score >= 80"), "p1", "p2", "p_partkey")
    return L.keep_ids(T(s, d, "part").select("p_partkey", "p_brand"), ids, "p_partkey")


@query(f"WITH {_LINKS} SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT p1 FROM links WHERE score >= 95 UNION SELECT p2 FROM links WHERE score >= 95)")
def src7_id_anti_filter(s, d):
    ids = L.endpoints(_links(s, d).where("score >= 95"), "p1", "p2", "p_partkey")
    return L.keep_ids(T(s, d, "part").select("p_partkey"), ids, "p_partkey", inside=False)


_PAIRS = f"""{_LINKS}, c AS (SELECT links.*, x.p_brand AS clu1, y.p_brand AS clu2 FROM links JOIN part x ON x.p_partkey = p1 JOIN part y ON y.p_partkey = p2 WHERE x.p_brand <> y.p_brand),
b AS (SELECT least(clu1, clu2) AS lo, greatest(clu1, clu2) AS hi, score, p1, p2, row_number() OVER (PARTITION BY least(clu1, clu2), greatest(clu1, clu2) ORDER BY score DESC, p1, p2) AS r FROM c)"""


def _pairs(s, d):
    parts = T(s, d, "part").select("p_partkey", "p_brand")
    return L.best_pairs(L.cluster_links(_links(s, d), parts, "p1", "p2", "p_partkey", "p_brand"), "clu1", "clu2", "score", ["p1", "p2"])


@query(f"WITH {_PAIRS} SELECT lo, hi, score, p1, p2 FROM b WHERE r = 1")
def win5_canonical_pairs(s, d):
    return _pairs(s, d)


@query(f"WITH {_PAIRS} SELECT lo, hi, x.p_name AS seq1, y.p_name AS seq2 FROM b JOIN part x ON x.p_partkey = p1 JOIN part y ON y.p_partkey = p2 WHERE r = 1 AND x.p_size > 10")
def jn5_two_sided_lookup(s, d):
    names = T(s, d, "part").select("p_partkey", "p_name", "p_size")
    j = L.attach_both(_pairs(s, d), names.where("p_size > 0"), "p1", "p2", "p_partkey", "p_name")
    big = names.where("p_size > 10").select(F.col("p_partkey").alias("k"))
    return j.join(big, F.col("p1") == F.col("k"), "left_semi").select("lo", "hi", "seq1", "seq2")


@query("SELECT c_custkey AS member, coalesce(r_name, n_name) AS rep FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3")
def jn14_map_composition(s, d):
    n = T(s, d, "nation")
    first = T(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("member"), F.col("n_name").alias("rep"))
    second = n.join(T(s, d, "region").where("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("member"), F.col("r_name").alias("rep"))
    return L.compose(first, second)


@query("""WITH c AS (SELECT l_partkey AS member, l_orderkey % 500 AS rep, count(*) FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2),
bad AS (SELECT DISTINCT rep FROM (SELECT member, rep FROM c UNION SELECT rep, rep FROM c) WHERE member % 97 = 0)
SELECT member, rep FROM c WHERE rep NOT IN (SELECT rep FROM bad) AND member % 97 <> 0""")
def jn13_decontaminate(s, d):
    c = T(s, d, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("member"), (F.col("l_orderkey") % 500).alias("rep")).distinct()
    ids = c.select(F.col("member").alias("id")).union(c.select("rep")).where("id % 97 = 0")
    return L.decontaminate(c, ids)


@query(f"WITH {PF} SELECT group_id, count(*) AS n, count(DISTINCT seq) AS distinct_sequences FROM pf GROUP BY 1")
def agg1_group_counts(s, d):
    # Two steps, so that a group with most rows doesn't gather its sequences in one task.
    one = pf(s, d).groupBy("group_id", "seq").agg(F.count(F.lit(1)).alias("c"))
    return one.groupBy("group_id").agg(F.sum("c").alias("n"), F.count("seq").alias("distinct_sequences"))


@query(f"WITH {PF} SELECT count(*) AS n, count(DISTINCT seq) AS sequences, count(DISTINCT fam) AS families, count(DISTINCT clan_id) AS clans FROM pf")
def agg4_column_distincts(s, d):
    return pf(s, d).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("sequences"), F.count_distinct("fam").alias("families"), F.count_distinct("clan_id").alias("clans"))


@query(f"WITH {PF}, c AS (SELECT *, coalesce(clan_id, fam) AS parent FROM pf WHERE fam IS NOT NULL), p AS (SELECT parent, count(DISTINCT fam) AS n, count(*) AS r, max(CASE WHEN fam = parent THEN 1 ELSE 0 END) AS own FROM c GROUP BY 1) SELECT count(*) AS parents, CAST(sum(r) AS BIGINT) AS rows, count_if(own = 1) AS orphans, count_if(n > 1) AS multi, round(100 * count_if(n > 1) / greatest(count(*), 1), 6) AS multi_percent FROM p")
def agg21_parent_statistics(s, d):
    return C.parent_statistics(pf(s, d).where("fam is not null").withColumn("parent", F.coalesce("clan_id", "fam")), "fam", "parent")


@query(f"WITH {PF} SELECT count(length(seq)) AS n, min(length(seq)) AS least, max(length(seq)) AS greatest, round(avg(length(seq)), 6) AS mean FROM pf")
def agg6_length_statistics(s, d):
    return C.length_statistics(pf(s, d), "seq")


@query(f"WITH {DMS} SELECT count(score) AS n, min(score) AS least, max(score) AS greatest, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std FROM dms")
def agg6_score_statistics(s, d):
    return dms(s, d).agg(F.count("score").alias("n"), F.min("score").alias("least"), F.max("score").alias("greatest"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_samp("score"), 6).alias("std"))


@query(f"WITH {TDP} SELECT dms_id, slice, list(mutant ORDER BY row_id) AS members, list(row_id ORDER BY row_id) AS ids FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY dms_id ORDER BY row_id) - 1) / {MEMBERS}.0) AS BIGINT) AS slice FROM tdp WHERE mutant <> '' AND dms_id IS NOT NULL) GROUP BY 1, 2")
def agg7_member_lists(s, d):
    # Every group has all its members, in numbered slices of MEMBERS, so that no list grows with its group.
    t = group_place(tdp(s, d).where("mutant <> '' and dms_id is not null").select("row_id", "dms_id", "mutant"), "dms_id", "row_id")
    x = t.groupBy("dms_id", F.floor(F.col("_place") / MEMBERS).alias("slice")).agg(F.sort_array(F.collect_list(F.struct("row_id", "mutant"))).alias("m"))
    return x.select("dms_id", "slice", F.col("m.mutant").alias("members"), F.col("m.row_id").alias("ids"))


@query(f"WITH {PF} SELECT fam, count(*) AS n FROM pf WHERE fam IS NOT NULL GROUP BY 1 ORDER BY n DESC, fam LIMIT 20")
def agg15_top_values(s, d):
    return pf(s, d).where("fam is not null").groupBy("fam").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "fam").limit(20)


@query("""SELECT 'DMS_id' AS column_name, count(*) FILTER (WHERE DMS_id IS NULL) AS nulls FROM test_data_prep UNION ALL SELECT 'target_seq', count(*) FILTER (WHERE target_seq IS NULL) FROM test_data_prep
UNION ALL SELECT 'DMS_score', count(*) FILTER (WHERE DMS_score IS NULL) FROM test_data_prep UNION ALL SELECT 'stage', count(*) FILTER (WHERE stage IS NULL) FROM test_data_prep""")
def agg20_null_audit(s, d):
    return C.null_audit(T(s, d, "test_data_prep"), ["DMS_id", "target_seq", "DMS_score", "stage"])


@query(f"WITH {PF} SELECT row_id, row_number() OVER (ORDER BY clan_id NULLS LAST, fam NULLS LAST, row_id NULLS LAST) AS place FROM pf")
def srt1_hierarchical_sort(s, d):
    o = C.sorted_by(pf(s, d).select("clan_id", "fam", "row_id"), ["clan_id", "fam"], ["row_id"])
    return C.indexed(o, ["clan_id", "fam", "row_id"], "place").select("row_id", (F.col("place") + 1).alias("place"))


@query("SELECT l_returnflag, l_linestatus, l_quantity, row_number() OVER (ORDER BY l_returnflag, l_quantity DESC, l_linestatus) AS place FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem)")
def srt2_mixed_order(s, d):
    keys = T(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity").distinct().withColumn("_down", -F.col("l_quantity"))
    return C.indexed(keys, ["l_returnflag", "_down", "l_linestatus"], "place").select("l_returnflag", "l_linestatus", "l_quantity", (F.col("place") + 1).alias("place"))


@query(f"WITH {DMS} SELECT DISTINCT s0 AS sequence FROM dms WHERE s0 <> '' UNION SELECT s1 FROM dms WHERE s1 <> ''")
def set4_unique_sequences(s, d):
    x = dms(s, d)
    return x.select(F.col("s0").alias("sequence")).union(x.select("s1")).where("sequence <> ''").distinct()


@query("SELECT p_partkey AS id, p_name AS name, CAST(p_size AS BIGINT) AS size, NULL AS balance FROM part UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def set2_diagonal_union(s, d):
    a = T(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("bigint").alias("size"))
    b = T(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT 'both' AS side, count(*) AS n FROM (SELECT dataset FROM dataset_info INTERSECT SELECT dataset FROM task_config) UNION ALL SELECT 'tables', count(*) FROM (SELECT dataset FROM dataset_info UNION SELECT dataset FROM task_config) UNION ALL SELECT 'data only', count(*) FROM (SELECT dataset FROM dataset_info EXCEPT SELECT dataset FROM task_config)")
def set5_key_sets(s, d):
    a, b = T(s, d, "dataset_info").select("dataset"), T(s, d, "task_config").select("dataset")
    n = lambda x, t: x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("side"), "n")
    return n(a.intersect(b), "both").union(n(a.union(b).distinct(), "tables")).union(n(a.subtract(b), "data only"))


@query(None)
def win9_shuffled_within_key(s, d):
    return C.shuffled_within(pf(s, d).select("row_id", "group_id"), ["group_id"], "row_id")


@query("""SELECT event_id, lower(trim(event_type)) IN ('click', 'view') AS flagged, json_extract_string(props, '$.page') AS page,
strftime(ts, '%Y-%m-%d') AS day, printf('%.5f', value) AS value5, replace(replace(event_type, '/', '_'), '\\', '_') AS name FROM events""")
def fn_text_and_dates(s, d):
    e = T(s, d, "events")
    return e.select("event_id", F.lower(F.trim("event_type")).isin("click", "view").alias("flagged"), F.get_json_object("props", "$.page").alias("page"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.format_string("%.5f", "value").alias("value5"), P.safe_name("event_type").alias("name"))


@query("""SELECT row_id, list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(translate(t, '[]''"', ''), '[,;|]', ' ', 'g'), '\\s+'), lambda x: x <> ''))) AS labels
FROM (SELECT row_id, '[''' || dataset || '''; ' || coalesce(split_name, '') || ' | x]' AS t FROM dataset_info)""".replace("\\\\", "\\"))
def fn_multilabel_parse(s, d):
    t = F.concat(F.lit("['"), F.col("dataset"), F.lit("'; "), F.coalesce("split_name", F.lit("")), F.lit(" | x]"))
    return T(s, d, "dataset_info").select("row_id", F.sort_array(F.array_distinct(P.multilabel(t))).alias("labels"))


@query("SELECT substr(sha256(string_agg(DISTINCT dataset, chr(10) ORDER BY dataset)), 1, 12) AS signature FROM dataset_info")
def fn_value_signature(s, d):
    return P.signature(T(s, d, "dataset_info"), "dataset")
