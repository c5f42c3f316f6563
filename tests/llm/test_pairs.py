"""Near-duplicates and cross-split overlaps against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.llm import kernels as K
from helixframe.llm import neardup as N
from helixframe.llm import overlap as O

AA = "ACDEFGHIKLMNPQRSTVWY"


def edited(s, rate, rng):
    return "".join(rng.choice(AA) if rng.random() < rate else c for c in s)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = []
    for _ in range(60):
        base = "".join(rng.choice(AA) for _ in range(rng.choice([5, 6, 9, 20, 45, 60, 150, 400])))
        out += [base, edited(base, 0.02, rng), edited(base, 0.05, rng), edited(base, 0.09, rng), base[len(base) // 3 :] + base[: len(base) // 3]]
    # A third of all texts are one crowd of relatives.
    core = "".join(rng.choice(AA) for _ in range(120))
    out += [edited(core, 0.03, rng) for _ in range(150)]
    return list(dict.fromkeys(x for x in out if len(x) >= 5))


def brute(a, b=None):
    if b is None:
        return {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if K.window_jaccard(a[i], a[j]) >= 0.5}
    return {(i, j) for i in range(len(a)) for j in range(len(b)) if K.window_jaccard(a[i], b[j]) >= 0.5}


def test_jaccard_kernel(texts):
    a, b = texts[:100], texts[1:101]
    assert np.allclose(K.pair_jaccards(pa.array(a), pa.array(b)), [K.window_jaccard(x, y) for x, y in zip(a, b)])


def test_near_pairs(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, residues string")
    got = {(r["id_a"], r["id_b"]) for r in N.near_pairs(df).collect()}
    want = brute(texts)
    assert got <= want
    assert len(got) >= 0.995 * len(want)
    short = {(i, j) for i, j in want if min(len(texts[i]), len(texts[j])) < N.SHORT}
    assert short <= got


def test_near_pairs_of_a_large_family(spark):
    # All combinations of the family's common windows are crowded; pairs just over the threshold have the fewest of them.
    rng = random.Random(21)
    core = "".join(rng.choice(AA) for _ in range(130))
    family = list(dict.fromkeys(edited(core, 0.04, rng) for _ in range(900)))
    rec, code = K.codes(*K.text_bytes(pa.array(family)), K.WINDOW)
    windows = np.unique(np.stack([rec, code]), axis=1)
    _, token, often = np.unique(windows[1], return_inverse=True, return_counts=True)
    size = np.bincount(windows[0])
    shared = often[token] > 1
    column = np.cumsum(often > 1) - 1
    has = np.zeros((len(family), int(column[-1]) + 1), np.float32)
    has[windows[0][shared], column[token[shared]]] = 1
    both = has @ has.T
    i, j = np.triu_indices(len(family), 1)
    s = both[i, j] / (size[i] + size[j] - both[i, j])
    close = (s >= 0.5) & (s < 0.55)
    want = set(zip(i[close].tolist(), j[close].tolist()))
    assert len(want) > 50_000
    t = N.near_pairs(spark.createDataFrame(list(enumerate(family)), "id long, residues string")).toArrow()
    got = set(zip(t.column("id_a").to_pylist(), t.column("id_b").to_pylist()))
    assert len(got) == t.num_rows and not got - set(zip(i[s >= 0.5].tolist(), j[s >= 0.5].tolist()))
    print("missed", len(want - got), "of", len(want))
    assert len(want - got) <= 1e-4 * len(want)


@pytest.mark.parametrize("length, times", [(75, 20), (90, 100)])
def test_near_pairs_of_short_relatives(spark, length, times):
    # A crowd of distant relatives with few windows: nearly all of its pairs have some of the common windows in their prefixes.
    # Records of 75 residues give single tokens, those of 90 only combinations, most of which are crowded.
    rng = random.Random(31)
    core = "".join(rng.choice(AA) for _ in range(length))
    family = [edited(core, rng.uniform(0.15, 0.37), rng) for _ in range(1500)]
    family = list(dict.fromkeys(family + [edited(x, 0.03, rng) for x in family[:150]]))
    at = {}
    for i, x in enumerate(family):
        for w in {x[k : k + K.WINDOW] for k in range(len(x) - K.WINDOW + 1)}:
            at.setdefault(w, []).append(i)
    has = np.zeros((len(family), len(at)), np.float32)
    for c, members in enumerate(at.values()):
        has[members, c] = 1
    both, size = has @ has.T, has.sum(axis=1)
    i, j = np.triu_indices(len(family), 1)
    close = both[i, j] >= 0.5 * (size[i] + size[j] - both[i, j])
    want = set(zip(i[close].tolist(), j[close].tolist()))
    assert len(want) > 100 and (both[i, j] > 0).mean() > 0.8
    df = spark.createDataFrame(list(enumerate(family)), "id long, residues string")
    assert {(r["id_a"], r["id_b"]) for r in N.near_pairs(df).collect()} == want
    assert N.candidate_pairs(df).count() < times * len(want)


def test_near_pairs_of_short_records_are_exact(spark):
    # Few letters and 1 to 79 windows: pairs that need only one to three common windows, and pairs of unequal sizes.
    rng = random.Random(37)
    short = []
    for _ in range(150):
        base = "".join(rng.choice(AA[: rng.choice([2, 3, 20])]) for _ in range(rng.choice([5, 6, 7, 8, 12, 20, 44, 60, 83])))
        short += [base, edited(base, 0.04, rng), base[1:], base[: len(base) * 2 // 3], base[:-2] + "AC"]
    short = list(dict.fromkeys(x for x in short if len(x) >= 5))
    t = N.near_pairs(spark.createDataFrame(list(enumerate(short)), "id long, residues string")).toArrow()
    assert set(zip(t.column("id_a").to_pylist(), t.column("id_b").to_pylist())) == brute(short)


def test_near_classes(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, residues string")
    group = list(range(len(texts)))
    pairs = brute(texts)
    for i, j in pairs:
        x, y = sorted((group[i], group[j]))
        group = [x if g == y else g for g in group]
    got = {r["node"]: r["component"] for r in N.near_classes(df).collect()}
    assert got == {i: group[i] for i in {x for p in pairs for x in p}}
    assert N.near_classes(spark.createDataFrame([], "id long, residues string")).collect() == []


def test_pairs_across_labels():
    starts, ends, label = np.array([0, 5]), np.array([5, 7]), np.array([1, 1, 2, 3, 3, 4, 4])
    got = [tuple(p) for i, j in N.list_pairs("across", starts, ends, label) for p in zip(i.tolist(), j.tolist())]
    assert got == [(i, j) for i in range(5) for j in range(i + 1, 5) if label[i] != label[j]]


def test_pairs_are_formed_in_small_blocks():
    # 3.4 million pairs of 3,000 lists of 48 records: a task forms them some at a time, and none is left out.
    starts = np.arange(0, 3000 * 48, 48)
    label = np.arange(3000 * 48)
    for mode, total in (("all", 3000 * 48 * 47 // 2), ("across", 3000 * 48 * 47 // 2), ("star", 3000 * 47)):
        sizes = [len(i) for i, _ in N.list_pairs(mode, starts, starts + 48, label)]
        assert sum(sizes) == total and max(sizes) <= 502_000


def test_statistics_are_added_up_in_a_tree(spark, texts):
    df = spark.createDataFrame([(i, x, "s") for i, x in enumerate(texts)], "id long, residues string, scope string")
    a, b = (O.gather_statistics(df.repartition(n), df.limit(0), "all") for n in (1, O.FAN_IN + 6))
    assert np.array_equal(a.idf, b.idf) and np.array_equal(a.most, b.most) and np.array_equal(a.present, b.present)


def test_near_pairs_edges(spark):
    assert N.near_pairs(spark.createDataFrame([], "id long, residues string")).collect() == []
    df = spark.createDataFrame([(1, "ACDEF"), (2, "ACDEFG"), (3, "AAAAAAAAAA"), (4, "AAAAAA"), (5, "ACDEF" * 9000)], "id long, residues string")
    got = {(r["id_a"], r["id_b"]) for r in N.near_pairs(df).collect()}
    # The long text repeats the windows of ACDEFACDEF and no more: 5 windows, one of them in text 1.
    assert got == {(1, 2), (3, 4)}


def test_representatives_fold_copies(spark):
    rows = [(1, "acd-ef gh", "x"), (2, "ACDEFGH", "y"), (3, None, "z"), (4, "", None), (5, "AC", None), (6, "ACDEFGHI", None), (None, "ACDEFGH", None)]
    df = spark.createDataFrame(rows, "row_id long, sequence string, residues string")
    from helixframe.util import residues

    reps, members = N.representatives(df, "row_id", residues("sequence"), "t")
    assert {(r["id"], r["residues"]) for r in reps.collect()} == {(1, "ACDEFGH"), (6, "ACDEFGHI")}
    assert {(r["id"], r["rep"]) for r in members.collect()} == {(1, 1), (2, 1), (6, 6)}


def test_pair_blocks_complete():
    starts, ends = np.array([0, 5, 6, 10]), np.array([5, 6, 10, 3000])
    got = set()
    for i, j in K.pair_blocks(starts, ends, 1000):
        got |= set(zip(i.tolist(), j.tolist()))
    want = {(i, j) for s, e in zip(starts, ends) for i in range(s, e) for j in range(i + 1, e)}
    assert got == want


def test_packed_exchange_round_trip():
    ids = np.array([5, 1 << 40, 7, 9])
    b = K.pack_buckets(np.array([2, 0, 2, 0]), 3, ids, np.arange(4, dtype=np.uint32))
    t = pa.Table.from_batches([b])
    i, p = K.unpack_bucket(t, np.dtype(np.uint32))
    assert dict(zip(i.tolist(), p.tolist())) == dict(zip(ids.tolist(), range(4)))


def test_cross_pairs(spark, texts):
    ev, tr = texts[::2], texts[1::2]
    scope = lambda i: "abc"[i % 3]
    e = spark.createDataFrame([(i, t, scope(i)) for i, t in enumerate(ev)], "id long, residues string, scope string")
    t = spark.createDataFrame([(i, x, O.DMS if i % 4 == 0 else scope(i)) for i, x in enumerate(tr)], "id long, residues string, scope string")
    got = {(r["id_a"], r["id_b"]) for r in O.cross_pairs(e, t, O.DMS).collect()}
    want = {(i, j) for i, j in brute(ev, tr) if j % 4 == 0 or scope(i) == scope(j)}
    assert got <= want
    assert len(got) >= 0.99 * len(want)


def test_cross_pairs_of_rearranged_blocks(spark):
    # Common parts of 12 residues in another order, a few repeats, and sizes that differ: no run of 13 residues is common.
    rng = random.Random(17)
    ev, tr = [], []
    for blocks in (4, 12, 20, 60):
        for _ in range(25):
            parts = ["".join(rng.choice(AA) for _ in range(12)) for _ in range(blocks)]
            ev.append("".join(parts))
            tr.append("".join(rng.sample(parts, blocks)))
            tr.append("".join(rng.sample(parts, blocks)[: max(2, blocks * 3 // 4)]))
    # Low complexity: few different windows in long texts, and long texts with many repeated runs.
    for _ in range(20):
        unit = "".join(rng.choice("AG") for _ in range(400))
        ev.append(unit + unit[:90])
        tr += [edited(unit, 0.01, rng), unit[200:] + unit[:200], "".join(rng.choice(AA) for _ in range(2500))]
        ev.append(edited(tr[-1], 0.03, rng))
        short = "".join(rng.choice(AA) for _ in range(rng.randint(5, 45)))
        ev.append(short)
        tr += [short + rng.choice(AA) * 3, short[1:], short * 3]
    e = spark.createDataFrame([(i, t, "a") for i, t in enumerate(ev)], "id long, residues string, scope string")
    t = spark.createDataFrame([(i, x, "a" if i % 2 else O.DMS) for i, x in enumerate(tr)], "id long, residues string, scope string")
    got = {(r["id_a"], r["id_b"]) for r in O.cross_pairs(e, t, O.DMS).collect()}
    want = brute(ev, tr)
    assert len(want) > 200
    assert got == want


def test_cross_pairs_without_common_long_runs(spark):
    # Nine parts of 12 residues in another order; in a few of 3,000 pairs the least-hashed runs of the parts hardly agree.
    rng = random.Random(29)
    parts = [["".join(rng.choice(AA) for _ in range(12)) for _ in range(9)] for _ in range(3000)]
    ev, tr = ["".join(p) for p in parts], ["".join(rng.sample(p, 9)) for p in parts]
    e, t = (spark.createDataFrame([(i, x, "a") for i, x in enumerate(c)], "id long, residues string, scope string") for c in (ev, tr))
    got = {(r["id_a"], r["id_b"]) for r in O.cross_pairs(e, t, O.DMS).collect()}
    assert got == {(i, i) for i in range(3000) if K.window_jaccard(ev[i], tr[i]) >= 0.5}
    assert len(got) > 2500


def test_bound_of_common_runs():
    # Pairs made of common blocks, tandem repeats and edits never have fewer common terms than the bound says.
    rng = random.Random(23)
    texts = []
    for _ in range(120):
        base = "".join(rng.choice(AA[: rng.choice([4, 8, 20])]) for _ in range(rng.randint(40, 300)))
        cut = rng.randint(1, len(base) - 1)
        i, k = rng.randrange(len(base) - 5), rng.randint(1, 6)
        texts += [base, edited(base, 0.06, rng), base[cut:] + base[:cut], base[:i] + base[i : i + k] + base[i:], base[: len(base) * 3 // 5]]
    rs = O.Records(pa.array(texts), 0.5)
    rec, term = rs.runs(np.ones(len(texts), bool))
    runs = [set(term[rec == i].tolist()) for i in range(len(texts))]
    some = 0
    for g in range(0, len(texts), 5):
        for i in range(g, g + 5):
            for j in range(i + 1, g + 5):
                if K.window_jaccard(texts[i], texts[j]) >= 0.5:
                    bound = O.least_of_pair(rs.size[i], rs.size[j], rs.slack[i], rs.slack[j], O.RUNS, 0.5)
                    assert len(runs[i] & runs[j]) >= bound
                    some += bound > 0
                    if rs.regular[i] and rs.regular[j]:
                        assert bound >= max(O.least(rs.size[[i, j]], rs.slack[[i, j]], np.zeros(2, int), 0.5))
    assert some > 300
    assert np.array_equal(O.unpacked_keys(O.packed_keys(np.array([0, 1, 255, 256, 511, 5000]))), [0, 1, 255, 256, 511, 5000])


def test_cross_pairs_empty(spark):
    none = spark.createDataFrame([], "id long, residues string, scope string")
    some = spark.createDataFrame([(1, "ACDEFGHIKL", "a")], "id long, residues string, scope string")
    assert O.cross_pairs(none, some, O.DMS).collect() == []
    assert O.cross_pairs(some, none, O.DMS).collect() == []
    assert len(O.cross_pairs(some, some, O.DMS).collect()) == 1


def test_overlap_tables(spark, tmp_path):
    rng = random.Random(5)
    seq, other = ("".join(rng.choice(AA) for _ in range(80)) for _ in range(2))
    info = [(1, "d", " Test", seq, 1), (2, "d", "train", seq.lower(), 2), (3, "d", "valid", other, 3), (4, "d", None, seq, 4), (5, "x", "train", seq, 5), (6, "d", "test", None, 6), (7, "d", "test", seq[:40] + "-" + seq[40:], 7)]
    spark.createDataFrame(info, "row_id long, dataset string, split_name string, sequence string, residues int").write.parquet(f"{tmp_path}/dataset_info.parquet")
    spark.createDataFrame([(1, other + "AC", None), (2, None, "x")], "row_id long, sentence_0 string, id string").write.parquet(f"{tmp_path}/dms_cosent.parquet")
    spark.createDataFrame([("t", "d", "TEST ", "valid", "train")], "name string, dataset string, test_split string, validation_split string, train_split string").write.parquet(f"{tmp_path}/task_config.parquet")
    got = {tuple(r) for r in O.p6_found(spark, str(tmp_path)).collect()}
    assert got == {(1, "test", "dataset_info"), (7, "test", "dataset_info"), (3, "valid", "dms_cosent")}
    rep = {(r["eval_split"], r["train_source"]): r["eval_rows"] for r in O.p6_report(spark, str(tmp_path)).collect()}
    assert rep == {("test", "dataset_info"): 2, ("valid", "dms_cosent"): 1}


def test_classes_and_found(spark, tmp_path):
    rng = random.Random(9)
    a = "".join(rng.choice(AA) for _ in range(100))
    b = edited(a, 0.03, rng)
    spark.createDataFrame([(1, a), (2, b), (3, a), (4, None), (5, "ACD"), (6, "")], "row_id long, sequence string").write.parquet(f"{tmp_path}/dataset_info.parquet")
    spark.createDataFrame([(9, a)], "row_id long, sentence_0 string").write.parquet(f"{tmp_path}/dms_cosent.parquet")
    assert {tuple(r) for r in N.p4_found(spark, str(tmp_path)).collect()} == {("dataset_info", 1, 2), ("dataset_info", 1, 3), ("dataset_info", 2, 3)}
    c = {(r["table_name"], r["row_id"]): (r["class_id"], r["copies"]) for r in N.p4_classes(spark, str(tmp_path)).collect()}
    assert c == {("dataset_info", 1): (1, 2), ("dataset_info", 3): (1, 2), ("dataset_info", 2): (1, 1), ("dms_cosent", 9): (9, 1)}
