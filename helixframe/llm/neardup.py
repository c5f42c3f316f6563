"""Problem 4: groups of sequences that repeat each other with small edits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import kernels as K
from helixframe.llm.graph import components
from helixframe.util import materialize, residues, table

THRESHOLD = 0.5
#: Token classes; each gives one signature a record.
CLASSES = 64
#: A combination of two tokens shared by more records than this is crowded.
CROWD = 48
#: Independent hashings in which ``near_classes`` searches the records of crowded combinations again, by three tokens.
ROUNDS = 3
#: Pairs with fewer windows than this in the smaller record are found by single tokens (exact prefix filter); the larger
#: record of such a pair has under SHORT / threshold windows, and so do all records that give single tokens.
SHORT = 40
#: Meetings that make a candidate: of single tokens each counts one, of combinations each counts half of this.
MEETINGS = 4
#: Low bits of the key of a single token: the lowest is 1, then 15 bits of its place in the record's order and 16 of the
#: record's windows; the hash of the token stands above them.
PLACE, WIDE, DEEP = 32, (1 << 16) - 1, (1 << 15) - 1
#: Signatures a bucket of the exchange is meant to hold.
BUCKET = 1_000_000

#: Met pairs a bucket holds at most before they are folded and sent on, and pairs formed at a time.
HELD, BLOCK = 1_000_000, 500_000
#: Records whose signatures are packed at a time.
ROWS = 2_000

_SIG = np.dtype("<u8")
_MARKED = np.dtype([("sig", "<u8"), ("label", "<i8")])


def prefixes(off: np.ndarray, data: np.ndarray, hashing: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Record and hash of each distinct window of a batch, the records with windows and the class prefixes of each of them.

    Every distinct window is a token. Tokens fall into CLASSES classes by hash and are ordered inside a class by a
    second hash, the same for all records; the record's least token of a class is the class prefix, and a class without
    tokens borrows the next one's. Each value of ``hashing`` gives other classes and another order.
    """
    rec, code = K.codes(off, data, K.WINDOW)
    code = code + (hashing << 26)
    h = K.mix32(code).astype(np.int64)
    cls = (K.mix32(code + (1 << 25)) % np.uint32(CLASSES)).astype(np.int64)
    key = K.unique((rec << 38) | (cls << 32) | h)
    rec, cls, h = key >> 38, (key >> 32) & 63, key & 0xFFFFFFFF
    n = len(off) - 1
    least = np.zeros((n, CLASSES), np.uint64)
    at = K.first_of(key >> 32)
    least[rec[at], cls[at]] = h[at].astype(np.uint64) + np.uint64(1)
    has = np.flatnonzero(np.bincount(rec, minlength=n) > 0)
    m = least[has]
    while (m == 0).any():
        m = np.where(m == 0, np.where(np.roll(m, -1, axis=1) > 0, K.mix64(np.roll(m, -1, axis=1)), 0), m)
    return rec, h, has, m


def joined(m: np.ndarray, tokens: int, hashing: int = 0) -> np.ndarray:
    """Keys of the combinations of ``tokens`` neighbouring class prefixes (circular), the lowest bit 0."""
    key = m + (np.arange(1, CLASSES + 1, dtype=np.uint64) << np.uint64(40)) + (np.uint64(hashing) << np.uint64(50))
    for j in range(1, tokens):
        key = K.mix64(key) + np.roll(m, -j, axis=1)
    return K.mix64(key) & ~np.uint64(1)


def combinations(m: np.ndarray, has: np.ndarray, size: np.ndarray, tokens: int, threshold: float, hashing: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Record and key of each combination of the records ``has``. Bit 1 of a key marks a record that also gives single
    tokens. Records under SHORT windows have no combinations: whatever is close to them gives single tokens as well."""
    long = size[has] >= SHORT
    mark = (size[has[long]] < SHORT / threshold).astype(np.uint64) << np.uint64(1)
    key = joined(m[long], tokens, hashing) & ~np.uint64(3)
    return np.repeat(has[long], CLASSES), (key | mark[:, None]).ravel()


def signatures(off: np.ndarray, data: np.ndarray, threshold: float, common: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Record and key of each signature of a batch: CLASSES combinations of two tokens a record.

    Records with under SHORT / threshold windows also give the single tokens of their Jaccard prefix in the one global
    order, rare tokens first (``common``: see ``common_tokens``); the lowest bit of their keys is 1. The prefix is so long
    that the first MEETINGS common tokens of a close pair are in both.
    """
    rec, h, has, m = prefixes(off, data)
    n = len(off) - 1
    size = np.bincount(rec, minlength=n)
    parts = [combinations(m, has, size, 2, threshold)]
    few = size[rec] < SHORT / threshold
    if few.any():
        parts.append(single_tokens(rec[few], h[few], size, threshold, common))
    return tuple(np.concatenate(c) for c in zip(*parts))


def single_tokens(rec: np.ndarray, h: np.ndarray, size: np.ndarray, threshold: float, common: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Record and key of the tokens in the prefix of each record, see ``signatures``; a record's tokens stand together.

    Records with more than WIDE windows have that number and place 0, which only makes the bounds of their pairs wider.
    """
    h = h.astype(np.uint64)
    t, level = K.mix64(h + np.uint64(1 << 50)), np.zeros(len(h), np.uint8)
    if common is not None and len(common[0]):
        at = np.minimum(np.searchsorted(common[0], h), len(common[0]) - 1)
        level = np.where(common[0][at] == h, common[1][at], 0)
    o = np.lexsort((t, level, rec))
    r, h = rec[o], h[o]
    start = np.r_[0, np.cumsum(np.bincount(r, minlength=len(size)))][:-1]
    place = np.arange(len(r)) - start[r]
    keep = place < size[r] - np.ceil(threshold * size[r] - 1e-9).astype(np.int64) + MEETINGS
    r, h, place = r[keep], h[keep], place[keep]
    low = (np.minimum(size[r], WIDE) << 16) | (np.where(size[r] > WIDE, 0, np.minimum(place, DEEP)) << 1) | 1
    return r, (h << np.uint64(PLACE)) | low.astype(np.uint64)


def crowd_tokens(off: np.ndarray, data: np.ndarray, threshold: float, common: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The single tokens of all records of a batch, whatever their length."""
    rec, code = K.codes(off, data, K.WINDOW)
    key = K.unique((rec << 32) | K.mix32(code).astype(np.int64))
    rec = key >> 32
    return single_tokens(rec, key & 0xFFFFFFFF, np.bincount(rec, minlength=len(off) - 1), threshold, common)


def common_tokens(reps: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (in order) of the tokens that more than CROWD records hold, and a level that rises with their number.

    They only put the single tokens in order: the result is the same with any order, but where a crowd of relatives has
    its common tokens last, the prefixes of two of them have a token in common only if they are nearly close enough. So
    tokens met once in a task are not counted. There are at most 26^5 tokens, however many records.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(26**K.WINDOW, np.int32)
        for b in (p for big in batches for p in K.steps(big)):
            rec, code = K.codes(*K.text_bytes(b.column(0)), K.WINDOW)
            token, n = np.unique(K.unique((rec << 24) | code) & 0xFFFFFF, return_counts=True)
            held[token] += n.astype(np.int32)
        token = np.flatnonzero(held > 1)
        for i in range(0, len(token), 100_000):
            some = token[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[some], pa.int32())], ["token", "n"])

    t = reps.select("residues").mapInArrow(count, "token int, n int").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > CROWD).toArrow()
    h, n = K.mix32(t.column("token").to_numpy()).astype(np.uint64), t.column("n").to_numpy()
    o = np.argsort(h)
    return h[o], (4 * np.log2(np.maximum(n[o], 1))).astype(np.uint8)


def crowd_signatures(off: np.ndarray, data: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Record and key of CLASSES combinations of three tokens a record in each of ROUNDS hashings of their own."""
    out_rec, out_key = [], []
    for hashing in range(1, ROUNDS + 1):
        rec, _, has, m = prefixes(off, data, hashing)
        r, key = combinations(m, has, np.bincount(rec, minlength=len(off) - 1), 3, threshold, hashing)
        out_rec.append(r)
        out_key.append(key)
    return np.concatenate(out_rec), np.concatenate(out_key)


def _folded(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of all blocks with their summed counts."""
    a, b, n = (np.concatenate(c) for c in zip(*found))
    o = np.lexsort((b, a))
    a, b, n = a[o], b[o], n[o]
    at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    return a[at], b[at], np.minimum(np.add.reduceat(n, at) if len(at) else n, 99)


def with_labels(key: np.ndarray, label: np.ndarray) -> np.ndarray:
    out = np.empty(len(key), _MARKED)
    out["sig"], out["label"] = key, label
    return out


def spanned(left: np.ndarray, low: np.ndarray, high: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (left[i], j) for all j in [low[i], high[i]), in blocks of about ``limit`` pairs; nothing is left out."""
    n = np.maximum(high - low, 0)
    keep = n > 0
    left, low, n = left[keep], low[keep], n[keep]
    total, i = np.r_[0, np.cumsum(n)], 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, "right")) - 1)
        row = np.repeat(np.arange(i, j), n[i:j])
        yield left[row], low[row] + np.arange(len(row)) - (total[row] - total[i])
        i = j


def token_pairs(sig: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of records (as positions in ``sig``) that may be close and have this token among their first common ones.

    ``sig``: keys of single tokens in order, so the records of a token stand by their number of windows. With a and b
    windows, a close pair has at least (a + b) * threshold / (1 + threshold) in common; all of them but fewer than MEETINGS
    follow each of the first MEETINGS in the global order. So the a - p windows from place p on bound b, and the same
    holds the other way round. Every close pair meets both bounds at its first MEETINGS common tokens, or at all that it
    needs if these are fewer; such pairs are given as many times at each as make up for it.
    """
    share = threshold / (1 + threshold)
    size, place = ((sig >> np.uint64(16)) & np.uint64(WIDE)).astype(np.int64), ((sig >> np.uint64(1)) & np.uint64(DEEP)).astype(np.int64)
    reach = np.clip(np.floor((size - place + MEETINGS - 1) / share - size + 1e-9), 0, WIDE).astype(np.int64)
    last = (sig >> np.uint64(PLACE) << np.uint64(PLACE)) | (reach.astype(np.uint64) << np.uint64(16)) | np.uint64(WIDE)
    at = np.arange(len(sig))
    for i, j in spanned(at, at + 1, np.searchsorted(sig, last, "right")):
        ok = size[i] <= reach[j]
        i, j = i[ok], j[ok]
        least = np.ceil((size[i] + size[j]) * share - 1e-9).astype(np.int64)
        times = -(-MEETINGS // np.clip(least, 1, MEETINGS))
        yield np.repeat(i, times), np.repeat(j, times)


def list_pairs(mode: str, starts: np.ndarray, ends: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs inside the lists [start, end): ``all`` of them, ``star``: each with the first, ``across``: of different
    labels (sorted inside a list), ``new``: all but those of two records with label 1 (after those with label 0)."""
    if mode == "all":
        return K.pair_blocks(starts, ends, BLOCK)
    if mode == "star":
        return spanned(starts, starts + 1, ends)
    n = ends - starts
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    if mode == "new":
        plain = label[at] == 0
        return spanned(at[plain], at[plain] + 1, np.repeat(ends, n)[plain])
    run = np.repeat(np.arange(len(n)), n)
    change = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (label[at][1:] != label[at][:-1])]) if len(at) else np.zeros(0, np.int64)
    size = np.diff(np.r_[change, len(at)])
    return spanned(at, np.repeat(at[change] + size, size), np.repeat(ends, n))


def short_texts(reps: DataFrame, threshold: float) -> DataFrame:
    return reps.where(F.length("residues") < SHORT / threshold + K.WINDOW - 1)


def met(reps: DataFrame, keys, per_record: int, crowd: int | None, threshold: float, mode: str = "new") -> DataFrame:
    """Pairs of records sharing two keys with lowest bit 0 or the first MEETINGS with lowest bit 1: id_a < id_b, n.

    ``keys``: a function like ``signatures``. A key with lowest bit 0 that more than ``crowd`` records share gives no
    pairs; its records are named in rows with id_a = id_b instead. None: every key gives its pairs.
    ``mode``: which pairs of a key with lowest bit 0, see ``list_pairs``; ``across`` needs a column ``label`` (long).
    ``new`` leaves out pairs of two records that both give single tokens: these find every close pair of them.
    """
    marked = mode == "across"
    n_buckets = max(4, -(-reps.count() * per_record // BUCKET))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (big.slice(i, ROWS) for big in batches for i in range(0, big.num_rows, ROWS)):
            parts = []
            for p in K.steps(b):
                rec, key = keys(*K.text_bytes(p.column(1)), threshold)
                bucket = ((key >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64)
                if marked:
                    key = with_labels(key, p.column(2).to_numpy()[rec])
                parts.append((p.column(0).to_numpy()[rec], bucket, key))
            if sum(len(p[0]) for p in parts):
                ids, bucket, sig = (np.concatenate(c) for c in zip(*parts))
                yield K.pack_buckets(bucket, n_buckets, ids, sig)

    def rows(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["id_a", "id_b", "n"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sig = K.unpack_bucket(pa.Table.from_batches(list(batches)), _MARKED if marked else _SIG)
        label = sig["label"] if marked else None
        sig = np.ascontiguousarray(sig["sig"]) if marked else sig
        single = (sig & np.uint64(1)) == 1
        alone, token = ids[single], sig[single]
        order = np.argsort(token, kind="stable")
        alone, token = alone[order], token[order]
        ids, sig = ids[~single], sig[~single]
        label = label[~single] if marked else (sig >> np.uint64(1)) & np.uint64(1)
        sig = sig & ~np.uint64(3)
        order = np.lexsort((label, sig)) if marked else np.argsort(sig | label, kind="stable")
        sig, ids, label = sig[order], ids[order], label[order]
        starts = K.first_of(sig)
        ends = np.r_[starts[1:], len(sig)]
        done = ends - starts <= (crowd or len(sig))
        found, waiting = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for own, weight, pairs in ((ids, MEETINGS // 2, list_pairs(mode, starts[done], ends[done], label)), (alone, 1, token_pairs(token, threshold))):
            for i, j in pairs:
                a, b = np.minimum(own[i], own[j]), np.maximum(own[i], own[j])
                a, b, n = K.unique_pairs(a[a != b], b[a != b])
                found.append((a, b, n * weight))
                waiting += len(a)
                if waiting > HELD:
                    # Counts of a pair may leave in parts: they are added up after the exchange.
                    found, waiting = [_folded(found)], 0
                    if len(found[0][0]) > HELD // 2:
                        yield rows(*found.pop())
        if found:
            yield rows(*_folded(found))
        crowded = ~done if mode != "new" else ~done & (label[starts] == 0)
        inside = np.zeros(len(sig) + 1, np.int64)
        inside[starts[crowded]] += 1
        inside[ends[crowded]] -= 1
        many = np.unique(ids[np.cumsum(inside)[:-1] > 0])
        yield rows(many, many, np.zeros(len(many), np.int64))

    packed = reps.select("id", "residues", *(["label"] if marked else [])).mapInArrow(emit, K.PACKED)
    return packed.groupBy("bucket").applyInArrow(match, "id_a long, id_b long, n long").groupBy("id_a", "id_b").agg(F.sum("n").alias("n")).where(f"n >= {MEETINGS} or id_a = id_b")


def candidate_pairs(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs to be verified by ``near_pairs``, whose docstring has the method: id_a < id_b."""
    first = materialize(met(reps, partial(signatures, common=common_tokens(short_texts(reps, threshold))), CLASSES, CROWD, threshold), "met")
    pairs = first.where("id_a < id_b").select("id_a", "id_b")
    crowd = materialize(reps.join(first.where("id_a = id_b").select(F.col("id_a").alias("id")), "id", "left_semi").select("id", "residues"), "crowd")
    if crowd.isEmpty():
        return pairs
    windows = crowd.agg(F.avg(F.length("residues"))).first()[0]
    again = met(crowd, partial(crowd_tokens, common=common_tokens(crowd)), int((1 - threshold) * windows) + MEETINGS, None, threshold)
    return pairs.union(again.select("id_a", "id_b")).distinct()


def near_pairs(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of distinct sequences whose window sets have a Jaccard similarity of at least ``threshold``.

    ``reps``: id (long, unique) and residues (A-Z only); it is read several times, so it should be a stored table.
    Method: token-combination prefixes (``signatures``). Signatures go to buckets as packed arrays; in a bucket,
    records sharing a two-token combination meet where at most CROWD share it. Single tokens, rare ones first, serve
    pairs of records with few windows, each record under SHORT / threshold; they bound the windows in common
    (``token_pairs``), so that relatives below the threshold are seldom candidates. All records of more crowded
    combinations are searched again among themselves by single tokens in the same way, whatever their length and however
    many share one (``crowd_tokens``). A pair is a candidate with two meetings by combinations, or MEETINGS of single
    tokens; candidates are then verified exactly on the whole sequences.

    The prefixes of combinations are taken from hashed classes, so a pair can be missed, but only one that shares no
    crowded combination: if under two of its CLASSES neighbouring pairs of classes agree. Neighbours share classes, so
    the chance is that of runs in circles of CLASSES draws of chance s, simulated (2,000,000 circles): at similarity 0.5
    1.5e-5, at 0.55 3e-6. Borrowed prefixes make the draws of records with few windows less independent than that (no
    figure for them). Never missed are pairs that share a crowded combination, pairs in which the smaller record has
    under SHORT windows, and those in which the larger has under SHORT / threshold. No group of records is cut or sampled.
    Output: id_a < id_b, similarity.
    """
    return verify_pairs(candidate_pairs(reps, threshold), reps, reps, threshold)


def near_classes(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, component (least id) of every record with a partner in ``near_pairs``, without forming all pairs of a crowd.

    The first search is that of ``near_pairs``. Of the records of crowded combinations each is then compared only with
    the first record of its lists (``crowd_signatures``), which joins most of a crowd; in a second round of the same lists
    only records that are still in different components are compared. A pair of a crowd is left out if under two of its
    ROUNDS * CLASSES neighbouring triples of classes agree (simulated: 1.2e-6 at similarity 0.5, 9e-9 at 0.55); the
    components are those of all pairs but such.
    """
    first = materialize(met(reps, partial(signatures, common=common_tokens(short_texts(reps, threshold))), CLASSES, CROWD, threshold), "met")
    near = verify_pairs(first.where("id_a < id_b").select("id_a", "id_b"), reps, reps, threshold).select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))
    crowd = materialize(reps.join(first.where("id_a = id_b").select(F.col("id_a").alias("id")), "id", "left_semi").select("id", "residues"), "crowd")
    stars = verify_pairs(met(crowd, crowd_signatures, CLASSES * ROUNDS, None, threshold, "star").select("id_a", "id_b"), crowd, crowd, threshold)
    edges = materialize(near.union(stars.select("id_a", "id_b")), "edges")
    known = components(edges)
    if crowd.isEmpty():
        return known
    marked = materialize(crowd.join(known, F.col("id") == F.col("node"), "left").select("id", "residues", F.coalesce("component", "id").alias("label")), "marked")
    rest = verify_pairs(met(marked, crowd_signatures, CLASSES * ROUNDS, None, threshold, "across").select("id_a", "id_b"), crowd, crowd, threshold)
    rest = materialize(rest.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")), "rest")
    return known if rest.isEmpty() else components(edges.union(rest))


def verify_pairs(candidates: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Exact window Jaccard of candidate pairs (id_a of ``left``, id_b of ``right``), those below the threshold dropped."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for big in batches for p in K.steps(big)):
            s = K.pair_jaccards(b.column(2), b.column(3))
            ok = s >= threshold
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok)), pa.array(s[ok])], ["id_a", "id_b", "similarity"])

    la = left.select(F.col("id").alias("_ia"), F.col("residues").alias("_ra"))
    rb = right.select(F.col("id").alias("_ib"), F.col("residues").alias("_rb"))
    both = candidates.join(la, F.col("id_a") == F.col("_ia")).join(rb, F.col("id_b") == F.col("_ib")).select("id_a", "id_b", "_ra", "_rb")
    return both.mapInArrow(exact, "id_a long, id_b long, similarity double")


def representatives(df: DataFrame, id_col: str, text: F.Column, name: str) -> tuple[DataFrame, DataFrame]:
    """Exact copies folded: (reps: id, residues) with the least id of each text, and (members: id, rep).

    Only texts with at least one window have a place; null ids cannot be named in a pair and are left out.
    """
    base = df.select(F.col(id_col).cast("long").alias("id"), text.alias("residues")).where((F.length("residues") >= K.WINDOW) & F.col("id").isNotNull())
    reps = materialize(base.groupBy("residues").agg(F.min("id").alias("id")).select("id", "residues"), name)
    digest = F.unhex(F.md5(F.col("residues").cast("binary")))
    members = base.select("id", digest.alias("_d")).join(reps.select(F.col("id").alias("rep"), digest.alias("_e")), F.col("_d") == F.col("_e")).select("id", "rep")
    return reps, members


TABLES = {"dataset_info": "sequence", "dms_cosent": "sentence_0"}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows of one table with half of their windows in common, copies included."""
    out = None
    for name in TABLES:
        reps, members = representatives(table(spark, sf_dir, name), "row_id", residues(TABLES[name]), name)
        members, pairs = materialize(members, "members"), materialize(near_pairs(reps), "pairs")
        m1 = members.select(F.col("id").alias("x"), F.col("rep").alias("rx"))
        m2 = members.select(F.col("id").alias("y"), F.col("rep").alias("ry"))
        apart = pairs.join(m1, F.col("id_a") == F.col("rx")).join(m2, F.col("id_b") == F.col("ry")).select("x", "y")
        alike = m1.join(m2, (F.col("rx") == F.col("ry")) & (F.col("x") < F.col("y"))).select("x", "y")
        part = apart.union(alike).select(F.lit(name).alias("table_name"), F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"))
        out = part if out is None else out.union(part)
    return out


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row with a window: its class (least row_id of the connected group) and the copies of its text."""
    out = None
    for name in TABLES:
        reps, members = representatives(table(spark, sf_dir, name), "row_id", residues(TABLES[name]), name)
        of = near_classes(reps).select("node", F.col("component").alias("c"))
        copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies")).select(F.col("rep").alias("r2"), "copies")
        part = members.join(of, F.col("rep") == F.col("node"), "left").join(copies, F.col("rep") == F.col("r2")).select(
            F.lit(name).alias("table_name"), F.col("id").alias("row_id"), F.coalesce("c", "rep").alias("class_id"), "copies")
        out = part if out is None else out.union(part)
    return out


QUERIES = {"p4_found": p4_found, "p4_classes": p4_classes}
_PAIRS = """
SELECT '{t}' AS table_name, a.row_id AS row_id_a, b.row_id AS row_id_b
FROM (SELECT x.row_id AS i, y.row_id AS j, count(*) AS n FROM w_{t} x JOIN w_{t} y ON x.g = y.g AND x.row_id < y.row_id GROUP BY 1, 2) p
JOIN c_{t} a ON a.row_id = p.i JOIN c_{t} b ON b.row_id = p.j WHERE p.n * 2 >= a.n + b.n - p.n"""
_WINDOWS = """w_{t} AS (SELECT DISTINCT row_id, substr(s, i, 5) AS g FROM (
  SELECT row_id, s, unnest(generate_series(1, length(s) - 4)) AS i FROM (SELECT row_id, upper(regexp_replace({c}, '[^A-Za-z]', '', 'g')) AS s FROM {t}) WHERE length(s) >= 5)),
c_{t} AS (SELECT row_id, count(*) AS n FROM w_{t} GROUP BY 1)"""
SQL = {"p4_found": "WITH " + ",\n".join(_WINDOWS.format(t=t, c=c) for t, c in TABLES.items()) + " UNION ALL ".join(_PAIRS.format(t=t) for t in TABLES)}
