"""Problem 6: records of evaluation splits that recur, exactly or almost, in training data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import kernels as K
from helixframe.llm.neardup import THRESHOLD, verify_pairs
from helixframe.util import materialize, residues, table

#: Records with fewer windows are never regular (see ``Records``).
SHORT = 32
#: A record is regular if its slack is at most this part of its windows.
SLACK = 1 / 8
#: Kinds of terms: runs of LONG residues of two regular records; windows of an irregular evaluation record and any
#: training record; windows of a regular evaluation record and an irregular training record.
RUNS, ODD_EVAL, ODD_TRAIN = 0, 1, 2
LONG = 7
COUNTERS = 1 << 18
PRESENCE = 1 << 27
CHUNKS = 16
BUCKET = 1_000_000
#: Partial counters one task adds up, and partial counts a bucket holds before they are folded and sent on.
FAN_IN, HELD = 64, 2_000_000

#: side: 2 * windows + 1 for a training record, 0 or 1 where size or slack don't fit.
_POST = np.dtype([("key", "<u4"), ("side", "<u2"), ("slack", "u1")])


class Records:
    """Windows, sizes and terms of a batch of sequences.

    size: distinct windows. slack: repeated runs of three residues, twice the repeated windows, and 1. Two records of a and b
    windows, c of them common, have at least 2c - min(a, b) - slack_a - slack_b common runs of LONG = 7 residues:
    a run is common where its three windows are; each window of the smaller record that isn't common
    breaks one run and each gap between common windows two more; a gap of a single window needs a run of three
    residues that one of the two repeats, all others are of two windows or more. Here the runs of a record are all
    those whose three windows it has, side by side or not (``runs``).
    """

    def __init__(self, col: pa.Array, threshold: float):
        off, data = K.text_bytes(col)
        self.n = n = len(off) - 1
        self.off, self.data = off, data
        self.rec, self.code = K.codes(off, data, K.WINDOW)
        self.size = np.bincount(self.rec, minlength=n)
        extra3, extra4 = (self._repeats(off, data, k) for k in (3, 4))
        self.again = extra4 > 0
        mine = self.again[self.rec]
        self.folded = K.unique((self.rec[mine] << 24) | self.code[mine])
        distinct = np.bincount(self.folded >> 24, minlength=n)
        twice = np.where(self.again, self.size - distinct, 0)
        self.size = self.size - twice
        self.slack = extra3 + 2 * twice + 1
        self.regular = (self.size >= SHORT) & (self.slack <= SLACK * self.size) & (least_runs(1.0, 0.0, threshold) > 0)

    def _repeats(self, off: np.ndarray, data: np.ndarray, k: int) -> np.ndarray:
        rec, code = K.codes(off, data, k)
        return np.bincount(rec, minlength=self.n) - np.bincount(K.unique(rec * 26**k + code) // 26**k, minlength=self.n)

    def windows(self, which: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Record and term of each distinct window of the records of a mask."""
        mine = (which & ~self.again)[self.rec]
        old = self.folded[which[self.folded >> 24]]
        code = np.concatenate([self.code[mine], old & 0xFFFFFF])
        return np.concatenate([self.rec[mine], old >> 24]), K.mix64(code + (kind << 50))

    def runs(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Record and term of each run of LONG residues whose windows all are windows of the record (of a mask)."""
        rec, code = K.codes(self.off, self.data, LONG)
        mine = (which & ~self.again)[rec]
        old = self.folded[which[self.folded >> 24]]
        r, c = old >> 24, old & 0xFFFFFF
        ahead, tail = r * 26**4 + c // 26, r * 26**4 + c % 26**4
        low = np.searchsorted(ahead, tail, "left")
        more = np.searchsorted(ahead, tail, "right") - low

        def follow(last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            many = more[last]
            at = np.repeat(np.arange(len(last)), many)
            return at, low[last[at]] + np.arange(len(at)) - (np.cumsum(many) - many)[at]

        u, v = follow(np.arange(len(r)))
        at, x = follow(v)
        path = c[u[at]] * 676 + (c[v[at]] % 26) * 26 + c[x] % 26
        return np.concatenate([rec[mine], r[u[at]]]), K.mix64(np.concatenate([code[mine], path]) + (1 << 40))


def share(threshold: float) -> float:
    """Records of a and b windows with that Jaccard have this part of a + b in common."""
    return threshold / (1 + threshold)


def least_runs(b, slack, threshold: float):
    """Common runs, at least, of a regular record of b windows with any regular record it is close to (one of b windows)."""
    return (4 * share(threshold) - 1 - SLACK) * b - slack


def least(b: np.ndarray, slack: np.ndarray, kind: np.ndarray, threshold: float) -> np.ndarray:
    """Common terms, at least, of a record with any it is close to."""
    return np.maximum(1, np.ceil(np.where(kind == RUNS, least_runs(b, slack, threshold), threshold * b) - 1e-6)).astype(np.int64)


def least_of_pair(a, b, slack_a, slack_b, kind, threshold: float) -> np.ndarray:
    """Common terms, at least, of two records that are close."""
    common = share(threshold) * (a + b)
    return np.ceil(np.where(kind == RUNS, 2 * common - np.minimum(a, b) - slack_a - slack_b, common) - 1e-6).astype(np.int64)


def scoped(term: np.ndarray, scope: np.ndarray) -> np.ndarray:
    return K.mix64(term ^ scope)


def octave(size: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(size, 1) + 0.5).astype(np.int64)


def at_octave(key: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Key of a scoped term of an irregular record with about 2**o windows: only records of like size look for it."""
    return K.mix64(key + np.asarray(o + 1).astype(np.uint64))


def marks(kind: int, o: np.ndarray) -> np.ndarray:
    """Key that says there is an irregular record of that size."""
    return at_octave(np.full(len(o), (7 << 60) + kind, np.uint64), o)


def scope_codes(col: pa.Array) -> np.ndarray:
    """A 64-bit code of each scope name, the same in every task."""
    d = col.dictionary_encode()
    return np.array([K.mix64(np.array([int.from_bytes(x.encode(), "little") % (1 << 61)]))[0] for x in d.dictionary.to_pylist()], np.uint64)[d.indices.to_numpy()]


class Statistics:
    """What pruning needs to know of the records of one side, in tables of fixed size (about 18 MB).

    idf: rarity by hashed term, for the order in which terms are sent; most: most windows of an evaluation record with
    that hashed term; present: a bit for each hashed key met on that side - a term that the other side doesn't have can add nothing.
    """

    def __init__(self, idf: np.ndarray, most: np.ndarray, present: np.ndarray):
        self.idf, self.most, self.present = idf, most, present

    @classmethod
    def of(cls, df: np.ndarray, most: np.ndarray, present: np.ndarray) -> Statistics:
        return cls((1 / (1 + df)).astype(np.float32), most, present)

    def has(self, key: np.ndarray) -> np.ndarray:
        p = (key % np.uint64(PRESENCE)).astype(np.int64)
        return (self.present[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0

    def has_near(self, key: np.ndarray, size: np.ndarray, threshold: float) -> np.ndarray:
        """Keys met with an irregular record of a size that may be close to ``size`` windows."""
        o, span = octave(size), int(np.ceil(-np.log2(threshold) - 1e-9))
        out = np.zeros(len(key), bool)
        for d in range(-span, span + 1):
            at = np.flatnonzero(o + d >= 0)
            out[at] |= self.has(at_octave(key[at], o[at] + d))
        return out


def slots(term: np.ndarray) -> np.ndarray:
    return (term >> np.uint64(46)).astype(np.int64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted numbers as single-byte steps; 255 goes on without a number."""
    step = np.diff(np.r_[np.int64(-1), keys.astype(np.int64)]) - 1
    long = step // 255
    out = np.full(len(step) + int(long.sum()), 255, np.uint8)
    out[np.arange(len(step)) + np.cumsum(long)] = step % 255
    return out.tobytes()


def unpacked_keys(data: bytes) -> np.ndarray:
    step = np.frombuffer(data, np.uint8)
    here = step < 255
    return (np.cumsum(step, dtype=np.int64) + np.cumsum(here) - 1)[here]


def gather(both: DataFrame, of: Callable) -> Statistics:
    """One pass over ``both``; each task sends fixed-size counters, added up by chunk in a tree of FAN_IN inputs a task.

    ``of`` gives for a batch: terms to be counted; terms and sizes of evaluation records; keys to be marked as present.
    """
    per = COUNTERS // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, most, keys, n = np.zeros(COUNTERS, np.int64), np.zeros(COUNTERS, np.uint16), [], 0
        for b in (p for big in batches for p in K.steps(big)):
            counted, mine, size, key = of(b)
            df += np.bincount(slots(counted), minlength=COUNTERS)
            np.maximum.at(most, slots(mine), np.minimum(size, 65535).astype(np.uint16))
            keys.append(K.unique((key % np.uint64(PRESENCE)).astype(np.uint32)))
            n += b.num_rows
        keys = K.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint32)
        cut = np.searchsorted(keys, np.arange(CHUNKS + 1) * (PRESENCE // CHUNKS))
        place = TaskContext.get().partitionId()
        for c in range(CHUNKS):
            part = slice(c * per, (c + 1) * per)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c], pa.int32()), pa.array([place // FAN_IN], pa.int32()), pa.array([df[part].astype(np.uint64).tobytes()]), pa.array([most[part].tobytes()]), pa.array([packed_keys(keys[cut[c] : cut[c + 1]] - np.uint32(c * (PRESENCE // CHUNKS)))])],
                    ["chunk", "part", "df", "most", "present"],
                )

    def add(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df, most, bits = np.zeros(per, np.uint64), np.zeros(per, np.uint16), np.zeros(PRESENCE // CHUNKS // 8, np.uint8)
            c, place = 0, 0
            for b in batches:
                for c, place, d, s, p in zip(*(b.column(i).to_pylist() for i in range(5))):
                    df += np.frombuffer(d, np.uint64)
                    most = np.maximum(most, np.frombuffer(s, np.uint16))
                    if first:
                        flag = np.zeros(PRESENCE // CHUNKS, np.uint8)
                        flag[unpacked_keys(p)] = 1
                        bits |= np.packbits(flag, bitorder="little")
                    else:
                        bits |= np.frombuffer(p, np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([place // FAN_IN], pa.int32()), pa.array([df.tobytes()]), pa.array([most.tobytes()]), pa.array([bits.tobytes()])], ["chunk", "part", "df", "most", "present"])

        return run

    schema = "chunk int, part int, df binary, most binary, present binary"
    left = -(-max(1, both.rdd.getNumPartitions()) // FAN_IN)
    sums = both.mapInArrow(count, schema).groupBy("chunk", "part").applyInArrow(add(True), schema)
    while left > 1:
        sums = sums.groupBy("chunk", "part").applyInArrow(add(False), schema)
        left = -(-left // FAN_IN)
    rows = sorted(sums.collect(), key=lambda r: r["chunk"])
    if not rows:
        return Statistics.of(np.zeros(COUNTERS), np.zeros(COUNTERS, np.uint16), np.zeros(PRESENCE // 8, np.uint8))
    glue = lambda k, t: np.concatenate([np.frombuffer(r[k], t) for r in rows])
    return Statistics.of(glue("df", np.uint64), glue("most", np.uint16), glue("present", np.uint8))


def gather_statistics(evals: DataFrame, train: DataFrame | None, common: str, threshold: float = THRESHOLD) -> Statistics:
    """Statistics of the evaluation side; terms of ``train``, where given, count for the rarity only."""

    def of(b: pa.RecordBatch):
        rs = Records(b.column(1), threshold)
        r0, t0 = rs.runs(rs.regular)
        r1, t1 = rs.windows(~rs.regular, ODD_EVAL)
        ev = b.column(3).to_numpy(zero_copy_only=False)
        counted = np.concatenate([t0, t1])
        r0, t0, r1, t1 = r0[ev[r0]], t0[ev[r0]], r1[ev[r1]], t1[ev[r1]]
        own, size, odd = scope_codes(b.column(2)), octave(rs.size), ev & ~rs.regular & (rs.size > 0)
        keys = [marks(ODD_EVAL, K.unique(size[odd]))]
        for s in (own, np.full(b.num_rows, scope_codes(pa.array([common]))[0])):
            keys += [scoped(t0, s[r0]), at_octave(scoped(t1, s[r1]), size[r1])]
        return counted, np.concatenate([t0, t1]), rs.size[np.concatenate([r0, r1])], np.concatenate(keys)

    both = evals.select("id", "residues", "scope", F.lit(True).alias("ev"))
    return gather(both if train is None else both.union(train.select("id", "residues", "scope", F.lit(False))), of)


def train_terms(b: pa.RecordBatch, known: Statistics, threshold: float) -> tuple[Records, np.ndarray, np.ndarray, np.ndarray]:
    """Vector number (record * 4 + kind), term and scoped term of all that a training batch may have in common with the
    evaluation side; vectors that have too few such terms for any close pair are left out."""
    rs = Records(b.column(1), threshold)
    own = scope_codes(b.column(2))
    r, t = rs.runs(rs.regular)
    key = scoped(t, own[r])
    size = np.minimum(threshold * rs.size[r], 65535)
    met = known.has(key) & (known.most[slots(t)] >= size)
    parts = [(r[met] * 4 + RUNS, t[met], key[met])]
    odd = known.has_near(np.full(rs.n, (7 << 60) + ODD_EVAL, np.uint64), rs.size, threshold)
    r, t = rs.windows(odd, ODD_EVAL)
    key = scoped(t, own[r])
    met = known.has_near(key, rs.size[r], threshold)
    parts.append((r[met] * 4 + ODD_EVAL, t[met], key[met]))
    r, t = rs.windows(~rs.regular, ODD_TRAIN)
    parts.append((r * 4 + ODD_TRAIN, t, scoped(t, own[r])))
    vec, term, key = (np.concatenate(c) for c in zip(*parts))
    kept = enough(vec, rs, threshold)[vec]
    return rs, vec[kept], term[kept], key[kept]


def eval_terms(b: pa.RecordBatch, met: Statistics, every: np.uint64, threshold: float) -> tuple[Records, np.ndarray, np.ndarray]:
    """Vector number and scoped term, for the own scope and for all, of what an evaluation batch may have in common
    with the training records that are left."""
    rs = Records(b.column(1), threshold)
    near = met.has_near(np.full(rs.n, (7 << 60) + ODD_TRAIN, np.uint64), rs.size, threshold) & rs.regular
    vecs, keys = [], []
    for s in (scope_codes(b.column(2)), np.full(rs.n, every)):
        parts = []
        for kind, (r, t) in ((RUNS, rs.runs(rs.regular)), (ODD_EVAL, rs.windows(~rs.regular, ODD_EVAL)), (ODD_TRAIN, rs.windows(near, ODD_TRAIN))):
            key = scoped(t, s[r])
            ok = met.has_near(key, rs.size[r], threshold) if kind == ODD_TRAIN else met.has(key)
            parts.append((r[ok] * 4 + kind, key[ok]))
        vec, key = (np.concatenate(c) for c in zip(*parts))
        kept = enough(vec, rs, threshold)[vec]
        vecs.append(vec[kept])
        keys.append(key[kept])
    return rs, np.concatenate(vecs), np.concatenate(keys)


def enough(vec: np.ndarray, rs: Records, threshold: float) -> np.ndarray:
    """Which vectors have terms enough for a close pair."""
    v = np.arange(4 * rs.n)
    return np.bincount(vec, minlength=4 * rs.n) >= least(rs.size[v >> 2], rs.slack[v >> 2], v & 3, threshold)


def posts(rs: Records, vec: np.ndarray, key: np.ndarray, side: int) -> np.ndarray:
    size, slack = rs.size[vec >> 2], rs.slack[vec >> 2]
    fits = (size < 1 << 15) & ((slack < 256) | (vec & 3 != RUNS))
    post = np.empty(len(vec), _POST)
    post["key"], post["side"], post["slack"] = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.where(fits, size, 0) * 2 + side, np.minimum(slack, 255)
    return post


def rarest(rs: Records, vec: np.ndarray, rarity: np.ndarray, threshold: float) -> np.ndarray:
    """Positions of the terms that are sent: of each vector all but the most frequent, one fewer than a close pair needs."""
    o = np.lexsort((rarity, vec))
    start = K.first_of(vec[o])
    place = np.arange(len(o)) - np.repeat(start, np.diff(np.r_[start, len(o)]))
    v = vec[o]
    return o[place >= least(rs.size[v >> 2], rs.slack[v >> 2], v & 3, threshold) - 1]


def cross_pairs(evals: DataFrame, train: DataFrame, common: str, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (id_a of ``evals``, id_b of ``train``) with a window Jaccard of at least ``threshold``, similarity as third column.

    Both sides: id (long, unique), residues (A-Z), scope. A training record meets the evaluation records of its scope;
    those of the scope ``common`` meet all. ``evals`` is read several times, so it should be a stored table; ``train`` is read once.

    Method: join of inverted lists by bounds that follow from the threshold (``Records``), so no pair is missed. Close
    records of a and b windows have c >= threshold / (1 + threshold) * (a + b) of them in common. If both are regular, that is,
    repeat few short runs, they have a number of runs of LONG residues in common that follows from c; pairs with an irregular or
    short record are compared on their windows. Terms that the other side doesn't have (``Statistics``, a bitmap
    of fixed size; a false hit costs time only) are left out, then records with too few terms left, then of
    each training record its most frequent terms, one fewer than any close pair has in common. Lists travel as packed arrays by term; partial
    counts are summed in each bucket, then over buckets by pair. Pairs whose count plus the part left out reaches the
    bound are compared exactly. No list is cut or sampled.
    """
    spark = evals.sparkSession
    send = lambda s: spark.sparkContext.broadcast((s.idf, s.most, s.present))
    known = send(gather_statistics(evals, None, common, threshold))
    three = lambda df: df.select("id", "residues", "scope")

    def only(terms: Callable):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (p for big in batches for p in K.steps(big)):
                yield b.filter(pa.array(np.bincount(terms(b) >> 2, minlength=b.num_rows) > 0))

        return run

    train = materialize(three(train).mapInArrow(only(lambda b: train_terms(b, Statistics(*known.value), threshold)[1]), "id long, residues string, scope string"), "train")

    def left(b: pa.RecordBatch):
        rs, vec, term, key = train_terms(b, Statistics(*known.value), threshold)
        odd = vec & 3 == ODD_TRAIN
        size = octave(rs.size)
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, np.int64), np.concatenate([key[~odd], at_octave(key[odd], size[vec[odd] >> 2]), marks(ODD_TRAIN, K.unique(size[vec[odd] >> 2]))])

    met = send(gather(three(train), left))
    every = scope_codes(pa.array([common]))[0]
    evals = materialize(three(evals).mapInArrow(only(lambda b: eval_terms(b, Statistics(*met.value), every, threshold)[1]), "id long, residues string, scope string"), "near")
    total = lambda df: df.agg(F.coalesce(F.sum(F.length("residues")), F.lit(0))).first()[0]
    n_buckets = max(4, -(-(2 * total(evals) + total(train)) // BUCKET))

    def emit(is_eval: bool):
        def one(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if is_eval:
                rs, vec, key = eval_terms(b, Statistics(*met.value), every, threshold)
            else:
                s = Statistics(*known.value)
                rs, vec, term, key = train_terms(b, s, threshold)
                at = rarest(rs, vec, s.idf[slots(term)], threshold)
                vec, key = vec[at], key[at]
            return key, b.column(0).to_numpy()[vec >> 2] * 4 + (vec & 3), posts(rs, vec, key, int(not is_eval))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                parts = [x for x in map(one, K.steps(big)) if len(x[0])]
                if parts:
                    key, ids, post = (np.concatenate(c) for c in zip(*parts))
                    yield K.pack_buckets(((key >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64), n_buckets, ids, post)

        return run

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, post = K.unpack_bucket(pa.Table.from_batches(list(batches)), _POST)
        o = np.argsort(post["key"], kind="stable")
        ids, post = ids[o], post[o]
        ev = post["side"] % 2 == 0
        (e_id, e_key, e_size, e_slack), (t_id, t_key, t_size, t_slack) = (
            (ids[x], post["key"][x], (post["side"][x] >> 1).astype(np.int64), post["slack"][x].astype(np.int64)) for x in (ev, ~ev))
        lo, hi = np.searchsorted(e_key, t_key, "left"), np.searchsorted(e_key, t_key, "right")
        got: list[tuple] = []

        def fold(parts):
            e, x, n, need = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((x, e))
            e, x, n, need = e[order], x[order], n[order], need[order]
            at = np.flatnonzero(np.r_[True, (e[1:] != e[:-1]) | (x[1:] != x[:-1])]) if len(e) else np.zeros(0, np.int64)
            return (e[at], x[at], np.add.reduceat(n, at), np.maximum.reduceat(need, at)) if len(at) else (e, x, n, need)

        def rows(e, x, n, need):
            return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()), pa.array(x, pa.int64()), pa.array(n, pa.int32()), pa.array(need, pa.int32())], ["e", "t", "n", "need"])

        many = hi - lo
        held = 0
        limit, i, total = 1_000_000, 0, np.r_[0, np.cumsum(many)]
        while i < len(many):
            j = max(i + 1, int(np.searchsorted(total, total[i] + limit, "right")) - 1)
            row = np.repeat(np.arange(i, j), many[i:j])
            if len(row):
                col = lo[row] + np.arange(len(row)) - (total[row] - total[i])
                a, b = e_size[col], t_size[row]
                same = ((e_id[col] & 3) == (t_id[row] & 3)) & ((a == 0) | (b == 0) | ((a >= threshold * b - 1e-6) & (b >= threshold * a - 1e-6)))
                row, col, a, b = row[same], col[same], a[same], b[same]
                kind = t_id[row] & 3
                need = least_of_pair(a, b, e_slack[col], t_slack[row], kind, threshold) - least(b, t_slack[row], kind, threshold) + 1
                need = np.where((a == 0) | (b == 0), 1, np.maximum(need, 1)).astype(np.int32)
                got.append(fold([(e_id[col] >> 2, t_id[row], np.ones(len(row), np.int32), need)]))
                held += len(got[-1][0])
            if held > HELD:
                # Partial counts of a pair may leave in parts: they are added up after the exchange.
                got = [fold(got)]
                held = 0
                if len(got[0][0]) > HELD // 2:
                    yield rows(*got.pop())
            i = j
        if got:
            yield rows(*fold(got))

    lists = three(evals).mapInArrow(emit(True), K.PACKED).union(three(train).mapInArrow(emit(False), K.PACKED))
    sums = lists.groupBy("bucket").applyInArrow(match, "e long, t long, n int, need int").groupBy("e", "t").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
    candidates = sums.where("n >= need").select(F.col("e").alias("id_a"), F.shiftright("t", 2).alias("id_b")).distinct()
    return verify_pairs(candidates, evals, train, threshold)


DMS = "\x00dms_cosent"


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of dataset_info with residues: row_id, dataset, split (trimmed, lower-cased), residues, is_eval, is_train."""
    form = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    cfg = table(spark, sf_dir, "task_config")
    role = lambda c, r: cfg.select(F.col("dataset").alias("d"), form(c).alias("s"), F.lit(r).alias("r"))
    roles = role("test_split", 1).union(role("validation_split", 1)).union(role("train_split", 2)).where("s is not null").groupBy("d", "s").agg(
        F.max(F.col("r") == 1).alias("is_eval"), F.max(F.col("r") == 2).alias("is_train"))
    rows = table(spark, sf_dir, "dataset_info").select("row_id", "dataset", form("split_name").alias("split"), residues("sequence").alias("residues"))
    return rows.where(F.length("residues") >= K.WINDOW).join(roles, (F.col("dataset") == F.col("d")) & (F.col("split") == F.col("s"))).drop("d", "s")


def overlap_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each evaluation row with the training texts it is close to: row_id, dataset, eval_split, train_source, train_id, similarity."""
    rows = materialize(split_rows(spark, sf_dir), "splits")
    ev = rows.where("is_eval")
    reps = materialize(ev.groupBy("dataset", "residues").agg(F.min("row_id").alias("id")).select("id", "residues", F.col("dataset").alias("scope")), "evals")
    own = rows.where("is_train").groupBy("dataset", "residues").agg(F.min("row_id").alias("id")).select((F.col("id") * 2).alias("id"), "residues", F.col("dataset").alias("scope"))
    dms = table(spark, sf_dir, "dms_cosent").select("row_id", residues("sentence_0").alias("residues")).where(F.length("residues") >= K.WINDOW)
    dms = dms.groupBy("residues").agg(F.min("row_id").alias("id")).select((F.col("id") * 2 + 1).alias("id"), "residues", F.lit(DMS).alias("scope"))
    pairs = cross_pairs(reps, own.union(dms), DMS)
    digest = F.unhex(F.md5(F.col("residues").cast("binary")))
    back = reps.select(F.col("id").alias("rep"), F.col("scope").alias("_s"), digest.alias("_d"))
    named = ev.select("row_id", "dataset", "split", digest.alias("_e")).join(back, (F.col("_d") == F.col("_e")) & (F.col("dataset") == F.col("_s")))
    return named.join(pairs, F.col("rep") == F.col("id_a")).select(
        "row_id", "dataset", F.col("split").alias("eval_split"), F.when(F.col("id_b") % 2 == 1, "dms_cosent").otherwise("dataset_info").alias("train_source"),
        F.shiftright("id_b", 1).alias("train_id"), "similarity")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_links(spark, sf_dir).select("row_id", "eval_split", "train_source").distinct()


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping evaluation rows by dataset, split and training source, with the links to different training texts."""
    return overlap_links(spark, sf_dir).groupBy("dataset", "eval_split", "train_source").agg(
        F.count_distinct("row_id").alias("eval_rows"), F.count(F.lit(1)).alias("links"), F.sum((F.col("similarity") == 1).cast("int")).alias("exact_links"))


QUERIES = {"p6_found": p6_found, "p6_report": p6_report}
SQL = {
    "p6_found": r"""
WITH role AS (
  SELECT dataset AS d, lower(trim(test_split)) AS s, 1 AS ev FROM task_config UNION SELECT dataset, lower(trim(validation_split)), 1 FROM task_config
  UNION SELECT dataset, lower(trim(train_split)), 0 FROM task_config),
r AS (SELECT row_id, dataset, lower(regexp_replace(split_name, '^\s+|\s+$', '', 'g')) AS s, upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) AS q FROM dataset_info),
e AS (SELECT DISTINCT 'e' AS side, row_id, dataset, r.s, q FROM r JOIN role ON d = dataset AND role.s = r.s AND ev = 1),
t AS (SELECT DISTINCT 'dataset_info' AS src, row_id, dataset, q FROM r JOIN role ON d = dataset AND role.s = r.s AND ev = 0
  UNION ALL SELECT 'dms_cosent', row_id, NULL, upper(regexp_replace(sentence_0, '[^A-Za-z]', '', 'g')) FROM dms_cosent),
we AS (SELECT DISTINCT row_id, substr(q, i, 5) AS g FROM (SELECT row_id, q, unnest(generate_series(1, length(q) - 4)) AS i FROM e WHERE length(q) >= 5)),
wt AS (SELECT DISTINCT src, row_id, substr(q, i, 5) AS g FROM (SELECT src, row_id, q, unnest(generate_series(1, length(q) - 4)) AS i FROM t WHERE length(q) >= 5)),
ne AS (SELECT row_id, count(*) AS n FROM we GROUP BY 1), nt AS (SELECT src, row_id, count(*) AS n FROM wt GROUP BY 1, 2),
p AS (SELECT we.row_id AS x, wt.src, wt.row_id AS y, count(*) AS n FROM we JOIN wt ON we.g = wt.g GROUP BY 1, 2, 3)
SELECT DISTINCT e.row_id, e.s AS eval_split, p.src AS train_source FROM p JOIN e ON e.row_id = p.x JOIN t ON t.src = p.src AND t.row_id = p.y
JOIN ne ON ne.row_id = p.x JOIN nt ON nt.src = p.src AND nt.row_id = p.y
WHERE p.n * 2 >= ne.n + nt.n - p.n AND (p.src = 'dms_cosent' OR t.dataset = e.dataset)"""
}
