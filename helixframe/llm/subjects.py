"""Problem 9: the subject areas each document is about."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import kernels as K
from helixframe.util import materialize, parallelism, spread, strip, table

#: Labelled documents the model is fitted on at most.
SAMPLE = 20_000
#: Rows and columns of the embedding table; lengths of the parts of words that have a row besides the word itself.
ROWS, WIDTH, PARTS = 1 << 16, 24, (4, 5)
ROUNDS, EPOCHS, BATCH, RATE = 14, 3, 256, 0.25
#: Sentences that must be devoted to an area, and how far from the area's base rate towards certainty one is.
SENTENCES, LEVEL = 3, 0.3

_WORD = regex.compile(r"[\p{L}]+")
_FORMAT = regex.compile(r"\p{Cf}+")
_LINE = regex.compile("\r\n?|[\v\f\x85\u2028\u2029]")
_END = regex.compile(r"""(?<=[.!?…。])["”’')\]]*\s+|\n[^\S\n]*\n""")
#: Words a sentence has at least; less are headings, counters and the like.
WORDS = 3


def sentences(text: str | None) -> list[list[str]]:
    """Words (runs of letters, lower-cased, NFKC, no format characters) of each sentence that has WORDS of them.

    A sentence ends with its punctuation or at a blank line; a single line break may stand anywhere inside it.
    """
    if not text:
        return []
    if not text.isascii():
        text = _FORMAT.sub("", unicodedata.normalize("NFKC", text))
    split = (_WORD.findall(s) for s in _END.split(_LINE.sub("\n", text.lower())) if s)
    return [w for w in split if len(w) >= WORDS]


def word_rows(word: str) -> list[int]:
    """Rows of the embedding table of a word: its own and those of its parts with the word's ends marked."""
    marked = f"<{word}>"
    parts = [marked[i : i + n] for n in PARTS for i in range(len(marked) - n + 1)]
    return [xxhash.xxh32_intdigest(p) % ROWS for p in [word, *parts]]


class Examples:
    """Sentences of one task as arrays: word numbers of each, the table rows of each word, the areas of each document."""

    def __init__(self, rows: np.ndarray, row_n: np.ndarray, words: np.ndarray, word_n: np.ndarray, targets: np.ndarray):
        self.rows, self.row_n, self.words, self.word_n, self.targets = rows, row_n, words, word_n, targets
        self.row_at, self.word_at = np.cumsum(row_n) - row_n, np.cumsum(word_n) - word_n

    @classmethod
    def of(cls, texts: Iterator[tuple[str, np.ndarray]]) -> Examples:
        number: dict[str, int] = {}
        rows, row_n, words, word_n, targets = [], [], [], [], []
        for text, y in texts:
            for s in sentences(text):
                for w in s:
                    n = number.get(w)
                    if n is None:
                        n = number[w] = len(number)
                        own = word_rows(w)
                        rows += own
                        row_n.append(len(own))
                    words.append(n)
                word_n.append(len(s))
                targets.append(y)
        return cls(np.array(rows, np.int32), np.array(row_n, np.int64), np.array(words, np.int32), np.array(word_n, np.int64), np.array(targets, np.uint8))

    FIELDS = (("rows", np.int32), ("row_n", np.int64), ("words", np.int32), ("word_n", np.int64), ("targets", np.uint8))

    def packed(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([getattr(self, f).tobytes()], pa.binary()) for f, _ in self.FIELDS], [f for f, _ in self.FIELDS])

    @classmethod
    def unpacked(cls, b: pa.RecordBatch, i: int, areas: int) -> Examples:
        out = [np.frombuffer(b.column(k)[i].as_buffer(), t) for k, (_, t) in enumerate(cls.FIELDS)]
        return cls(*out[:4], out[4].reshape(-1, areas))


EXAMPLES = ", ".join(f"{f} binary" for f, _ in Examples.FIELDS)


def spans(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Positions of several runs, one after the other."""
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def start_values(areas: int, seed: int = 5) -> np.ndarray:
    """All parameters in one vector: embedding table, output weights, output biases."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-0.5, 0.5, ROWS * WIDTH)
    w = rng.uniform(-0.5, 0.5, WIDTH * areas)
    return np.concatenate([e, w, np.full(areas, -2.0)]).astype(np.float32)


def parts_of(p: np.ndarray, areas: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = ROWS * WIDTH, ROWS * WIDTH + WIDTH * areas
    return p[:a].reshape(ROWS, WIDTH), p[a:b].reshape(WIDTH, areas), p[b:]


def local_steps(p: np.ndarray, x: Examples, areas: int, history: np.ndarray, seed: int) -> np.ndarray:
    """EPOCHS passes of Adagrad over one task's sentences, from the common parameters; the change it would make."""
    mine, h = p.copy(), history.copy()
    e, w, b = parts_of(mine, areas)
    he, hw, hb = parts_of(h, areas)
    order = np.concatenate([np.random.default_rng((seed, k)).permutation(len(x.word_n)) for k in range(EPOCHS)])
    for i in range(0, len(order), BATCH):
        pick = order[i : i + BATCH]
        n = x.word_n[pick]
        some, at = np.unique(x.words[spans(x.word_at[pick], n)], return_inverse=True)
        r = x.row_n[some]
        rows, owner = x.rows[spans(x.row_at[some], r)], np.repeat(np.arange(len(some)), r)
        vec = np.add.reduceat(e[rows], np.cumsum(r) - r, axis=0) / r[:, None].astype(np.float32)
        mean = np.add.reduceat(vec[at], np.cumsum(n) - n, axis=0) / n[:, None].astype(np.float32)
        err = (1 / (1 + np.exp(-np.clip(mean @ w + b, -30, 30))) - x.targets[pick]).astype(np.float32)
        gx = (err @ w.T) / n[:, None].astype(np.float32)
        gw, gb = mean.T @ err, err.sum(0)
        o = np.argsort(at, kind="stable")
        gvec = np.add.reduceat(np.repeat(gx, n, axis=0)[o], K.first_of(at[o]), axis=0) / r[:, None].astype(np.float32)
        o = np.argsort(rows, kind="stable")
        first = K.first_of(rows[o])
        ge, which = np.add.reduceat(gvec[owner[o]], first, axis=0), rows[o][first]
        now = he[which] + ge**2
        he[which] = now
        e[which] -= RATE * ge / np.sqrt(now + 1e-6)
        hw += gw**2
        w -= RATE * gw / np.sqrt(hw + 1e-6)
        hb += gb**2
        b -= RATE * gb / np.sqrt(hb + 1e-6)
    return mine - p


def area_key(c: F.Column) -> F.Column:
    """Spellings of one area alike: lower case, separators as underscores."""
    return F.regexp_replace(F.lower(strip(c)), r"[\s_\-]+", "_")


def fit(documents: DataFrame, labels: DataFrame, areas: list[str], sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Parameters, and the share of sentences under each area, fitted on at most ``sample`` labelled documents (chosen by hash) and the labels' areas.

    ``documents``: doc_id, text; ``labels``: doc_id, area (a key of ``areas``).
    Every sentence of a labelled document is an example with the document's areas as independent yes/no targets; what
    is said in all areas alike ends at the base rate, so wrong labels and general sentences do not reach
    ``LEVEL``.
    Texts are cut into sentences once; what is stored is one row of word numbers a partition, from which a lost task starts again. In each round every
    partition runs over its sentences from the common parameters and sends its summed gradient steps, only for the rows it met; their mean makes the next common parameters. At most 8 partitions send at most
    6 MB each, whatever the corpus.
    """
    spark = documents.sparkSession
    order = {a: i for i, a in enumerate(areas)}
    of_doc = labels.groupBy("doc_id").agg(F.sort_array(F.collect_set("area")).alias("areas"))
    n = of_doc.count()
    if n > sample:
        of_doc = of_doc.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n)).limit(sample)
    tasks = max(1, min(parallelism(spark), 8, n // 50 or 1))
    examples = documents.select("doc_id", "text").join(of_doc.withColumnRenamed("doc_id", "_d"), F.col("doc_id") == F.col("_d")).where(F.length("text") > 0)
    examples = materialize(examples.select("text", "areas"), "examples").repartition(tasks)
    k = len(areas)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts() -> Iterator[tuple[str, np.ndarray]]:
            for b in batches:
                for text, names in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    y = np.zeros(k, np.uint8)
                    y[[order[a] for a in names]] = 1
                    yield text, y

        x = Examples.of(texts())
        if len(x.word_n):
            yield x.packed()

    examples = materialize(examples.mapInArrow(split, EXAMPLES), "sentences")
    prior = np.zeros(k)
    p, history = start_values(k), np.zeros(ROWS * WIDTH + WIDTH * k + k, np.float32)
    table_size = ROWS * WIDTH
    for turn in range(ROUNDS):
        now = spark.sparkContext.broadcast((p, history))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p0, h0 = now.value
            for b in batches:
                for i in range(b.num_rows):
                    x = Examples.unpacked(b, i, k)
                    change = local_steps(p0, x, k, h0, turn)
                    moved = change[:table_size].reshape(ROWS, WIDTH)
                    rows = np.flatnonzero(moved.any(axis=1)).astype(np.int32)
                    under = x.targets.sum(0, dtype=np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (rows, moved[rows], change[table_size:], under)] + [pa.array([len(x.word_n)])], ["rows", "moved", "rest", "under", "n"])

        total, by = np.zeros_like(p), np.zeros(ROWS, np.float32)
        parts, under, n_sents = 0, np.zeros(k), 0
        for r in examples.mapInArrow(learn, "rows binary, moved binary, rest binary, under binary, n long").collect():
            # A row's change is the mean over the partitions that changed it: rare words are not held back.
            rows = np.frombuffer(r["rows"], np.int32)
            total[:table_size].reshape(ROWS, WIDTH)[rows] += np.frombuffer(r["moved"], np.float32).reshape(-1, WIDTH)
            by[rows] += 1
            total[table_size:] += np.frombuffer(r["rest"], np.float32)
            parts += 1
            under += np.frombuffer(r["under"])
            n_sents += r["n"]
        now.destroy()
        if not parts:
            break
        total[:table_size].reshape(ROWS, WIDTH)[:] /= np.maximum(by, 1)[:, None]
        total[table_size:] /= parts
        p, prior = p + total, under / n_sents
        history = history + (total / RATE) ** 2
    return p, prior


def score(documents: DataFrame, p: np.ndarray, prior: np.ndarray, areas: list[str], least: int = SENTENCES, level: float = LEVEL) -> DataFrame:
    """doc_id, subject_area, sentences: the areas at least ``least`` sentences of a document are devoted to.

    A sentence is devoted to the area whose probability is the largest part of the way from the area's base rate to 1,
    when that is at least ``level``. All sentences of all documents are scored. Null, empty and blank texts have no rows; repeated rows are scored each.
    """
    k = len(areas)
    model = documents.sparkSession.sparkContext.broadcast(p)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, w, bias = parts_of(model.value, k)
        known: dict[str, int] = {}
        logits: list[np.ndarray] = []
        stacked = np.zeros((0, k), np.float32)
        for big in batches:
            for i in range(0, big.num_rows, 1000):
                b = big.slice(i, 1000)
                if len(known) > 300_000:
                    known, logits, stacked = {}, [], np.zeros((0, k), np.float32)
                flat, n, doc = [], [], []
                for d, text in enumerate(b.column(1).to_pylist()):
                    for s in sentences(text):
                        for word in s:
                            at = known.get(word)
                            if at is None:
                                at = known[word] = len(known)
                                logits.append(e[word_rows(word)].mean(0) @ w)
                            flat.append(at)
                        n.append(len(s))
                        doc.append(d)
                if not n:
                    continue
                if len(stacked) < len(logits):
                    stacked = np.concatenate([stacked, np.array(logits[len(stacked) :])])
                n = np.array(n)
                x = np.add.reduceat(stacked[np.array(flat)], np.cumsum(n) - n, axis=0) / n[:, None] + bias
                x = (1 / (1 + np.exp(-np.clip(x, -30, 30))) - prior) / np.maximum(1 - prior, 1e-9)
                top = x.argmax(1)
                sure = x[np.arange(len(x)), top] >= level
                counts = np.bincount(np.array(doc)[sure] * k + top[sure], minlength=b.num_rows * k)
                at = np.flatnonzero(counts >= least)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at // k)), pa.array([areas[a] for a in (at % k).tolist()], pa.string()), pa.array(counts[at])], ["doc_id", "subject_area", "sentences"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, subject_area string, sentences long")


def subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """Subject areas of every document: averaged word and subword embeddings with independent logistic outputs.

    ``areas``: subject_area (a bounded list); ``labels``: doc_id, subject_area in any spelling; see ``fit``, ``score``.
    Labels of unknown areas or documents are ignored; without labels no document has an area.
    """
    names = sorted(r[0] for r in areas.select("subject_area").where("subject_area is not null").distinct().collect())
    known = areas.select(area_key(F.col("subject_area")).alias("_k"), F.col("subject_area").alias("area")).distinct()
    clean = labels.select("doc_id", area_key(F.col("subject_area")).alias("_l")).join(F.broadcast(known), F.col("_l") == F.col("_k")).select("doc_id", "area").distinct()
    return score(documents, *fit(documents, clean, names), names)


def p9_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_areas"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_areas(spark, sf_dir).select("doc_id", "subject_area")


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and sentences by area."""
    return p9_areas(spark, sf_dir).groupBy("subject_area").agg(F.count(F.lit(1)).alias("documents"), F.sum("sentences").alias("sentences"))


QUERIES = {"p9_found": p9_found, "p9_areas": p9_areas, "p9_composition": p9_composition}
SQL: dict[str, str] = {}
