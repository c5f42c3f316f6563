"""Problem 8: evaluation passages inside training documents."""

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
from helixframe.util import materialize, spread, table

#: Words of a passage, and of a shingle inside it.
PASSAGE, SHINGLE = 10, 5
#: Bits of the filter that spares the corpus the exchange of hashes no item has.
FILTER = 1 << 26
_WORD = regex.compile(r"[\p{L}\p{Nd}]+")
_FORMAT = regex.compile(r"\p{Cf}+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits after NFKC, without format characters, lower-cased."""
    if not text:
        return []
    if not text.isascii():
        text = _FORMAT.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.lower())


def passage_minima(texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; and text number, hash and word position of the MinHash of every passage (repeats folded).

    A passage of PASSAGE words is a set of PASSAGE - SHINGLE + 1 shingles; its MinHash is the least shingle hash.
    """
    seen: dict[str, int] = {}
    code = lambda w: seen.get(w) or seen.setdefault(w, xxhash.xxh64_intdigest(w) | 1)
    split = [words(t) for t in texts]
    n = np.array([len(s) for s in split])
    flat = np.fromiter((code(w) for s in split for w in s), np.uint64, int(n.sum()))
    rec = np.repeat(np.arange(len(split)), n)
    start = (np.cumsum(n) - n)[rec]
    m = len(flat) - PASSAGE + 1
    if m <= 0:
        return split, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(len(flat) - SHINGLE + 1, np.uint64)
    for j in range(SHINGLE):
        h = K.mix64(h + flat[j : j + len(h)])
    span = PASSAGE - SHINGLE + 1
    low, at = h[:m].copy(), np.arange(m)
    for j in range(1, span):
        less = h[j : j + m] < low
        low = np.where(less, h[j : j + m], low)
        at = np.where(less, np.arange(m) + j, at)
    inside = rec[:m] == rec[PASSAGE - 1 :]
    at = np.unique(at[inside])
    return split, rec[at], h[at], at - start[at]


def context(w: list[str], p: int) -> list[str]:
    """All passages whose MinHash may sit at word p lie in these words."""
    return w[max(0, p - (PASSAGE - SHINGLE)) : p + PASSAGE]


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents and items that have PASSAGE consecutive words in common: doc_id, item_id, passages, item_passages.

    ``documents``: doc_id, text; ``items``: item_id, text.
    Method: size-partitioned MinHash containment search. The part of an item that leaks may be far smaller than the
    item, so items are cut to their passages, the sets to be found; all sets of that one size form one partition, and
    documents are taken apart in windows of the partition's size, so that containment in a window is equality and one
    MinHash a window finds it without loss. Neighbouring windows mostly share their MinHash, so a document gives about
    two hashes in seven words. A filter of fixed size (8 MB) drops document hashes no item has before the exchange;
    the rest meets the items' hashes in a join, and every meeting is verified on the exact passages of both sides.

    ``passages``: different passages of the item found in the document; ``item_passages``: all the item has.
    Defined results: null and empty texts and texts under PASSAGE words leak nothing; a passage in two items counts for
    both; equal documents are each reported; null ids are kept as they are; empty tables give no rows.
    """
    spark = documents.sparkSession

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split, rec, h, at = passage_minima(b.column(1).to_pylist())
            n = np.array([len({tuple(w[i : i + PASSAGE]) for i in range(len(w) - PASSAGE + 1)}) for w in split], np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rec)), pa.array(h.view(np.int64)), pa.array([context(split[r], p) for r, p in zip(rec.tolist(), at.tolist())], pa.list_(pa.string())), pa.array(n[rec] if len(rec) else np.zeros(0, np.int64))],
                ["item_id", "h", "item_words", "item_passages"])

    wanted = materialize(items.select("item_id", "text").mapInArrow(of_items, "item_id long, h long, item_words array<string>, item_passages long"), "items")
    slots = wanted.select(F.pmod("h", F.lit(FILTER)).cast("int").alias("s")).groupBy(F.floor(F.col("s") / (FILTER // 64)).alias("c")).agg(F.collect_set("s").alias("s"))
    bits = np.zeros(FILTER, np.bool_)
    for r in slots.toLocalIterator():
        bits[np.array(r["s"], np.int64)] = True
    packed = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little"))

    def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = packed.value
        for big in batches:
            for i in range(0, big.num_rows, 2000):
                b = big.slice(i, 2000)
                split, rec, h, at = passage_minima(b.column(1).to_pylist())
                s = h.view(np.int64) % FILTER
                hit = (have[s >> 3] >> (s & 7).astype(np.uint8)) & 1 > 0
                rec, h, at = rec[hit], h[hit], at[hit]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rec)), pa.array(h.view(np.int64)), pa.array([context(split[r], p) for r, p in zip(rec.tolist(), at.tolist())], pa.list_(pa.string()))],
                    ["doc_id", "h2", "doc_words"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, i in zip(b.column("doc_words").to_pylist(), b.column("item_words").to_pylist()):
                pd = {tuple(d[k : k + PASSAGE]) for k in range(len(d) - PASSAGE + 1)}
                both = {tuple(i[k : k + PASSAGE]) for k in range(len(i) - PASSAGE + 1)} & pd
                out.append(sorted(" ".join(x) for x in both))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("item_id"), b.column("item_passages"), pa.array(out, pa.list_(pa.string()))], ["doc_id", "item_id", "item_passages", "p"])

    found = spread(documents.select("doc_id", "text")).mapInArrow(of_documents, "doc_id long, h2 long, doc_words array<string>")
    met = found.join(wanted, F.col("h") == F.col("h2")).select("doc_id", "item_id", "item_passages", "doc_words", "item_words")
    seen = met.mapInArrow(verify, "doc_id long, item_id long, item_passages long, p array<string>").select("doc_id", "item_id", "item_passages", F.explode("p").alias("p")).distinct()
    return seen.groupBy("doc_id", "item_id", "item_passages").agg(F.count(F.lit(1)).alias("passages")).select("doc_id", "item_id", "passages", "item_passages")


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items").select("item_id", F.col("item_text").alias("text")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each affected document with the items leaked and how much of each item it holds."""
    return _tables(spark, sf_dir).withColumn("containment", F.col("passages") / F.col("item_passages"))


QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks}
SQL: dict[str, str] = {}
