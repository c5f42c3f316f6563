"""Problem 7: token ids of every text by a public byte-level BPE."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from helixframe.util import spread, table

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the published pattern by which this vocabulary cuts texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces a task remembers; beyond that it starts afresh.
MEMORY = 500_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Rank, which is the id, of each token of a .tiktoken file."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a piece: the leftmost adjacent pair of lowest rank is merged until no pair has a rank.

    A segment tree holds the rank of each adjacent pair; its root is the lowest rank, the leftmost leaf with it is
    found by descent, and a merge changes three leaves: O(n log n) for a piece of n bytes, however long.
    """
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    none = 1 << 60
    get = ranks.get
    parts = [piece[i : i + 1] for i in range(n)]
    if n == 2:
        r = get(piece)
        return [r] if r is not None else [ranks[parts[0]], ranks[parts[1]]]
    width = 1 << (n - 2).bit_length()
    tree = [none] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = get(piece[i : i + 2], none)
    for x in range(width - 1, 0, -1):
        a, b = tree[2 * x], tree[2 * x + 1]
        tree[x] = a if a <= b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        x = width + i
        tree[x] = value
        x >>= 1
        while x:
            a, b = tree[2 * x], tree[2 * x + 1]
            low = a if a <= b else b
            if tree[x] == low:
                break
            tree[x] = low
            x >>= 1

    while tree[1] != none:
        low, x = tree[1], 1
        while x < width:
            x = 2 * x if tree[2 * x] == low else 2 * x + 1
        i = x - width
        j = after[i]
        parts[i] += parts[j]
        k = after[i] = after[j]
        if j < n - 1 or tree[width + min(j, n - 2)] != none:
            if j <= n - 2:
                put(j, none)
        if k < n:
            before[k] = i
            put(i, get(parts[i] + parts[k], none))
        else:
            put(i, none)
        p = before[i]
        if p >= 0:
            put(p, get(parts[p] + parts[i], none))
    out, i = [], 0
    while i < n:
        out.append(ranks[parts[i]])
        i = after[i]
    return out


class Encoder:
    """Texts to ids; pieces met before are remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.known, self.cut = ranks, {}, regex.compile(PATTERN).findall

    def piece(self, p: str) -> list[int]:
        data = p.encode("utf-8", "surrogatepass")
        one = self.ranks.get(data)
        ids = [one] if one is not None else merge(data, self.ranks)
        if len(self.known) >= MEMORY:
            self.known.clear()
        self.known[p] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            known, piece = self.known, self.piece
            for p in self.cut(text):
                out += known.get(p) or piece(p)
        return out


def encode_column(df: DataFrame, id_col: str, text_col: str, path: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """The id and ``ids`` (array<int>) of each text, without special tokens; their strings in a text are ordinary text.

    Method: the text is cut by the vocabulary's pattern, each piece merged with a segment tree over its adjacent pair
    ranks (``merge``). The vocabulary file is read on the driver and broadcast (under 1 MB). No shuffle, except where
    the input has fewer splits than there are cores.

    Defined results: null and empty texts give an empty list; blank texts the ids of their white space; repeated rows
    are encoded each; a null id is kept; an empty table gives no rows.
    """
    with open(f"{path}/{name}.tiktoken", "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(read_ranks(data.value))
        for big in batches:
            for i in range(0, big.num_rows, 1000):
                b = big.slice(i, 1000)
                ids = [enc.encode(t) for t in b.column(1).to_pylist()]
                n = np.array([len(x) for x in ids])
                flat = np.fromiter((y for x in ids for y in x), np.int32, int(n.sum()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat))], [id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p7_ids": p7_ids}
SQL: dict[str, str] = {}
