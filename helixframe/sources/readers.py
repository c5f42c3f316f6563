"""Readers: Parquet shards, headerless tables, FASTA, link lists, profile libraries, result files."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.sources import files

AMINO = "ACDEFGHIKLMNPQRSTVWY"
# Background frequencies of the residues in the order above, as published with HMMER 3.
BACKGROUND = (
    0.0787945, 0.0151600, 0.0535222, 0.0668298, 0.0397062, 0.0695071, 0.0229198, 0.0590092, 0.0594422, 0.0963728,
    0.0237718, 0.0414386, 0.0482904, 0.0395639, 0.0540978, 0.0683364, 0.0540687, 0.0673417, 0.0114135, 0.0304133,
)


def shards(spark: SparkSession, paths: list[str], columns: dict[str, str]) -> DataFrame:
    """SRC1: Parquet shards with projection and alias (new name -> column); reading stops before the first missing shard."""
    have = []
    for p in paths:
        if not files.exists(p):
            break
        have.append(p)
    if not have:
        raise FileNotFoundError(f"no shard of {paths}")
    return spark.read.parquet(*have).select(*[F.col(c).alias(n) for n, c in columns.items()])


def tree(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: all Parquet files below a folder."""
    return spark.read.option("recursiveFileLookup", True).parquet(path)


def headerless(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, sep: str = "\t") -> DataFrame:
    """SRC4: headerless separated text (gzip by extension) under a stated schema, projected early."""
    df = spark.read.schema(schema).option("sep", sep).option("quote", "").csv(path)
    return df.select(*columns) if columns else df


def structural_map(spark: SparkSession, path: str, flags: tuple[int, ...]) -> DataFrame:
    """SRC3: representative, entry and flag of a headerless map; flags that are no small number are null and so dropped."""
    raw = headerless(spark, path, "foldseek_rep string, entry_id string, clu_flag string, tax_id string")
    flag = F.col("clu_flag").try_cast("tinyint")
    return raw.select("foldseek_rep", "entry_id", flag.alias("clu_flag")).where(F.col("clu_flag").isin(*flags))


def links(spark: SparkSession, path: str, least: int) -> DataFrame:
    """SRC8: protein1, protein2, combined_score of a blank-separated list with a header; last field is the score."""
    raw = spark.read.text(path)
    f = F.split(F.trim("value"), r"\s+")
    rows = raw.where(F.size(f) >= 3).select(f[0].alias("protein1"), f[1].alias("protein2"), F.element_at(f, -1).try_cast("int").alias("combined_score"))
    return rows.where(F.col("combined_score") >= least)


def _residue_text(lines: Column) -> Column:
    """Sequence lines joined without white space."""
    return F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), ""), r"\s+", "")


def parse_fasta(df: DataFrame, record: str = "value", family: bool = False) -> DataFrame:
    """SRC5 / SRC6: records (one FASTA entry a row, with or without its '>') to id and sequence.

    With ``family``: domain_id, family_id (third token of the header, else the second; what follows ';' or '.' cut off)
    and sequence; headers of one token give no row. Records are cut apart before they are parsed, so a malformed header
    can never leak residues into the next. Empty sequences are dropped.
    """
    lines = F.split(F.regexp_replace(F.col(record), r"^>", ""), r"\r?\n")
    parts = df.select(F.split(F.trim(lines[0]), r"\s+").alias("_h"), _residue_text(lines).alias("sequence")).where("sequence <> ''")
    if not family:
        return parts.select(F.col("_h")[0].alias("id"), "sequence").where("id <> ''")
    token = F.when(F.size("_h") >= 3, F.get("_h", F.lit(2))).otherwise(F.get("_h", F.lit(1)))
    fam = F.substring_index(F.substring_index(token, ";", 1), ".", 1)
    return parts.where(F.size("_h") >= 2).select(F.col("_h")[0].alias("domain_id"), fam.alias("family_id"), "sequence")


def fasta(spark: SparkSession, path: str, family: bool = False, cap: int = 0) -> DataFrame:
    """SRC5 / SRC6: FASTA file, cut at record starts by the reader, so a plain file splits over tasks. ``cap`` > 0: so many rows."""
    df = parse_fasta(spark.read.option("lineSep", "\n>").text(path), family=family)
    return df.limit(cap) if cap > 0 else df


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: profile library (HMMER 3 text) to family_id, pos (0-based), aa, log_odds (log2 of emission over background)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fam, pos, aa, odds = [], [], [], []
            for text in b.column(0).to_pylist():
                acc, order, at = None, None, 0
                for line in (text or "").splitlines():
                    t = line.split()
                    if not t:
                        continue
                    if t[0] == "ACC":
                        acc = t[1].split(".")[0]
                    elif t[0] == "HMM" and len(t) > 20:
                        order, at = t[1:21], 0
                    elif order and acc and t[0] == str(at + 1) and len(t) > 20:
                        for a, x in zip(order, t[1:21]):
                            p = 1e-9 if x == "*" else max(math.exp(-float(x)), 1e-9)
                            fam.append(acc)
                            pos.append(at)
                            aa.append(a)
                            odds.append(math.log2(p) - math.log2(BACKGROUND[AMINO.index(a)]))
                        at += 1
            yield pa.RecordBatch.from_arrays([pa.array(fam, pa.string()), pa.array(pos, pa.int32()), pa.array(aa, pa.string()), pa.array(odds, pa.float64())], ["family_id", "pos", "aa", "log_odds"])

    return spark.read.option("lineSep", "\n//").text(path).mapInArrow(parse, "family_id string, pos int, aa string, log_odds double")


def first_existing(candidates: list[str]) -> str:
    """SRC10 / SRC11: the first of several places that exists; the error names all."""
    for c in candidates:
        if files.exists(c):
            return c
    raise FileNotFoundError("none of: " + ", ".join(candidates))


def first_loaded(loaders: list[Callable[[], DataFrame]]) -> DataFrame:
    """SRC11: the table of the first loader that works (saved folder, named set, second try); the error names all."""
    errors = []
    for load in loaders:
        try:
            df = load()
            df.schema  # noqa: B018 - a missing path shows here at the latest
            return df
        except Exception as e:  # noqa: BLE001 - every kind of failure means the next place
            errors.append(str(e).split("\n")[0])
    raise FileNotFoundError("nothing could be loaded: " + " | ".join(errors))


def expand_paths(names: list[str], data_dir: str) -> list[str]:
    """SRC18: folders become their sorted Parquet files, patterns their matches, other names are tried below ``data_dir``.

    All names that lead nowhere are collected before the error is raised; a folder without Parquet files is an error.
    """
    out, bad = [], []
    for f in names:
        found: list[str] = []
        for p in (f, f"{data_dir.rstrip('/')}/{f}" if data_dir else f):
            found = files.matches(f"{p.rstrip('/')}/*.parquet") if files.is_folder(p) else files.matches(p)
            if found:
                break
        out += found
        if not found:
            bad.append(f)
    if bad:
        raise FileNotFoundError("nothing found for: " + ", ".join(bad))
    return out


def latest_result(name: str, output_dir: str) -> str | None:
    """SRC19: a CSV file by its path, else the newest in a folder, else the newest below ``output_dir`` named for a model."""
    if files.exists(name):
        if not files.is_folder(name):
            return name
        found = files.matches(f"{name.rstrip('/')}/*.csv")
    else:
        safe = name.replace("/", "_").replace("\\", "_")
        found = [p for pattern in (f"{safe}.csv", f"*{safe}*.csv") for p in files.matches(f"{output_dir.rstrip('/')}/{pattern}")]
    return max(found, key=lambda p: (files.stamp(p)[1], p)) if found else None


def results(spark: SparkSession, paths: str | list[str], numbers: list[str]) -> DataFrame:
    """SRC12 / SRC13: result CSV files under the union of their columns; named columns as numbers, blank or odd text as null."""
    out = None
    for p in [paths] if isinstance(paths, str) else paths:
        df = spark.read.option("header", True).csv(p)
        df = df.select(*[F.when(F.trim(F.col(f"`{c}`")) != "", F.col(f"`{c}`")).try_cast("double").alias(c) if c in numbers else F.col(f"`{c}`") for c in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """SRC14: column names, from the footer."""
    return spark.read.parquet(path).schema.fieldNames()


def is_pair_table(spark: SparkSession, path: str) -> bool:
    """A file is a pair table when it has both sequence columns."""
    return {"seq1", "seq2"} <= set(columns_of(spark, path))


def row_count(df: DataFrame) -> int:
    """SRC15: rows; a scan of no columns, answered from the footers."""
    return df.select().count()
