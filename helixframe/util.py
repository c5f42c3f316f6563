"""Small helpers shared by all operators: table access, shared storage, text normal forms."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors reach: ``spark.checkpoint.dir``, or a temporary one where that is unset (tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="helixframe-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialize`` that nothing reads any more."""
    path = getattr(df, "_helix_path", None)
    if path:
        _remove(df.sparkSession, path)


def _cleanup() -> None:
    for spark, path in _WRITTEN:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass


atexit.register(_cleanup)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed at the end of the session."""
    path = f"{shared_dir(spark)}/helixframe/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back, so that a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._helix_path = path
    return out


def residues(c: Column | str) -> Column:
    """Letters A-Z of a sequence, upper-cased, in order; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.upper(F.regexp_replace(c, "[^A-Za-z]", ""))


def strip(c: Column | str) -> Column:
    """Remove white space of every kind at both ends."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def family_key(c: Column | str) -> Column:
    """Trimmed, upper-cased accession without its version (everything from the first dot)."""
    return F.substring_index(F.upper(strip(c)), ".", 1)


def parallelism(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as there are cores, for work in Python on inputs of few splits."""
    n = parallelism(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)
