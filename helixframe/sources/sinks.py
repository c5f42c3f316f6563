"""Writers: sorted Parquet, CSV, FASTA, Markdown, and outputs that are made only once."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.ledger import markdown, rounded, upsert
from helixframe.sources import files
from helixframe.sources.readers import results


def sorted_parquet(df: DataFrame, path: str, keys: list[str], files: int | None = None) -> None:
    """SNK1: range-partitioned by the keys and sorted inside each file; file order is the global order."""
    cols = [F.col(k).asc_nulls_last() for k in keys]
    parted = df.repartitionByRange(files, *cols) if files else df.repartitionByRange(*cols)
    parted.sortWithinPartitions(*cols).write.mode("overwrite").parquet(path)


def parquet(df: DataFrame, path: str) -> None:
    """SNK2."""
    df.write.mode("overwrite").parquet(path)


def csv(df: DataFrame, path: str, digits: int = 5) -> None:
    """SNK3: CSV with a header, floating columns rounded."""
    rounded(df, digits).write.mode("overwrite").option("header", True).csv(path)


def append_rows(df: DataFrame, path: str) -> None:
    """SNK4: rows appended to a directory table; each file has its header, so none is doubled."""
    df.write.mode("append").option("header", True).csv(path)


def fasta(df: DataFrame, path: str, key: str, seq: str) -> None:
    """SNK6: one record a row; null and empty sequences are left out."""
    df.where(F.col(seq).isNotNull() & (F.col(seq) != "")).select(F.concat(F.lit(">"), F.col(key).cast("string"), F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)


def report(df: DataFrame, path: str) -> None:
    """SNK8: a small result as .csv or .md by extension; any other extension is an error."""
    if path.endswith(".md"):
        files.write_text(path, markdown(df) + "\n")
    elif path.endswith(".csv"):
        csv(df.coalesce(1), path)
    else:
        raise ValueError(f"unknown kind of output: {path}")


def save_ledger(new: DataFrame, path: str, keys: list[str], numbers: list[str], order: str = "ord") -> str:
    """SNK5: new rows merged into the ledger at ``path`` (a CSV folder), the last row of a key kept; the path written.

    The merged ledger is written beside the old one, which it then replaces. A ledger that cannot be read, or lacks the
    keys, is left as it is: the new rows go to ``path`` with the ending ``.recovery``.
    """
    out = rounded(new)
    if files.exists(path):
        try:
            old = results(new.sparkSession, path, numbers)
            if not set(keys) <= set(old.columns):
                raise ValueError(f"no ledger: {path}")
            out = rounded(upsert(old.select(*keys, *[c for c in old.columns if c not in keys]), new, keys, order))
        except Exception:  # noqa: BLE001 - whatever is wrong with the old file, the new rows must not be lost
            out, path = rounded(new), path.rstrip("/") + ".recovery"
    made = path.rstrip("/") + ".new"
    out.write.mode("overwrite").option("header", True).csv(made)
    files.delete(path)
    files.move(made, path)
    return path


def once(path: str, settings: dict, make: Callable[[], None], force: bool = False, inputs: list[str] | None = None) -> bool:
    """SNK10: run ``make`` unless the output stands and was made under equal settings and inputs; True when it ran.

    A sidecar next to the output keeps the settings and a signature of the inputs (size and time of change).
    """
    seen = [[p, *files.stamp(p)] for p in sorted(inputs or [])]
    mark = hashlib.sha256(json.dumps([settings, seen], sort_keys=True).encode()).hexdigest()
    side = path.rstrip("/") + ".meta.json"
    if not force and files.exists(path) and files.exists(side) and json.loads(files.read_text(side)).get("mark") == mark:
        return False
    make()
    files.write_text(side, json.dumps({"mark": mark, "settings": settings}, sort_keys=True))
    return True
