"""Result rows arriving as a stream, merged into a stored ledger batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from helixframe.operators.ledger import upsert
from helixframe.sources import files


def versions(path: str) -> list[str]:
    """Folders of the versions of a ledger, oldest first."""
    return sorted(files.matches(f"{path}/v*"), key=lambda v: int(v.rsplit("/v", 1)[1]))


def current(path: str) -> str | None:
    """Folder of the newest complete version of a ledger."""
    done = [v for v in versions(path) if files.exists(f"{v}/_SUCCESS")]
    return done[-1] if done else None


def merge_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str, order: str = "ord", keep: int = 2) -> StreamingQuery:
    """LED2 on a stream: each micro-batch is upserted into a new version of the ledger; the last ``keep`` versions stay.

    A version is named for its batch, so a batch that is run again after a failure writes the same version anew from
    the one before it: the result is exactly once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        target = f"{path}/v{number}"
        files.delete(target)
        old = current(path)
        base = spark.read.parquet(old) if old else batch.limit(0)
        upsert(base, batch, keys, order).write.parquet(target)
        for v in versions(path)[:-keep]:
            files.delete(v)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
