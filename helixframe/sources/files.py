"""Files through Hadoop's file system: the same calls for the local disk, HDFS and object stores."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(path: str):
    spark = SparkSession.active()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(path: str) -> bool:
    fs, p = _at(path)
    return fs.exists(p)


def is_folder(path: str) -> bool:
    fs, p = _at(path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def matches(pattern: str) -> list[str]:
    """Sorted paths that fit a pattern; paths without a scheme come back without one."""
    fs, p = _at(pattern)
    found = [x.getPath() for x in fs.globStatus(p) or []]
    return sorted(x.toString() if ":" in pattern.split("/")[0] else x.toUri().getPath() for x in found)


def stamp(path: str) -> tuple[int, int]:
    """Bytes (of all files below a folder) and time of change in milliseconds."""
    fs, p = _at(path)
    return fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()


def read_text(path: str) -> str:
    fs, p = _at(path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    fs, p = _at(path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def delete(path: str) -> None:
    fs, p = _at(path)
    fs.delete(p, True)


def move(path: str, to: str) -> None:
    fs, p = _at(path)
    if not fs.rename(p, fs.makeQualified(_at(to)[1])):
        raise OSError(f"cannot move {path} to {to}")


def touch(path: str, at: int) -> None:
    """Set the time of change, in milliseconds."""
    fs, p = _at(path)
    fs.setTimes(p, at, -1)
