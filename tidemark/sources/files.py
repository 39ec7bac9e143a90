"""Folders and files through the session's own file systems, whatever the address: what the driver has to see or remove."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: How tables and logs are compressed: hashes in hex take about half the room that they have with snappy.
CODEC = {"compression": "zstd"}


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _at(spark, path)
    return system.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """A file, or a folder with all it has; nothing happens if it is gone."""
    where, system = _at(spark, path)
    system.delete(where, True)


def listed(spark: SparkSession, path: str, suffix: str = "") -> list[str]:
    """The files below a folder whose names end so; none if there is no folder."""
    where, system = _at(spark, path)
    if not system.exists(where):
        return []
    found, every = [], system.listFiles(where, True)
    while every.hasNext():
        at = every.next().getPath().toString()
        if at.endswith(suffix):
            found.append(at)
    return sorted(found)


def size(spark: SparkSession, path: str) -> int:
    """The bytes of a file or of all files of a folder."""
    where, system = _at(spark, path)
    return system.getContentSummary(where).getLength()


def move(spark: SparkSession, path: str, to: str, millis: int) -> None:
    """Renames a file, and gives it a time of change where the file system keeps that apart; a folder that lacks is made."""
    (old, system), new = _at(spark, path), _at(spark, to)[0]
    system.mkdirs(new.getParent())
    if not system.rename(old, new):
        raise OSError(f"{path} could not be renamed to {to}")
    system.setTimes(new, millis, -1)


def changed(spark: SparkSession, path: str) -> int:
    where, system = _at(spark, path)
    return system.getFileStatus(where).getModificationTime()


def signature(spark: SparkSession, path: str) -> str:
    """The sizes and times of a file or of the files of a folder."""
    where, system = _at(spark, path)
    status, parts = system.getFileStatus(where), []
    for f in system.listStatus(where) if status.isDirectory() else [status]:
        parts.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return ", ".join(sorted(parts))
