"""What driver and executors share: a folder, and the disk that shuffles take."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset, as in tests, a temporary folder of a local session."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Spark's setting that has the shuffle files of a query removed when it ends, and not when the driver next clears its memory.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(*sessions: SparkSession) -> Iterator[None]:
    """Queries that start meanwhile leave no shuffle files behind. One that is run again makes them again."""
    before = [(s, s.conf.get(_RELEASE, "false")) for s in sessions]
    for s in sessions:
        s.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        for s, value in before:
            s.conf.set(_RELEASE, value)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
