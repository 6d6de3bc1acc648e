"""Shared scratch space, lineage cuts and shuffle files that go when they have been read."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A row can be a block of megabytes, so that pages and row groups are measured at each few rows.
_CHECKS = {"parquet.page.size.row.check.min": "4", "parquet.block.size.row.check.min": "4", "parquet.block.size.row.check.max": "64"}


def _base(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where that setting is missing, in unit tests or on a laptop, a folder of this machine is used; executors on other machines would not
    see it, so that it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return base.rstrip("/")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{_base(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a DataFrame that is made and run here go as soon as its action is over; those of what it persists don't."""
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def materialize(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that outlives executors.  Its shuffle files are deleted as soon as it is written."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, label)
    with dropping_shuffles(spark):
        df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_blocks(df: DataFrame, label: str) -> DataFrame:
    return materialize(df, label, _CHECKS)


def free(*tables: DataFrame) -> None:
    """Empty tables of ``materialize`` whose last reader is done."""
    for t in tables:
        base = _base(t.sparkSession).rpartition(":")[2].rstrip("/")
        for path in {f.rpartition("/")[0] for f in t.inputFiles()}:
            if base not in path:
                raise ValueError(f"{path} is no scratch table")
            t.sparkSession.range(0).coalesce(1).write.mode("overwrite").parquet(path)
