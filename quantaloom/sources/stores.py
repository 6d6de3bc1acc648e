"""Small stores: JSON documents on the driver, parquet caches in Spark's file systems."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .panel import Panel

RECORDS = "expression string, ic_mean double, ic_std double, icir double, max_correlation double, turnover double, logic_description string, admitted_at double, mining_round int, factor_id string"


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the folder that the cluster names in ``spark.checkpoint.dir``; of this machine where there is no cluster and no such setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def load_json(path: str | Path, default: Any) -> Any:
    """A JSON document; ``default`` if it is absent or broken."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return default


def save_json(path: str | Path, value: Any) -> None:
    """Write a JSON document in one step: readers see the old one or the new one."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=path.parent, suffix=".tmp")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
    os.replace(temp, path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Factor records of a JSON array as a table; unknown fields are dropped, absent ones null."""
    return spark.read.schema(RECORDS).option("multiLine", True).json(path)


def strongest(records: DataFrame, n: int) -> DataFrame:
    """The n records of largest absolute mean IC, ties by expression."""
    return records.orderBy(F.abs("ic_mean").desc(), "expression").limit(n)


def constituents(records: DataFrame, column: str = "code") -> DataFrame:
    """(code) of index members, as six digits."""
    return records.select(F.lpad(F.col(column).cast("string"), 6, "0").alias("code")).distinct()


def save_panel(panel: Panel, path: str) -> None:
    panel.df.write.mode("overwrite").parquet(path)


def load_panel(spark: SparkSession, path: str) -> Panel | None:
    """A saved panel; None if there is none."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return None
    last = df.agg(F.max("t")).first()[0]
    return Panel(df, 0 if last is None else last + 1)


def write_by_asset(bars: DataFrame, path: str) -> None:
    """Bars as parquet, one folder per asset."""
    bars.repartition("code").write.mode("overwrite").partitionBy("code").parquet(path)


def read_by_asset(spark: SparkSession, path: str) -> DataFrame:
    """Bars of ``write_by_asset``."""
    df = spark.read.option("recursiveFileLookup", "false").parquet(path)
    return df.withColumn("code", F.col("code").cast("string"))
