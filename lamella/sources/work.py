"""The folder that driver and executors share, and tables settled in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only in local mode may it be a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lamella-index-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def settled(rows: DataFrame, label: str) -> DataFrame:
    """Written there as Parquet and read back: computed once, without lineage, and there for every executor."""
    path = f"{work_dir(rows.sparkSession)}/{label}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
