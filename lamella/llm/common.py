"""Helpers shared by the training-data operators: tables, the shared work folder, Arrow glue."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only in local mode without the setting (tests) is a temporary folder chosen, and then it is also made the
    session's checkpoint folder; on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lamella-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and survives
    lost executors, because every executor can read the files again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Delete a table that ``stored`` wrote and nothing reads any more."""
    jvm = table.sparkSession._jvm
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(rows: DataFrame, small: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``small``, which has one row for each key and the number ``n`` of rows with it.

    A key with more than a 500th of all ``total`` rows (and over 1,000) would fill one task of the join's exchange; there are
    at most 500 of those, and they are broadcast. ``how`` is inner or left.
    """
    hot = small.where(F.col(n) > max(1000, total // 500))
    first = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return first.unionByName(rest.join(small.where(F.col(n) <= max(1000, total // 500)), key, how))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, raw)``: whole texts as UTF-8 bytes, null as empty. Other columns are left behind,
    so that none can clash with what an operator adds."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("raw"))


def unused(name: str, taken: list[str]) -> str:
    """A column name that no column of ``taken`` has, whatever the case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def fold(id_col: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % k


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """A mapInArrow function from a function of one record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return run
