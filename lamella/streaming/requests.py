"""Requests as a stream: each micro-batch goes through the whole chain against a kept index and is remembered once.

A batch writes its answers and its messages to folders of its own number, replacing what an interrupted attempt left there, and
reads the memory of smaller numbers only. Run again after a failure it therefore sees the same memory and writes the same
rows: each request is answered and remembered exactly once. Messages lie by session bucket, so a batch reads the buckets of
its own sessions. Requests of one session in one batch see the memory before the batch and are numbered by ``query_id``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import chain, dialogue
from ..plans.index import Index
from ..sources import index_store

BUCKETS = 64
MESSAGES = "session_id {0}, seq long, role string, content string"


def _bucket():
    return F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int")


def memory(spark: SparkSession, path: str, session_type: str = "string", before: int | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """``session_id, seq, role, content`` of all batches, or of those before a number; with ``sessions`` only theirs."""
    if not index_store.exists(spark, f"{path}/memory"):
        return spark.createDataFrame([], MESSAGES.format(session_type))
    rows = spark.read.schema(f"{MESSAGES.format(session_type)}, batch long, bucket int").parquet(f"{path}/memory")
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    if sessions is not None:
        own = sessions.select("session_id").distinct()
        rows = rows.where(F.col("bucket").isin([r[0] for r in own.select(_bucket()).distinct().collect()])).join(own, "session_id", "left_semi")
    return rows.drop("batch", "bucket")


def answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/answers")


def batch_answered(held: Index, path: str, **options) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls; ``options`` are those of ``chain.answered``."""

    def run(requests: DataFrame, number: int) -> None:
        spark = requests.sparkSession
        kind = requests.schema["session_id"].dataType.simpleString()
        if requests.isEmpty():
            return
        known = memory(spark, path, kind, number, requests)
        told = f"{path}/answers/batch={number}"
        chain.answered(held, requests, known, **options).write.mode("overwrite").parquet(told)
        # messages are made of the answers that were written, not of answers computed again
        done = spark.read.parquet(told)
        added = dialogue.appended(known, done, done).withColumn("bucket", _bucket())
        added.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/memory/batch={number}")

    return run


def serve(requests: DataFrame, held: Index, path: str, checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Answer a stream of ``query_id, session_id, query``; answers and memory are kept under ``path``."""
    writer = requests.writeStream.foreachBatch(batch_answered(held, path, **options)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
