"""Retrieval quality of ranked, judged hits (``query_id, rank, relevant``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_query(judged: DataFrame, k: int = 10, total: DataFrame | None = None) -> DataFrame:
    """P@k, recall@k, reciprocal rank and NDCG@k. ``total`` (``query_id, n_relevant``) has all relevant documents;
    without it those among the hits count."""
    rel = F.col("relevant").cast("int")
    within = F.when(F.col("rank") <= k, rel).otherwise(0)
    rows = judged.groupBy("query_id").agg(
        F.sum(within).alias("hit"), F.sum(rel).alias("all_hit"), F.min(F.when(rel == 1, F.col("rank"))).alias("first"), F.sum(within / F.log2(F.col("rank") + 1)).alias("dcg")
    )
    rows = rows.join(total, "query_id", "left").withColumn("n", F.coalesce("n_relevant", F.lit(0))) if total is not None else rows.withColumn("n", F.col("all_hit"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n"), F.lit(k)), F.lit(1))), F.lit(0.0), lambda z, i: z + 1 / F.log2(i + 1))
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return rows.select("query_id", r(F.col("hit") / k).alias("precision"), r(F.col("hit") / F.nullif(F.col("n"), F.lit(0))).alias("recall"), r(1 / F.col("first")).alias("reciprocal_rank"), r(F.when(F.col("n") > 0, F.col("dcg") / ideal)).alias("ndcg"))
