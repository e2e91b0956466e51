"""A corpus pipeline of five stages: quality, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last keep the columns of ``documents``.

Defined cases are those of the operators: null texts count as empty for every decision and stay null where a
stage keeps the row; rows that repeat an id count as one document for the near-duplicate stage; an empty
input gives an empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import decontam, packing, pii, quality, simhash
from lamella.llm.common import fold, stored, table, unused
from lamella.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more stay. The model learns from labelled documents of the input."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    name = unused("quality_score", docs.columns)
    return quality.scored_rows(docs, model, name).where(F.col(name) >= 0.3).drop(name)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the smallest id stays."""
    groups = simhash.similar(docs, shingle=5, similarity=0.8)
    kept_id = unused("kept_id", docs.columns)
    kept = groups.where("doc_id <=> component_id").select(F.col("doc_id").alias(kept_id)).distinct()
    return docs.join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(kept_id)), "left_semi")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.pack(packing.pieces(docs, tokenizer_path()), packing.Limits(4096))


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]

#: No stage but the redaction of base kinds is plain SQL; of the others near-duplicates are compared with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
