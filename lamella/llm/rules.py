"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document and leaves one failure bit and its measurements in a
ledger. A policy is a versioned mask over those bits: applying another policy, or asking what a rule
contributes, reads the ledger only and never a text again.

Defined cases: a null text counts as empty (no words: it fails ``too_few_words``); a null or repeated id
is kept as it is, one ledger row for each input row; an empty table gives an empty ledger; other columns
of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_batch, texts
from .textstats import measure_all

LEDGER_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_upper long, n_lower long, n_pipe long, top_count long"
)
_MEASURES = [x.split()[0] for x in LEDGER_SCHEMA.split(", ")]


@dataclass(frozen=True)
class Rule:
    """``failed`` is a Boolean SQL expression over the measurements; bit is its place in the mask."""

    bit: int
    name: str
    failed: str


#: Integer arithmetic only, so that every engine decides alike. The order is the bit order and never changes.
RULES = tuple(
    Rule(i, name, sql)
    for i, (name, sql) in enumerate(
        [
            ("too_few_words", "n_words < 50"),
            ("repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
            ("symbols", "10 * n_symbols > 2 * n_words AND n_words > 0"),
            ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
            ("shouting", "100 * n_upper > 40 * (n_upper + n_lower)"),
            ("one_word", "100 * top_count > 25 * n_words AND n_words >= 20"),
            ("long_words", "word_chars > 15 * n_words"),
            ("table_debris", "10 * n_pipe > 2 * n_words AND n_words > 0"),
        ]
    )
)


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject; bits outside the mask are recorded but don't count."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[name] for name in self.rules)


BASE = Policy("base-1", ("too_few_words", "repeated_trigrams"))
STANDARD = Policy("standard-1", tuple(r.name for r in RULES))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: measurements and ``fail_bits`` (bit i: rule i failed)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = measure_all(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[k]) for k in _MEASURES)], ["doc_id", *_MEASURES])

    source = texts(docs, id_col, text_col)
    measured = source.mapInArrow(per_batch(run), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {LEDGER_SCHEMA}")
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.failed), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("fail_bits", bits)


def rejected(policy: Policy, bits: str | Column = "fail_bits") -> Column:
    c = F.col(bits) if isinstance(bits, str) else bits
    return c.bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def ablations(led: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents failing it, failing it alone, and kept if it were left out.

    The ledger is first aggregated by its bit pattern (2^rules rows at most), so one shuffle of a few
    rows answers every ablation.
    """
    patterns = led.select(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in policy.rules)))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return (
        patterns.select("bits", "n", rules.alias("r"))
        .select("bits", "n", "r.rule", "r.bit")
        .groupBy("rule")
        .agg(
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("bit")), F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
        .withColumn("policy", F.lit(policy.version))
    )
