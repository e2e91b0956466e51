"""An index that takes changes: documents are upserted and deleted, and every state that was committed stays readable.

A commit adds a segment: the changed documents, their chunks and counted terms, the ids whose earlier rows it replaces, and what
it adds to and takes from document frequencies and lengths, signed. A manifest lists the segments of a version and is written last,
under a name that must not exist, so a reader sees all of a commit or nothing, and of two writers the second fails and can
try again. A version is a manifest: snapshots copy nothing. ``compacted`` writes a version's rows as one segment.

Documents whose cleaned text has not changed (by SHA-256) are left alone. Chunks are replaced by document, so no orphan stays. Reading joins
rows to the replaced ids of later segments, which is one shuffle of ids; statistics are sums over the segments' deltas.

Defined cases: rows with a null id are left out, since nothing could replace them; of repeated ids in one batch the greatest
``version`` wins, then the greatest text; a null text is an empty document; deleting an unknown id does nothing; a batch that changes
nothing commits nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import clean_text, tokens
from ..operators import bm25
from .index import Embedder, Index, Tokeniser, hashed, prepared


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Version:
    """What a manifest holds: its number, its segments with the sequence numbers of their commits, and the chunks' schema, which the
    folders of a segment without chunks don't tell."""

    number: int = 0
    segments: list[tuple[int, str]] = field(default_factory=list)
    chunk_schema: str = ""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _name(path: str, number: int) -> str:
    return f"{path}/manifests/{number:012d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all committed versions, in order."""
    p, fs = _fs(spark, f"{path}/manifests")
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[:12]) for n in names if n.endswith(".json") and not n.startswith("."))


def manifest(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """A version, by default the last; an index without any has version 0."""
    if number is None:
        number = max(versions(spark, path), default=0)
    if number == 0:
        return Version()
    p, fs = _fs(spark, _name(path, number))
    stream = fs.open(p)
    told = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    stream.close()
    return Version(told["number"], [tuple(s) for s in told["segments"]], told["chunk_schema"])


def commit(spark: SparkSession, path: str, version: Version) -> Version:
    """Write a manifest under its number, or fail if that is taken."""
    held, fs = _fs(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(held, False)
    out.write(bytearray(json.dumps(asdict(version)).encode()))
    out.close()
    target, _ = _fs(spark, _name(path, version.number))
    if fs.exists(target) or not fs.rename(held, target):
        fs.delete(held, False)
        raise Conflict(f"version {version.number} is there already")
    return version


def _table(spark: SparkSession, path: str, version: Version, name: str) -> DataFrame | None:
    """The rows of a table in all segments of a version, with ``seq``."""
    out = None
    for seq, segment in version.segments:
        reader = spark.read.schema(StructType.fromJson(json.loads(version.chunk_schema))) if name == "chunks" else spark.read
        rows = reader.parquet(f"{path}/segments/{segment}/{name}").withColumn("seq", F.lit(seq))
        out = rows if out is None else out.unionByName(rows)
    return out


def _live(spark: SparkSession, path: str, version: Version, name: str) -> DataFrame:
    """The rows that no later segment has replaced."""
    rows, gone = _table(spark, path, version, name), _table(spark, path, version, "gone")
    if len(version.segments) > 1:
        last = gone.groupBy(F.col("doc_id").alias("gone_id")).agg(F.max("seq").alias("gone_seq"))
        rows = rows.join(last, (F.col("doc_id") == F.col("gone_id")) & (F.col("seq") < F.col("gone_seq")), "left_anti")
    return rows.drop("seq")


def _stats(counted: DataFrame, sign: int) -> tuple[DataFrame, DataFrame]:
    """Signed document frequencies and totals of counted chunks."""
    terms = counted.select(F.explode("terms").alias("term")).groupBy("term").agg((sign * F.count("*")).alias("df"))
    return terms, counted.agg((sign * F.count("*")).alias("chunks"), (sign * F.coalesce(F.sum("length"), F.lit(0))).cast("long").alias("length"))


def _write(path: str, segment: str, described: DataFrame, chunks: DataFrame, gone: DataFrame, replaced: DataFrame | None, tokenise: Tokeniser) -> None:
    base = f"{path}/segments/{segment}"
    spark = described.sparkSession
    described.withColumn("hash", F.sha2("text", 256)).write.parquet(f"{base}/documents")
    chunks.write.partitionBy("hierarchy_level").parquet(f"{base}/chunks")
    own = spark.read.schema(chunks.schema).parquet(f"{base}/chunks").select(F.col("chunk_id"), F.col("doc_id").alias("document_id"), "hierarchy_level", "text")
    toks = bm25.tokenised(own, "chunk_id", keep=["hierarchy_level", "document_id"], tokenise=tokenise)
    bm25.counted(toks).select(F.col("doc_id").alias("chunk_id"), "length", "terms", "tfs", "hierarchy_level", F.col("document_id").alias("doc_id")).write.parquet(f"{base}/counted")
    gone.select("doc_id").write.parquet(f"{base}/gone")
    terms, totals = _stats(spark.read.parquet(f"{base}/counted"), 1)
    if replaced is not None:
        less, minus = _stats(replaced, -1)
        terms = terms.unionByName(less).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        totals = totals.unionByName(minus)
    terms.write.parquet(f"{base}/terms")
    totals.write.parquet(f"{base}/totals")


def upsert(
    docs: DataFrame, path: str, deleted: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", version_col: str | None = None,
    embed: Embedder = hashed, levels: int = 3, tokenise: Tokeniser = tokens,
) -> Version:
    """Commit new and changed documents of ``docs`` and the removal of ``deleted`` (``doc_id``) on top of the last version; an id in
    both is deleted. The embedder, levels and tokeniser must be those of the segments before."""
    spark = docs.sparkSession
    before = manifest(spark, path)
    order = F.struct(*([F.col(version_col)] if version_col else []), F.coalesce(F.col(text_col), F.lit("")))
    named = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max_by(F.coalesce(F.col(text_col), F.lit("")), order).alias("text"))
    if deleted is not None:
        removed = deleted.select(F.col("doc_id")).where("doc_id IS NOT NULL").distinct()
        named = named.join(removed, "doc_id", "left_anti")
    held = _live(spark, path, before, "documents").select(F.col("doc_id").alias("held_id"), F.col("hash").alias("held_hash")) if before.segments else None
    if held is not None:
        met = named.join(held, F.col("doc_id") == F.col("held_id"), "left")
        named = met.where(~F.sha2(clean_text(F.col("text")), 256).eqNullSafe(F.col("held_hash"))).select("doc_id", "text", F.col("held_id").isNotNull().alias("known"))
    else:
        named = named.withColumn("known", F.lit(False))
    segment = uuid.uuid4().hex
    base = f"{path}/segments/{segment}"
    named.write.parquet(f"{base}/incoming")
    incoming = spark.read.parquet(f"{base}/incoming")
    gone = incoming.where("known").select("doc_id")
    if deleted is not None and held is not None:
        gone = gone.unionByName(removed.join(held.select(F.col("held_id").alias("doc_id")), "doc_id", "left_semi"))
    if incoming.isEmpty() and gone.isEmpty():
        return before
    described, chunks = prepared(incoming, embed=embed, levels=levels)
    replaced = _live(spark, path, before, "counted").join(gone, "doc_id", "left_semi") if before.segments else None
    _write(path, segment, described, chunks, gone, replaced, tokenise)
    number = before.number + 1
    return commit(spark, path, Version(number, [*before.segments, (number, segment)], chunks.schema.json()))


def compacted(spark: SparkSession, path: str) -> Version:
    """Commit the last version's rows as one segment; earlier versions stay as they are."""
    before = manifest(spark, path)
    if len(before.segments) < 2:
        return before
    segment = uuid.uuid4().hex
    base = f"{path}/segments/{segment}"
    for name in ("documents", "counted"):
        _live(spark, path, before, name).write.parquet(f"{base}/{name}")
    _live(spark, path, before, "chunks").write.partitionBy("hierarchy_level").parquet(f"{base}/chunks")
    _live(spark, path, before, "documents").where("false").select("doc_id").write.parquet(f"{base}/gone")
    terms, totals = _stats(spark.read.parquet(f"{base}/counted"), 1)
    terms.write.parquet(f"{base}/terms")
    totals.write.parquet(f"{base}/totals")
    number = before.number + 1
    return commit(spark, path, Version(number, [(number, segment)], before.chunk_schema))


def opened(spark: SparkSession, path: str, number: int | None = None, tokenise: Tokeniser = tokens) -> Index:
    """The index as a version has it, for ``index.retrieve`` and all that follows."""
    version = manifest(spark, path, number)
    if not version.segments:
        raise ValueError(f"no version of an index at {path}")
    totals = _table(spark, path, version, "totals").agg(F.sum("chunks").alias("n"), F.sum("length").alias("length")).first()
    n, length = totals["n"] or 0, totals["length"] or 0
    df = _table(spark, path, version, "terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    terms = bm25.term_ids(df.withColumn("idf", bm25.idf(F.lit(n), F.col("df"))))
    counted = _live(spark, path, version, "counted").drop("doc_id").withColumnRenamed("chunk_id", "doc_id")
    model = bm25.Model(counted, terms, n, length / n if n else 0.0)
    return Index(_live(spark, path, version, "documents").drop("hash"), _live(spark, path, version, "chunks"), model, tokenise)
