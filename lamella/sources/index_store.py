"""Index tables at rest: partitioned Parquet, upserts, JSON dumps, versioned snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def create(spark: SparkSession, path: str, table: DataFrame, recreate: bool = True) -> bool:
    """Write a collection; with ``recreate`` off an existing one stays as it is. Whether it was written."""
    if not recreate and exists(spark, path):
        return False
    table.write.mode("overwrite").parquet(path)
    return True


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a collection; false if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def by_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Points whose ``key`` is among the ids; missing ones are left out."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """By level, so that a level filter of either retrieval leg prunes partitions."""
    chunks.write.mode("overwrite").partitionBy("hierarchy_level").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def upsert(existing: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """Latest wins, as an aggregate that combines before the shuffle: no window, no sort of hot keys."""
    cols = [c for c in existing.columns if c != key]
    both = existing.unionByName(incoming)
    latest = F.max_by(F.struct(*cols), F.struct(F.col(version), F.struct(*cols))).alias("row")
    return both.groupBy(key).agg(latest).select(key, *(F.col(f"row.{c}").alias(c) for c in cols)).select(existing.columns)


def export_json(table: DataFrame, path: str, name: str, vector_col: str | None = None, distance: str = "Cosine") -> None:
    """Points as JSON lines beside a one-row description, so that no file grows with the collection."""
    size = F.max(F.size(vector_col)) if vector_col else F.lit(None).cast("int")
    table.write.mode("overwrite").json(f"{path}/points")
    table.agg(F.lit(name).alias("collection_name"), size.alias("vector_size"), F.lit(distance).alias("distance"), F.count("*").alias("points_count")).write.mode("overwrite").json(f"{path}/description")


def import_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/points")


#: Names of distances in dumps.
DISTANCES = ("Cosine", "Dot", "Euclid")


def import_collection(spark: SparkSession, path: str, root: str, schema, name: str | None = None, recreate: bool = False) -> str:
    """A dump as a collection under ``root``, under its own name or another; the path it has. ``recreate`` replaces an existing one,
    else points are added to it."""
    told = spark.read.json(f"{path}/description").first()
    if told["distance"] not in DISTANCES:
        raise ValueError(f"unknown distance {told['distance']}")
    target = f"{root}/{name or told['collection_name']}"
    import_json(spark, path, schema).write.mode("overwrite" if recreate else "append").parquet(target)
    return target


def export_all(spark: SparkSession, collections: dict[str, str], path: str) -> dict[str, str]:
    """Dump collections (name to folder), each on its own: what went wrong with one is returned by name and stops no other."""
    failed = {}
    for name, folder in collections.items():
        try:
            export_json(read(spark, folder), f"{path}/{name}", name)
        except Exception as e:  # noqa: BLE001 - reported to the caller
            failed[name] = str(e).splitlines()[0]
    return failed


def snapshot(table: DataFrame, root: str, version: int) -> str:
    """A version is a folder of its own; restoring is reading it."""
    path = f"{root}/version={version}"
    table.write.mode("errorifexists").parquet(path)
    return path


def snapshot_all(spark: SparkSession, collections: dict[str, str], root: str, version: int) -> dict[str, str]:
    """A snapshot of each collection (name to folder): where it lies."""
    return {name: snapshot(read(spark, folder), f"{root}/{name}", version) for name, folder in collections.items()}


def restore(spark: SparkSession, root: str, version: int, path: str) -> None:
    """Put a snapshot's rows back in place of the collection at ``path``, which isn't read."""
    read(spark, f"{root}/version={version}").write.mode("overwrite").parquet(path)


def collection_info(table: DataFrame, vector_col: str | None = None) -> DataFrame:
    size = F.max(F.size(vector_col)) if vector_col else F.lit(None).cast("int")
    return table.agg(F.count("*").alias("points_count"), size.alias("vector_size")).withColumn("status", F.when(F.col("points_count") > 0, "green").otherwise("empty"))


def filtered(table: DataFrame, document_type: str | None = None, category: str | None = None, min_importance: float = 0.0, level: int | None = None) -> DataFrame:
    """The conjunction of what is given; pushed to the Parquet scan."""
    conditions = [("document_type", document_type, "="), ("category_level1", category, "="), ("importance_score", min_importance or None, ">="), ("hierarchy_level", level, "=")]
    for column, value, op in conditions:
        if value is not None:
            table = table.where(F.col(column) == value if op == "=" else F.col(column) >= value)
    return table
