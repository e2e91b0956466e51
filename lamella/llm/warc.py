"""Merkle fixity audit of WARC replicas.

Records of an archive file are hashed with their place (file, offset, length), and trees of fixed fan-out are
built over the ordered ranges of offsets: a node covers ``fanout ** level`` slots of ``slot_bytes`` bytes, so a node's
range doesn't depend on what a replica holds, and a lost or added record changes only the nodes above it. An
audit compares the roots of two replicas, then goes down, level by level, through mismatching nodes only,
and compares records just below mismatching leaves.

All of it is DataFrame functions: a level is one aggregation by node, with the children's hashes in order.

Defined cases: null payloads count as empty; records with a null file or offset are left out (they have no
place); several records at one place are hashed together, in order of their digests, and reported together;
a file that only one replica has is reported record by record; empty replicas are equal to each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

FANOUT, SLOT_BYTES, LEVELS = 16, 1 << 16, 5


def payloads(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", per_file: int = 256) -> DataFrame:
    """WARC response records of pages, ``file, record_id, payload``; a file holds the pages of ``per_file`` neighbouring ids."""
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.col(id_col).cast("string"), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col(url_col), F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.where(F.col(id_col).isNotNull()).select(F.floor(F.col(id_col) / per_file).alias("file"), F.col(id_col).alias("record_id"), F.concat(head.cast("binary"), body, F.lit(b"\r\n\r\n")).alias("payload"))


def records(found: DataFrame) -> DataFrame:
    """``file, record_id, length, digest, offset`` of records (``file, record_id, payload``, and ``held``, the bytes that are really
    there, where they aren't the payload).

    Records of a file lie one after another in order of id, so offsets are a running sum over a bounded group.
    Payloads are hashed where they are read; only sizes and digests are shuffled.
    """
    held = F.col("held") if "held" in found.columns else F.col("payload")
    place = F.sha2("payload", 256) if "held" in found.columns else F.lit("")
    sized = found.select("file", "record_id", F.octet_length("payload").cast("long").alias("length"), F.sha2(held, 256).alias("digest"), place.alias("place"))
    order = "OVER (PARTITION BY file ORDER BY record_id, IF(place = '', digest, place) ROWS UNBOUNDED PRECEDING)"
    return sized.withColumn("offset", F.expr(f"sum(length) {order} - length")).drop("place")


def leaves(replica: DataFrame) -> DataFrame:
    """``file, slot, hash``: the records of each slot of offsets, hashed in order."""
    entry = F.concat_ws(":", F.lpad(F.col("offset").cast("string"), 20, "0"), F.col("length").cast("string"), "digest")
    rows = replica.where("file IS NOT NULL AND offset IS NOT NULL").select("file", F.floor(F.col("offset") / SLOT_BYTES).alias("slot"), entry.alias("entry"))
    return rows.groupBy("file", "slot").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("entry")), ","), 256).alias("hash"))


def _up(level: DataFrame) -> DataFrame:
    child = F.concat_ws(":", F.lpad(F.col("slot").cast("string"), 20, "0"), "hash")
    return level.groupBy("file", F.floor(F.col("slot") / FANOUT).alias("slot")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(child)), ","), 256).alias("hash"))


def tree(replica: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Levels from the leaves to the roots; each node has at most ``FANOUT`` children. With the default
    numbers a root covers 64 GiB of a file, and larger files have several roots."""
    out = [stored(leaves(replica), "leaves")]
    for _ in range(levels - 1):
        out.append(stored(_up(out[-1]), "nodes"))
    return out


def _mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("file", "slot", F.col("hash").alias("ha")).join(b.select("file", "slot", F.col("hash").alias("hb")), ["file", "slot"], "full_outer")
    return both.where("NOT ha <=> hb").select("file", "slot")


def audit(primary: DataFrame, replica: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``file, offset, status, expected, actual``: places where the replicas differ.

    status is ``altered``, ``missing`` (not in ``replica``) or ``extra``; expected and actual are digests of
    primary and replica, comma-joined in order if a place has several records. The levels of both trees and
    each level's mismatches are written to the shared folder, so nothing is built twice on the way down.
    """
    a, b = tree(primary, levels), tree(replica, levels)
    bad = _mismatch(a[-1], b[-1])
    for x, y in zip(a[-2::-1], b[-2::-1], strict=True):
        parent = bad.select(F.col("file").alias("pf"), F.col("slot").alias("ps"))
        below = (F.col("file") == F.col("pf")) & (F.floor(F.col("slot") / FANOUT) == F.col("ps"))
        bad = stored(_mismatch(x.join(parent, below, "left_semi"), y.join(parent, below, "left_semi")), "mismatch")
    bad = bad.select(F.col("file").alias("bf"), F.col("slot").alias("bs"))
    place: Column = (F.col("file") == F.col("bf")) & (F.floor(F.col("offset") / SLOT_BYTES) == F.col("bs"))

    def at(rows: DataFrame, name: str) -> DataFrame:
        found = rows.join(bad, place, "left_semi")
        return found.groupBy("file", "offset").agg(F.array_join(F.array_sort(F.collect_list("digest")), ",").alias(name), F.min("record_id").alias(f"{name}_id"))

    both = at(primary, "expected").join(at(replica, "actual"), ["file", "offset"], "full_outer").where("NOT expected <=> actual")
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("altered")
    return both.select("file", "offset", F.coalesce("expected_id", "actual_id").alias("record_id"), status.alias("status"), "expected", "actual")


def roots(replica: DataFrame, levels: int = LEVELS) -> DataFrame:
    return tree(replica, levels)[-1].select("file", F.col("slot").alias("root"), "hash")


def damaged(found: DataFrame, every: int = 97) -> DataFrame:
    """The records of a replica of ``found`` (``file, record_id, payload``) with deterministic damage, for audits of the audit: in
    those whose id leaves 5 modulo ``every`` the last byte has changed, those that leave 11 are lost, and one byte after
    the start of those that leave 17 a record was added. All bytes that the replica holds are hashed."""
    rest = F.pmod("record_id", F.lit(every))
    changed = F.concat(F.substring("payload", 1, F.octet_length("payload") - 1), F.lit(b"!"))
    rows = records(found.withColumn("held", F.when(rest == 5, changed).otherwise(F.col("payload"))))
    added = rows.where(rest == 17).withColumn("offset", F.col("offset") + 1).withColumn("digest", F.sha2(F.lit(b"added"), 256))
    return rows.where(rest != 11).unionByName(added)
