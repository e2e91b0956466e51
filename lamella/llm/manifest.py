"""Merkle manifest of a dataset by superblock reduction.

Rows are leaves; those of a group (a source) are put in order and hashed up, ``fanout`` neighbours at a time, to the group's
root; group roots, in order, are hashed up to the dataset's root in the same way. Levels aren't built one shuffle each: a
superblock holds the ``fanout ** levels`` nodes whose numbers agree after division, and one ``applyInPandas`` group
collapses all its levels at once. What remains are superblock roots, which are reduced by the same step until each
group has one, so 100 billion rows need four rounds. A proof is what the superblock itself gives (the lower part) followed by its
root's proof, which the round above gives (the upper part).

Nothing is numbered by one task: rows are sorted by range, numbered inside their partition, and partition sizes are
summed by group. A group with a third of all rows is many superblocks like any other.

Defined cases: a null field is hashed as ``-``; a null group is a group of its own and the first; null order keys come first;
rows that tie in all order keys are ordered by their place in storage, which matters only where their hashes differ; a group
of one row is its own root, a dataset of one group has that group's root; an empty table gives an empty result; other columns
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

FANOUT, LEVELS = 3, 6  # a superblock holds 729 nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"
Path = list[tuple[str, str]]


def digest(*parts: str) -> str:
    """The hash of a node from its children, in order."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """How a field enters a leaf: its size in bytes and itself, so that no two rows are written alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def collapsed(nodes: list[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The levels over some nodes, the nodes themselves first."""
    out = [nodes]
    for _ in range(levels):
        last = out[-1]
        out.append([digest(*last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return out


def siblings(tree: list[list[str]], i: int, fanout: int = FANOUT) -> Path:
    """For each level the hashes before and after the node over leaf ``i`` in its run."""
    out = []
    for level in tree[:-1]:
        first = i - i % fanout
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + fanout])))
        i //= fanout
    return out


def folded(node: str, path: Path) -> str:
    """The root that follows from a node and its proof."""
    for before, after in path:
        node = digest(before, node, after)
    return node


def proof_digest(path: Path) -> str:
    return digest(*(x for step in path for x in step))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with a group ``g``) plus ``i``, the place in the group from 0, and ``n``, the group's size."""
    held = stored(rows, "leaves")
    place = ["tie_file", "tie_row"]
    tied = held.select("*", F.col("_metadata.file_path").alias(place[0]), F.col("_metadata.row_index").alias(place[1]))
    keys = ["g", *order, *place]
    ranged = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*place)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = pd.Series(batch.column("g").to_pandas())
            at = np.zeros(batch.num_rows, np.int64)
            first = np.flatnonzero((g != g.shift()).to_numpy())
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), batch.num_rows], strict=True):
                seen = seen if g[lo] == group else 0
                at[lo:hi] = np.arange(seen, seen + hi - lo)
                group, seen = g[lo], seen + hi - lo
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(at)], [*batch.schema.names, "part", "at"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
    placed = stored(ranged.mapInArrow(count, f"{schema}, part int, at long"), "placed")
    sizes = placed.groupBy("g", "part").agg(F.count("*").alias("size"))
    before = sizes.select("g", "part", F.expr("sum(size) OVER (PARTITION BY g ORDER BY part) - size").alias("before"), F.expr("sum(size) OVER (PARTITION BY g)").alias("n"))
    return placed.join(before, ["g", "part"]).withColumn("i", F.col("before") + F.col("at")).drop("part", "at", "before")


def superblocks(nodes: DataFrame, payload: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row for each superblock of ``g, i, n, h``: its number ``block``, of ``blocks``, the group's levels that it
    collapses, its nodes ``hs`` in order with their payload columns, and its root."""
    size = fanout**levels
    kept = {p: nodes.schema[p].dataType.simpleString() for p in payload}

    def collapse(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        n, up = int(rows["n"].iloc[0]), 0
        while up < levels and fanout**up < n:
            up += 1
        hs = rows["h"].tolist()
        (root,) = collapsed(hs, up, fanout)[-1]
        row = [key[0], key[1], -(-n // size), up, root, hs, *(rows[p].astype(object).where(rows[p].notna(), None).tolist() for p in payload)]
        return pd.DataFrame([row], columns=["g", "block", "blocks", "levels", "root", "hs", *payload])

    schema = "g string, block long, blocks long, levels int, root string, hs array<string>" + "".join(f", `{p}` array<{t}>" for p, t in kept.items())
    return nodes.withColumn("block", F.floor(F.col("i") / size)).groupBy("g", "block").applyInPandas(collapse, schema)


def reduced(nodes: DataFrame, payload: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """All rounds of superblocks over ``g, i, n, h`` (the payload stays with the first), and ``g, root, top``: each group's root and
    the round that reached it."""
    rounds = [stored(superblocks(nodes, payload, fanout, levels), "superblocks")]
    roots = None
    while True:
        now = rounds[-1]
        done = now.where("blocks = 1").select("g", "root", F.lit(len(rounds) - 1).alias("top"))
        roots = done if roots is None else roots.unionByName(done)
        rest = now.where("blocks > 1")
        if rest.isEmpty():
            return rounds, roots
        rounds.append(stored(superblocks(rest.select("g", F.col("block").alias("i"), F.col("blocks").alias("n"), F.col("root").alias("h")), [], fanout, levels), "superblocks"))


def below(rounds: list[DataFrame], tops: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The first round's superblocks with the proofs of their roots, from ``g, top, path, subroot, dataset`` of each group."""

    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                tree = collapsed(list(r.hs), r.levels, fanout)
                first = r.block * fanout**levels
                upper = [tuple(p.values()) for p in r.path]
                paths = [[{"before": b, "after": a} for b, a in siblings(tree, i, fanout) + upper] for i in range(len(r.hs))]
                yield pd.DataFrame({"g": r.g, "block": np.arange(first, first + len(paths)), "path": paths, "subroot": r.subroot, "dataset": r.dataset})

    carried = None
    for level in range(len(rounds) - 1, -1, -1):
        mine = tops.where(F.col("top") == level).select("g", F.lit(0).cast("long").alias("block"), "path", "subroot", "dataset")
        carried = mine if carried is None else mine.unionByName(carried)
        met = rounds[level].drop("root").join(carried, ["g", "block"])
        if not level:
            return met
        carried = stored(met.mapInPandas(children, f"g string, block long, path {PATH}, subroot string, dataset string"), "proofs")
    raise AssertionError("no round")


def manifest(leaves: DataFrame, group: str = "source", order: str = "doc_id", claim: str | None = None, fanout: int = FANOUT, levels: int = LEVELS, proofs: bool = True) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root, proof`` of each row of ``leaves`` (with a column ``leaf``): the id is the
    order column, ``proof`` the hashes before and after the row's node in each level (left out without ``proofs``).
    ``folded_root`` follows from the row's ``claim`` column where given and not null (a leaf that was hashed again, perhaps from
    other bytes), else from its leaf.
    """
    # a null group sorts before all others, as the empty text does
    rows = leaves.select(
        F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("")).alias("g"), F.col(order).alias("id"), F.col("leaf").alias("h"),
        (F.col(claim) if claim else F.lit(None).cast("string")).alias("claim"),
    )
    id_type = rows.schema["id"].dataType.simpleString()
    # pandas would make floats of whole numbers beside nulls
    rounds, roots = reduced(numbered(rows, ["id"]).select("g", "i", "n", "h", F.col("id").cast("string").alias("id"), "claim"), ["id", "claim"], fanout, levels)
    roots = stored(roots, "subroots")
    tier = numbered(roots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("h"), "top"), ["name"])
    upper, whole = reduced(tier.select("g", "i", "n", "h", "name", "top"), ["name", "top"], fanout, levels)
    start = whole.select("g", "top", F.expr(f"cast(array() AS {PATH})").alias("path"), F.lit("").alias("subroot"), F.col("root").alias("dataset"))
    names = below(upper, start, fanout, levels)

    def of_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                tree, rest = collapsed(list(r.hs), r.levels, fanout), [tuple(p.values()) for p in r.path]
                paths = [[{"before": b, "after": a} for b, a in siblings(tree, i, fanout) + rest] for i in range(len(r.hs))]
                yield pd.DataFrame({"g": r.name, "top": r.top, "path": paths, "subroot": r.hs, "dataset": r.dataset})

    tops = stored(names.mapInPandas(of_groups, f"g string, top int, path {PATH}, subroot string, dataset string"), "tops")

    def of_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                hs = list(r.hs)
                tree, rest = collapsed(hs, r.levels, fanout), [tuple(p.values()) for p in r.path]
                paths = [siblings(tree, i, fanout) + rest for i in range(len(hs))]
                out = pd.DataFrame({"id": pd.Series(list(r.id), dtype=object), "leaf": hs, "subroot": r.subroot, "root": r.dataset})
                out["proof_sha256"] = [proof_digest(p) for p in paths]
                out["folded_root"] = [folded(c or h, p) for c, h, p in zip(r.claim, hs, paths, strict=True)]
                if proofs:
                    out["proof"] = [[{"before": b, "after": a} for b, a in p] for p in paths]
                yield out

    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + (f", proof {PATH}" if proofs else "")
    return below(rounds, tops, fanout, levels).mapInPandas(of_rows, schema).withColumn("id", F.col("id").cast(id_type))
