"""Sharding by a hierarchical weighted hash tree.

A tree of regions, racks and shards is descended level by level; at each node
every child draws ``-ln(u) / weight`` from a hash of the id and the child's name
and the least draw wins.  A child's draw depends on nothing but id, name and its
weight, so a change of weight moves rows only into or out of that child's
subtree.  A shard added in a region of its own therefore takes rows only into
itself.  All of it is column expressions: rows carry ids and sizes, never texts.

Defined results: a null id hashes as the empty string; a null text has size 1
and crc 0; rows that repeat an id share a shard, each with a slot of its own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import materialize, shuffle_partitions


@dataclass(frozen=True)
class Leaf:
    name: str
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class Node:
    name: str
    children: tuple[Node | Leaf, ...]

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children)


def tree(shards: int = 16, per_rack: int = 4, per_region: int = 2) -> Node:
    """Equal shards in racks of ``per_rack``, ``per_region`` racks a region."""
    racks = []
    for begin in range(0, shards, per_rack):
        racks.append(Node(f"rack{begin // per_rack}", tuple(Leaf(f"shard{i}", i) for i in range(begin, min(begin + per_rack, shards)))))
    regions = [Node(f"region{i // per_region}", tuple(racks[i : i + per_region])) for i in range(0, len(racks), per_region)]
    return Node("root", tuple(regions))


def shards_of(node: Node | Leaf) -> list[int]:
    return [node.shard] if isinstance(node, Leaf) else [s for c in node.children for s in shards_of(c)]


def grow(root: Node, weight: float = 1.0) -> Node:
    """One more shard, in a new region and rack, so that no other subtree's weight changes."""
    number = max(shards_of(root), default=-1) + 1
    leaf = Leaf(f"shard{number}", number, weight)
    return Node(root.name, (*root.children, Node(f"region+{number}", (Node(f"rack+{number}", (leaf,)),))))


def _draw(doc_id: Column, name: str, weight: float) -> Column:
    """``-ln(u) / weight`` with u in (0, 1) from 53 bits of the hash of name and id."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(name), F.coalesce(doc_id.cast("string"), F.lit(""))), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 53))) / F.lit(float(weight))


def descend(doc_id: Column, node: Node | Leaf, path: str = "") -> Column:
    """The shard of an id, as one expression over the tree."""
    if isinstance(node, Leaf):
        return F.lit(node.shard)
    here = f"{path}/{node.name}"
    live = [c for c in node.children if c.weight > 0]
    if len(live) == 1:
        return descend(doc_id, live[0], here)
    scores = [_draw(doc_id, f"{here}/{c.name}", c.weight) for c in live]
    # struct ordering: least draw, then first child
    best = F.least(*[F.struct(s.alias("draw"), F.lit(i).alias("child")) for i, s in enumerate(scores)])
    choice = best["child"]
    out = descend(doc_id, live[-1], here)
    for i in range(len(live) - 2, -1, -1):
        out = F.when(choice == i, descend(doc_id, live[i], here)).otherwise(out)
    return out


def assign(docs: DataFrame, root: Node, grown: Node | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, grown_shard`` of every row, without a shuffle."""
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    return docs.select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        descend(F.col("doc_id"), root).cast("int").alias("shard"),
        (descend(F.col("doc_id"), grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )


def with_slots(assigned: DataFrame) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard.

    Each shard is cut into hash pieces; rows are numbered within a piece and
    pieces are offset by the counts before them, so no task holds a whole shard.  The task that read a row
    is part of the hash, so that copies of one row are in many pieces; pieces are written before rows are numbered.
    """
    pieces = shuffle_partitions(assigned.sparkSession)
    kept = materialize(assigned.withColumn("piece", F.pmod(F.xxhash64(F.lit("slot"), "doc_id", "text_crc32", F.spark_partition_id()), F.lit(pieces)).cast("int")), "shards")
    order = Window.partitionBy("shard").orderBy("piece")
    offsets = (
        kept.groupBy("shard", "piece")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(order) - F.col("n"))
        .drop("n")
    )
    within = Window.partitionBy("shard", "piece").orderBy("doc_id", "text_crc32", "size")
    numbered = kept.withColumn("at", F.row_number().over(within) - 1)
    # offsets has shards x pieces rows, both parameters
    return (
        numbered.join(F.broadcast(offsets), ["shard", "piece"])
        .withColumn("slot", (F.col("before") + F.col("at")).cast("long"))
        .drop("piece", "before", "at")
    )


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    root = tree(shards)
    return with_slots(assign(docs, root, grow(root))).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
