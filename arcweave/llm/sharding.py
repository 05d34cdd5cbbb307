"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A row descends the tree. At every level each child draws ``-ln(u) / weight``
from a hash of (row key, child) and the smallest draw wins, so a child gets rows
in proportion to its weight. A draw depends on its own child alone: when weights
change, rows move only into or out of the subtrees whose weights changed, and
the draws of all other levels stay. The law is ``key``: the row's id and the
shard count decide. The tree for n shards holds the base shards in full racks;
every further shard opens a region of its own, so that it takes rows only into
itself. Slots count along (a draw's range, id, checksum), so no task ranks a
whole shard.

Defined cases: a null id draws by the text's checksum; a null text has size 1;
repeated rows go to one shard and get slots of their own, in any order; texts of
any length are only measured and summed; a tie between two draws goes to the
first child; weights that are all zero raise; empty in, empty out; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.draws import SPAN, draw, range_of
from arcweave.runtime import ranked_within


#: Key of the leaf of shard 0.
LEAF = 3_000_000


@dataclass(frozen=True)
class Node:
    """A subtree: ``key`` names it in the draws; a leaf carries its shard number."""

    key: int
    weight: float
    children: tuple[Node, ...] = ()
    shard: int = -1


def tree_for(shards: int, base: int = 16, per_rack: int = 4, racks_per_region: int = 2, weights: dict[int, float] | None = None) -> Node:
    """The tree of ``shards`` shards; ``weights`` by shard, 1 where not given."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    w = weights or {}
    leaf = lambda s: Node(LEAF + s, float(w.get(s, 1.0)), (), s)
    group = lambda level, i, kids: Node(level * 1_000_000 + i, sum(k.weight for k in kids), tuple(kids))
    full = min(shards, base)
    racks = [group(2, i, [leaf(s) for s in range(lo, min(lo + per_rack, full))]) for i, lo in enumerate(range(0, full, per_rack))]
    regions = [group(1, i, racks[lo : lo + racks_per_region]) for i, lo in enumerate(range(0, len(racks), racks_per_region))]
    regions += [group(1, len(regions) + i, [group(2, 10_000 + s, [leaf(s)])]) for i, s in enumerate(range(full, shards))]
    total = sum(r.weight for r in regions)
    if total <= 0:
        raise ValueError("no shard has a weight above zero")
    return Node(0, total, tuple(regions))


def _child(at: Column, nodes: list[Node], key: Column) -> Column:
    """The key of the child that wins below the node whose key is ``at``; each child's draw is taken once."""
    live = {n.key: [c for c in n.children if c.weight > 0] for n in nodes}
    options = []
    for i in range(max(map(len, live.values()))):
        child, weight = F.lit(None).cast("int"), F.lit(None).cast("double")
        for k, kids in live.items():
            if i < len(kids):
                child, weight = F.when(at == k, F.lit(kids[i].key)).otherwise(child), F.when(at == k, F.lit(kids[i].weight)).otherwise(weight)
        u = (draw(child, key).cast("double") + F.lit(0.5)) / F.lit(SPAN)
        options.append(F.when(child.isNotNull(), F.struct((-F.log(u) / weight).alias("d"), F.lit(i).alias("i"), child.alias("at"))))
    return F.array_min(F.array(*options))["at"]


def _chooser(nodes: list[Node], key: Column) -> Callable[[Column], Column]:
    return lambda at: _child(at, nodes, key)


def shard_of(key: Column, tree: Node) -> Column:
    """The shard reached from the root; a level's winner is bound once (a lambda) and read by the next level."""
    at, nodes = F.lit(tree.key), [tree]
    while nodes[0].children:
        at = F.transform(F.array(at), _chooser(nodes, key))[0]
        nodes = [c for n in nodes for c in n.children if c.weight > 0]
    return (at - F.lit(LEAF)).cast("int")


def path_of(shard: Column, tree: Node) -> tuple[Column, Column]:
    """Region and rack of a shard."""
    region, rack = F.lit(None).cast("int"), F.lit(None).cast("int")
    for ri, r in enumerate(tree.children):
        for ki, k in enumerate(r.children):
            for leaf in k.children:
                region = F.when(shard == leaf.shard, F.lit(ri)).otherwise(region)
                rack = F.when(shard == leaf.shard, F.lit(ki)).otherwise(rack)
    return region, rack


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, weights: dict[int, float] | None = None) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, region, rack), one row per input row."""
    tree, grown = tree_for(shards, base=shards, weights=weights), tree_for(shards + 1, base=shards, weights=weights)
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("long"), -1 - F.col("text_crc32"))
    placed = rows.withColumn("shard", shard_of(key, tree)).withColumn("grown_shard", shard_of(key, grown))
    out = ranked_within(placed, ["shard"], ["doc_id", "text_crc32"], "slot", salt=range_of(draw("slot", key)))
    region, rack = path_of(F.col("shard"), tree)
    return out.select(F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", region.alias("region"), rack.alias("rack"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> None:
    """Write the rows below ``path``/shard=N; large shards are spread over several files."""
    key = F.coalesce(F.col(id_col).cast("long"), -1 - F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    docs.withColumn("shard", shard_of(key, tree_for(shards, base=shards))).write.partitionBy("shard").parquet(path)
