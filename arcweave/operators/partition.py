"""Graph partitioning: contiguous blocks, nested splits, label propagation, boundary nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcweave.graph import Graph, undirected
from arcweave.operators.ordering import global_rank
from arcweave.runtime import discard, materialize, ranked_within

DEGREE_THRESHOLD = 8


def block_of(node: Column, nodes: int, parts: int) -> Column:
    """Owner of a dense id: contiguous ranges of ceil(nodes / parts)."""
    return F.floor(node / F.lit(max(1, -(-nodes // parts)))).cast("long")


def block_partition(graph: Graph, parts: int, nodes: int) -> DataFrame:
    """(node, part) for ids in 0..nodes-1."""
    return graph.nodes.select("node", block_of(F.col("node"), nodes, parts).alias("part"))


def owns(node: Column, part: int, nodes: int, parts: int) -> Column:
    return block_of(node, nodes, parts) == part


def bounds(assigned: DataFrame) -> DataFrame:
    """(part, first, last, nodes) of an assignment (node, part)."""
    return assigned.groupBy("part").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("nodes"))


def relabel(assigned: DataFrame) -> DataFrame:
    """(node, part, new_node): dense new ids ordered by part, then node."""
    return global_rank(assigned, ["part", "node"], "new_node")


def apply_relabel(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    m = mapping.select(F.col("node").alias("m"), "new_node")
    a = edges.join(m, F.col("src") == F.col("m")).drop("m", "src").withColumnRenamed("new_node", "src")
    return a.join(m, F.col("dst") == F.col("m")).drop("m", "dst").withColumnRenamed("new_node", "dst").select("src", "dst", *[c for c in edges.columns if c not in ("src", "dst")])


def restore_labels(values: DataFrame, mapping: DataFrame) -> DataFrame:
    """Values keyed by new ids, keyed by the original ids again."""
    m = mapping.select(F.col("node").alias("orig"), F.col("new_node").alias("m"))
    return values.join(m, F.col("node") == F.col("m")).drop("node", "m").withColumnRenamed("orig", "node")


def halos(edges: DataFrame, owner) -> DataFrame:
    """(part, node): distinct destinations that another part owns."""
    cut = edges.select(owner(F.col("src")).alias("part"), F.col("dst").alias("node")).where(F.col("part") != owner(F.col("node")))
    return cut.distinct()


def halo_counts(edges: DataFrame, owner) -> DataFrame:
    """(part, total, distinct_nodes) of remote destinations."""
    cut = edges.select(owner(F.col("src")).alias("part"), F.col("dst").alias("node")).where(F.col("part") != owner(F.col("node")))
    per = cut.groupBy("part", "node").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("part").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_nodes"))


def hierarchical_part(src: Column, dst: Column, low: int, high: int, parts: int, first: int = 0) -> Column:
    """Part of an edge by recursive halving of the node range: right if both ends lie in the right half, else left."""
    if parts <= 1:
        return F.lit(first).cast("long")
    left = parts // 2
    split = low + (high - low) * left // parts
    inside = lambda c: (c >= split) & (c < high)
    return F.when(inside(src) & inside(dst), hierarchical_part(src, dst, split, high, parts - left, first + left)).otherwise(hierarchical_part(src, dst, low, split, left, first))


def even_split(df: DataFrame, size: int, order: list[str]) -> DataFrame:
    """``chunk``: consecutive chunks of at most ``size`` rows."""
    return global_rank(df, order, "__r").withColumn("chunk", F.floor(F.col("__r") / size).cast("long")).drop("__r")


def auto_config(nodes: int, edges: int, parts: int, threshold: int = DEGREE_THRESHOLD) -> dict:
    """Sparse graphs are split by vertex and merged in chunks; dense ones by edge chunks."""
    if nodes and edges / nodes < threshold:
        return {"vertex_partitioning": True, "merge_chunks": 8, "plain_rounds": 1, "edge_chunk": max(1, -(-edges // max(1, parts)))}
    return {"vertex_partitioning": False, "merge_chunks": 1, "plain_rounds": 1, "edge_chunk": max(1, nodes)}


def propagation_partition(graph: Graph, parts: int, rounds: int = 5, slack: float = 1.2) -> DataFrame:
    """(node, part) with few cut edges: blocks refined by label propagation under a size limit.

    In a round every node asks for the part most of its neighbours are in;
    requests to a part are ranked in a hashed order and the first are granted
    while it has room, so no part exceeds ``slack`` times an even share, plus one. A substitute for k-way cut
    minimisation with the same contract (an assignment for relabel), not its quality.
    """
    both = materialize(undirected(graph.edges.select("src", "dst")).where("src <> dst").distinct(), "lp")
    ranked = global_rank(graph.nodes, ["node"], "__r")
    n = graph.nodes.count()
    room = int(slack * n / parts) + 1
    cur = materialize(ranked.select("node", F.least(F.lit(parts - 1), F.floor(F.col("__r") * parts / max(1, n))).cast("long").alias("part")), "lp")
    for i in range(rounds):
        near = both.join(cur.select(F.col("node").alias("n"), F.col("part").alias("p")), F.col("dst") == F.col("n")).groupBy("src", "p").agg(F.count(F.lit(1)).alias("c"))
        want = near.groupBy("src").agg(F.max_by("p", F.struct("c", -F.col("p"))).alias("want"))
        asked = cur.join(want, F.col("node") == F.col("src"), "left").select("node", "part", F.coalesce("want", "part").alias("want"))
        sizes = {r.part: r.n for r in cur.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a part
        free = F.create_map(*[x for p in range(parts) for x in (F.lit(p).cast("long"), F.lit(max(0, room - sizes.get(p, 0))))])
        asks = asked.where("want <> part").select("node", "want", F.xxhash64("node", F.lit(i)).alias("__h"))
        granted = ranked_within(asks, ["want"], ["__h", "node"], "__at").where(F.col("__at") < free[F.col("want")]).select(F.col("node").alias("__g"), "want")
        nxt = materialize(cur.join(granted, F.col("node") == F.col("__g"), "left").select("node", F.coalesce("want", "part").alias("part")), "lp")
        discard(cur)
        cur = nxt
    return cur


def cut_edges(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    a = assigned.select(F.col("node").alias("sn"), F.col("part").alias("sp"))
    b = assigned.select(F.col("node").alias("dn"), F.col("part").alias("dp"))
    return edges.join(a, F.col("src") == F.col("sn")).join(b, F.col("dst") == F.col("dn")).agg(F.count_if(F.col("sp") != F.col("dp")).alias("cut"))


def numbered_by_part(assigned: DataFrame) -> DataFrame:
    """(node, part, local): position inside the part."""
    return assigned.withColumn("local", (F.row_number().over(Window.partitionBy("part").orderBy("node")) - 1).cast("long"))
