"""Deterministic graph and value generators.

Random draws are arithmetic hashes of the row's own numbers, so any engine that
evaluates BIGINT arithmetic gives the same graph and a lost task regenerates
exactly its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.graph import Graph

#: Fixed values of the hash: multiplier, increment, modulus (a prime below 2^31).
MUL, INC, MOD = 48271, 12345, 2147483647
STRIDE = 1000003


def draw(x: Column, salt: int = 0) -> Column:
    """A value in 0..MOD-1 for a non-negative BIGINT: two rounds of a modular product."""
    one = (F.pmod(x, F.lit(MOD)) * F.lit(MUL) + F.lit(INC + salt)) % F.lit(MOD)
    return (one * F.lit(MUL) + F.lit(INC)) % F.lit(MOD)


def _nodes(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("node"))


def random_graph(spark: SparkSession, nodes: int, max_neighbours: int, seed: int = 0) -> Graph:
    """Every node gets 1..max_neighbours distinct neighbours other than itself."""
    if not 1 <= max_neighbours <= nodes - 1:
        raise ValueError("max_neighbours must be between 1 and nodes - 1")
    stride = STRIDE
    while _gcd(stride, nodes - 1) != 1:
        stride += 2
    n = _nodes(spark, nodes)
    k = 1 + draw(F.col("node"), seed) % max_neighbours
    e = n.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), k - 1)))
    step = (draw(F.col("node"), seed + 1) + F.col("i") * stride) % (nodes - 1)
    return Graph(n, e.select(F.col("node").alias("src"), ((F.col("node") + 1 + step) % nodes).alias("dst")))


def _gcd(a: int, b: int) -> int:
    while b:
        a, b = b, a % b
    return a


def chain(spark: SparkSession, nodes: int) -> Graph:
    """i to i - 1 and i + 1."""
    n = _nodes(spark, nodes)
    e = n.select(F.col("node").alias("src"), F.explode(F.array(F.col("node") - 1, F.col("node") + 1)).alias("dst")).where(f"dst >= 0 and dst < {nodes}")
    return Graph(n, e)


def segmented_chain(spark: SparkSession, nodes: int, segments: int) -> Graph:
    """A chain whose links do not cross segments; the node count is rounded down to a multiple of the segments."""
    size = nodes // segments
    g = chain(spark, size * segments)
    return Graph(g.nodes, g.edges.where(F.floor(F.col("src") / size) == F.floor(F.col("dst") / size)))


def cliques(spark: SparkSession, nodes: int, segments: int) -> Graph:
    """A complete graph inside each segment, without self loops."""
    size = nodes // segments
    n = _nodes(spark, size * segments)
    first = F.floor(F.col("node") / size).cast("long") * size
    e = n.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")))).select(F.col("node").alias("src"), (first + F.col("j")).alias("dst"))
    return Graph(n, e.where("src <> dst"))


def with_weights(graph: Graph, max_weight: int = 100, seed: int = 0) -> Graph:
    """Weights 1..max_weight drawn from both ends of an edge."""
    w = 1 + draw(F.col("src") * 31 + F.col("dst") * 17 + 7, seed) % max_weight
    return Graph(graph.nodes, graph.edges.select("src", "dst", w.alias("weight")))


def values(spark: SparkSession, n: int, ratio: float = 0.5, seed: int = 0) -> DataFrame:
    """(idx, value): floats in [ratio - 1, ratio)."""
    return spark.range(n).select(F.col("id").alias("idx"), (draw(F.col("id"), seed) / F.lit(float(MOD)) + F.lit(ratio - 1)).cast("float").alias("value"))
