"""A graph as two tables: all nodes (also isolated ones) and directed edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.runtime import dealt


@dataclass(frozen=True)
class Graph:
    """nodes(node), edges(src, dst[, weight]); parallel edges and self loops are allowed.

    ``rows``: edges there are at most, 0 if unknown. ``kept``: edges dealt and persisted for several loops.
    """

    nodes: DataFrame
    edges: DataFrame
    rows: int = 0
    kept: DataFrame | None = None

    @property
    def weighted(self) -> bool:
        return "weight" in self.edges.columns

    def weights(self) -> DataFrame:
        """edges with a weight: 1 where the input has none."""
        w = F.coalesce(F.col("weight"), F.lit(1)) if self.weighted else F.lit(1)
        return self.edges.select("src", "dst", w.cast("long").alias("weight"))

    def by_source(self, parts: int | None = None) -> DataFrame:
        """Edges dealt by source once, for loops that join on it every round."""
        e = self.weights()
        return e.repartition(parts, "src") if parts else e.repartition("src")

    @classmethod
    def of_edges(cls, edges: DataFrame) -> Graph:
        ends = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node")))
        return cls(ends.distinct(), edges)


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def one_direction(edges: DataFrame, strict: bool = False, rows: int = 0) -> DataFrame:
    """An undirected edge set stored once: ``strict`` keeps only rows with src <= dst, else ends are ordered and made distinct; ``rows`` if known."""
    if strict:
        return edges.where("src <= dst")
    return dealt(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")), ["src", "dst"], rows).distinct()


def degrees(graph: Graph) -> DataFrame:
    """(node, degree): out-degree of every node, parallel edges counted."""
    d = graph.edges.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    return graph.nodes.join(d, F.col("node") == F.col("src"), "left").select("node", F.coalesce("d", F.lit(0)).alias("degree"))


def stats(graph: Graph) -> DataFrame:
    """One row: nodes, edges, max_degree, avg_degree."""
    return degrees(graph).agg(
        F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("degree"), F.lit(0)).alias("edges"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"),
        (F.sum("degree") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("avg_degree"),
    )
