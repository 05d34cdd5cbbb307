"""Breadth-first levels and single-source distances."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.graph import Graph
from arcweave.plans.fixpoint import FixpointSpec, Stop, deal, fixpoint

BFS = FixpointSpec(expand=lambda v, w: v + 1, name="bfs")
SSSP = FixpointSpec(expand=lambda v, w: v + w, name="sssp")
NEAR_FAR_DELTA = 10_000
PRIORITY_DELTA = 10


@contextmanager
def kept_edges(graph: Graph) -> Iterator[Graph]:
    """The graph with its edges dealt once, for several traversals. Levels need a graph without weights."""
    kept = deal(graph.weights())
    try:
        yield replace(graph, kept=kept)
    finally:
        kept.unpersist()


def clamp_source(graph: Graph, source: int) -> int:
    """The source moved into the range of node ids."""
    r = graph.nodes.agg(F.min("node").alias("lo"), F.max("node").alias("hi")).first()
    return source if r.lo is None else min(max(r.lo, source), r.hi)


def _seed(graph: Graph, source: int) -> DataFrame:
    return graph.nodes.where(F.col("node") == source).select("node", F.lit(0).cast("long").alias("value"))


def _all_nodes(graph: Graph, reached: DataFrame, name: str) -> DataFrame:
    r = reached.select(F.col("node").alias("n"), F.col("value").cast("long").alias(name))
    return graph.nodes.join(r, F.col("node") == F.col("n"), "left").select("node", name)


def bfs(graph: Graph, source: int = 0, stop: Stop | None = None, delta: int | None = None, metrics: list | None = None) -> DataFrame:
    """(node, level) of all nodes over directed edges; level is NULL where unreachable."""
    edges = graph.edges.select("src", "dst", F.lit(1).cast("long").alias("weight"))
    return _all_nodes(graph, fixpoint(BFS, edges, _seed(graph, clamp_source(graph, source)), stop, delta, metrics=metrics, kept=graph.kept), "level")


def sssp(graph: Graph, source: int = 0, stop: Stop | None = None, delta: int | None = None, metrics: list | None = None) -> DataFrame:
    """(node, dist) of all nodes; weight 1 where the graph has none.

    ``delta`` turns on bucket order: NEAR_FAR_DELTA for near-far, PRIORITY_DELTA for soft priority.
    """
    return _all_nodes(graph, fixpoint(SSSP, graph.weights(), _seed(graph, clamp_source(graph, source)), stop, delta, metrics=metrics, kept=graph.kept), "dist")


def sssp_near_far(graph: Graph, source: int = 0, delta: int = NEAR_FAR_DELTA, **options) -> DataFrame:
    return sssp(graph, source, delta=delta, **options)


def sssp_priority(graph: Graph, source: int = 0, delta: int = PRIORITY_DELTA, **options) -> DataFrame:
    return sssp(graph, source, delta=delta, **options)
