"""Graphs kept by path for repeated commands."""

from __future__ import annotations

from pyspark.sql import SparkSession

from arcweave.graph import Graph
from arcweave.sources.dimacs import read_dimacs
from arcweave.sources.gr import read_gr

_KEPT: dict[tuple[str, str, bool], Graph] = {}


def cached_graph(spark: SparkSession, path: str, binary: bool | None = None) -> Graph:
    """The graph of this application, path and format; those of stopped applications are forgotten."""
    app = spark.sparkContext.applicationId
    for old in [k for k in _KEPT if k[0] != app]:
        del _KEPT[old]
    binary = path.endswith(".gr") if binary is None else binary
    key = (app, path, binary)
    if key not in _KEPT:
        g = read_gr(spark, path) if binary else read_dimacs(spark, path).graph
        _KEPT[key] = Graph(g.nodes, g.edges.persist())
    return _KEPT[key]


def clear_graphs() -> None:
    for g in _KEPT.values():
        g.edges.unpersist()
    _KEPT.clear()
