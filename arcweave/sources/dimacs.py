"""DIMACS10 / METIS text graphs.

``%`` starts a comment line. The header is ``vertices edges [fmt [ncon]]`` with
fmt digits for vertex sizes, vertex weights and edge weights; then one line a
vertex with 1-based neighbours. The header counts undirected edges, so the body
holds twice as many. Lines are numbered by a distributed rank over their place
in the file and parsed by SQL functions; every rule of the format is checked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.graph import Graph
from arcweave.runtime import materialize


class BadGraphText(ValueError):
    pass


@dataclass(frozen=True)
class Header:
    nodes: int
    edges: int
    sizes: bool
    weights: bool
    edge_weights: bool
    ncon: int


def parse_header(line: str | None) -> Header:
    if line is None:
        raise BadGraphText("the file ends before the header")
    try:
        parts = [int(x) for x in line.split()]
    except ValueError:
        raise BadGraphText("the header is not numeric") from None
    if len(parts) < 2:
        raise BadGraphText("the header needs the numbers of vertices and edges")
    nodes, edges = parts[:2]
    if nodes <= 0 or edges <= 0:
        raise BadGraphText("the numbers of vertices and edges must be positive")
    fmt = parts[2] if len(parts) > 2 else 0
    if fmt > 111 or any(c not in "01" for c in str(fmt)):
        raise BadGraphText(f"format {fmt} is unknown")
    s, w, e = (c == "1" for c in f"{fmt:03d}")
    ncon = parts[3] if len(parts) > 3 else 0
    if ncon > 0 and not w:
        raise BadGraphText("ncon is given but vertex weights are not")
    return Header(nodes, edges, s, w, e, ncon or (1 if w else 0))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, value): lines without comments; ``at`` rises with the place in the file."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    return raw.where("not startswith(ltrim(value), '%')")


@dataclass(frozen=True)
class ParsedGraph:
    graph: Graph
    vertices: DataFrame
    header: Header


def read_dimacs(spark: SparkSession, path: str) -> ParsedGraph:
    """Graph plus vertices(node, vsize, vwgt); sizes and weights are 1 where the file has none."""
    from arcweave.operators.ordering import global_rank

    lines = global_rank(_lines(spark, path), ["block", "i"], "line")
    first = lines.where("line = 0").first()
    h = parse_header(first.value if first else None)
    body = lines.where("line > 0").select((F.col("line") - 1).alias("node"), F.trim("value").alias("value"))
    count = body.count()
    extra = body.where((F.col("node") >= h.nodes) & (F.col("value") != "")).limit(1).count()
    if count < h.nodes:
        raise BadGraphText("the file ends before the last vertex")
    if extra:
        raise BadGraphText("there are lines behind the last vertex")
    toks = F.when(F.col("value") == "", F.expr("cast(array() as array<bigint>)")).otherwise(F.transform(F.split("value", "\\s+"), lambda x: x.cast("bigint")))
    lead = int(h.sizes) + (h.ncon if h.weights else 0)
    rows = body.where(F.col("node") < h.nodes).select("node", toks.alias("t"))
    rows = materialize(rows, "dimacs")
    _check(rows.where(F.size("t") < lead), "a vertex size or weight is missing")
    if h.sizes:
        _check(rows.where(F.get("t", F.lit(0)) < 0), "vertex sizes must not be negative")
    if h.weights:
        _check(rows.where(F.exists(F.slice("t", int(h.sizes) + 1, h.ncon), lambda x: x < 0)), "vertex weights must not be negative")
    rest: Column = F.slice("t", lead + 1, F.greatest(F.size("t") - lead, F.lit(0)))
    rows = rows.withColumn("rest", rest)
    if h.edge_weights:
        _check(rows.where(F.size("rest") % 2 == 1), "an edge weight is missing")
        pairs = F.transform(F.sequence(F.lit(0), F.size("rest") - 2, F.lit(2)), lambda i: F.struct(F.get("rest", i).alias("d"), F.get("rest", i + 1).alias("w")))
        edges = rows.where(F.size("rest") > 1).select(F.col("node").alias("src"), F.explode(pairs).alias("e")).select("src", (F.col("e.d") - 1).alias("dst"), F.col("e.w").alias("weight"))
        _check(edges.where("weight <= 0"), "edge weights must be positive")
    else:
        edges = rows.select(F.col("node").alias("src"), F.explode("rest").alias("d")).select("src", (F.col("d") - 1).alias("dst"))
    _check(edges.where((F.col("dst") < 0) | (F.col("dst") >= h.nodes)), "a neighbour is out of range")
    found = edges.count()
    if found > 2 * h.edges:
        raise BadGraphText("there are more edges than the header says")
    if found != 2 * h.edges:
        raise BadGraphText(f"the header says {h.edges} edges, the file has {found / 2}")
    one = F.lit(1).cast("long")
    size = F.get("t", F.lit(0)) if h.sizes else one
    weight = F.slice("t", int(h.sizes) + 1, h.ncon) if h.weights else F.array(one)
    vertices = rows.select("node", size.alias("vsize"), weight.alias("vwgt"))
    return ParsedGraph(Graph(vertices.select("node"), edges), vertices, h)


def _check(bad: DataFrame, message: str) -> None:
    if not bad.isEmpty():
        raise BadGraphText(message)
