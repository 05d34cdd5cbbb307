"""Shortest paths with partition-local fixpoints: many relaxations between two exchanges.

Nodes are dealt into hash parts with their edges. A round lets every part relax
its own frontier until nothing changes inside it, and only then sends candidates
to other parts. Long paths inside a part cost one round. The number of parts
follows the number of edges, so a part holds some ``PART_EDGES`` of them. A round
reads only the edges whose source is in the id range of its frontier; what is
reached inside a part but outside that range is sent as to another part.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.graph import Graph
from arcweave.operators.traversal import clamp_source
from arcweave.runtime import discard, materialize, materialize_counted

PART_EDGES = 400_000


def _relax(work: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """work(part, node, dist, fresh), edges(src, dst, weight, stays): local distances and outgoing candidates."""
    empty = pd.DataFrame({"node": np.zeros(0, np.int64), "dist": np.zeros(0, np.int64), "kind": np.zeros(0, np.int32)})
    if not len(work):
        return empty
    dist: dict[int, int] = {}
    queue: list[tuple[int, int]] = []
    for n, v, fresh in zip(work["node"], work["dist"], work["fresh"], strict=True):
        if v < dist.get(n, 1 << 62):
            dist[n] = v
        if fresh:
            queue.append((int(v), int(n)))
    before = dict(dist) if queue else {}
    edges = edges.sort_values("src", kind="stable")
    src = edges["src"].to_numpy()
    dst, weight, stays = edges["dst"].to_numpy(), edges["weight"].to_numpy(), edges["stays"].to_numpy()
    out: dict[int, int] = {}
    heapq.heapify(queue)
    moved = {n for _, n in queue}
    while queue:
        v, n = heapq.heappop(queue)
        if v > dist.get(n, 1 << 62):
            continue
        a, z = np.searchsorted(src, [n, n + 1])
        for i in range(a, z):
            c, t = v + int(weight[i]), int(dst[i])
            if stays[i]:
                if c < dist.get(t, 1 << 62):
                    dist[t] = c
                    moved.add(t)
                    heapq.heappush(queue, (c, t))
            elif c < out.get(t, 1 << 62):
                out[t] = c
    own = [(n, dist[n], 0) for n in moved if n not in before or dist[n] <= before[n]]
    rows = own + [(n, v, 1) for n, v in out.items()]
    return pd.DataFrame(rows, columns=["node", "dist", "kind"]).astype({"node": "int64", "dist": "int64", "kind": "int32"}) if rows else empty


def sssp_fused(graph: Graph, source: int = 0, parts: int = 64, max_rounds: int = 10_000) -> DataFrame:
    """(node, dist) as :func:`sssp` gives it; ``parts`` or, in a large graph, more."""
    edges = graph.weights()
    parts = max(parts, -(-edges.count() // PART_EDGES))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("long")
    edges = edges.select(part(F.col("src")).alias("part"), "src", "dst", "weight", part(F.col("dst")).alias("to")).repartition("part").sortWithinPartitions("part", "src").persist()
    span = {"lo": F.min("node"), "hi": F.max("node")}
    frontier = graph.nodes.where(F.col("node") == clamp_source(graph, source)).select("node", F.lit(0).cast("long").alias("dist"))
    frontier, seen = materialize_counted(frontier, "fused", **span)
    state = frontier
    for _ in range(max_rounds):
        if not seen["rows"]:
            break
        inside = lambda c: F.col(c).between(seen["lo"], seen["hi"])  # noqa: B023, E731
        old = state.where(inside("node")).join(frontier.select(F.col("node").alias("n")), F.col("node") == F.col("n"), "left_anti").withColumn("fresh", F.lit(False))
        work = old.unionByName(frontier.withColumn("fresh", F.lit(True))).withColumn("part", part(F.col("node")))
        near = edges.where(inside("src")).select("part", "src", "dst", "weight", ((F.col("to") == F.col("part")) & inside("dst")).alias("stays"))
        done = materialize(work.groupBy("part").cogroup(near.groupBy("part")).applyInPandas(_relax, "node long, dist long, kind int"), "fused")
        known = materialize(state.unionByName(done.where("kind = 0").select("node", "dist")).groupBy("node").agg(F.min("dist").alias("dist")), "fused")
        cand = done.where("kind = 1").groupBy("node").agg(F.min("dist").alias("dist"))
        better = cand.join(known.select(F.col("node").alias("n"), F.col("dist").alias("old")), F.col("node") == F.col("n"), "left").where("old is null or dist < old")
        discard(frontier if frontier is not state else None)
        frontier, seen = materialize_counted(better.select("node", "dist"), "fused", **span)
        after = materialize(known.unionByName(frontier).groupBy("node").agg(F.min("dist").alias("dist")), "fused")
        discard(state, known, done)
        state = after
    else:
        if seen["rows"]:
            edges.unpersist()
            raise RuntimeError(f"distances did not settle in {max_rounds} rounds")
    edges.unpersist()
    r = state.select(F.col("node").alias("n"), "dist")
    return graph.nodes.join(r, F.col("node") == F.col("n"), "left").select("node", "dist")
