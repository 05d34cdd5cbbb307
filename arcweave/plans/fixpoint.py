"""Delta iteration: the loop under breadth-first search, shortest paths and their ordered variants.

A round joins the frontier with the edges, combines candidates by destination
(partial aggregate), joins them with the state and keeps improvements. Only the
improvements are written, as one small table in the shared folder; the state is
the set of these tables, merged every ``compact`` rounds. Edges are dealt by
source once, sorted by it and persisted with their lineage (a lost block is dealt
again from the source tables), so a round moves only its frontier and skips the
blocks of edges outside the frontier's range of ids. Writing is also the round's
single action: row count and range are observed by it, and no rows end the loop.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.runtime import TASK_ROWS, discard, materialize, materialize_counted


@dataclass
class FixpointSpec:
    """The extension point: how a value crosses an edge, combines, and improves.

    ``expand(value, weight)`` is the candidate, ``combine`` an aggregate,
    ``improves(candidate, state)`` tells whether it replaces the state.
    """

    expand: Callable[[Column, Column], Column]
    combine: Callable[[Column], Column] = F.min
    improves: Callable[[Column, Column], Column] = lambda new, old: new < old
    name: str = "fixpoint"


@dataclass
class Stop:
    """Stopping conditions: a round limit, a time limit, or none; an empty frontier always ends the loop."""

    rounds: int | None = None
    seconds: float | None = None
    began: float = field(default_factory=time.monotonic)

    def now(self, done: int) -> bool:
        return (self.rounds is not None and done >= self.rounds) or (self.seconds is not None and time.monotonic() - self.began > self.seconds)


def _merge(parts: list[DataFrame], combine) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("node").agg(combine(F.col("value")).alias("value"))


def deal(edges: DataFrame) -> DataFrame:
    """Edges as the loop wants them; the caller unpersists them."""
    return edges.select("src", "dst", "weight").repartition("src").sortWithinPartitions("src").persist()


def _span(wanted=None) -> dict:
    """Measures of the rows that are ``wanted``: number and range of ids."""
    node = F.col("node") if wanted is None else F.when(wanted, F.col("node"))
    return {"size": F.count(node), "lo": F.min(node), "hi": F.max(node)}


def fixpoint(spec: FixpointSpec, edges: DataFrame, seed: DataFrame, stop: Stop | None = None, delta: float | None = None, threshold: float | None = None, compact: int = 6, metrics: list | None = None, kept: DataFrame | None = None) -> DataFrame:
    """(node, value) of all reached nodes. seed(node, value); edges(src, dst, weight), or ``kept`` as :func:`deal` left them.

    With ``delta`` the frontier is split by value: up to the threshold it is worked
    on, the rest waits. When nothing is left below the threshold, the threshold
    rises by ``delta`` and everything that waited becomes the frontier.
    """
    stop = stop or Stop()
    edges = deal(edges) if kept is None else kept
    frontier, seen = materialize_counted(seed.select("node", "value"), spec.name, **_span())
    parts, waiting = [frontier], []
    limit = threshold if threshold is not None else delta
    done, size = 0, seen["size"]
    while size and not stop.now(done):
        work = frontier.select(F.col("node").alias("at"), "value")
        near_edges = edges.where(F.col("src").between(seen["lo"], seen["hi"]))
        reached = work.join(near_edges, F.col("at") == F.col("src")).select(F.col("dst").alias("to"), spec.expand(F.col("value"), F.col("weight")).alias("v"))
        if size <= TASK_ROWS:  # each of many tasks would open a file for each of many others
            reached = reached.coalesce(2 * reached.sparkSession.sparkContext.defaultParallelism)
        cand = reached.groupBy("to").agg(spec.combine(F.col("v")).alias("v"))
        state = (parts[0] if len(parts) == 1 else _merge(parts, spec.combine)).select(F.col("node").alias("known"), F.col("value").alias("old"))
        better = cand.join(state, F.col("to") == F.col("known"), "left").where(F.col("old").isNull() | spec.improves(F.col("v"), F.col("old")))
        wanted = None if delta is None else F.col("value") <= limit
        accepted, seen = materialize_counted(better.select(F.col("to").alias("node"), F.col("v").alias("value")), spec.name, **_span(wanted))
        got = seen["rows"]
        done += 1
        if metrics is not None:
            metrics.append({"round": done, "frontier": size, "accepted": got, "waiting": len(waiting)})
        if got:
            parts.append(accepted)
        if delta is None:
            frontier, size = accepted, got
        else:
            frontier, size = accepted.where(F.col("value") <= limit), seen["size"]
            waiting.append(accepted.where(F.col("value") > limit))
            if not size:
                limit += delta
                held = waiting[0]
                for w in waiting[1:]:
                    held = held.unionByName(w)
                frontier, seen = materialize_counted(held.groupBy("node").agg(spec.combine(F.col("value")).alias("value")), spec.name, **_span())
                size, waiting = seen["size"], []
        if len(parts) >= compact:
            merged = materialize(_merge(parts, spec.combine), spec.name)
            if delta is None:
                discard(*[p for p in parts if p is not frontier])
            parts = [merged]
    if kept is None:
        edges.unpersist()
    return parts[0] if len(parts) == 1 else _merge(parts, spec.combine)
