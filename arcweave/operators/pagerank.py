"""PageRank by synchronous residual push.

Every node starts with rank 1 - alpha and the residual that its in-neighbours
push first. A round moves the residual of active nodes (above epsilon) into
their rank and pushes alpha * residual / out-degree along their edges. A sink
absorbs what it receives. Ranks are not normalised except where asked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcweave.graph import Graph
from arcweave.runtime import discard, materialize, materialize_counted, task_parts

ALPHA, EPSILON, MAX_ITERATIONS = 0.85, 0.01, 200


def _out(graph: Graph) -> DataFrame:
    """edges(src, dst, deg) with the source's out-degree, dealt by source."""
    deg = graph.edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg")).withColumnRenamed("src", "s")
    return graph.edges.select("src", "dst").join(deg, F.col("src") == F.col("s")).select("src", "dst", "deg")


def _dealt(graph: Graph) -> DataFrame:
    """:func:`_out` dealt by source and persisted, in as many parts as the edges need: a round costs a file for each pair of parts."""
    n = max(graph.edges.sparkSession.sparkContext.defaultParallelism, task_parts(graph.edges.count()))
    return _out(graph).repartition(n, "src").persist()


def init_residual(graph: Graph, alpha: float = ALPHA) -> DataFrame:
    """(node, residual) before the first round."""
    first = (1 - alpha) * alpha
    push = _out(graph).groupBy("dst").agg(F.sum(F.lit(1.0) / F.col("deg")).alias("p"))
    return graph.nodes.join(push, F.col("node") == F.col("dst"), "left").select("node", (F.lit(first) * F.coalesce("p", F.lit(0.0))).alias("residual"))


def pagerank(graph: Graph, alpha: float = ALPHA, epsilon: float = EPSILON, max_iterations: int = MAX_ITERATIONS, metrics: list | None = None) -> DataFrame:
    """(node, rank) of all nodes."""
    edges = _dealt(graph)
    state = materialize(init_residual(graph, alpha).select("node", F.lit(1 - alpha).alias("rank"), F.col("residual").alias("res"), F.lit(True).alias("act")), "pr")
    for i in range(max_iterations + 1):
        hot = state.where("act and res > 0").select(F.col("node").alias("n"), "res")
        push = hot.join(edges, F.col("n") == F.col("src")).groupBy("dst").agg(F.sum(F.col("res") * F.lit(alpha) / F.col("deg")).alias("add"))
        rest = F.when(F.col("act"), F.lit(0.0)).otherwise(F.col("res")) + F.coalesce("add", F.lit(0.0))
        moved = state.join(push, F.col("node") == F.col("dst"), "left").select("node", (F.col("rank") + F.when(F.col("act"), F.col("res")).otherwise(F.lit(0.0))).alias("rank"), rest.alias("res"))
        nxt, seen = materialize_counted(moved.withColumn("act", F.col("res") > epsilon), "pr", active=F.count_if(F.col("act")))
        active = seen["active"]
        discard(state)
        state = nxt
        if metrics is not None:
            metrics.append({"round": i + 1, "active": active})
        if not active:
            break
    edges.unpersist()
    return state.select("node", "rank")


def power_ranks(graph: Graph, alpha: float = ALPHA, epsilon: float = EPSILON, max_iterations: int = MAX_ITERATIONS, steps: int = 5) -> DataFrame:
    """(node, rank) by whole multiplications with the link matrix: no residuals, no active nodes, so a check of :func:`pagerank`.

    From 1 - alpha upwards ranks only grow, and a step takes 1 - alpha off the
    missing sum at least. So the growth of the sum over ``steps`` steps, which
    are one job, bounds what is missing; the mean error ends below ``epsilon``.
    """
    edges = _dealt(graph)
    base = graph.nodes.select("node", F.lit(1 - alpha).alias("rank"))
    state, seen = materialize_counted(base, "power", total=F.sum("rank"))
    left = alpha**steps / (1 - alpha**steps)
    for _ in range(0, max_iterations if seen["rows"] else 0, steps):
        cur = state
        for _ in range(steps):
            push = cur.select(F.col("node").alias("n"), "rank").join(edges, F.col("n") == F.col("src")).select(F.col("dst").alias("node"), (F.col("rank") * F.lit(alpha) / F.col("deg")).alias("rank"))
            cur = base.unionByName(push).groupBy("node").agg(F.sum("rank").alias("rank"))
        nxt, now = materialize_counted(cur, "power", total=F.sum("rank"))
        discard(state)
        state, grown, seen = nxt, now["total"] - seen["total"], now
        if grown * left <= epsilon * now["rows"]:
            break
    else:
        if seen["rows"]:
            edges.unpersist()
            raise RuntimeError(f"ranks did not settle in {max_iterations} steps")
    edges.unpersist()
    return state


def normalised(ranks: DataFrame) -> DataFrame:
    """(node, rank, rank_norm): rank over the sum of ranks."""
    total = ranks.agg(F.sum("rank").alias("total")).first().total or 1.0
    return ranks.select("node", "rank", (F.col("rank") / F.lit(total)).alias("rank_norm"))


def top_ranks(ranks: DataFrame, k: int = 10, for_output: bool = False) -> DataFrame:
    """(position, node, rank), best first. Equal ranks: the lower node first, or the higher one ``for_output``."""
    tie = F.desc("node") if for_output else F.asc("node")
    best = ranks.orderBy(F.desc("rank"), tie).limit(k)
    return best.withColumn("position", F.row_number().over(Window.orderBy(F.desc("rank"), tie)).cast("long")).select("position", "node", "rank")
