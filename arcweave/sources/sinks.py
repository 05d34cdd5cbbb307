"""Text outputs: levels and distances by node, ranks with their header."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.operators.pagerank import ALPHA, EPSILON, normalised, top_ranks
from arcweave.schema import INF


def node_lines(df: DataFrame, value: str) -> DataFrame:
    """(value): ``node value`` in node order, INF where the value is null."""
    return df.orderBy("node").select(F.concat_ws(" ", F.col("node").cast("string"), F.coalesce(F.col(value).cast("string"), F.lit(INF))).alias("value"))


def write_node_values(df: DataFrame, value: str, path: str) -> None:
    """Sorted text parts below ``path``; their order is the node order."""
    node_lines(df, value).write.text(path)


def rank_lines(ranks: DataFrame, k: int = 10, print_ranks: bool = False, alpha: float = ALPHA, epsilon: float = EPSILON) -> list[str]:
    """Header and the k best, with the normalised rank if asked."""
    n = ranks.count()
    best = top_ranks(normalised(ranks).select("node", F.col("rank_norm").alias("rank")), k, for_output=True).orderBy("position").collect()
    head = [f"ALPHA {alpha} EPSILON {epsilon}", f"RANKS 1--{len(best)} of {n}"]
    return head + [f"{r.position} {r.node}" + (f" {r.rank:.6g}" if print_ranks else "") for r in best]
