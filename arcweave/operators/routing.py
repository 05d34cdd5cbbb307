"""Exchange patterns and reductions over partitioned tables.

Links between devices become shuffles: a route is the expression that names a
row's destination. Reductions are aggregates, which Spark combines before it
shuffles; the tree form adds explicit levels for many partial tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def scatter(df: DataFrame, parts: int) -> DataFrame:
    """Rows to any free receiver: round robin."""
    return df.repartition(parts)


def scatter_by(df: DataFrame, route: Column, parts: int) -> DataFrame:
    """Rows to the receiver that an expression names."""
    return df.repartition(parts, route)


def gather(df: DataFrame, limit: int | None = None) -> DataFrame:
    """All rows in one partition; ``limit`` bounds what may be gathered."""
    return (df.limit(limit) if limit is not None else df).coalesce(1)


def broadcast_to_all(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A copy for every receiver, only if the table has at most ``max_rows`` rows; else it is left to a shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def point_to_point(df: DataFrame) -> DataFrame:
    """One sender, one receiver: a narrow dependency, so nothing moves."""
    return df


def ring_exchange(items: DataFrame, owner: Column, parts: int) -> DataFrame:
    """Every item reaches its owner: one shuffle in place of n - 1 hops."""
    return items.repartition(parts, owner)


def total(df: DataFrame, col: str, out: str = "total") -> DataFrame:
    return df.agg(F.sum(F.col(col).cast("long")).alias(out))


def one_way_reduce(df: DataFrame, device: Column, value: str) -> DataFrame:
    """(device, partial) of every device, then their sum: one row with total."""
    return df.groupBy(device.alias("device")).agg(F.sum(value).alias("partial")).agg(F.sum("partial").alias("total"))


def histogram(df: DataFrame, bin_: Column) -> DataFrame:
    """(bin, n) of the bins that occur."""
    return df.groupBy(bin_.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def dense_histogram(df: DataFrame, bin_: Column, bins: int, offset: int = 0) -> DataFrame:
    """(bin, n) of all bins offset..offset+bins-1, zeros included."""
    all_bins = df.sparkSession.range(offset, offset + bins).select(F.col("id").alias("b"))
    h = histogram(df, bin_)
    return all_bins.join(h, F.col("b") == F.col("bin"), "left").select(F.col("b").alias("bin"), F.coalesce("n", F.lit(0)).alias("n"))


def merge_histograms(parts: list[DataFrame]) -> DataFrame:
    """Sum of partial histograms."""
    return reduce(DataFrame.unionByName, parts).groupBy("bin").agg(F.sum("n").alias("n"))


def tree_reduce(parts: list[DataFrame], merge) -> DataFrame:
    """Pairs with doubling stride until one table is left."""
    parts = list(parts)
    while len(parts) > 1:
        parts = [merge(parts[i : i + 2]) if len(parts[i : i + 2]) > 1 else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def routing_table(policy: str, devices: int) -> dict[int, list[int]]:
    """Who may send to whom; -1 is the host."""
    n = range(devices)
    if policy == "broadcast":
        return {-1: list(n)}
    if policy == "scatter":
        return {-1: list(n)}
    if policy == "gather":
        return {i: [-1] for i in n}
    if policy == "one-way":
        return {i: (list(range(i)) if i else [-1]) for i in n}
    if policy == "ring":
        return {i: [(i + 1) % devices] for i in n} | {-1: list(n)}
    if policy == "tree":
        table, stride = {0: [-1]}, 1
        while stride < devices:
            for i in range(stride, devices, 2 * stride):
                table[i] = [i - stride]
            stride *= 2
        return table
    if policy == "p2p":
        return {0: [1]} if devices > 1 else {}
    raise ValueError(f"unknown policy {policy}")
