"""Worklist algebra: a worklist is a bag of items; order, where it matters, is a ``seq`` column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SplitOps:
    """Column builders that steer an exchange: what is kept on receipt, what is packed on sending."""

    improves: Callable[[Column, Column], Column]
    pack: Callable[[Column], Column] = lambda v: v
    unpack: Callable[[Column], Column] = lambda v: v
    is_high: Callable[[Column, Column], Column] = lambda v, limit: v <= limit


def append(bag: DataFrame, items: DataFrame) -> DataFrame:
    """Duplicates are kept."""
    return bag.unionByName(items)


def with_sequence(items: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """Items numbered from ``start`` in the given order."""
    from arcweave.operators.ordering import global_rank

    return global_rank(items, order, "seq").withColumn("seq", F.col("seq") + start)


def _edge(items: DataFrame, agg) -> int | None:
    """The first or last sequence number: one number to the driver."""
    return items.agg(agg("seq").alias("x")).first().x


def append_sequenced(ring: DataFrame, items: DataFrame) -> DataFrame:
    """Items behind the last of the ring; both have seq."""
    last, first = _edge(ring, F.max), _edge(items, F.min)
    shift = (0 if last is None else last + 1) - (first or 0)
    return ring.unionByName(items.withColumn("seq", F.col("seq") + shift))


def prepend_sequenced(ring: DataFrame, items: DataFrame) -> DataFrame:
    """Items before the first of the ring: they get the sequence numbers below it."""
    head, last = _edge(ring, F.min), _edge(items, F.max)
    return items.withColumn("seq", F.col("seq") + ((head or 0) - 1 - (last or 0))).unionByName(ring)


def pop(ring: DataFrame, n: int) -> DataFrame:
    """The ring without its first n items."""
    return ring.where(F.col("seq") >= (_edge(ring, F.min) or 0) + n)


def first_items(ring: DataFrame, n: int) -> DataFrame:
    """The first n items: a bounded head segment."""
    return ring.orderBy("seq").limit(n)


def length(bag: DataFrame) -> DataFrame:
    return bag.agg(F.count(F.lit(1)).alias("length"))


def segments(ring: DataFrame, capacity: int) -> DataFrame:
    """(segment, items) of a ring of ``capacity`` cells: 0, 1 or 2 rows, split where it wraps."""
    return ring.groupBy((F.floor(F.col("seq") / capacity)).alias("lap")).agg(F.count(F.lit(1)).alias("items")).withColumn("segment", F.row_number().over(Window.orderBy("lap")) - 1).select("segment", "items")


def reset(bag: DataFrame) -> DataFrame:
    return bag.limit(0)


def consume_sum(bag: DataFrame, col: str) -> DataFrame:
    return bag.agg(F.coalesce(F.sum(col), F.lit(0)).alias("total"))


def dedup(bag: DataFrame, key: str = "node") -> DataFrame:
    """One item per node, as a mark bitmap would leave."""
    return bag.dropDuplicates([key])


def split_received(items: DataFrame, state: DataFrame, owner: Column, me: Column, ops: SplitOps) -> DataFrame:
    """items(node, value) with ``action``: pass if another owns it, take if it improves the state, else filter."""
    s = state.select(F.col("node").alias("__n"), F.col("value").alias("__old"))
    joined = items.join(s, F.col("node") == F.col("__n"), "left")
    act = F.when(owner != me, "pass").when(F.col("__old").isNull() | ops.improves(ops.unpack(F.col("value")), F.col("__old")), "take").otherwise("filter")
    return joined.withColumn("action", act).drop("__n", "__old")


def split_to_send(items: DataFrame, owner: Column, me: Column, ops: SplitOps) -> DataFrame:
    """Packed items with ``action`` take (own) or pass (another's)."""
    return items.select("node", ops.pack(F.col("value")).alias("value"), F.when(owner == me, "take").otherwise("pass").alias("action"))


def near_far(items: DataFrame, value: str, delta: float) -> tuple[DataFrame, DataFrame]:
    return items.where(F.col(value) <= delta), items.where(F.col(value) > delta)


def high_low(items: DataFrame, value: str, priority: float) -> DataFrame:
    """items with ``bucket`` high or low by the priority threshold."""
    return items.withColumn("bucket", F.when(F.col(value) <= priority, "high").otherwise("low"))


def pack_pending(halos: DataFrame, pending: DataFrame) -> DataFrame:
    """The halo nodes that have a pending value, packed as (node, value)."""
    return pending.join(halos.select("node").distinct(), "node", "left_semi").select("node", "value")


def take_pending(state: DataFrame, active: Column) -> tuple[DataFrame, DataFrame]:
    """Swap and take: (items taken, state with the taken values at 0); state(node, value)."""
    return state.where(active).select("node", "value"), state.withColumn("value", F.when(active, F.lit(0).cast(state.schema["value"].dataType)).otherwise(F.col("value")))
