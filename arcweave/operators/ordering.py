"""Order over a whole table without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcweave.runtime import materialize


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows dealt by ranges of the order columns; the dealing is kept, so later plans agree on it."""
    return materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")


def global_rank(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """0-based position of each row in the total order; ties take any order among themselves."""
    r = _ranged(df, order)
    counts = r.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return r.withColumn("__rn", inner).join(F.broadcast(offsets), F.col("__part") == F.col("__p")).withColumn(out, (F.col("__rn") + F.col("__off")).cast("long")).drop("__rn", "__p", "__off", "__part")


def with_next(df: DataFrame, order: list[str], carry: str, out: str, wrap: bool = False) -> DataFrame:
    """``out``: column ``carry`` of the next row in the total order; at the end null, or the first row's with ``wrap``."""
    r = _ranged(df, order)
    inner = F.lead(F.struct(F.col(carry).alias("v"))).over(Window.partitionBy("__part").orderBy(*order))
    heads = r.groupBy("__part").agg(F.min_by(F.struct(F.col(carry).alias("v")), F.struct(*order)).alias("h"))
    by = Window.orderBy("__part")
    after = F.lead("h").over(by)
    links = heads.select(F.col("__part").alias("__p"), (F.coalesce(after, F.first("h").over(by)) if wrap else after).alias("__after"))
    return r.withColumn("__next", inner).join(F.broadcast(links), F.col("__part") == F.col("__p")).withColumn(out, F.coalesce("__next", "__after")["v"]).drop("__next", "__p", "__after", "__part")
