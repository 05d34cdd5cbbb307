"""Result verifiers: each returns one row with an explicit verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.operators.components import star_violations
from arcweave.operators.pagerank import top_ranks
from arcweave.runtime import dealt

RANK_TOLERANCE = 1e-2


def compare_values(got: DataFrame, expected: DataFrame, value: str) -> DataFrame:
    """(over, miss, errors, ok): values too high, too low or missing; unreached counts as infinite."""
    g = got.select("node", F.col(value).cast("double").alias("g"), F.lit(1).alias("has_g"))
    e = expected.select(F.col("node").alias("n"), F.col(value).cast("double").alias("e"), F.lit(1).alias("has_e"))
    inf = F.lit(float("inf"))
    j = g.join(e, F.col("node") == F.col("n"), "full").select("has_g", "has_e", F.coalesce("g", inf).alias("g"), F.coalesce("e", inf).alias("e"))
    lost = F.col("has_g").isNull() | F.col("has_e").isNull()
    over = F.count_if(~lost & (F.col("g") > F.col("e")))
    miss = F.count_if(lost | (F.col("g") < F.col("e")))
    return j.agg(over.alias("over"), miss.alias("miss")).select("over", "miss", (F.col("over") + F.col("miss")).alias("errors"), (F.col("over") + F.col("miss") == 0).alias("ok"))


def compare_ranks(got: DataFrame, expected: DataFrame, k: int = 10, tolerance: float = RANK_TOLERANCE) -> DataFrame:
    """(diffs, mean_diff, ok): top-k by position, node order not compared; the mean counts too."""
    a = top_ranks(got, k).select("position", F.col("rank").alias("a"))
    b = top_ranks(expected, k).select(F.col("position").alias("p"), F.col("rank").alias("b"))
    d = F.abs(F.col("a") - F.col("b"))
    j = a.join(b, F.col("position") == F.col("p"), "full")
    rel = F.coalesce(d / F.abs(F.col("b")), F.lit(1.0))
    return j.agg(F.count_if(rel > tolerance).alias("diffs"), F.coalesce(F.avg(d), F.lit(0.0)).alias("mean_diff")).select("diffs", "mean_diff", ((F.col("diffs") == 0) & (F.col("mean_diff") <= tolerance)).alias("ok"))


def check_star(labels: DataFrame) -> DataFrame:
    return star_violations(labels).withColumn("ok", (F.col("deep") == 0) & (F.col("upward") == 0))


def compare_bags(got: DataFrame, expected: DataFrame, rows: int = 0) -> DataFrame:
    """(extra, missing, ok) as multisets; ``rows`` of both together, if known and mostly distinct."""
    cols = got.columns
    side = lambda df, a, b: df.select(*cols, F.lit(a).cast("long").alias("__a"), F.lit(b).cast("long").alias("__b"))
    u = dealt(side(got, 1, 0).unionByName(side(expected, 0, 1)), cols, rows).groupBy(*cols).agg(F.sum("__a").alias("a"), F.sum("__b").alias("b"))
    return u.agg(
        F.coalesce(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))), F.lit(0)).alias("extra"), F.coalesce(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))), F.lit(0)).alias("missing")
    ).withColumn("ok", (F.col("extra") == 0) & (F.col("missing") == 0))


def compare_histograms(got: DataFrame, expected: DataFrame) -> DataFrame:
    """(over, miss, ok): bins counted too high and too low."""
    e = expected.select(F.col("bin").alias("b"), F.col("n").alias("m"))
    j = got.join(e, F.col("bin") == F.col("b"), "full").select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    return j.agg(F.count_if(F.col("n") > F.col("m")).alias("over"), F.count_if(F.col("n") < F.col("m")).alias("miss")).withColumn("ok", (F.col("over") == 0) & (F.col("miss") == 0))
