"""Graphs over the driver's tables, each as DataFrames and as SQL common table expressions.

G1 entity: customers, orders and parts. G2 supply: weighted. G3 click: directed,
with sinks. G4 fragments: many components. Ids are interleaved by entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.graph import Graph, undirected
from arcweave.operators.ordering import with_next
from arcweave.runtime import dealt, materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ids(df: DataFrame, key: str, step: int, offset: int) -> DataFrame:
    return df.select((F.col(key).cast("long") * step + offset).alias("node"))


def g1(spark: SparkSession, sf_dir: str) -> Graph:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    a = orders.select((F.col("o_custkey") * 3).alias("src"), (F.col("o_orderkey") * 3 + 1).alias("dst"))
    b = lines.select((F.col("l_orderkey") * 3 + 1).alias("src"), (F.col("l_partkey") * 3 + 2).alias("dst"))
    nodes = _ids(table(spark, sf_dir, "customer"), "c_custkey", 3, 0).union(_ids(orders, "o_orderkey", 3, 1)).union(_ids(table(spark, sf_dir, "part"), "p_partkey", 3, 2))
    rows = orders.count() + lines.count()
    return Graph(nodes, undirected(dealt(a.union(b), ["src", "dst"], rows).distinct()), 2 * rows)


G1 = """e as (select 3 * o_custkey as a, 3 * o_orderkey + 1 as b from orders union select 3 * l_orderkey + 1, 3 * l_partkey + 2 from lineitem),
g as (select a as src, b as dst from e union all select b, a from e),
nodes as (select 3 * c_custkey as node from customer union all select 3 * o_orderkey + 1 from orders union all select 3 * p_partkey + 2 from part)"""


def g2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    items = lines.select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"), "l_quantity")
    return dealt(items, ["src", "dst"], lines.count()).groupBy("src", "dst").agg(F.min("l_quantity").cast("long").alias("weight"))


def g2(spark: SparkSession, sf_dir: str) -> Graph:
    """Pairs and nodes are tables: a traversal reads each of them several times."""
    pairs = materialize(g2_pairs(spark, sf_dir), "pairs")
    return Graph(materialize(Graph.of_edges(pairs).nodes, "nodes"), undirected(pairs))


G2 = """e as (select 2 * l_suppkey as a, 2 * l_partkey + 1 as b, cast(min(l_quantity) as bigint) as w from lineitem group by 1, 2),
g as (select a as src, b as dst, w from e union all select b, a, w from e),
nodes as (select distinct src as node from g)"""


def g3(spark: SparkSession, sf_dir: str) -> Graph:
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id", "event_type")
    nxt = with_next(events, ["ts", "event_id"], "user_id", "dst")
    e = nxt.where("dst is not null and event_type in ('click', 'purchase') and user_id % 10 <> 0").select(F.col("user_id").alias("src"), "dst").distinct()
    return Graph(materialize(events.select(F.col("user_id").alias("node")).distinct(), "nodes"), materialize(e, "edges"))


G3 = """ev as (select user_id, event_type, lead(user_id) over (order by ts, event_id) as nxt from events),
g as (select distinct user_id as src, nxt as dst from ev where nxt is not null and event_type in ('click', 'purchase') and user_id % 10 <> 0),
nodes as (select distinct user_id as node from events)"""


def g4_edges(spark: SparkSession, sf_dir: str, odd_lines: bool | None = None) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 48")
    if odd_lines is not None:
        lines = lines.where(F.col("l_linenumber") % 2 == int(odd_lines))
    return lines.select((F.col("l_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).distinct()


def g4(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.of_edges(undirected(g4_edges(spark, sf_dir)))


G4 = """e as (select distinct 2 * l_orderkey as a, 2 * l_partkey + 1 as b from lineitem where l_quantity >= 48),
g as (select a as src, b as dst from e union all select b, a from e),
nodes as (select distinct src as node from g)"""
