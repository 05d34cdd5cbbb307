"""The registered graph and dataflow queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.functions.predicates import add_constant, keep_with_pandas, kept_count, wave_on_host, wave_predicate
from arcweave.functions.predicates import keep as keep_values
from arcweave.graph import degrees, one_direction, stats
from arcweave.operators import components as cc
from arcweave.operators import frontier as wl
from arcweave.operators import pagerank as pr
from arcweave.operators import partition as pt
from arcweave.operators import routing as rt
from arcweave.operators import traversal as tv
from arcweave.operators import verify as vf
from arcweave.plans.fixtures import G1, G2, G3, G4, g1, g2, g2_pairs, g3, g4, g4_edges, table
from arcweave.runtime import materialize, shared_file
from arcweave.schema import INF
from arcweave.sources import generators as gen

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# ---------------------------------------------------------------- traversal

_BFS = """b(node, lvl) using key (node) as (
  select cast({seed} as bigint), cast(0 as bigint)
  union
  select g.dst, min(b.lvl) + 1 from b join g on g.src = b.node left join recurring.b r on r.node = g.dst where r.node is null group by g.dst)"""


def _bfs_sql(graph: str, seed: str, tail: str) -> str:
    return f"with recursive {graph},\n{_BFS.format(seed=seed)}\n{tail}"


@query(_bfs_sql(G1, "0", "select n.node, b.lvl as level from nodes n left join b on b.node = n.node"))
def q_bfs_levels(spark, d):
    return tv.bfs(g1(spark, d), 0)


@query(_bfs_sql(G1, "0", "select n.node, b.lvl as level from nodes n left join b on b.node = n.node"))
def q_bfs_priority(spark, d):
    """Breadth-first search with the frontier ordered by soft priority."""
    return tv.bfs(g1(spark, d), 0, delta=2)


@query(_bfs_sql(G1, "0", "select lvl as level, count(*) as n from b group by lvl"))
def q_bfs_level_histogram(spark, d):
    return tv.bfs(g1(spark, d), 0).where("level is not null").groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with recursive {G1},
lo(node, lvl) using key (node) as (
  select (select min(node) from nodes), cast(0 as bigint)
  union select g.dst, min(lo.lvl) + 1 from lo join g on g.src = lo.node left join recurring.lo r on r.node = g.dst where r.node is null group by g.dst),
hi(node, lvl) using key (node) as (
  select (select max(node) from nodes), cast(0 as bigint)
  union select g.dst, min(hi.lvl) + 1 from hi join g on g.src = hi.node left join recurring.hi r on r.node = g.dst where r.node is null group by g.dst)
select 'below' as source, lvl as level, count(*) as n from lo group by lvl union all select 'above', lvl, count(*) from hi group by lvl""")
def q_bfs_source_clamped(spark, d):
    one = lambda g, s, name: tv.bfs(g, s).where("level is not null").groupBy("level").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), "level", "n")
    with tv.kept_edges(g1(spark, d)) as g:
        return one(g, -5, "below").unionByName(one(g, 2**60, "above"))


@query(_bfs_sql(G4, "(select min(node) from nodes)", "select n.node, coalesce(cast(b.lvl as varchar), 'INF') as level from nodes n left join b on b.node = n.node"))
def q_bfs_unreachable(spark, d):
    return tv.bfs(g4(spark, d), -1).select("node", F.coalesce(F.col("level").cast("string"), F.lit(INF)).alias("level"))


_SSSP = """b(node, dist) using key (node) as (
  select cast(0 as bigint), cast(0 as bigint)
  union
  select c.dst, c.nd from (select g.dst, min(b.dist + {w}) as nd from b join g on g.src = b.node group by g.dst) c left join recurring.b r on r.node = c.dst where r.node is null or c.nd < r.dist)
select n.node, b.dist from nodes n left join b on b.node = n.node"""
_DIST = f"with recursive {G2},\n{_SSSP.format(w='g.w')}"


@query(_DIST)
def q_sssp_dist(spark, d):
    return tv.sssp(g2(spark, d), 0)


@query(f"with recursive {G2},\n{_SSSP.format(w='1')}")
def q_sssp_unit_weights(spark, d):
    g = g2(spark, d)
    return tv.sssp(type(g)(g.nodes, g.edges.select("src", "dst")), 0)


@query(_DIST)
def q_sssp_nearfar(spark, d):
    return tv.sssp_near_far(g2(spark, d), 0, delta=6)


@query(_DIST)
def q_sssp_priority(spark, d):
    return tv.sssp_priority(g2(spark, d), 0)


@query(_DIST)
def q_sssp_local_fused(spark, d):
    from arcweave.operators.fused import sssp_fused

    return sssp_fused(g2(spark, d), 0, parts=8)


# --------------------------------------------------------------- components

_CC = f"""with recursive {G4},
b(node, comp) using key (node) as (
  select node, node from nodes
  union
  select c.dst, c.m from (select g.dst, min(b.comp) as m from b join g on g.src = b.node group by g.dst) c join recurring.b r on r.node = c.dst where c.m < r.comp)
"""


@query(_CC + "select node, comp from b")
def q_cc_labels(spark, d):
    return cc.connected_components(g4(spark, d))


@query(_CC + "select count(*) filter (where node = comp) as components from b")
def q_cc_count(spark, d):
    return cc.component_count(cc.connected_components(g4(spark, d)))


@query(_CC + "select comp, count(*) as size from b group by comp")
def q_cc_sizes(spark, d):
    return cc.component_sizes(cc.connected_components(g4(spark, d)))


@query("select cast(0 as bigint) as deep, cast(0 as bigint) as upward, true as ok")
def q_cc_star_check(spark, d):
    return vf.check_star(cc.connected_components(g4(spark, d)))


@query(_CC + "select node, comp from b")
def q_cc_incremental(spark, d):
    g = g4(spark, d)
    early = materialize(cc.connected_components(g, g4_edges(spark, d, False)), "early")
    return cc.merge_components(g, early, g4_edges(spark, d, True))


@query(f"""with {G4}, one as (select n.node, least(n.node, coalesce(min(g.dst), n.node)) as comp from nodes n left join g on g.src = n.node group by n.node)
select a.node, b.comp from one a join one b on a.comp = b.node""")
def q_cc_hook_jump(spark, d):
    g = g4(spark, d)
    labels = g.nodes.select("node", F.col("node").alias("comp"))
    return cc.jump(cc.hook(labels, one_direction(g.edges)))


# ----------------------------------------------------------------- pagerank

_PR = f"""with recursive {G3},
deg as (select src, count(*) as deg from g group by src),
p as (
  select 0 as it, n.node, cast(0.15 as double) as rank, cast(0.15 as double) * 0.85 * coalesce((select sum(1.0 / deg.deg) from g join deg on deg.src = g.src where g.dst = n.node), 0) as res, true as act from nodes n
  union all
  select it, node, rank, res, res > 0.01 from (
    select p.it + 1 as it, p.node, p.rank + case when p.act then p.res else 0 end as rank, (case when p.act then 0 else p.res end) + coalesce(i.add, 0) as res
    from p left join (select g.dst, sum(q.res * 0.85 / deg.deg) as add from p q join g on g.src = q.node join deg on deg.src = g.src where q.act group by g.dst) i on i.dst = p.node
    where exists (select 1 from p x where x.act) and p.it < 201)),
r as (select node, rank from p where it = (select max(it) from p))
"""


@query(_PR + "select node, round(rank, 6) as rank from r")
def q_pr_ranks(spark, d):
    return pr.pagerank(g3(spark, d)).select("node", F.round("rank", 6).alias("rank"))


@query(_PR + "select position, node, rank from (select row_number() over (order by round(rank, 6) desc, node) as position, node, round(rank, 6) as rank from r) where position <= 10")
def q_pr_topk(spark, d):
    return pr.top_ranks(pr.pagerank(g3(spark, d)).select("node", F.round("rank", 6).alias("rank")))


@query(_PR + "select position, node, rank from (select row_number() over (order by round(rank, 6) desc, node desc) as position, node, round(rank, 6) as rank from r) where position <= 10")
def q_pr_topk_output(spark, d):
    return pr.top_ranks(pr.pagerank(g3(spark, d)).select("node", F.round("rank", 6).alias("rank")), for_output=True)


@query(_PR + "select node, round(rank / (select sum(rank) from r), 8) as rank_norm from r")
def q_pr_norm(spark, d):
    return pr.normalised(pr.pagerank(g3(spark, d))).select("node", F.round("rank_norm", 8).alias("rank_norm"))


@query(f"""with {G3}, deg as (select src, count(*) as deg from g group by src)
select n.node, round(coalesce(cast(0.1275 as double) * sum(1.0 / deg.deg), 0), 8) as residual from nodes n left join g on g.dst = n.node left join deg on deg.src = g.src group by n.node""")
def q_pr_init_residual(spark, d):
    return pr.init_residual(g3(spark, d)).select("node", F.round("residual", 8).alias("residual"))


# ----------------------------------------------------- degrees and partitions

_NODE_COUNT = "(select max(node) + 1 from nodes)"


@query(f"with {G1} select n.node, count(g.src) as degree from nodes n left join g on g.src = n.node group by n.node")
def q_degree(spark, d):
    return degrees(g1(spark, d))


_STATS = "select count(*) as nodes, cast(sum(d) as bigint) as edges, max(d) as max_degree, sum(d) / count(*) as avg_degree from (select n.node, count(g.src) as d from nodes n left join g on g.src = n.node group by n.node)"


@query(f"with {G1} {_STATS}")
def q_graph_stats(spark, d):
    return stats(g1(spark, d))


@query(f"with {G3} {_STATS}")
def q_graph_stats_directed(spark, d):
    return stats(g3(spark, d))


def _span(graph) -> int:
    return graph.nodes.agg((F.max("node") + 1).alias("n")).first().n


_SIZE = f"(select cast(ceil({_NODE_COUNT} / 4.0) as bigint))"


@query(f"with {G1}, c as (select {_SIZE} as size), x as (select distinct src // size as part, dst as node from g, c where src // size <> dst // size) select part, node from x")
def q_halos(spark, d):
    g = g1(spark, d)
    n = _span(g)
    return pt.halos(g.edges, lambda c: pt.block_of(c, n, 4))


@query(f"with {G1}, c as (select {_SIZE} as size), x as (select src // size as part, dst as node from g, c where src // size <> dst // size) select part, count(*) as total, count(distinct node) as distinct_nodes from x group by part")
def q_halo_counts(spark, d):
    g = g1(spark, d)
    n = _span(g)
    return pt.halo_counts(g.edges, lambda c: pt.block_of(c, n, 4))


@query(f"with {G1}, c as (select {_SIZE} as size) select node // size as part, min(node) as first, max(node) as last, count(*) as nodes from nodes, c group by 1")
def q_block_partition(spark, d):
    g = g1(spark, d)
    return pt.bounds(pt.block_partition(g, 4, _span(g)))


@query(f"""with {G1}, c as (select {_NODE_COUNT} as n), h as (
  select case when src >= n * 2 // 4 and src < n and dst >= n * 2 // 4 and dst < n
    then case when src >= n * 2 // 4 + (n - n * 2 // 4) // 2 and dst >= n * 2 // 4 + (n - n * 2 // 4) // 2 then 3 else 2 end
    else case when src >= (n * 2 // 4) // 2 and src < n * 2 // 4 and dst >= (n * 2 // 4) // 2 and dst < n * 2 // 4 then 1 else 0 end end as part from g, c)
select cast(part as bigint) as part, count(*) as edges from h group by part""")
def q_hier_partition(spark, d):
    g = g1(spark, d)
    n = _span(g)
    return g.edges.groupBy(pt.hierarchical_part(F.col("src"), F.col("dst"), 0, n, 4).alias("part")).agg(F.count(F.lit(1)).alias("edges"))


@query(f"with {G1} select node, node % 4 as part, row_number() over (order by node % 4, node) - 1 as new_node from nodes")
def q_relabel(spark, d):
    return pt.relabel(g1(spark, d).nodes.select("node", (F.col("node") % 4).alias("part"))).select("node", "part", "new_node")


@query(f"with {G1} select distinct least(src, dst) as src, greatest(src, dst) as dst from g")
def q_undirected_dedup(spark, d):
    g = g1(spark, d)
    return one_direction(g.edges, rows=g.rows)


@query(f"with {G3} select src, dst from g where src <= dst")
def q_direction_filter(spark, d):
    return one_direction(g3(spark, d).edges, strict=True)


@query(f"with {G4} select part, count(*) as nodes from (select cast(floor((row_number() over (order by node) - 1) / 1000) as bigint) as part from nodes) group by part")
def q_even_split(spark, d):
    return pt.even_split(g4(spark, d).nodes, 1000, ["node"]).groupBy(F.col("chunk").alias("part")).agg(F.count(F.lit(1)).alias("nodes"))


@query(f"with {G4} select count(*) as nodes, count(*) as placed, true as within_room, true as cut_no_worse from nodes")
def q_propagation_partition(spark, d):
    """What an assignment owes: every node once, no part above its room, no more cut edges than blocks of consecutive ids."""
    g = g4(spark, d)
    got = materialize(pt.propagation_partition(g, 4), "parts")
    n = g.nodes.count()
    blocks = pt.even_split(g.nodes, -(-n // 4), ["node"]).select("node", F.col("chunk").alias("part"))
    cut = lambda a: pt.cut_edges(g.edges, a).first().cut
    largest = got.groupBy("part").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first().n
    return got.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("node").alias("placed")).select("nodes", "placed", F.lit(largest <= int(1.2 * n / 4) + 1).alias("within_room"), F.lit(cut(got) <= cut(blocks)).alias("cut_no_worse"))


# ------------------------------------------------------------------ filters

_V = "select event_id as idx, value / 10.0 - floor(value / 10.0) - 0.5 as value from events"
_WAVE = "value >= sin(cos(exp(value) * sin(value)) / (cos((sin(value) + 3) / (exp(value) + 2)) + 4))"


def _values(spark, d) -> DataFrame:
    v = F.col("value") / 10.0
    return table(spark, d, "events").select(F.col("event_id").alias("idx"), (v - F.floor(v) - 0.5).alias("value"))


@query(f"select idx, round(value, 9) as value from ({_V}) where {_WAVE}")
def q_pbf_filter(spark, d):
    return keep_values(_values(spark, d), wave_predicate).select("idx", F.round("value", 9).alias("value"))


@query(f"select count(*) as kept from ({_V}) where {_WAVE}")
def q_pbf_count(spark, d):
    return kept_count(_values(spark, d), wave_predicate)


@query(f"select row_number() over (order by value, idx) - 1 as position, idx, round(value, 9) as value from ({_V}) where {_WAVE}")
def q_pbf_sorted(spark, d):
    from arcweave.operators.ordering import global_rank

    kept = materialize(keep_values(_values(spark, d), wave_predicate), "kept")
    return global_rank(kept, ["value", "idx"], "position").select("position", "idx", F.round("value", 9).alias("value"))


@query("select event_id as idx, event_id % 100 + 1 as v from events")
def q_add_constant(spark, d):
    return add_constant(table(spark, d, "events").select(F.col("event_id").alias("idx"), (F.col("event_id") % 100).alias("v")), "v", 1)


# --------------------------------------------------- routing and reductions


@query("select cast(sum(l_orderkey % 100) as bigint) as total from lineitem")
def q_scatter_sum(spark, d):
    items = table(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("v"))
    return rt.one_way_reduce(rt.scatter(items, 4), F.spark_partition_id(), "v")


@query("select l_partkey % 1000 as bin, count(*) as n from lineitem group by 1")
def q_histogram(spark, d):
    return rt.histogram(table(spark, d, "lineitem"), F.col("l_partkey") % 1000)


@query("select b.bin, count(l.l_partkey) as n from (select unnest(range(0, 2500)) as bin) b left join (select l_partkey from lineitem) l on l.l_partkey % 1000 = b.bin group by b.bin")
def q_histogram_dense(spark, d):
    return rt.dense_histogram(table(spark, d, "lineitem"), F.col("l_partkey") % 1000, 2500)


@query("select l_partkey % 1000 as bin, count(*) as n from lineitem group by 1")
def q_tree_merge_histogram(spark, d):
    lines = table(spark, d, "lineitem")
    parts = [rt.histogram(lines.where(F.col("l_orderkey") % 5 == i), F.col("l_partkey") % 1000) for i in range(5)]
    return rt.tree_reduce(parts, rt.merge_histograms)


@query("select (l_orderkey % 1024) // 256 as device, l_orderkey % 1024 as bin, count(*) as n from lineitem group by 1, 2")
def q_ring_histogram(spark, d):
    items = table(spark, d, "lineitem").select((F.col("l_orderkey") % 1024).alias("bin"))
    owner = F.floor(F.col("bin") / 256).cast("long")
    return rt.ring_exchange(items.withColumn("device", owner), F.col("device"), 4).groupBy("device", "bin").agg(F.count(F.lit(1)).alias("n"))


@query("select i as device, j as sends_to from (values (0, -1), (1, 0), (2, 0), (3, 2), (4, 0), (5, 4), (6, 4), (7, 6)) t(i, j)")
def q_tree_routing(spark, d):
    pairs = [(i, j) for i, to in rt.routing_table("tree", 8).items() for j in to]
    return spark.createDataFrame(pairs, "device int, sends_to int")


# ---------------------------------------------------------------- worklists


@query("select cast(sum(event_id % 100) as bigint) as total, count(*) as items, min(event_id % 100) filter (where event_id = 0) as first_value from events")
def q_worklist_append_prepend_sum(spark, d):
    ev = table(spark, d, "events").select("event_id", (F.col("event_id") % 100).alias("v"))
    front = wl.with_sequence(ev.where("event_id < 50"), ["event_id"])
    back = wl.with_sequence(ev.where("event_id >= 50"), ["event_id"])
    ring = wl.prepend_sequenced(back, front)
    return ring.agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("items"), F.min_by("v", "seq").alias("first_value"))


@query("select event_id from events where event_id >= 25")
def q_worklist_pop(spark, d):
    ring = wl.with_sequence(table(spark, d, "events").select("event_id"), ["event_id"])
    return wl.pop(ring, 25).select("event_id")


@query("select event_id from events order by event_id limit 40")
def q_worklist_first_segment(spark, d):
    return wl.first_items(wl.with_sequence(table(spark, d, "events").select("event_id"), ["event_id"]), 40).select("event_id")


@query("select distinct user_id as node from events")
def q_worklist_dedup(spark, d):
    return wl.dedup(table(spark, d, "events").select(F.col("user_id").alias("node")))


_ROUND = f"""with {G2}, s as (select node, case when node = 0 then 0 when node % 3 = 0 then 5 else null end as value from nodes),
c as (select g.dst as node, g.w as value from g)"""


def _candidates(spark, d):
    g = g2(spark, d)
    state = g.nodes.select("node", F.when(F.col("node") == 0, 0).when(F.col("node") % 3 == 0, 5).alias("value")).where("value is not null")
    items = g.edges.select(F.col("dst").alias("node"), F.col("weight").alias("value"))
    return items, state


@query(_ROUND + " select case when c.node % 4 <> 1 then 'pass' when s.value is null or c.value < s.value then 'take' else 'filter' end as action, count(*) as n from c join s on s.node = c.node group by 1")
def q_split_take_pass_filter(spark, d):
    items, state = _candidates(spark, d)
    ops = wl.SplitOps(improves=lambda new, old: new < old)
    return wl.split_received(items, state, F.col("node") % 4, F.lit(1), ops).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(_ROUND + " select case when node % 4 = 1 then 'take' else 'pass' end as action, cast(sum(value) as bigint) as total from c group by 1")
def q_split_send(spark, d):
    items, _ = _candidates(spark, d)
    return wl.split_to_send(items, F.col("node") % 4, F.lit(1), wl.SplitOps(improves=lambda a, b: a < b)).groupBy("action").agg(F.sum("value").alias("total"))


@query(_ROUND + " select case when value <= 12 then 'near' else 'far' end as bucket, count(*) as n, cast(sum(value) as bigint) as total from c group by 1")
def q_near_far_split(spark, d):
    items, _ = _candidates(spark, d)
    near, far = wl.near_far(items, "value", 12)
    one = lambda df, name: df.select(F.lit(name).alias("bucket"), "value")
    return one(near, "near").unionByName(one(far, "far")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query(_ROUND + " select case when value <= 20 then 'high' else 'low' end as bucket, count(*) as n from c group by 1")
def q_high_low_split(spark, d):
    items, _ = _candidates(spark, d)
    return wl.high_low(items, "value", 20).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(_ROUND + " select node, min(value) as value from c where node in (select node from nodes where node % 5 = 0) group by node")
def q_pack_pending(spark, d):
    items, _ = _candidates(spark, d)
    halo = g2(spark, d).nodes.where("node % 5 = 0")
    return wl.pack_pending(halo, items.groupBy("node").agg(F.min("value").alias("value")))


# --------------------------------------------------------------- generators

_DRAW = "((((({x}) % 2147483647) * 48271 + {inc}) % 2147483647) * 48271 + 12345) % 2147483647"


def _draw(x: str, salt: int = 0) -> str:
    return _DRAW.format(x=x, inc=12345 + salt)


@query("select i as src, j as dst from (select unnest(range(0, 1000)) as i), (values (-1), (1)) t(s), lateral (select i + s as j) where j >= 0 and j < 1000")
def q_gen_chain(spark, d):
    return gen.chain(spark, 1000).edges


@query("select i as src, j as dst from (select unnest(range(0, 999)) as i), (values (-1), (1)) t(s), lateral (select i + s as j) where j >= 0 and j < 999 and i // 333 = j // 333")
def q_gen_chain_segmented(spark, d):
    return gen.segmented_chain(spark, 1000, 3).edges


@query("select a as src, b as dst from (select unnest(range(0, 120)) as a), (select unnest(range(0, 120)) as b) where a <> b and a // 30 = b // 30")
def q_gen_cliques(spark, d):
    return gen.cliques(spark, 120, 4).edges


@query(f"""select node as src, (node + 1 + (({_draw('node', 1)}) + i * 1000003) % 4999) % 5000 as dst
from (select unnest(range(0, 5000)) as node), (select unnest(range(0, 10)) as i) where i < 1 + ({_draw('node')}) % 10""")
def q_gen_random(spark, d):
    return gen.random_graph(spark, 5000, 10).edges


@query(f"with {G1} select src, dst, 1 + ({_draw('src * 31 + dst * 17 + 7')}) % 100 as weight from g")
def q_gen_weights(spark, d):
    return gen.with_weights(g1(spark, d)).edges


# --------------------------------------------------- readers and verifiers


@query("with e as (select 2 * l_suppkey as src, 2 * l_partkey + 1 as dst, cast(min(l_quantity) as bigint) as weight from lineitem group by 1, 2) select src, dst, weight from e")
def q_gr_roundtrip(spark, d):
    from arcweave.sources.gr import read_gr, write_gr

    pairs = materialize(g2_pairs(spark, d), "pairs")
    n = pairs.agg((F.greatest(F.max("src"), F.max("dst")) + 1).alias("n")).first().n
    path = shared_file(spark, "g.gr")
    write_gr(pairs, n, path)
    back = materialize(read_gr(spark, path, 1000).edges, "back")
    found = vf.compare_bags(back, pairs, pairs.count() + back.count()).first()
    if not found.ok:
        raise ValueError(f"the round trip of G2 added {found.extra} edges and lost {found.missing}")
    return back


@query("select i as src, j as dst from (select unnest(range(0, 300)) as i), (values (-1), (1)) t(s), lateral (select i + s as j) where j >= 0 and j < 300")
def q_dimacs_parse(spark, d):
    from arcweave.sources.dimacs import read_dimacs

    path = shared_file(spark, "chain.graph")
    with open(path, "w") as f:
        f.write("% a chain\n300 299\n")
        for i in range(300):
            f.write(" ".join(str(j + 1) for j in (i - 1, i + 1) if 0 <= j < 300) + "\n")
    return read_dimacs(spark, path).graph.edges


@query(f"""with {G1}, n as (select count(distinct dst) as n from g where src = 0 and dst <> 0)
select 'as computed' as case, cast(0 as bigint) as over, cast(0 as bigint) as miss, cast(0 as bigint) as errors, true as ok
union all select 'with errors', n, 1, n + 1, false from n""")
def q_verify_levels(spark, d):
    """Levels against ordered shortest paths, as computed and with planted errors: level 1 raised, the source lowered."""
    with tv.kept_edges(g1(spark, d)) as g:
        got = materialize(tv.bfs(g, 0), "got")
        other = materialize(tv.sssp_priority(g, 0, delta=2).withColumnRenamed("dist", "level"), "other")
    wrong = got.select("node", F.when(F.col("level") == 1, 2).when(F.col("level") == 0, -1).otherwise(F.col("level")).alias("level"))
    named = lambda df, name: vf.compare_values(df, other, "level").select(F.lit(name).alias("case"), "over", "miss", "errors", "ok")
    return named(got, "as computed").unionByName(named(wrong, "with errors"))


@query("select 'as computed' as case, cast(0 as bigint) as diffs, true as ok union all select 'with errors', 10, false")
def q_verify_ranks(spark, d):
    """Ranks by synchronous rounds of residuals against multiplications with the whole link matrix, as computed and doubled."""
    g = g3(spark, d)
    ranks = materialize(pr.pagerank(g, epsilon=1e-4), "ranks")
    other = pr.power_ranks(g, epsilon=1e-4)
    named = lambda df, name: vf.compare_ranks(df, other).select(F.lit(name).alias("case"), "diffs", "ok")
    return named(ranks, "as computed").unionByName(named(ranks.withColumn("rank", F.col("rank") * 2), "with errors"))


@query("select cast(0 as bigint) as over, cast(0 as bigint) as miss, true as ok")
def q_verify_histogram(spark, d):
    lines = table(spark, d, "lineitem")
    parts = [rt.histogram(lines.where(F.col("l_linenumber") % 3 == i), F.col("l_partkey") % 1000) for i in range(3)]
    return vf.compare_histograms(rt.merge_histograms(parts), rt.histogram(lines, F.col("l_partkey") % 1000))


@query(f"with v as ({_V}) select 'as computed' as case, cast(0 as bigint) as extra, cast(0 as bigint) as missing, true as ok union all select 'with errors', count(*) filter (where not ({_WAVE})), count(*) filter (where {_WAVE} and value >= 0.25), false from v where value >= 0.25 or not ({_WAVE})")
def q_verify_filter(spark, d):
    """The filter against numpy's value of the same formula, as computed and with the large values lost and the rejected ones kept."""
    v = _values(spark, d)
    got, other = materialize(keep_values(v, wave_predicate).select("value"), "got"), keep_with_pandas(v, wave_on_host).select("value")
    rejected = v.where(~wave_predicate(F.col("value"))).select("value")
    named = lambda df, name: vf.compare_bags(df, other).select(F.lit(name).alias("case"), "extra", "missing", "ok")
    return named(got, "as computed").unionByName(named(got.where("value < 0.25").unionByName(rejected), "with errors"))


@query("select cast(sum(event_id % 100) as bigint) as total from events")
def q_streamed_sum(spark, d):
    from arcweave.runtime import scratch_root
    from arcweave.streaming.chunks import chunks, streamed_sum

    src = table(spark, d, "events").select((F.col("event_id") % 100).alias("v")).repartition(4)
    import uuid

    name = uuid.uuid4().hex
    path = f"{scratch_root(spark)}/chunks-{name}"
    src.write.parquet(path)
    return spark.createDataFrame([(streamed_sum(chunks(spark, path, src.schema), "v", name),)], "total long")
