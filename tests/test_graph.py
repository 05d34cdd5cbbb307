import random

import pytest
from pyspark.sql import functions as F

from arcweave.graph import Graph, degrees, stats, undirected
from arcweave.operators import components as cc
from arcweave.operators import pagerank as pr
from arcweave.operators import partition as pt
from arcweave.operators import traversal as tv
from arcweave.operators import verify as vf
from arcweave.operators.fused import sssp_fused
from arcweave.operators.ordering import global_rank, with_next
from arcweave.plans.fixpoint import Stop
from tests import oracles


def build(spark, nodes, edges):
    schema = "src long, dst long" + (", weight long" if edges and len(edges[0]) == 3 else "")
    return Graph(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, schema))


@pytest.fixture(scope="module")
def small(spark):
    rnd = random.Random(7)
    nodes = list(range(60)) + [99]  # 99 is isolated
    edges = [(rnd.randrange(60), rnd.randrange(60), rnd.randrange(1, 20)) for _ in range(110)]
    edges += edges[:5] + [(3, 3, 1)]  # parallel edges and a self loop
    return nodes, edges, build(spark, nodes, edges)


def values(df):
    return {r[0]: r[1] for r in df.collect()}


def test_bfs(small):
    nodes, edges, g = small
    want = oracles.bfs([e[:2] for e in edges], 0)
    assert values(tv.bfs(g, 0)) == {n: want.get(n) for n in nodes}


def test_bfs_source_is_clamped(small):
    nodes, edges, g = small
    assert values(tv.bfs(g, -4)) == values(tv.bfs(g, 0))
    assert values(tv.bfs(g, 10**9))[99] == 0


def test_stop_after_rounds(small):
    _, _, g = small
    got = values(tv.bfs(g, 0, stop=Stop(rounds=1)))
    assert max(v for v in got.values() if v is not None) == 1


@pytest.mark.parametrize("run", [tv.sssp, lambda g, s: tv.sssp_near_far(g, s, delta=9), lambda g, s: tv.sssp_priority(g, s, delta=3), lambda g, s: sssp_fused(g, s, parts=3)])
def test_sssp_variants(small, run):
    nodes, edges, g = small
    want = oracles.dijkstra(edges, 0)
    assert values(run(g, 0)) == {n: want.get(n) for n in nodes}


def test_metrics(small):
    rows = []
    tv.bfs(small[2], 0, metrics=rows)
    assert rows[0]["round"] == 1 and rows[-1]["accepted"] == 0


def test_components(small):
    nodes, edges, g = small
    want = oracles.components(nodes, [e[:2] for e in edges])
    labels = cc.connected_components(g)
    assert values(labels) == want
    assert vf.check_star(labels).first().ok
    assert cc.component_count(labels).first().components == len(set(want.values()))


def test_incremental_components(small):
    nodes, edges, g = small
    first = cc.connected_components(g, g.edges.where("src % 2 = 0"))
    assert values(cc.merge_components(g, first, g.edges.where("src % 2 = 1"))) == oracles.components(nodes, [e[:2] for e in edges])


def test_long_chain_components(spark):
    from arcweave.sources.generators import chain

    g = chain(spark, 300)
    assert cc.connected_components(g).agg(F.max("comp").alias("m")).first().m == 0


def test_pagerank(small):
    nodes, edges, g = small
    want = oracles.pagerank(nodes, [e[:2] for e in edges])
    got = values(pr.pagerank(g))
    assert all(abs(got[n] - want[n]) < 1e-9 for n in nodes)
    assert abs(sum(values(pr.normalised(pr.pagerank(g)).select("node", "rank_norm")).values()) - 1) < 1e-9


def test_top_rank_ties(spark):
    ranks = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.1)], "node long, rank double")
    assert [r.node for r in pr.top_ranks(ranks, 2).orderBy("position").collect()] == [1, 2]
    assert [r.node for r in pr.top_ranks(ranks, 2, for_output=True).orderBy("position").collect()] == [2, 1]
    assert pr.top_ranks(ranks, 9).count() == 3


def test_empty_graph(spark):
    g = Graph(spark.createDataFrame([], "node long"), spark.createDataFrame([], "src long, dst long"))
    assert tv.bfs(g, 0).count() == 0 and cc.connected_components(g).count() == 0 and pr.pagerank(g).count() == 0


def test_degrees_and_stats(small):
    nodes, edges, g = small
    assert values(degrees(g))[99] == 0
    s = stats(g).first()
    assert s.nodes == len(nodes) and s.edges == len(edges)


def test_partitions(spark, small):
    nodes, edges, g = small
    assigned = pt.block_partition(g, 4, 100)
    assert {r.part for r in assigned.collect()} <= {0, 1, 2, 3}
    mapping = pt.relabel(g.nodes.select("node", (F.col("node") % 3).alias("part")))
    new = values(mapping.select("node", "new_node"))
    assert sorted(new.values()) == list(range(len(nodes)))
    back = pt.restore_labels(pt.apply_relabel(g.edges, mapping).groupBy(F.col("src").alias("node")).count(), mapping)
    assert {r["node"]: r["count"] for r in back.collect()} == {r["src"]: r["count"] for r in g.edges.groupBy("src").count().collect()}
    lp = pt.propagation_partition(g, 3)
    sizes = [r["count"] for r in lp.groupBy("part").count().collect()]
    assert sum(sizes) == len(nodes)
    halo = pt.halos(g.edges, lambda c: pt.block_of(c, 100, 4))
    want = {(s // 25, d) for s, d, _ in edges if s // 25 != d // 25}
    assert {(r.part, r.node) for r in halo.collect()} == want
    assert pt.auto_config(100, 300, 4)["vertex_partitioning"] and not pt.auto_config(10, 300, 4)["vertex_partitioning"]


def test_global_order(spark):
    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "k long, v long").repartition(5)
    assert {r.k: r.rank for r in global_rank(df, ["k"]).collect()} == {i: i for i in range(101)}
    nxt = {r.k: r.n for r in with_next(df, ["k"], "k", "n", wrap=True).collect()}
    assert nxt == {i: (i + 1) % 101 for i in range(101)}


def test_verifiers(spark):
    a = spark.createDataFrame([(1, 1), (2, None), (3, 5)], "node long, level long")
    b = spark.createDataFrame([(1, 1), (2, 4), (3, 4)], "node long, level long")
    r = vf.compare_values(a, b, "level").first()
    assert (r.over, r.miss, r.ok) == (2, 0, False)
    assert vf.compare_values(a, a, "level").first().ok
    x = spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "value double")
    y = spark.createDataFrame([(1.0,), (2.0,), (2.0,)], "value double")
    r = vf.compare_bags(x, y).first()
    assert (r.extra, r.missing, r.ok) == (1, 1, False)
    r1 = spark.createDataFrame([(1, 1.0), (2, 0.5)], "node long, rank double")
    r2 = spark.createDataFrame([(1, 1.0), (2, 0.6)], "node long, rank double")
    assert not vf.compare_ranks(r1, r2).first().ok and vf.compare_ranks(r1, r1).first().ok


def test_undirected(spark):
    e = spark.createDataFrame([(1, 2)], "src long, dst long")
    assert sorted(map(tuple, undirected(e).collect())) == [(1, 2), (2, 1)]


def test_one_hub_is_one_component(spark):
    """A star of 3,000 leaves with small partitions that may be split, beside a chain."""
    keys = ["spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold"]
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in zip(keys, ("1k", "1k", "-1"), strict=True):
            spark.conf.set(k, v)
        hub = spark.range(1, 3001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
        chain = spark.range(5000, 5020).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
        got = cc.component_labels(hub.union(chain)).groupBy("comp").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == [(0, 3001), (5000, 21)]


def test_checkers_on_the_driver(spark):
    from arcweave.operators.host import host_distances, host_levels, host_ranks

    edges = [(0, 1, 5), (0, 2, 1), (2, 1, 1), (1, 3, 2), (3, 3, 1), (7, 8, 1)]
    g = Graph(spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 7, 8, 9)], "node long"), spark.createDataFrame(edges, "src long, dst long, weight long"))
    plain = lambda df: {r[0]: r[1] for r in df.collect() if r[1] is not None}
    assert plain(host_distances(g, 0)) == oracles.dijkstra(edges, 0)
    assert plain(host_levels(g, 0)) == oracles.bfs([e[:2] for e in edges], 0)
    want = oracles.pagerank([0, 1, 2, 3, 7, 8, 9], [e[:2] for e in edges], eps=1e-9, cap=2000)
    got = plain(host_ranks(g, epsilon=1e-9, max_iterations=2000))
    assert all(abs(got[n] - want[n]) < 1e-6 for n in want)


def test_unfinished_distances_are_an_error(spark):
    from arcweave.operators.fused import sssp_fused
    from arcweave.sources import generators

    with pytest.raises(RuntimeError):
        sssp_fused(generators.chain(spark, 40), 0, parts=8, max_rounds=1)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from arcweave import runtime

    context = SimpleNamespace(applicationId="app", master="spark://host:7077", getCheckpointDir=lambda: None)
    far = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: default))
    with pytest.raises(ValueError):
        runtime.scratch_root(far)
    context.getCheckpointDir = lambda: "hdfs://shared/dir"
    assert runtime.scratch_root(far) == "hdfs://shared/dir/arcweave-app"


def test_id_filter_never_misses(spark):
    from arcweave.runtime import id_filter, may_hold

    ids = spark.range(0, 30000, 7).union(spark.createDataFrame([(-5,), (None,)], "id long"))
    rows = spark.range(0, 30000).union(spark.createDataFrame([(-5,), (None,)], "id long")).withColumnRenamed("id", "key")
    got = {(r.key, r.may) for r in may_hold(rows, "key", id_filter(ids), "may").collect()}
    assert all((i, True) in got for i in [*range(0, 30000, 7), -5]) and (None, False) in got
    assert sum(m for k, m in got) < 4400  # few others
    crowded = may_hold(rows, "key", id_filter(ids, rows=1), "may", rows=1)
    assert crowded.where("not may and key is not null and key % 7 = 0").count() == 0


def test_parts_of_fused_distances_follow_the_edges(spark, monkeypatch):
    """No part gets more edges than it may hold by number, and edges outside the frontier's range are not read."""
    from arcweave.operators import fused

    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300), rnd.randrange(1, 9)) for _ in range(900)]
    edges += [(a + 10_000, b + 10_000, w) for a, b, w in edges]  # never reached
    g = build(spark, sorted({n for a, b, _ in edges for n in (a, b)}), edges)
    folder, relax = fused.materialize, []
    monkeypatch.setattr(fused, "PART_EDGES", 100)

    def seen(df, name):
        relax.extend(m for m in df._jdf.queryExecution().toString().splitlines() if "InMemoryTableScan" in m and "10000" not in m)
        parts.append(df._jdf.queryExecution().optimizedPlan().toString())
        return folder(df, name)

    parts = []
    monkeypatch.setattr(fused, "materialize", seen)
    want = oracles.dijkstra(edges, 0)
    got = values(sssp_fused(g, 0, parts=2))
    assert {n: v for n, v in got.items() if v is not None} == want
    assert any("pmod(xxhash64(node" in p and ", 18)" in p for p in parts) and relax


def test_tasks_of_a_grouping_follow_the_rows(spark, data, monkeypatch):
    """Distinct edges, in one direction too, are dealt to more tasks where there are more rows; small tables stay as Spark deals them."""
    from arcweave import runtime
    from arcweave.plans import catalog, fixtures

    few = fixtures.g1(spark, data)
    assert "REPARTITION_BY_NUM" not in few.edges._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(runtime, "TASK_ROWS", 500)
    g = fixtures.g1(spark, data)
    assert g.rows == 2 * 7500 and g.edges.count() == few.edges.count()
    for df, n in ((g.edges, 15), (catalog.q_undirected_dedup(spark, data), 30), (catalog.q_degree(spark, data), 15), (catalog.q_halos(spark, data), 15)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert f"{n}), REPARTITION_BY_NUM" in plan


def test_loops_deal_edges_once_and_open_few_files(small, monkeypatch):
    """Two traversals share one dealing of the edges; a small frontier is expanded in few tasks and reads only its range of ids."""
    from arcweave.plans import fixpoint as fx

    nodes, edges, g = small
    g = Graph(g.nodes, g.edges.select("src", "dst"))
    calls, plans, write = [], [], fx.materialize_counted
    monkeypatch.setattr(tv, "deal", lambda e: calls.append(1) or fx.deal(e))
    monkeypatch.setattr(fx, "materialize_counted", lambda df, *a, **b: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, *a, **b))
    with tv.kept_edges(g) as kept:
        a, b = values(tv.bfs(kept, 0)), values(tv.sssp_priority(kept, 0, delta=2))
    want = oracles.bfs([e[:2] for e in edges], 0)
    assert a == b == {n: want.get(n) for n in nodes} and len(calls) == 1
    assert "Repartition 8, false" in plans[1] and "src" in plans[1] and ">= 0" in plans[1]


def test_power_ranks(spark, small, data, monkeypatch):
    """The second algorithm of the check of ranks agrees with plain rounds and has no limit of edges."""
    from arcweave.operators import host
    from arcweave.plans import catalog

    nodes, edges, g = small
    want = oracles.pagerank(nodes, [e[:2] for e in edges], eps=1e-9, cap=2000)
    got = values(pr.power_ranks(g, epsilon=1e-7))
    assert set(got) == set(nodes) and all(abs(got[n] - want[n]) < 1e-5 for n in want)
    monkeypatch.setattr(host, "HOST_EDGES", 0)
    assert sorted((r.case, r.diffs, r.ok) for r in catalog.q_verify_ranks(spark, data).collect()) == [("as computed", 0, True), ("with errors", 10, False)]
