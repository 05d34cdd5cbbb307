import numpy as np
import pytest
from pyspark.sql import functions as F

from arcweave.functions.predicates import add_constant, keep, keep_with_pandas, kept_count, wave_predicate
from arcweave.operators import frontier as wl
from arcweave.operators import routing as rt
from arcweave.streaming.chunks import chunks, streamed_components, streamed_sum


def wave(v):
    a, b = np.exp(v), np.sin(v)
    return v >= np.sin(np.cos(a * b) / (np.cos((b + 3) / (a + 2)) + 4))


def test_predicate(spark):
    v = np.linspace(-0.5, 0.5, 301)
    df = spark.createDataFrame([(float(x),) for x in v], "value double")
    assert kept_count(df, wave_predicate).first().kept == int(wave(v).sum())
    assert keep_with_pandas(df, wave).count() == keep(df, wave_predicate).count()


@pytest.mark.parametrize("n", [256, 1024])
def test_add_one(spark, n):
    df = spark.range(n).select(F.col("id").alias("v"))
    assert add_constant(rt.scatter(df, 3), "v", 1).agg(F.sum("v").alias("s")).first().s == n * (n + 1) // 2


@pytest.mark.parametrize("devices", [1, 2, 4])
def test_scatter_sum(spark, devices):
    df = spark.range(5000).select((F.col("id") % 100).alias("v"))
    assert rt.one_way_reduce(rt.scatter(df, devices), F.spark_partition_id(), "v").first().total == sum(i % 100 for i in range(5000))


@pytest.mark.parametrize("devices", [2, 3, 4, 5, 8])
def test_ring_histogram(spark, devices):
    bins = 1024 // devices * devices
    items = spark.range(4096).select(F.pmod(F.xxhash64("id"), F.lit(bins)).alias("item"))
    owner = F.floor(F.col("item") / (bins // devices)).cast("long")
    moved = rt.ring_exchange(items, owner, devices)
    got = {r.bin: r.n for r in rt.dense_histogram(moved, F.col("item"), bins).collect()}
    want = dict.fromkeys(range(bins), 0)
    for r in items.collect():
        want[r.item] += 1
    assert got == want


def test_merge_histograms(spark):
    df = spark.range(1000)
    parts = [rt.histogram(df.where(F.col("id") % 3 == i), F.col("id") % 7) for i in range(3)]
    assert {r.bin: r.n for r in rt.tree_reduce(parts, rt.merge_histograms).collect()} == {r.bin: r.n for r in rt.histogram(df, F.col("id") % 7).collect()}


def test_routing_tables():
    assert rt.routing_table("tree", 5) == {0: [-1], 1: [0], 3: [2], 2: [0], 4: [0]}
    assert rt.routing_table("ring", 3)[2] == [0]
    assert rt.routing_table("one-way", 3)[2] == [0, 1]
    with pytest.raises(ValueError):
        rt.routing_table("star", 3)


@pytest.mark.parametrize("back,front", [(200, 0), (200, 32), (0, 200), (32, 200)])
def test_append_prepend(spark, back, front):
    ring = wl.with_sequence(spark.range(back).select((F.col("id") % 100).alias("v"), "id"), ["id"])
    more = wl.with_sequence(spark.range(front).select((F.col("id") % 50).alias("v"), "id"), ["id"])
    both = wl.prepend_sequenced(ring, more)
    assert wl.consume_sum(both, "v").first().total == sum(i % 100 for i in range(back)) + sum(i % 50 for i in range(front))
    if front:
        assert both.orderBy("seq").first().v == 0
        assert wl.pop(both, front).count() == back
    assert wl.length(wl.reset(both)).first().length == 0
    tail = wl.append_sequenced(ring, more) if back and front else ring
    assert tail.select("seq").distinct().count() == tail.count()


def test_segments_wrap(spark):
    ring = spark.range(6, 11).select(F.col("id").alias("seq"))
    assert [r["items"] for r in wl.segments(ring, 8).orderBy("segment").collect()] == [2, 3]


def test_split(spark):
    items = spark.createDataFrame([(1, 5), (2, 5), (3, 9), (5, 1)], "node long, value long")
    state = spark.createDataFrame([(1, 4), (3, 10)], "node long, value long")
    ops = wl.SplitOps(improves=lambda a, b: a < b)
    got = {r.node: r.action for r in wl.split_received(items, state, F.col("node") % 2, F.lit(1), ops).collect()}
    assert got == {1: "filter", 2: "pass", 3: "take", 5: "take"}
    near, far = wl.near_far(items, "value", 5)
    assert (near.count(), far.count()) == (3, 1)
    taken, rest = wl.take_pending(state, F.col("value") > 5)
    assert taken.count() == 1 and rest.agg(F.sum("value")).first()[0] == 4


def test_streams(spark, tmp_path):
    path = str(tmp_path / "parts")
    spark.range(100).select(F.col("id").alias("v")).repartition(3).write.parquet(path)
    assert streamed_sum(chunks(spark, path, "v long"), "v", f"s{tmp_path.name}") == 4950
    from arcweave.operators.components import connected_components
    from arcweave.sources.generators import segmented_chain

    g = segmented_chain(spark, 30, 3)
    path = str(tmp_path / "edges")
    g.edges.repartition(4).write.parquet(path)
    got = streamed_components(g, chunks(spark, path, "src long, dst long"), f"c{tmp_path.name}")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, connected_components(g).collect()))


def test_streams_go_on_after_a_second_run(spark, tmp_path):
    import uuid

    path, name = str(tmp_path / "in"), uuid.uuid4().hex
    spark.range(100).select(F.col("id").alias("v")).repartition(3).write.parquet(path)
    assert streamed_sum(chunks(spark, path, "v long"), "v", name) == 4950
    assert streamed_sum(chunks(spark, path, "v long"), "v", name) == 4950  # nothing new: the committed chunks are read back
    spark.range(10).select(F.col("id").alias("v")).write.mode("append").parquet(path)
    assert streamed_sum(chunks(spark, path, "v long"), "v", name) == 4995
    assert streamed_sum(chunks(spark, path, "v long"), "v") == 4995  # a stream of its own
