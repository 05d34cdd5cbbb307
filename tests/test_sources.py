import struct

import numpy as np
import pytest

from arcweave.sources import generators as gen
from arcweave.sources.cache import cached_graph, clear_graphs
from arcweave.sources.dimacs import BadGraphText, read_dimacs
from arcweave.sources.f32 import read_f32, write_f32_sorted
from arcweave.sources.gr import BadGraphFile, read_gr, read_header, write_gr
from arcweave.sources.sinks import node_lines, rank_lines


@pytest.mark.parametrize("weighted", [True, False])
@pytest.mark.parametrize("odd", [True, False])
def test_gr_round_trip(spark, tmp_path, weighted, odd):
    rows = [(0, 1, 5), (0, 2, 6), (2, 0, 7)] + ([] if odd else [(4, 1, 9)])
    edges = spark.createDataFrame(rows, "src long, dst long, weight long")
    edges = edges if weighted else edges.drop("weight")
    path = str(tmp_path / "a.gr")
    write_gr(edges, 5, path)
    g = read_gr(spark, path, edges_per_partition=2)
    assert sorted(map(tuple, g.edges.collect())) == sorted(map(tuple, edges.collect()))
    assert g.nodes.count() == 5


def test_gr_query_takes_the_whole_graph(spark, monkeypatch):
    from arcweave.plans import catalog
    from arcweave.sources import gr

    data, headers, lose = "/root/testdata/sf0.01", [], []

    def write(edges, nodes, path):
        write_gr(edges.where("src < 40 or src % 100 <> 0") if lose else edges, nodes, path)
        headers.append(read_header(path))

    monkeypatch.setattr(gr, "write_gr", write)
    want = catalog.g2_pairs(spark, data)
    assert catalog.q_gr_roundtrip(spark, data).count() == want.count()
    assert headers[0][2] == want.count()
    lose.append(True)
    with pytest.raises(ValueError, match="lost"):
        catalog.q_gr_roundtrip(spark, data)


def test_gr_is_written_by_tasks_in_pieces(spark, tmp_path, monkeypatch):
    """Sources that span pieces and ids without edges; no edge passes the driver, and the number of ranges read has a bound."""
    from pyspark.sql import DataFrame

    from arcweave.sources import gr

    rows = [(7, i, i + 1) for i in range(300)] + [(i, 900 - i, 3) for i in range(0, 900, 17)] + [(7, 5, 6)] * 3
    edges = spark.createDataFrame(rows, "src long, dst long, weight long").repartition(5)
    monkeypatch.setattr(gr, "task_parts", lambda n: -(-n // 20))
    monkeypatch.setattr(gr, "BLOCK", 11)
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    path = str(tmp_path / "p.gr")
    write_gr(edges, 1000, path)
    ends = np.fromfile(path, "<u8", 1000, offset=32)
    assert ends.tolist() == np.searchsorted(sorted(r[0] for r in rows), np.arange(1000), side="right").tolist()
    monkeypatch.setattr(gr, "MAX_RANGES", 8)
    assert len(gr.GrReader(path, 1).partitions()) <= 8
    assert sorted(map(tuple, read_gr(spark, path, 100).edges.collect())) == sorted(rows)
    with pytest.raises(Exception, match="outside"):
        write_gr(edges, 500, path)


def test_gr_errors(tmp_path):
    p = tmp_path / "x.gr"
    for body, what in [(b"abc", "short"), (struct.pack("<4Q", 2, 0, 1, 0), "version"), (struct.pack("<4Q", 1, 0, 3, 0), "row ends"), (struct.pack("<5Q", 1, 0, 1, 2, 2), "destinations"), (struct.pack("<5Q", 1, 4, 1, 1, 1) + b"\0\0\0\0", "weights")]:
        p.write_bytes(body)
        with pytest.raises(BadGraphFile, match=what):
            read_header(str(p))


def test_dimacs(spark, tmp_path):
    p = tmp_path / "g.graph"
    p.write_text("% comment\n3 2 011 2\n1 9 2 5\n% inside\n2 8 1 5 3 4\n3 7 2 4\n")
    r = read_dimacs(spark, str(p))
    assert sorted(map(tuple, r.graph.edges.collect())) == [(0, 1, 5), (1, 0, 5), (1, 2, 4), (2, 1, 4)]
    assert {v.node: list(v.vwgt) for v in r.vertices.collect()} == {0: [1, 9], 1: [2, 8], 2: [3, 7]}


def test_dimacs_isolated_vertex_and_sizes(spark, tmp_path):
    p = tmp_path / "g.graph"
    p.write_text("3 1 100\n4 2\n5 1\n6\n")
    r = read_dimacs(spark, str(p))
    assert {v.node: v.vsize for v in r.vertices.collect()} == {0: 4, 1: 5, 2: 6}
    assert r.graph.edges.count() == 2


@pytest.mark.parametrize(
    "text,what",
    [
        ("% only\n", "before the header"), ("5\n", "needs the numbers"), ("0 3\n", "positive"), ("2 1 112\n2\n1\n", "unknown"), ("2 1 0 3\n2\n1\n", "ncon"),
        ("3 1\n2\n1\n", "before the last"), ("2 1\n3\n1\n", "out of range"), ("2 1 1\n2 0\n1 0\n", "positive"), ("2 1 1\n2\n1\n", "edge weight is missing"),
        ("2 1\n2 2\n1\n", "more edges"), ("2 2\n2\n1\n", "header says"), ("1 1 110\n1\n", "missing"),
    ],
)
def test_dimacs_errors(spark, tmp_path, text, what):
    p = tmp_path / "bad.graph"
    p.write_text(text)
    with pytest.raises(BadGraphText, match=what):
        read_dimacs(spark, str(p))


def test_f32(spark, tmp_path):
    p = str(tmp_path / "v.bin")
    v = np.array([3.5, -1.0, 2.25, 0.5], "<f4")
    v.tofile(p)
    df = read_f32(spark, p, values_per_partition=3)
    assert [r.value for r in df.orderBy("idx").collect()] == v.tolist()
    out = str(tmp_path / "s.bin")
    write_f32_sorted(df, out)
    assert np.fromfile(out, "<f4").tolist() == sorted(v.tolist())


def test_cache(spark, tmp_path):
    p = tmp_path / "g.graph"
    p.write_text("2 1\n2\n1\n")
    assert cached_graph(spark, str(p)) is cached_graph(spark, str(p))
    clear_graphs()


def test_sinks(spark):
    df = spark.createDataFrame([(2, 1), (1, None)], "node long, level long")
    assert [r.value for r in node_lines(df, "level").collect()] == ["1 INF", "2 1"]
    ranks = spark.createDataFrame([(1, 1.0), (2, 3.0)], "node long, rank double")
    lines = rank_lines(ranks, 5, print_ranks=True)
    assert lines[1] == "RANKS 1--2 of 2" and lines[2].startswith("1 2 0.75")


def test_generators(spark):
    g = gen.random_graph(spark, 50, 6)
    rows = list(map(tuple, g.edges.collect()))
    assert len(rows) == len(set(rows)) and all(a != b for a, b in rows)
    per = {}
    for a, _ in rows:
        per[a] = per.get(a, 0) + 1
    assert set(per) == set(range(50)) and max(per.values()) <= 6
    with pytest.raises(ValueError):
        gen.random_graph(spark, 5, 5)
    assert gen.cliques(spark, 9, 3).edges.count() == 18
    assert gen.segmented_chain(spark, 10, 3).edges.count() == 12
    w = [r.weight for r in gen.with_weights(g, 7).edges.collect()]
    assert min(w) >= 1 and max(w) <= 7
    v = [r.value for r in gen.values(spark, 500).collect()]
    assert min(v) >= -0.5 and max(v) < 0.5
