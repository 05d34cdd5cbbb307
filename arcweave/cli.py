"""Command line: run one of the analytics on a file or a generated graph, check it, write it.

    python -m arcweave.cli bfs --graph g.gr --source 3 --check --output out
    python -m arcweave.cli --cmdfile commands.txt

A command file has one command a line; quotes group words and ``#`` starts a
comment. A failed check gives exit code 1.
"""

from __future__ import annotations

import argparse
import shlex
import sys
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.functions.predicates import keep, keep_with_pandas, wave_on_host, wave_predicate
from arcweave.graph import Graph, stats
from arcweave.operators import components as cc
from arcweave.operators import pagerank as pr
from arcweave.operators import partition as pt
from arcweave.operators import traversal as tv
from arcweave.operators import verify as vf
from arcweave.operators.fused import sssp_fused
from arcweave.operators.host import host_distances, host_levels, host_ranks
from arcweave.runtime import local_session, materialize
from arcweave.sources import generators as gen
from arcweave.sources.cache import cached_graph
from arcweave.sources.f32 import read_f32, write_f32_sorted
from arcweave.sources.sinks import rank_lines, write_node_values

APPS = ("bfs", "sssp", "pr", "cc", "pbf")
MAX_GATHERED_LINES = 10_000


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="arcweave")
    p.add_argument("app", nargs="?", choices=APPS)
    p.add_argument("--cmdfile")
    p.add_argument("--graph", help="input graph (.gr binary or text)")
    p.add_argument("--gen-method", type=int, choices=range(4), default=0, help="0 random, 1 segmented chain, 2 chain, 3 cliques")
    p.add_argument("--gen-nodes", type=int, default=100_000)
    p.add_argument("--gen-factor", type=int, default=10)
    p.add_argument("--gen-weights", action="store_true")
    p.add_argument("--gen-weight-range", type=int, default=100)
    p.add_argument("--segments", type=int, default=4)
    p.add_argument("--source", type=int, default=0)
    p.add_argument("--variant", choices=("plain", "near-far", "priority", "fused"), default="plain")
    p.add_argument("--delta", type=int)
    p.add_argument("--max-iterations", type=int, default=pr.MAX_ITERATIONS)
    p.add_argument("--top-ranks", type=int, default=10)
    p.add_argument("--print-ranks", action="store_true")
    p.add_argument("--repetitions", type=int, default=1)
    p.add_argument("--check", action="store_true")
    p.add_argument("--stats", action="store_true")
    p.add_argument("--output")
    p.add_argument("--input", help="vector of raw floats for pbf")
    p.add_argument("--size", type=int, default=1_000_000)
    p.add_argument("--ratio", type=float, default=0.5)
    return p


def commands(path: str) -> Iterable[list[str]]:
    with open(path) as f:
        for line in f:
            words = shlex.split(line, comments=True)
            if words:
                yield words


def load_graph(spark: SparkSession, a: argparse.Namespace) -> Graph:
    if a.graph:
        g = cached_graph(spark, a.graph)
    elif a.gen_method == 0:
        g = gen.random_graph(spark, a.gen_nodes, a.gen_factor)
    elif a.gen_method == 1:
        g = gen.segmented_chain(spark, a.gen_nodes, a.segments)
    elif a.gen_method == 2:
        g = gen.chain(spark, a.gen_nodes)
    else:
        g = gen.cliques(spark, a.gen_nodes, a.segments)
    return gen.with_weights(g, a.gen_weight_range) if a.gen_weights and not g.weighted else g


def _solve(g: Graph, a: argparse.Namespace) -> DataFrame:
    if a.app == "bfs":
        return tv.bfs(g, a.source, delta=a.delta or (tv.PRIORITY_DELTA if a.variant == "priority" else None))
    if a.app == "sssp":
        if a.variant == "near-far":
            return tv.sssp_near_far(g, a.source, a.delta or tv.NEAR_FAR_DELTA)
        if a.variant == "priority":
            return tv.sssp_priority(g, a.source, a.delta or tv.PRIORITY_DELTA)
        return sssp_fused(g, a.source) if a.variant == "fused" else tv.sssp(g, a.source)
    if a.app == "pr":
        return pr.pagerank(g, max_iterations=a.max_iterations)
    return cc.connected_components(g)


def _verified(g: Graph, a: argparse.Namespace, got: DataFrame) -> bool:
    if a.app == "bfs":
        return vf.compare_values(got, host_levels(g, a.source), "level").first().ok
    if a.app == "sssp":
        return vf.compare_values(got, host_distances(g, a.source), "dist").first().ok
    if a.app == "pr":
        return vf.compare_ranks(got, host_ranks(g, max_iterations=a.max_iterations), a.top_ranks).first().ok
    return vf.check_star(got).first().ok


def run_one(spark: SparkSession, a: argparse.Namespace) -> bool:
    if a.app == "pbf":
        v = read_f32(spark, a.input) if a.input else gen.values(spark, a.size, a.ratio)
        began = time.perf_counter()
        for _ in range(a.repetitions):
            kept = materialize(keep(v, wave_predicate), "kept")
        print(f"pbf {kept.count()} kept {(time.perf_counter() - began) * 1000 / a.repetitions:.1f} ms")
        if a.output:
            write_f32_sorted(kept, a.output)
        if a.check:
            ok = vf.compare_bags(kept.select("value"), keep_with_pandas(v, wave_on_host).select("value")).first().ok
            print("passed" if ok else "FAILED")
            return ok
        return True
    g = load_graph(spark, a)
    if a.stats:
        s = stats(g).first()
        print(f"nodes {s.nodes} edges {s.edges} max degree {s.max_degree} avg degree {s.avg_degree or 0:.2f}")
        n = g.nodes.agg((F.max("node") + 1).alias("n")).first().n or 0
        for r in pt.halo_counts(g.edges, lambda c: pt.block_of(c, n, a.segments)).orderBy("part").collect():  # one row a segment
            print(f"segment {r.part}: halos {r.total}, distinct {r.distinct_nodes}")
        return True
    began = time.perf_counter()
    for _ in range(a.repetitions):
        got = materialize(_solve(g, a), a.app)
    print(f"{a.app} {(time.perf_counter() - began) * 1000 / a.repetitions:.1f} ms")
    if a.app == "cc":
        print(f"components {cc.component_count(got).first().components}")
    if a.output and a.app in ("bfs", "sssp"):
        write_node_values(got, "level" if a.app == "bfs" else "dist", a.output)
    elif a.output and a.app == "pr":
        with open(a.output, "w") as f:
            f.write("\n".join(rank_lines(got, min(a.top_ranks, MAX_GATHERED_LINES), a.print_ranks)) + "\n")
    elif a.output:
        got.write.parquet(a.output)
    if a.check:
        ok = _verified(g, a, got)
        print("passed" if ok else "FAILED")
        return ok
    return True


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    p = parser()
    first = p.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    todo = [p.parse_args(words) for words in commands(first.cmdfile)] if first.cmdfile else [first]
    if any(a.app is None for a in todo):
        p.error("an app is needed")
    return int(not all([run_one(spark, a) for a in todo]))


if __name__ == "__main__":
    sys.exit(main())
