"""Binary graph files (``.gr``, version 1) as a Spark data source, and a writer.

Layout, little endian: four u64 (version, bytes of an edge weight, nodes, edges);
a u64 per node with the end of its edge range; a u32 per edge with its
destination; four bytes of padding if the number of edges is odd and weights
follow; a u32 weight per edge. A partition is a range of edges: its reader seeks
to its destinations and finds sources by bisection of the row ends.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from arcweave.graph import Graph
from arcweave.runtime import shuffle_width, task_parts

HEADER = 32
#: A file is read in at most so many ranges, and bytes are copied and row ends written so many values at a time.
MAX_RANGES, BLOCK = 1024, 1 << 20


class BadGraphFile(ValueError):
    pass


def read_header(path: str) -> tuple[int, int, int]:
    """(weight bytes, nodes, edges), checked against the file's size."""
    size = os.path.getsize(path)
    if size < HEADER:
        raise BadGraphFile("short header")
    with open(path, "rb") as f:
        version, weight, nodes, edges = struct.unpack("<4Q", f.read(HEADER))
    if version != 1:
        raise BadGraphFile(f"version {version} is not supported")
    if weight not in (0, 4):
        raise BadGraphFile(f"edge data of {weight} bytes is not supported")
    at = HEADER + 8 * nodes
    if size < at:
        raise BadGraphFile("row ends are cut short")
    if size < at + 4 * edges:
        raise BadGraphFile("destinations are cut short")
    if weight and size < at + 4 * (edges + edges % 2) + 4 * edges:
        raise BadGraphFile("weights are cut short")
    return weight, nodes, edges


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class GrReader(DataSourceReader):
    def __init__(self, path: str, span: int):
        self.path, self.span = path, span
        self.weight, self.nodes, self.edges = read_header(path)

    def partitions(self):
        span = max(self.span, -(-self.edges // MAX_RANGES))
        return [_Range(a, min(a + span, self.edges)) for a in range(0, self.edges, span)] or [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        n = part.last - part.first
        ends = np.memmap(self.path, "<u8", "r", HEADER, (self.nodes,)) if self.nodes else np.zeros(0, "<u8")
        base = HEADER + 8 * self.nodes
        with open(self.path, "rb") as f:
            f.seek(base + 4 * part.first)
            dst = np.frombuffer(f.read(4 * n), "<u4").astype(np.int64)
            weight = None
            if self.weight:
                f.seek(base + 4 * (self.edges + self.edges % 2) + 4 * part.first)
                weight = np.frombuffer(f.read(4 * n), "<u4").astype(np.int64)
        if len(dst) and int(dst.max()) >= self.nodes:
            raise BadGraphFile("destination out of range")
        src = np.searchsorted(ends, np.arange(part.first, part.last), side="right").astype(np.int64)
        cols = [pa.array(src), pa.array(dst)] + ([pa.array(weight)] if weight is not None else [])
        yield pa.RecordBatch.from_arrays(cols, names=["src", "dst", "weight"][: len(cols)])


class GrSource(DataSource):
    """``spark.read.format("gr").load(path)``; option ``edges_per_partition``, more where a file would have above ``MAX_RANGES`` ranges."""

    @classmethod
    def name(cls) -> str:
        return "gr"

    def schema(self) -> str:
        weight, _, _ = read_header(self.options["path"])
        return "src bigint, dst bigint" + (", weight bigint" if weight else "")

    def reader(self, schema) -> GrReader:
        return GrReader(self.options["path"], int(self.options.get("edges_per_partition", 4_000_000)))


def read_gr(spark: SparkSession, path: str, edges_per_partition: int = 4_000_000) -> Graph:
    spark.dataSource.register(GrSource)
    edges = spark.read.format("gr").option("path", path).option("edges_per_partition", edges_per_partition).load()
    return Graph(spark.range(read_header(path)[1]).withColumnRenamed("id", "node"), edges)


def _pieces(folder: str, nodes: int):
    """Writes a sorted range of edges as three files: destinations, weights, and a local row end for each id from its first source to its last."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, n, first, last = f"{folder}/{task.partitionId()}-{task.taskAttemptId()}", 0, 0, -1
        with open(f"{name}.dst", "wb") as to, open(f"{name}.weight", "wb") as cost, open(f"{name}.end", "wb") as ends:

            def close(upto: int, src: np.ndarray) -> None:
                """Row ends of the ids from the last written one to before ``upto``."""
                for a in range(last, upto, BLOCK):
                    ids = np.arange(a, min(a + BLOCK, upto))
                    ends.write((n + np.searchsorted(src, ids, side="right")).astype("<u8").tobytes())

            for b in batches:
                if not b.num_rows:
                    continue
                if any(c.null_count for c in b.columns):
                    raise ValueError("an edge has a null end or weight")
                src, dst, *weight = (c.to_numpy() for c in b.columns)
                if src[0] < 0 or src[-1] >= nodes or dst.min() < 0 or dst.max() >= min(nodes, 1 << 32):
                    raise ValueError(f"an edge has an end outside 0 to {nodes - 1}")
                if weight and (weight[0].min() < 0 or weight[0].max() >= 1 << 32):
                    raise ValueError("a weight has more than 32 bits")
                if not n:
                    first = last = int(src[0])
                close(int(src[-1]), src)
                to.write(dst.astype("<u4").tobytes())
                for w in weight:
                    cost.write(w.astype("<u4").tobytes())
                n, last = n + len(src), int(src[-1])
            if n:
                close(last + 1, np.zeros(0, np.int64))
        if n:
            yield pa.RecordBatch.from_pydict({"at": [task.partitionId()], "name": [name], "n": [n], "first": [first], "last": [last]})

    return write


def write_gr(edges: DataFrame, nodes: int, path: str) -> None:
    """Write edges with ids 0..nodes-1. Tasks write sorted ranges as files beside ``path``, which they must reach; the driver strings them together, a block at a time."""
    weighted = "weight" in edges.columns
    order = ["src", "dst", "weight"][: 2 + weighted]
    ranges = max(shuffle_width(edges.sparkSession), task_parts(edges.count()))
    folder = f"{path}.{uuid.uuid4().hex}"
    os.makedirs(folder)
    ordered = edges.select(*[F.col(c).cast("long") for c in order]).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    pieces = sorted(ordered.mapInArrow(_pieces(folder, nodes), "at long, name string, n long, first long, last long").collect())  # one row a range
    total = sum(p.n for p in pieces)
    with open(path, "wb") as f:
        f.write(struct.pack("<4Q", 1, 4 if weighted else 0, nodes, total))

        def fill(count: int, end: int) -> None:
            for a in range(0, count, BLOCK):
                f.write(np.full(min(BLOCK, count - a), end, "<u8").tobytes())

        done = 0
        fill(pieces[0].first if pieces else nodes, 0)
        for p, after in zip(pieces, [x.first for x in pieces[1:]] + [nodes], strict=True):
            left = min(p.last + 1, after) - p.first  # a source that goes on in the next range ends there
            with open(f"{p.name}.end", "rb") as piece:
                while left:
                    k = min(BLOCK, left)
                    f.write((np.frombuffer(piece.read(8 * k), "<u8") + np.uint64(done)).tobytes())
                    left -= k
            done += p.n
            fill(after - p.last - 1, done)
        for kind in ("dst", "weight")[: 1 + weighted]:
            if kind == "weight" and total % 2:
                f.write(b"\0\0\0\0")
            for p in pieces:
                with open(f"{p.name}.{kind}", "rb") as piece:
                    shutil.copyfileobj(piece, f, BLOCK)
    shutil.rmtree(folder)
