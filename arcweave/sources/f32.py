"""Vectors of raw little-endian floats as a Spark data source, and the sorted writer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Slice(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class F32Reader(DataSourceReader):
    def __init__(self, path: str, span: int):
        self.path, self.span, self.n = path, span, os.path.getsize(path) // 4

    def partitions(self):
        return [_Slice(a, min(a + self.span, self.n)) for a in range(0, self.n, self.span)] or [_Slice(0, 0)]

    def read(self, part: _Slice) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            f.seek(4 * part.first)
            v = np.frombuffer(f.read(4 * (part.last - part.first)), "<f4")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first, part.first + len(v))), pa.array(v.astype(np.float32))], names=["idx", "value"])


class F32Source(DataSource):
    """``spark.read.format("f32").load(path)``; option ``values_per_partition``."""

    @classmethod
    def name(cls) -> str:
        return "f32"

    def schema(self) -> str:
        return "idx bigint, value float"

    def reader(self, schema) -> F32Reader:
        return F32Reader(self.options["path"], int(self.options.get("values_per_partition", 8_000_000)))


def read_f32(spark: SparkSession, path: str, values_per_partition: int = 8_000_000) -> DataFrame:
    spark.dataSource.register(F32Source)
    return spark.read.format("f32").option("path", path).option("values_per_partition", values_per_partition).load()


def write_f32_sorted(df: DataFrame, path: str, col: str = "value") -> None:
    """The values in ascending order, streamed partition by partition."""
    with open(path, "wb") as f:
        for r in df.select(col).orderBy(col).toLocalIterator(prefetchPartitions=True):
            f.write(np.float32(r[0]).tobytes())
