"""Chunked streams with Structured Streaming: bounded files read in chunks until they end."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.graph import Graph
from arcweave.operators.components import connected_components, merge_components
from arcweave.runtime import materialize, scratch_root


def chunks(spark: SparkSession, path: str, schema, files_per_chunk: int = 1) -> DataFrame:
    """A stream of Parquet files, a few a chunk; the end of the files is the end of the stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_chunk).parquet(path)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], name: str) -> None:
    """Run ``each`` on every chunk, in order, until the stream is empty."""
    place = f"{scratch_root(stream.sparkSession)}/stream-{name}"
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", place).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def _chunk_folder(spark: SparkSession, name: str) -> str:
    """Where the results of a stream's chunks lie, beside its checkpoint: a restart finds both."""
    return f"{scratch_root(spark)}/stream-{name}-chunks"


def _stored_chunks(spark: SparkSession, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    done = [f.getPath().getName() for f in files.listStatus(path) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(x.removeprefix("chunk=")) for x in done)


def streamed_sum(stream: DataFrame, col: str, name: str | None = None) -> int:
    """Produce and consume at once: the sum of a column over all chunks.

    Each chunk's sum is a small table under its number, so a repeated chunk
    replaces itself, and a second run or a restart under the same name goes on
    from the committed chunks. Without a name every call is a stream of its own.
    """
    spark, name = stream.sparkSession, name or uuid.uuid4().hex
    folder = _chunk_folder(spark, name)

    def add(df: DataFrame, chunk: int) -> None:
        df.agg(F.coalesce(F.sum(col), F.lit(0)).cast("long").alias("s")).write.mode("overwrite").parquet(f"{folder}/chunk={chunk}")

    drain(stream, add, name)
    if not _stored_chunks(spark, folder):
        return 0
    return int(spark.read.schema("s long").parquet(folder).agg(F.sum("s").alias("s")).first().s)


def streamed_components(graph: Graph, stream: DataFrame, name: str | None = None) -> DataFrame:
    """Labels after edge chunks that arrive one after another, each merged into the labels that the chunk before it left."""
    spark, name = stream.sparkSession, name or uuid.uuid4().hex
    folder = _chunk_folder(spark, name)

    def labels(before: int | None = None) -> DataFrame:
        done = [c for c in _stored_chunks(spark, folder) if before is None or c < before]
        return spark.read.schema("node long, comp long").parquet(f"{folder}/chunk={done[-1]}") if done else connected_components(graph, graph.edges.limit(0))

    def merge(df: DataFrame, chunk: int) -> None:
        merged = materialize(merge_components(graph, labels(chunk), df), "labels")
        merged.select(F.col("node").cast("long"), F.col("comp").cast("long")).write.mode("overwrite").parquet(f"{folder}/chunk={chunk}")

    drain(stream, merge, name)
    return labels()


def windowed_counts(stream: DataFrame, time_col: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event-time window and key; rows later than the watermark are left out."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), key).agg(F.count(F.lit(1)).alias("n"))
