"""Session settings, shared scratch space and lineage control used by every operator.

Iterative operators cut lineage by writing Parquet below the folder that the
cluster names in ``spark.checkpoint.dir``: any executor can read it back, so a
lost executor costs a re-read and never a lost result.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, str] = {}
#: Bits of one row of an id filter, as ``bitmap_construct_agg`` makes them, and the rows it has at most (16 MB in all).
_BITS, FILTER_ROWS = 1 << 15, 1 << 12


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, name: str = "arcweave", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for this application. A temporary one serves local masters only: elsewhere executors could not read each other's files."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        if app not in _LOCAL_SCRATCH:
            _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="arcweave-")
            atexit.register(shutil.rmtree, _LOCAL_SCRATCH[app], ignore_errors=True)
        base = f"file://{_LOCAL_SCRATCH[app]}"
    return f"{base.rstrip('/')}/arcweave-{app}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage, computed once."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._arcweave_path = path  # read by discard()
    return out


def materialize_counted(df: DataFrame, name: str = "table", **measures: Column) -> tuple[DataFrame, dict]:
    """:func:`materialize` with its number of rows as ``rows`` and other aggregates, taken while the table is written."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in measures.items()]), name)
    return out, seen.get


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`materialize` that no later plan reads."""
    for t in tables:
        path = getattr(t, "_arcweave_path", None)
        if path:
            jvm, sc = t.sparkSession._jvm, t.sparkSession.sparkContext
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def shared_file(spark: SparkSession, name: str) -> str:
    """A path that plain file calls reach on the driver and the executors: the scratch folder, mounted everywhere."""
    root = scratch_root(spark)
    if "://" in root and not root.startswith("file://"):
        raise ValueError(f"{root} cannot be reached by plain file calls; give a mounted path")
    folder = os.path.join(root.removeprefix("file://"), uuid.uuid4().hex)
    os.makedirs(folder)
    return os.path.join(folder, name)


def clear_scratch(spark: SparkSession) -> None:
    """Delete everything that this application has materialised; results read from it must be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def redeal(key: Column) -> Column:
    """A one-to-one image of a long key. Joining a table with an aggregate of itself on the image gives
    both sides an exchange of their own, and only such joins can be split where one key is hot."""
    return key.bitwiseXOR(F.lit(0x5DEECE66D))


def id_filter(ids: DataFrame, rows: int = FILTER_ROWS) -> DataFrame:
    """(__fb, __bits): a Bloom filter of the long column ``ids``, for :func:`may_hold`.

    It has at most ``rows`` rows of 4 kB whatever the number of ids, so it can
    always be broadcast; an overfull one lets more rows pass, never fewer.
    """
    spot = ids.select(F.pmod(F.xxhash64(F.col(ids.columns[0]).cast("long")), F.lit(rows * _BITS)).alias("p"))
    spot = spot.select(F.shiftright("p", 15).cast("int").alias("__fb"), F.pmod("p", F.lit(_BITS)).alias("at"))
    return spot.repartition("__fb").groupBy("__fb").agg(F.bitmap_construct_agg("at").alias("__bits"))


def may_hold(df: DataFrame, key: str, bits: DataFrame, out: str, rows: int = FILTER_ROWS) -> DataFrame:
    """``df`` with boolean ``out``: false only if the long column ``key`` is null or not among the ids of the filter."""
    spot = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(rows * _BITS))
    byte = F.substring("__bits", (F.pmod(F.shiftright(spot, 3), F.lit(_BITS // 8)) + 1).cast("int"), F.lit(1))
    hit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(spot, F.lit(8)).cast("int")) == 1
    joined = df.join(F.broadcast(bits), F.shiftright(spot, 15).cast("int") == F.col("__fb"), "left")
    return joined.withColumn(out, F.coalesce(hit & F.col(key).isNotNull(), F.lit(False))).drop("__fb", "__bits")


#: Rows that one task of a grouping holds where the number of tasks follows the input.
TASK_ROWS = 1 << 19


def task_parts(rows: int) -> int:
    return max(1, -(-rows // TASK_ROWS))


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``df`` of about ``rows`` rows (0: unknown) dealt by keys that repeat little. Spark deals a large table to as few
    tasks as the cluster has cores, each with more rows the larger the table; here a task gets some ``TASK_ROWS``."""
    n, spark = task_parts(rows), df.sparkSession
    return df.repartition(n, *keys) if n > min(shuffle_width(spark), spark.sparkContext.defaultParallelism) else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ranked_within(
    df: DataFrame, groups: list[str], order: list[str], out: str, salt: Column | None = None, salts: int | None = None
) -> DataFrame:
    """Gapless 0-based rank of each row within its group, without one task per group.

    Every group is cut into ``salts`` sub-groups by a hash of the order columns.
    A sub-group is ranked by a window; its offset is the running total of the
    sub-groups before it, taken from a table of (group, salt) counts whose
    size follows the number of sub-groups, not the number of rows.
    """
    n = salts or max(16, shuffle_width(df.sparkSession))
    salted = df.withColumn("__salt", salt if salt is not None else F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    keys = [*groups, "__salt"]
    counts = salted.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(g).alias(f"__g_{g}") for g in groups], F.col("__salt").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inner = Window.partitionBy(*keys).orderBy(*order)
    on = [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in groups] + [F.col("__salt") == F.col("__s")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return (
        salted.withColumn("__rn", F.row_number().over(inner) - 1)
        .join(offsets, cond, "left")
        .withColumn(out, (F.col("__off") + F.col("__rn")).cast("long"))
        .drop("__salt", "__rn", "__s", "__off", *[f"__g_{g}" for g in groups])
    )
