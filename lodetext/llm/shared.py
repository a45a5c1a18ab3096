"""Helpers of the training-data operators: shared storage, small hashes, graph components."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodetext.functions.shipping import ship

#: Rows and bytes of an Arrow batch: texts may be long, and a task holds some batches and their Python strings at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Parts that rows of one group are dealt into before they look up what the group has in common.
SALTS = 16


def prepared(spark: SparkSession) -> None:
    """Ships the package to the workers and bounds the batches they get."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that gives its memory back to the system at the end of a partition: workers live on, and idle ones would keep it."""

    @functools.wraps(run)
    def ended(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            del batches
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return ended


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a new temporary one where that is unset and the master is local (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodetext-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of a frame that stored() made and nothing needs any more."""
    spark = df.sparkSession
    for p in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an undirected graph given as (u, v) long pairs; root is the smallest node reachable.

    Alternates the large-star and small-star steps (Kiveris et al., 2014): every round is two aggregations and two
    joins on the edges, rounds grow with the logarithm of the longest path. They end when every edge leads from a node with no other edge to
    its root, which one aggregation tells exactly. No step gathers a component in one task:
    minima are combined before the shuffle, and AQE splits a join on a node with many edges. A graph without edges gives an
    empty frame.
    """
    now = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        ends = now.select(F.expr("inline(array(struct(u AS node, 1L AS up, 0L AS down), struct(v AS node, 0L AS up, 1L AS down)))"))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").isEmpty():
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u").select(F.expr("explode(array(struct(u AS a), struct(v AS a)))").alias("x"), "m")
        then = stored(pairs.select(F.col("x.a").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "edges")
        drop_stored(now)
        now = then
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
