"""Shared pieces: checkpoint folder, distributed connected components, vectorised byte hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; where none is named, make a local folder in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gapweave-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer over uint64 (wraps on purpose)."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


#: Edges of which one task finds the components.
ONE_TASK = 1 << 20


def _joined(batches):
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, c = top(u), top(v)
            if a != c:
                up[max(a, c)] = min(a, c)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that an edge names.

    Up to ONE_TASK edges (a count decides; 16 bytes each) are joined by one task.  Beyond that it alternates large-star and small-star steps until the edge set stands still.  Each step is a
    combinable ``min`` per node joined back to the edges, so a node with a third of all edges is
    pre-aggregated before the shuffle and its join side can be split by AQE.  Lineage is cut by a
    checkpoint each round.  Null ends are ignored; an empty edge set gives an empty table.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if e.count() <= ONE_TASK:
        return e.coalesce(1).mapInArrow(tidy(_joined), "node long, component long")
    e = cut(e.distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every neighbour above the node is tied to the node's least neighbour
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: the node and its lower neighbours are tied to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p"))
        e = cut(small.select("p.u", "p.v").where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    # at rest the edges are stars: (node, least of its component)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage through a Parquet table in the shared checkpoint folder (compressed, unlike a checkpoint).

    Results may read the table until they are stored, so it stays; ``forget`` removes all of a session.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove the files of written tables that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, t._written_to)


def _delete(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """A written table of narrow rows: sent to all tasks if a count finds at most ``rows`` of them, else met by hash."""
    return F.broadcast(df) if df.count() <= rows else df


def forget(spark: SparkSession) -> None:
    """Remove the tables and checkpoints that this session has written; call it once all results are stored."""
    if spark.sparkContext.getCheckpointDir() is not None:
        _delete(spark, spark.sparkContext.getCheckpointDir())


#: Bytes of one Arrow batch, about: rows are texts of any length, so a number of rows bounds nothing.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def tidy(run):
    """``run`` over batches of bounded size; after the last one, memory that it has freed goes back to the system.

    Workers are reused, and so is what the JVM takes for batches.  The session's bound on batches is lowered to
    BATCH_BYTES where it is above.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    """Hand memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
