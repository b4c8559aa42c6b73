"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: keys that a join may send to every executor, and rows of ids (one or two integers each)
HOT_KEYS, SALTS, BROADCAST_IDS = 1000, 64, 1 << 18


#: rows of an Arrow batch: whole texts are long, and several batches are in memory at a time in the JVM and in Python
BATCH_ROWS = 1000
#: bytes of batches that an operator may work on at a time
TOGETHER = 24 << 20


def in_batches(rows: DataFrame, run: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """mapInArrow with batches of at most BATCH_ROWS rows (set in the session, unless it has less) and workers that give memory back."""
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return rows.mapInArrow(lean(run), schema)


def together(batches: Iterator[pa.RecordBatch], size: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Batches put together up to `size` bytes: the more text, the fewer different pieces in proportion."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local one, but on a local master alone."""
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="quern-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return context.getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    atexit.register(_delete, there.getFileSystem(spark._jsc.hadoopConfiguration()), there)
    return path


def _delete(store, path) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        store.delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table in the shared folder."""
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: what a worker keeps from task to task: one operator's tables, until another operator's task comes
_kept: dict[str, object] = {}


def kept(owner: str, key: str, make: Callable[[], object]) -> object:
    """What make() gives, made once in a worker for tasks of the same owner (a module's name) and key."""
    if _kept.get("of") != (owner, key):
        _kept.clear()
        _kept.update(value=make(), of=(owner, key))
    return _kept["value"]


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that hands its worker's free memory back to the system at the end of a task."""

    def wrapped(batches: Iterator) -> Iterator:
        if _kept and _kept["of"][0] != run.__module__:
            _kept.clear()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def first_by_hash(rows: DataFrame, group: str, limits: DataFrame, limit: str, key: str = "doc_id") -> DataFrame:
    """Of each group that limits (group, limit, and few rows) names, the rows with the least hashes of key, at most `limit` many.

    Rows are counted by group first; only those whose hash lies under four times the limit's share of the hashes
    take part in the ranking, so what a group's task reads doesn't grow with the table.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("__n")).join(F.broadcast(limits), group)
    near = rows.withColumn("__h", F.xxhash64(key)).join(F.broadcast(counts), group)
    near = near.where(F.col("__h") / F.lit(2.0**64) + 0.5 <= 4 * (F.col(limit) + 8) / F.col("__n"))
    order = Window.partitionBy(group).orderBy("__h", *rows.columns)
    return near.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= F.col(limit)).select(*rows.columns)


def spread_join(rows: DataFrame, found: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of rows with found, which has each key once and in `weight` how many of the `total` rows have it.

    The rows of keys with more than total / HOT_KEYS rows, of which there are fewer than HOT_KEYS, are dealt
    out over SALTS parts, to each of which goes a copy of the key's row of found.
    """
    hot = F.col(weight) > total / HOT_KEYS
    heavy = found.where(hot)
    marked = rows.join(F.broadcast(heavy.select(*on, F.lit(1).alias("__hot"))), on, "left")
    salted = marked.withColumn("__salt", F.when(F.col("__hot") == 1, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    salts = F.sequence(F.lit(0).cast("long"), F.when(hot, F.lit(SALTS - 1)).otherwise(F.lit(0)).cast("long"))
    return salted.join(found.withColumn("__salt", F.explode(salts)), [*on, "__salt"]).drop("__salt", "__hot")


def by_ids(rows: DataFrame, ids: DataFrame, how: str, on: list[str] | None = None) -> DataFrame:
    """Join of rows with ids (a narrow table that has each key once), which is broadcast if it has at most BROADCAST_IDS rows."""
    ids = cut(ids)
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, on or ids.columns, how)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star steps.

    edges: src, dst (long). Returns node, component (the smallest node reachable) for every node with
    an edge. Each step is one shuffle by node with partial aggregation of the minimum; the number of
    steps grows with the logarithm of the longest path. An empty graph gives no rows.
    """
    e = cut(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src != dst").distinct())
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m"))
        # large star: neighbours above a node are linked with the least of its neighbourhood
        large = both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src != dst").distinct()
        # small star: a node and its neighbours below are linked with the least of them
        below = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(below, "src").select("src", "dst", "m")
        e2 = cut(
            small.select(F.col("dst").alias("src"), F.col("m").alias("dst"))
            .unionByName(below.select("src", F.col("m").alias("dst")))
            .where("src != dst")
            .distinct()
        )
        now = e2.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        e = e2
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    nodes = e.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = e.select(F.col("dst").alias("node")).distinct()
    return nodes.unionByName(roots.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
