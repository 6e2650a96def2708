"""What several corpus operators share: the shared working folder and connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Small tables up to this size (their values as text, and 16 bytes a row) are sent to all executors.
BROADCAST_BYTES = 8_000_000
#: Where working tables go in a local session that names no shared folder (tests, single machine).
LOCAL_FOLDER = "/tmp/checkpoints/tiltmeter"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session decides. Without it, a local session uses
    ``LOCAL_FOLDER`` and a cluster its warehouse folder, which is shared as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return LOCAL_FOLDER
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (a stored table) with a broadcast hint if its rows are proven to be small; both ways give the same join."""
    row = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= most else df


#: What this Python worker remembers between tasks of one operator.
_remembered: dict[str, object] = {}


def remembered(name: str, build: Callable[[], object]) -> object:
    """What ``build`` makes, made once in a worker, until a task of another operator ends there."""
    if name not in _remembered:
        _remembered[name] = build()
    return _remembered[name]


def hand_back_memory(keep: str | None = None) -> None:
    """Forget what is remembered under other names and return freed memory to the system, at the end of a task.

    Workers are kept for later tasks, and those may be of other operators.
    """
    others = [name for name in _remembered if name != keep]
    for name in others:
        del _remembered[name]
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows that a Python worker gets at once, while a table of whole texts is written."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` as ``(id, component_id)``.

    ``component_id`` is the smallest id of the component. Only ids that have an edge to another
    id appear. Each round contracts every node into its least neighbour: in the first round by id, which
    ends stars around their least id, then under an order that is drawn anew from a hash, so the number
    of nodes shrinks by a constant factor whatever the shape of the graph; hubs are aggregated with partial sums and joined with plain equi-joins. The
    parent maps of the rounds are stored tables; they are composed backwards at the end.
    """
    left = stored(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "cc-edges",
    )
    maps: list[DataFrame] = []
    for turn in range(max_rounds):
        if left.isEmpty():
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        key = lambda c: F.struct((F.xxhash64(F.lit(turn), F.col(c)) if turn else F.lit(0)).alias("h"), F.col(c).alias("id"))  # noqa: E731, B023
        parent = stored(
            both.groupBy("a")
            .agg(F.min(key("b")).alias("n"))
            .select(F.col("a").alias("id"), F.least(key("a"), F.col("n"))["id"].alias("up")),
            "cc-parents",
        )
        maps.append(parent)
        pa = parent.select(F.col("id").alias("a"), F.col("up").alias("pa"))
        pb = parent.select(F.col("id").alias("b"), F.col("up").alias("pb"))
        moved = left.join(pa, "a").join(pb, "b").where("pa <> pb")
        left = stored(
            moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges"
        )
    else:
        raise RuntimeError("components() did not finish; raise max_rounds")
    if not maps:
        return left.select(F.col("a").alias("id"), F.col("a").alias("component_id"))
    root = maps[-1]
    for parent in reversed(maps[:-1]):
        later = root.select(F.col("id").alias("up"), F.col("up").alias("top"))
        root = parent.join(later, "up", "left").select("id", F.coalesce("top", "up").alias("up"))
    root = stored(root, "cc-roots")
    least = root.groupBy("up").agg(F.min("id").alias("component_id"))
    return root.join(least, "up").select("id", "component_id")
