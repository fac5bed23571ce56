"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word contracts define it: space and U+0009 to U+000D.
ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Bytes with A-Z lower-cased and nothing else changed.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: As LOWER, with every ASCII byte that is no digit or letter turned into a space.
LOWER_ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests) a folder
    below the warehouse is used.  It is also made the context's checkpoint folder if it has none.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint, which survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage is cut, and columns can be left unread."""
    df.write.parquet(at := work_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(at)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a written table is whole: Spark adds _SUCCESS when the last task has committed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def fresh(name: str, *taken) -> str:
    """A column name that none of the given lists of names holds."""
    used = {c.lower() for t in taken for c in t}
    while name.lower() in used:
        name += "_"
    return name


#: Keys that hold more than one in so many of all rows are hot; there are fewer of them than this.
HOT_KEYS = 10_000
#: Rows of one key that any task may read.
HOT_ROWS = 64


def join_hot(rows: DataFrame, side: DataFrame, key: str | list[str], n: str = "n") -> DataFrame:
    """Inner join with ``side``, which has one row a key and in ``n`` the number of ``rows`` with that key.

    Rows of a key above one part in HOT_KEYS of all are joined where they lie, with the broadcast rows
    of such keys (fewer than HOT_KEYS, whatever the data); all others meet by a shuffle, in which no
    key is large.  ``side`` is read several times and should be materialised; it loses ``n``.
    """
    on = [key] if isinstance(key, str) else key
    total = side.agg(F.sum(n)).first()[0] or 0
    least = max(HOT_ROWS, total // HOT_KEYS + 1)
    hot = F.broadcast(side.where(F.col(n) > least).drop(n))
    few = rows.join(hot.select(*on), on, "left_anti").join(side.where(F.col(n) <= least).drop(n), on)
    return few.unionByName(rows.join(hot, on))


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


#: Rows of an Arrow batch at most; long texts make larger batches than rows suggest.
ARROW_ROWS = 2000


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` that holds worker memory down.

    Batches get at most ARROW_ROWS rows (a setting of the session, lowered here if it is larger), and
    a worker that ends a task gives unused memory back, since it lives on to run other stages.
    """
    spark = df.sparkSession
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    """Returns freed memory of Arrow and of the C library to the system."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, chars: int = 8_000_000):
    """Cuts a batch so that each part holds about so many bytes of ``column`` (one row at least).

    This bounds a worker's memory only; every row and every character is still processed.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count == len(col) or not len(col):
        yield batch
        return
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // chars
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(col)]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


#: Edges (about 16 bytes each) that one task may join by itself; more go through distributed rounds.
SMALL_EDGES = 200_000


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list, as (id, component): the smallest id reachable.

    Alternates large-star and small-star steps (Kiveris et al. 2014, "Connected Components in
    MapReduce and Beyond").  A step joins each vertex with the smallest vertex of its
    neighbourhood, found by a partially aggregated ``min``, so no neighbourhood is ever gathered
    in one task, and hubs are joined where their edges lie (``join_hot``).  Each
    round is cut by a reliable checkpoint.  At most ``SMALL_EDGES`` edges, which are counted first,
    are joined by one task instead, with the same result.  Only vertices that have an edge to
    another vertex appear; null ends and self-loops are ignored; repeated edges count once.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct())

    def digest(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = digest(e)
    if before[0] <= SMALL_EDGES:
        kind = e.schema["u"].dataType.simpleString()
        return e.coalesce(1).mapInArrow(_join_small, f"id {kind}, component {kind}")

    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        joined = join_hot(both, least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    for _ in range(max_rounds):
        e = cut(step(step(e, True), False))
        after = digest(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    child = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return child.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _join_small(batches):
    """Union-find over the edges of one small partition."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root.setdefault(x, x)
            root.setdefault(y, y)
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    if root:
        yield pa.RecordBatch.from_arrays([pa.array(list(root), kind), pa.array([find(x) for x in root], kind)], names=["id", "component"])
