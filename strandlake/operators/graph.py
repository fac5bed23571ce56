"""Connected components, lightest spanning forests and single-linkage trees of edge lists of any size.

Edge lists up to TASK_EDGES are worked out by one task; larger ones by rounds of joins on partially
aggregated minima, cut by reliable checkpoints.  The number of rounds grows with the logarithm of the number of
vertices, whatever the shape, and none of the loops has a limit that a graph could reach.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels.gapless import lightest as lightest_edges


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, by ``spark.checkpoint.dir`` (tests: below the warehouse)."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.checkpoints").rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again."""
    df.write.parquet(at := folder(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Edges (some 24 bytes each) that one task works out by itself.
TASK_EDGES = 500_000
#: Keys that hold more than one in so many of all rows are hot; there are fewer of them than this.
HOT_KEYS = 10_000
#: Rows of a key that any task may read.
HOT_ROWS = 1_000
#: Edges that a partition collects before it drops those that its forest does without.
THIN_EDGES = 200_000
FOREST = "a long, b long, dist double"
TREE = "into long, from long, height double"


class Sets:
    """Disjoint sets, named by their smallest members."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        p = self.parent
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = x = p[p[x]]
        return x

    def join(self, a, b) -> tuple | None:
        """The names (smaller, greater) of the sets that are joined, None if they are one."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return None
        a, b = min(a, b), max(a, b)
        self.parent[b] = a
        return a, b


def look_up(rows: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """Replaces ``column`` by its value in ``table`` (id, value), which has one row an id.

    Values of hot ids are broadcast (fewer than HOT_KEYS, whatever the data) and joined where the rows
    lie; the others meet by a shuffle, in which no id is large.  Both inputs are read several times.
    """
    table = table.select(F.col("id").alias("__id"), F.col("value").alias("__value"))
    counts = rows.groupBy(F.col(column).alias("__id")).agg(F.count("*").alias("rows"))
    total, most = counts.agg(F.sum("rows"), F.max("rows")).first()
    least = max(HOT_ROWS, (total or 0) // HOT_KEYS + 1)
    out = lambda df: df.select(*[F.col("__value").alias(c) if c == column else F.col(c) for c in rows.columns])
    if (most or 0) <= least:
        return out(rows.join(table, rows[column] == table["__id"]))
    hot = F.broadcast(table.join(F.broadcast(counts.where(F.col("rows") > least).select("__id")), "__id"))
    few = rows.join(hot.select("__id"), rows[column] == F.col("__id"), "left_anti")
    return out(few.join(table, few[column] == table["__id"]).unionByName(rows.join(hot, rows[column] == hot["__id"])))


def in_one_task(df: DataFrame, run: Callable[[Iterable[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """All rows of a table of bounded size, as tuples, through one task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def whole(batches):
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        out = list(run(rows))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out), kinds)], schema=kinds)

    return df.coalesce(1).mapInArrow(whole, schema)


def arrays_in_one_task(df: DataFrame, run: Callable[..., Iterable[np.ndarray]], schema: str) -> DataFrame:
    """All rows of a table of bounded size, as an array a column without nulls, through one task."""

    def whole(batches):
        held = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in run(*(np.concatenate(c) for c in zip(*held)))], names=names)

    names = [field.split()[0] for field in schema.split(", ")]
    return df.coalesce(1).mapInArrow(whole, schema)


def _components(rows: Iterable[tuple]) -> Iterator[tuple]:
    sets = Sets()
    for a, b in rows:
        sets.join(a, b)
    for x in list(sets.parent):
        yield x, sets.find(x)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) of vertices with an edge; a component is named by its smallest id.

    Rounds of large and small stars (Kiveris et al. 2014): every vertex hands its larger, then its
    smaller, neighbours to the smallest vertex around it, until nothing changes or what is left, which joins the same
    vertices, fits into one task.
    """
    e = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    kind = e.schema["u"].dataType.simpleString()
    digest = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    one_task = lambda e: checkpointed(in_one_task(e, _components, f"id {kind}, component {kind}"))
    before = digest(e)
    alone = edges.where(F.col(a) == F.col(b)).select(F.col(a).alias("id"), F.col(a).alias("component")).distinct()
    if before[0] <= TASK_EDGES:
        found = one_task(e)
        return found.unionByName(alone.join(found, "id", "left_anti"))

    def star(e: DataFrame, large: bool) -> DataFrame:
        flipped = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        both = e.unionByName(flipped) if large else e
        least = checkpointed(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("value")))
        handed = look_up(both.select("u", "v", F.col("u").alias("to")), "to", least)
        if large:
            out = handed.where("v > u").select(F.col("v").alias("u"), F.col("to").alias("v"))
        else:
            out = handed.select(F.col("v").alias("u"), F.col("to").alias("v")).unionByName(least.select(F.col("id").alias("u"), F.col("value").alias("v")))
        return checkpointed(out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    while True:
        e = star(star(e, True), False)
        now = digest(e)
        if now == before or now[0] <= TASK_EDGES:
            break
        before = now
    if now[0] <= TASK_EDGES:
        found = one_task(e)
    else:
        found = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
        found = checkpointed(found.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))
    return found.unionByName(alone.join(found, "id", "left_anti"))


def _forest(rows: Iterable[tuple]) -> Iterator[tuple]:
    """The edges (a, b, dist) of the lightest forest, lightest first."""
    sets = Sets()
    for dist, a, b in sorted((d, a, b) for a, b, d in rows):
        if sets.join(a, b):
            yield a, b, dist


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The lightest spanning forest of edges (a, b, dist); of equal distances the smaller (a, b) is lighter.

    First every partition drops the edges that its own forest does without, as they come, so that of all edges no more
    are shuffled than partitions have vertices.  Then, in rounds, every
    vertex takes its lightest edge, what these join becomes one vertex, and of parallel edges the lightest
    stays; a round at least halves the vertices that have edges left.
    """
    e = edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"), F.col("dist").cast("double").alias("dist")).where("a <> b")

    def thin(batches):
        forest, new, size = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)], [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new.append([c.to_numpy() for c in batch.columns])
                size += batch.num_rows
            if size >= max(THIN_EDGES, 4 * len(forest[0])) or batch is None and size:
                every = [np.concatenate(c) for c in zip(forest, *new)]
                kept = lightest_edges(*every)
                forest, new, size = [c[kept] for c in every], [], 0
        for k in range(0, len(forest[0]), THIN_EDGES):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + THIN_EDGES]) for c in forest], names=["a", "b", "dist"])

    e = checkpointed(e.mapInArrow(thin, FOREST))
    rows, before = e.count(), None
    while rows > TASK_EDGES and (before is None or 2 * rows <= before):  # what is left is thinned again in fewer parts, of bounded size
        e = checkpointed(e.repartition(rows // (4 * TASK_EDGES) + 1).mapInArrow(thin, FOREST))
        rows, before = e.count(), rows
    e = checkpointed(e.groupBy("a", "b").agg(F.min("dist").alias("dist")))
    if rows <= TASK_EDGES:
        return checkpointed(in_one_task(e, _forest, FOREST))
    rest, parts = e.select(F.col("a").alias("x"), F.col("b").alias("y"), "dist", "a", "b"), []
    while not rest.isEmpty():
        way = lambda x, y: rest.select(F.col(x).alias("x"), F.struct("dist", "a", "b", F.col(y).alias("y")).alias("k"))  # noqa: E731, B023
        best = checkpointed(way("x", "y").unionByName(way("y", "x")).groupBy("x").agg(F.min("k").alias("k")).select("x", "k.dist", "k.a", "k.b", "k.y"))
        parts.append(checkpointed(best.select("a", "b", "dist").distinct()))
        # Two vertices that took the same edge would point at each other: the smaller one is the root.
        twice = best.groupBy("a", "b").agg(F.count("*").alias("ends"))
        to = best.join(twice, ["a", "b"]).select(F.col("x").alias("id"), F.when((F.col("ends") == 2) & (F.col("x") < F.col("y")), F.col("x")).otherwise(F.col("y")).alias("value"))
        to, moved = checkpointed(to), True
        while moved:
            further = checkpointed(look_up(to.withColumn("was", F.col("value")), "value", to))
            moved = not further.where("value <> was").isEmpty()
            to = further.drop("was")
        rest = checkpointed(look_up(checkpointed(look_up(rest, "x", to)), "y", to).where("x <> y"))
        lightest = rest.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min(F.struct("dist", "a", "b")).alias("k"))
        rest = checkpointed(lightest.select("x", "y", "k.dist", "k.a", "k.b"))
    out = parts[0]
    for part in parts[1:]:  # as many as rounds
        out = out.unionByName(part)
    return out


def _joins(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(into, from, height) of the edges (rank, a, b, dist) of a forest, joined in order of rank."""
    sets = Sets()
    for _, a, b, dist in sorted(rows):
        into, gone = sets.join(a, b)
        yield into, gone, dist


def single_linkage_tree(edges: DataFrame) -> DataFrame:
    """(into, from, height): every join of single linkage, clusters named by their smallest members.

    Only the edges of the lightest forest join anything.  They are ranked by distance and split at
    the middle: the lower half joins among itself; the upper half does so with what the lower half joined as
    vertices, so the two no longer depend on each other.  Parts of TASK_EDGES edges are worked out by a task each.
    """
    forest = spanning_forest(edges)
    ranked = checkpointed(forest.orderBy("dist", "a", "b").select(F.lit(0).cast("long").alias("part"), F.monotonically_increasing_id().alias("rank"), "a", "b", "dist"))
    done = []

    def run(group: pa.Table) -> pa.Table:
        out = list(_joins(zip(*(group.column(c).to_pylist() for c in ("rank", "a", "b", "dist")))))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], names=["into", "from", "height"])

    while True:
        size = checkpointed(ranked.groupBy("part").agg(F.count("*").alias("edges"), F.percentile_approx("rank", 0.5).alias("middle")))
        large = size.where(F.col("edges") > TASK_EDGES)
        small = ranked.join(large.select("part"), "part", "left_anti")
        done.append(checkpointed(small.groupBy("part").applyInArrow(run, TREE)))
        if large.isEmpty():
            break
        ranked = ranked.join(large.select("part", "middle"), "part")
        lower, upper = ranked.where("rank <= middle").drop("middle"), ranked.where("rank > middle").drop("middle")
        # A vertex is another one in each part: part and id make one number, of which the smaller id is the smaller.
        span, least = (F.lit(str(x)).cast("decimal(20,0)") for x in (2**64, -(2**63)))
        wide = lambda c: (F.col("part").cast("decimal(18,0)") * span + F.col(c) - least).cast("decimal(38,0)")  # noqa: E731, B023
        own = connected_components(lower.select(wide("a").alias("x"), wide("b").alias("y")), "x", "y").select("id", F.col("component").alias("value"))
        named = checkpointed(upper.withColumns({"x": wide("a"), "y": wide("b")}))
        ends = named.select(F.col("x").alias("id")).unionByName(named.select(F.col("y").alias("id"))).distinct()
        own = checkpointed(ends.join(own, "id", "left").select("id", F.coalesce("value", "id").alias("value")))
        named = look_up(checkpointed(look_up(named, "x", own)), "y", own)
        back = lambda c: (F.col(c) - F.col("part").cast("decimal(18,0)") * span + least).cast("long")  # noqa: E731, B023
        upper = named.select((2 * F.col("part") + 2).alias("part"), "rank", back("x").alias("a"), back("y").alias("b"), "dist")
        ranked = checkpointed(lower.withColumn("part", 2 * F.col("part") + 1).unionByName(upper))
    out = done[0]
    for part in done[1:]:  # as many as halvings
        out = out.unionByName(part)
    return out
