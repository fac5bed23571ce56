"""Near-duplicate documents by HyperMinHash banding and exact verification.

1. Each text becomes its shingle set, a HyperMinHash sketch and 32 band keys of four densified
   registers; texts with equal sets form one class, so copies cost one row each and no pairs.
2. Classes that share a band key form a bucket.  Buckets with the same members are handled once.
3. Within a bucket all pairs are judged in memory: the collision-corrected estimate rules out
   what cannot reach the threshold, full shingle sets decide the rest.  Only a spanning forest of
   the links is emitted, never pairs of a group.  A bucket above ``CHUNK_ROWS`` or
   ``CHUNK_HASHES`` is dealt into chunks by a salt.  Its smallest members go into every chunk,
   which joins most chunks; only if it still holds several components are its pairs of chunks
   compared too, so nothing is lost and a uniform hot group costs one pass.
4. Connected components over the links give each document the smallest doc_id reachable.

At a similarity of 0.75 a pair shares no band with probability (1 - 0.75^4)^32 < 6e-6.

Defined results: null and empty texts, and texts of white space, have no shingles and link with
nothing; rows that repeat a doc_id give a row each, and are documents of their own if their texts
differ; a null doc_id names a component only if no other is reachable; an empty table gives an
empty result; other columns are not read and ``keep_one`` hands them on, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import minhash as M
from .common import checkpoint_dir, components, cut, fresh, join_hot, map_arrow, slices, stored, table

ROWS = 4
#: The threshold as a fraction: links need LEAST[1] * intersection >= LEAST[0] * union.
LEAST = (75, 100)
#: Most members and shingle hashes that are compared at once with a bucket's anchors.
CHUNK_ROWS = 256
CHUNK_HASHES = 375_000
#: Chunks that are put together where pairs of them are compared, so that members are copied less often.
COARSE = 4
#: Smallest members of a large bucket that join every chunk of it.
ANCHORS = 16
#: Ids that may be broadcast (about 16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_shingles, set_key (null if no shingles) and bands of each row; no shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 2_000_000):
                sets = M.shingle_sets(batch.column(1).to_pylist())
                bands = M.band_keys(M.sketches(sets), ROWS)
                some = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_pydict({
                    "key": batch.column(0),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "set_key": pa.array(map(_set_key, sets), pa.binary()),
                    "bands": pa.array([b if x else None for b, x in zip(bands, some)], pa.list_(pa.int64())),
                })

    return map_arrow(docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")), run, f"key {kind}, n_shingles long, set_key binary, bands array<long>")


def _set_key(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def hash_sets(texts: DataFrame) -> DataFrame:
    """(text) to (cls, n, hashes, registers): the set's key, size, packed hashes and sketch."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 2_000_000):
                sets = [s for s in M.shingle_sets(batch.column(0).to_pylist()) if len(s)]
                yield pa.RecordBatch.from_pydict({"cls": pa.array(map(_set_key, sets), pa.binary()), "n": pa.array([len(s) for s in sets], pa.int64()), "hashes": pa.array([s.tobytes() for s in sets], pa.binary()), "registers": pa.array([r.tobytes() for r in M.sketches(sets)], pa.binary())})

    return map_arrow(texts, run, "cls binary, n long, hashes binary, registers binary")


def intersections(sets: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs (at least of those that ``wanted`` marks)."""
    m = len(sets)
    out = np.zeros((m, m), np.int64)
    pairs = np.argwhere(np.triu(wanted, 1))
    if len(pairs) <= max(64, 4 * m):
        for i, j in pairs.tolist():
            a, b = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            out[i, j] = out[j, i] = int((b[at] == a).sum())
        return out
    use = np.flatnonzero(wanted.any(axis=0) | wanted.any(axis=1))
    h = np.concatenate([sets[i] for i in use])
    owner = np.repeat(use, [len(sets[i]) for i in use])
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    count = np.diff(np.append(first, len(h)))
    column = np.repeat(np.arange(len(first)), count)
    shared = np.repeat(count > 1, count)
    column, owner = column[shared], owner[shared]
    if len(column):
        column = np.cumsum(np.concatenate(([0], (column[1:] != column[:-1]).astype(np.int64))))
        width = 4096
        for a in range(0, int(column[-1]) + 1, width):
            lo, hi = np.searchsorted(column, (a, a + width))
            x = np.zeros((m, width), np.float32)
            x[owner[lo:hi], column[lo:hi] - a] = 1
            out += np.rint(x @ x.T).astype(np.int64)
    return out


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the smallest row that links lead to."""
    m = len(linked)
    label = np.arange(m)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], m).min(axis=1, initial=m))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def judge(group: pa.Table, least: tuple[int, int] = LEAST) -> list[tuple[object, object]]:
    """Forest edges of one chunk: pairs of classes that links connect."""
    n = group.column("n").to_numpy()
    cls = group.column("cls").to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
    registers = np.array([np.frombuffer(x, np.uint16) for x in group.column("registers").to_pylist()])
    low, high = np.minimum.outer(n, n), np.maximum.outer(n, n)
    wanted = (least[1] * low >= least[0] * high) & (M.jaccard_bounds(registers, n) >= least[0] / least[1])
    if "comp" in group.column_names:  # what is connected already needs no judgement
        number: dict = {}
        comp = np.array([number.setdefault(c, len(number)) for c in group.column("comp").to_pylist()])
        wanted &= comp[:, None] != comp[None, :]
    np.fill_diagonal(wanted, False)
    if not wanted.any():
        return []
    both = intersections(sets, wanted)
    linked = wanted & (least[1] * both >= least[0] * (n[:, None] + n[None, :] - both))
    root = forest(linked)
    return [(cls[int(r)], cls[i]) for i, r in enumerate(root.tolist()) if r != i]


def _judged(members: DataFrame, sets: DataFrame, by: list[str]) -> DataFrame:
    kind = sets.schema["cls"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.schema([("a", to_arrow_type(kind)), ("b", to_arrow_type(kind))])

    def run(group: pa.Table) -> pa.Table:
        edges = judge(group)
        return pa.Table.from_pydict({"a": [a for a, _ in edges], "b": [b for _, b in edges]}, schema=arrow)

    return members.join(sets, "cls").groupBy(*by).applyInArrow(run, f"a {kind.simpleString()}, b {kind.simpleString()}")


def find_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns key, n_shingles, component_id and kept of each row of ``docs``."""
    return _groups(docs, key, text).select(F.col("key").alias(key), "n_shingles", "component_id", "kept")


def _groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, set_key, n_shingles, component_id and kept of each row; classes are named by their set_key.

    No join meets a hot key: a class, a bucket or a component with a large share of the rows is joined
    where those lie, and rows without shingles take no part.
    """
    checkpoint_dir(docs.sparkSession)
    sig = stored(signatures(docs, key, text), "signatures")
    classes = stored(sig.where("set_key is not null").groupBy(F.col("set_key").alias("cls")).agg(F.min("key").alias("least"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "classes")
    rows = classes.select("cls", "n_shingles", F.explode("bands").alias("bucket"))
    bucket = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.min("cls").alias("first"), F.sum("n_shingles").alias("total"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("sign"))
    # Buckets of the same members are one bucket.
    bucket = bucket.where("members > 1").groupBy("members", "first", "total", "sign").agg(F.min("bucket").alias("bucket"))
    chunks = F.greatest(F.ceil(F.col("members") / CHUNK_ROWS), F.ceil(F.col("total") / CHUNK_HASHES)).cast("int")
    bucket = cut(bucket.select("bucket", chunks.alias("chunks"), F.col("members").alias("n")))
    members = cut(join_hot(rows, bucket, "bucket").withColumn("chunk", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("chunks")).cast("int")).select("cls", "bucket", "chunk", "chunks"))
    wanted = cut(classes.select("cls", "least").join(members.select("cls").distinct(), "cls", "left_semi").select("least").distinct())
    small = wanted.count() <= BROADCAST_IDS
    src = docs.select(docs[key].alias("least"), docs[text].cast("string").alias("text")).join((F.broadcast(wanted) if small else wanted).withColumnRenamed("least", "w"), F.col("least").eqNullSafe(F.col("w")), "left_semi")
    sets = cut(hash_sets(src.select("text")).dropDuplicates(["cls"]))

    large = members.where("chunks > 1")
    rank = F.row_number().over(Window.partitionBy("bucket", "chunk").orderBy("cls"))
    least = large.withColumn("r", rank).where(F.col("r") <= ANCHORS)  # spread by chunk first, so that no task ranks a whole bucket
    least = least.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("cls"))).where(F.col("r") <= ANCHORS)
    anchors = least.select("cls", "bucket", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("to")).where("to <> chunk")
    first = members.select("bucket", "chunk", "cls").unionByName(anchors.select("bucket", F.col("to").alias("chunk"), "cls"))
    edges = cut(_judged(first, sets, ["bucket", "chunk"]))
    comp = cut(components(edges))
    if not large.isEmpty():
        named = large.join(comp.withColumnRenamed("id", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
        several = cut(named.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("bucket"))
        coarse = F.ceil(F.col("chunks") / COARSE).cast("int")
        each = named.join(F.broadcast(several) if several.count() <= BROADCAST_IDS else several, "bucket", "left_semi").withColumn("chunks", coarse).withColumn("chunk", F.col("chunk") % F.col("chunks"))
        # Within a coarse chunk, too: its parts have met the anchors only.
        each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("other <> chunk or chunks = 1")
        pairs = each.select("bucket", F.least("chunk", "other").alias("p"), F.greatest("chunk", "other").alias("q"), "cls", "comp")
        more = _judged(pairs, sets, ["bucket", "p", "q"])
        comp = cut(components(edges.unionByName(more)))
    # Only classes with a link need the smallest key of their component.
    linked = cut(comp.withColumnRenamed("id", "cls").join(classes.select("cls", "least", "copies"), "cls"))
    smallest = cut(linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    linked = join_hot(linked.select("cls", "copies", "component"), smallest, "component").select("cls", "copies", "component_id")
    alone = classes.select("cls", "copies", F.col("least").alias("component_id")).join(comp.select(F.col("id").alias("cls")), "cls", "left_anti")
    merged = cut(linked.unionByName(alone).select(F.col("cls").alias("set_key"), F.col("copies").alias("n"), "component_id"))
    slim = sig.select("key", "n_shingles", "set_key")
    out = join_hot(slim.where("set_key is not null"), merged, "set_key").unionByName(slim.where("set_key is null").withColumn("component_id", F.col("key")))
    return out.select("key", "set_key", "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, the one with the smallest key.

    Rows without shingles all stay.  Rows of one key (null is a key too) are told apart by their sets,
    but only where a key occurs more than once; rows of one key and one set are one document.
    """
    groups = cut(_groups(docs, key, text))
    again = cut(groups.where("n_shingles > 0").groupBy("key").count().where("count > 1").select(F.col("key").alias("__again")))
    gone = groups.where("not kept").select(F.col("key").alias("__gone"))
    small = gone.count() <= BROADCAST_IDS
    at = docs.schema.names.index(text)
    own, name = fresh("own", docs.columns), fresh("shingles", docs.columns)
    held = docs.withColumn(own, docs[key])
    none = lambda other, c, how: held.join(F.broadcast(other) if small else other, F.col(own).eqNullSafe(F.col(c)), how)
    out = none(gone, "__gone", "left_anti")
    if not again.isEmpty():

        def run(batches):
            for whole in batches:
                for batch in slices(whole, text, 2_000_000):
                    names = list(map(_set_key, M.shingle_sets(batch.column(at).to_pylist())))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.binary())], names=[*batch.schema.names, name])

        some = held.join(again, F.col(own).eqNullSafe(F.col("__again")), "left_semi")
        some = map_arrow(some, run, some.withColumn(name, F.lit(None).cast("binary")).schema)
        kept = groups.where("kept").select(F.col("key").alias("__key"), F.col("set_key").alias("__set")).distinct()
        one = some.where(F.col(name).isNotNull()).dropDuplicates([own, name]).join(kept, F.col(own).eqNullSafe(F.col("__key")) & (F.col(name) == F.col("__set")), "left_semi")
        out = out.join(again, F.col(own).eqNullSafe(F.col("__again")), "left_anti").unionByName(some.where(F.col(name).isNull()).unionByName(one).drop(name))
    return out.drop(own)


def op4_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_groups(table(spark, sf_dir, "documents"))


def brute_force(docs: list[tuple[int, str | None]]) -> list[tuple[int, int, int, bool]]:
    """Straight from the definition, for tests."""
    import re

    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(docs)]
