"""Embedding near-duplicates by cross-polytope hashing with verified pairs.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is the
axis nearest to the result (Andoni et al. 2015).  A table joins ``HASHES`` such axes, and each
vector also probes the ``PROBES`` next likeliest buckets of every table.  Vectors of one label that
meet in a bucket are compared exactly, in double precision, in chunks of bounded size.

Equal vectors of a label are one class with a multiplicity, so copies make no pairs.  A bucket's
comparison emits one row per member (its number of links and the smallest member that it is
linked to through others), never pairs; a pair that meets in several buckets is counted in the one
with the smallest code.  Buckets of the same members are handled once.  Buckets above ``CHUNK``
members are dealt into chunks, and all pairs of chunks are compared, so nothing is lost.  Joins
on hot buckets, classes and components are made where their rows lie.

Defined results: null labels, null or zero vectors, and vectors with null or non-finite
components link with nothing; vectors of different lengths never link; rows that repeat a vector
count as other vectors of it, also under the same vec_id; an empty table gives an empty result;
only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, join_hot, map_arrow, stored, table
from .minhash import mix
from .neardup import forest

TABLES, HASHES, PROBES = 10, 3, 4
CHUNK = 1024
LEAST_COSINE = 0.98


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row (a power of two long), scaled to keep lengths."""
    n, width = x.shape
    half = 1
    while half < width:
        x = x.reshape(n, width // (2 * half), 2, half)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


def codes(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """Bucket codes of unit rows: one and ``PROBES`` more for each table, distinct within a row."""
    n, dim = x.shape
    width = 1 << max(1, (dim - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - dim)))
    g = np.random.default_rng([seed, width])
    out = []
    for t in range(TABLES):
        first, second, loss = [], [], []
        for _ in range(HASHES):
            y = x
            for _ in range(3):
                y = hadamard(y * g.choice([-1.0, 1.0], width))
            top = np.argpartition(-np.abs(y), 2, axis=1)[:, :3] if width > 2 else np.argsort(-np.abs(y), axis=1)
            size = np.take_along_axis(np.abs(y), top, 1)
            order = np.argsort(-size, axis=1)
            top, size = np.take_along_axis(top, order, 1), np.take_along_axis(size, order, 1)
            axis = 2 * top + (np.take_along_axis(y, top, 1) < 0)
            first.append(axis[:, 0])
            second.append(axis[:, 1:])
            loss.append(size[:, :1] - size[:, 1:])
        base = np.stack(first, axis=1)
        found = [base]
        # Probes that change one hash, the smallest loss first.
        all_loss = np.concatenate(loss, axis=1)
        width_2 = second[0].shape[1]
        best = np.argsort(all_loss, axis=1)[:, :PROBES]
        for p in range(best.shape[1]):
            probe = base.copy()
            for h in range(HASHES):
                pick = best[:, p] // width_2 == h
                probe[pick, h] = second[h][pick, best[pick, p] % width_2]
            found.append(probe)
        for b in found:
            h = np.full(n, np.uint64(t * 1000 + dim))
            for k in range(HASHES):
                h = mix(h ^ mix(b[:, k].astype(np.uint64) + np.uint64(k * 100_000 + 1)))
            out.append(h.view(np.int64))
    return np.stack(out, axis=1)


def hashed(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """key, vkey (null if the vector links with nothing), vec and codes of each row."""
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 2048):
                batch = whole.slice(at, 2048)
                rows: list[np.ndarray | None] = []
                for v, lab in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    x = None if v is None or lab is None or not v or any(c is None for c in v) else np.array(v, np.float64)
                    rows.append(x if x is not None and np.isfinite(x).all() and x.any() else None)
                own: list = [None] * len(rows)
                for dim in {len(x) for x in rows if x is not None}:
                    who = [i for i, x in enumerate(rows) if x is not None and len(x) == dim]
                    m = np.array([rows[i] for i in who])
                    m = m / np.abs(m).max(axis=1, keepdims=True)
                    for i, c in zip(who, codes(m / np.linalg.norm(m, axis=1, keepdims=True))):
                        own[i] = c
                labels = batch.column(2).to_pylist()
                name = [None if x is None else hashlib.blake2b(f"{lab}:".encode() + (x + 0.0).tobytes(), digest_size=16).digest() for x, lab in zip(rows, labels)]
                yield pa.RecordBatch.from_pydict({"key": batch.column(0), "label": pa.array([None if x is None else str(x) for x in labels], pa.string()), "vkey": pa.array(name, pa.binary()), "vec": pa.array([None if x is None else x.tobytes() for x in rows], pa.binary()), "codes": pa.array(own, pa.list_(pa.int64()))})

    return map_arrow(vectors.select(vectors[key].alias("key"), vectors[vector].alias("v"), vectors[label].alias("l")), run, f"key {kind}, label string, vkey binary, vec binary, codes array<long>")


def met_before(codes: pa.ChunkedArray, some: np.ndarray, code: int) -> np.ndarray:
    """Which pairs of the rows marked in ``some`` also meet in a bucket of a smaller code."""
    lists = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    size = np.diff(lists.offsets.to_numpy())
    owner, value = np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy()
    use = (value < code) & some[owner]
    owner, value = owner[use], value[use]
    order = np.lexsort((owner, value))
    owner, value = owner[order], value[order]
    out = np.zeros((len(size), len(size)), bool)
    edge = np.flatnonzero(np.diff(value, prepend=value[:1] - 1, append=value[-1:] + 1)) if len(value) else np.empty(0, np.int64)
    done = set()
    for a, b in zip(edge.tolist(), edge[1:].tolist()):
        if b - a > 1 and (who := owner[a:b].tobytes()) not in done:  # most codes of a tight group have the same rows
            done.add(who)
            out[np.ix_(owner[a:b], owner[a:b])] = True
    return out


def judge(group: pa.Table, least: float) -> pa.Table:
    """For each member of one chunk (or pair of chunks): links counted here, and where they lead."""
    cls = group.column("cls")
    vec = [np.frombuffer(v, np.float64) for v in group.column("vec").to_pylist()]
    weight = group.column("weight").to_numpy()
    side = group.column("chunk").to_numpy()
    p, q, code = group.column("p")[0].as_py(), group.column("q")[0].as_py(), group.column("code")[0].as_py()
    dims = np.array([len(v) for v in vec])
    linked = np.zeros((len(vec), len(vec)), bool)
    for d in np.unique(dims):
        who = np.flatnonzero(dims == d)
        x = np.array([vec[i] for i in who])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        norm = np.sqrt((x * x).sum(axis=1))
        linked[np.ix_(who, who)] = (x @ x.T) / (norm[:, None] * norm[None, :]) >= least
    if p != q:
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    some = linked.any(axis=1)
    root = forest(linked)
    counts = (linked & ~met_before(group.column("codes"), some, code)) @ weight
    take = pa.array(np.flatnonzero(some))
    return pa.table({"a": cls.take(take), "b": cls.take(pa.array(root[some])), "links": pa.array(counts[some])})


def find_links(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST_COSINE) -> DataFrame:
    """Returns key, n_links, component_id and kept of each row of ``vectors``."""
    kind = vectors.schema[key].dataType.simpleString()
    rows = stored(hashed(vectors, key, vector, label), "hashed")
    classes = stored(rows.where("vkey is not null").groupBy(F.col("vkey").alias("cls")).agg(F.min("key").alias("least"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("vec").alias("vec"), F.first("codes").alias("codes")), "vectors")
    meets = classes.select("cls", "label", F.explode(F.array_distinct("codes")).alias("code"))
    bucket = meets.groupBy("label", "code").agg(F.count("*").alias("n"), F.min("cls").alias("first"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("sign"))
    # Of buckets with the same members the one of the smallest code does for all.
    bucket = bucket.where("n > 1").groupBy("label", "n", "first", "sign").agg(F.min("code").alias("code"))
    bucket = cut(bucket.select("label", "code", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"), "n"))
    members = join_hot(meets, bucket, ["label", "code"]).withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("cls", "label", "code", "chunk", F.least("chunk", "other").alias("p"), F.greatest("chunk", "other").alias("q"))
    full = dealt.join(classes.select("cls", "weight", "vec", "codes"), "cls")
    found = cut(full.groupBy("label", "code", "p", "q").applyInArrow(lambda t: judge(t, least), "a binary, b binary, links long"))
    counted = found.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    comp = components(found.where("a <> b").select("a", "b")).withColumnRenamed("id", "cls")
    at = classes.select("cls", "least", "weight").join(comp, "cls", "left").join(counted, "cls", "left")
    at = cut(at.select("cls", "least", "weight", "component", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    linked, alone = at.where("component is not null"), at.where("component is null")
    smallest = cut(linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    per = join_hot(linked, smallest, "component").drop("component", "least").unionByName(alone.withColumnRenamed("least", "component_id").drop("component"))
    per = cut(per.select(F.col("cls").alias("vkey"), F.col("weight").alias("n"), "component_id", "n_links"))
    slim = rows.select("key", "vkey")
    out = join_hot(slim.where("vkey is not null"), per, "vkey").unionByName(slim.where("vkey is null").select("key", "vkey", F.col("key").alias("component_id"), F.lit(0).cast("long").alias("n_links")))
    out = out.select("key", F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast(kind).alias("component_id"))
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def brute_force(rows, least: float = LEAST_COSINE):
    """Straight from the definition, for tests: rows of (vec_id, n_links, component_id, kept)."""
    from math import isfinite, sqrt

    good = lambda v, lab: lab is not None and v and all(c is not None and isfinite(c) for c in v) and any(v)
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, v, a) in enumerate(rows):
        for j in range(i):
            _, w, b = rows[j]
            if good(v, a) and good(w, b) and a == b and len(v) == len(w):
                dot = sum(x * y for x, y in zip(v, w))
                if dot / sqrt(sum(x * x for x in v)) / sqrt(sum(x * x for x in w)) >= least:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    smallest: dict[int, int] = {}
    for i, r in enumerate(rows):
        smallest[find(i)] = min(smallest.get(find(i), r[0]), r[0])
    return [(r[0], links[i], smallest[find(i)], r[0] == smallest[find(i)]) for i, r in enumerate(rows)]


def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_links(table(spark, sf_dir, "embeddings"))
