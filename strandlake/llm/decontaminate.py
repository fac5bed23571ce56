"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is words, a block is two words, the test strings are windows of ten consecutive item
words (an item of fewer words, but not none, is one window).  For each window length a table, in
which blocks of one hash share the smaller value, gives the shift of a block: how far the search may
jump because no window can end earlier.  A block with shift zero selects, by the hash of the words
that end here, a bucket of windows, and their words are compared directly.  Words outside the
benchmark's vocabulary have the greatest shift of all.

The tables are arrays.  A benchmark is searched in blocks whose built size is counted as they are
filled (``BLOCK_BYTES``); of several blocks each is one pass over the rows, written out before the
next, so one block is held at a time.

Defined results: a null text has no words; items of no words match nothing; equal windows of
several items count for each; repeated item_ids count once per item_id; null item_ids mark words
but are not listed; repeated documents are judged each; empty tables give empty results or no
hits.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_ALNUM, cut, map_arrow, slices, stored, strings, table

#: Words in a window.
WINDOW = 10

#: Built size of the tables that are broadcast at once; a larger benchmark is searched in several blocks.
BLOCK_BYTES = 128_000_000
#: What a word of the vocabulary, and a place in an item, take of that (the driver's build included).
WORD_BYTES, PLACE_BYTES = 160, 48
#: log2 of the most entries of a shift table (a byte each).
TABLE_BITS = 24

_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15


def words(text: str) -> list[bytes]:
    """Lower-cases A-Z and splits at ASCII characters other than digits and letters."""
    return text.encode().translate(LOWER_ALNUM).split()


class Group:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, places: np.ndarray, starts: np.ndarray, owners: np.ndarray, length: int):
        self.length, self.block = length, min(2, length)
        self.bits = int(np.clip(np.ceil(np.log2(8.0 * length * len(starts))), 8, TABLE_BITS))
        shift = np.full(1 << self.bits, length - self.block + 1, np.uint8)
        value = np.zeros(len(starts), np.uint64)
        for k in range(length):
            value = value * np.uint64(_P) + places[starts + k].astype(np.uint64) + np.uint64(1)
        for end in range(self.block - 1, length):  # later ends have smaller shifts and are written over
            here = places[starts + end].astype(np.uint64)
            if self.block == 2:
                here = here + places[starts + end - 1].astype(np.uint64) * np.uint64(_P)
            shift[here * np.uint64(_P) >> np.uint64(64 - self.bits)] = length - 1 - end
        self.shift = shift.tobytes()
        order = np.lexsort((owners, value))
        value, starts, owners = value[order], starts[order], owners[order]
        first = np.concatenate(([True], value[1:] != value[:-1]))
        for at in range(1, len(starts), 100_000):  # equal hashes are equal windows unless their words differ
            x, y = starts[at : at + 100_000], starts[at - 1 : at - 1 + 100_000][: len(starts[at : at + 100_000])]
            first[at : at + len(x)] |= (places[x[:, None] + np.arange(length)] != places[y[:, None] + np.arange(length)]).any(axis=1)
        first = np.flatnonzero(first)
        self.hash, self.start, self.owners, self.edges = value[first], starts[first], owners, np.append(first, len(starts))

    def find(self, places: np.ndarray, here: list[int]) -> int:
        """The number of the window with these words, or -1."""
        h = 0
        for w in here:
            h = (h * _P + w + 1) & _MASK
        k = int(self.hash.searchsorted(np.uint64(h)))
        while k < len(self.hash) and int(self.hash[k]) == h:
            if places[self.start[k] : self.start[k] + self.length].tolist() == here:
                return k
            k += 1
        return -1


class Matcher:
    """Finds every occurrence of every window of a set of items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        places, groups, at = [], {}, 0
        for k, (_, text) in enumerate(items):
            own = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text or "")], np.int32)
            if len(own):
                n = min(window, len(own))
                starts = np.arange(at, at + len(own) - n + 1)
                groups.setdefault(n, []).append((starts, np.full(len(starts), k)))
                places.append(own)
                at += len(own)
        self.items = [item for item, _ in items]
        self.places = np.concatenate([*places, np.empty(0, np.int32)])
        self.groups = [Group(self.places, *(np.concatenate(x).astype(np.int32) for x in zip(*groups[n])), n) for n in sorted(groups)]

    def search(self, ids: list[int | None]) -> tuple[list[tuple[int, int]], set]:
        """Ranges of hit words, ordered by window length and place, and the items that occur."""
        ranges, items, n = [], set(), len(ids)
        for g in self.groups:
            m, pairs, shift, down = g.length, g.block == 2, g.shift, 64 - g.bits
            most = m - g.block + 1
            end = m - 1
            found: dict[int, None] = {}
            while end < n:
                b = ids[end]
                if b is None:  # no window holds this word, so none can end before it has passed
                    end += m
                    continue
                if pairs:
                    a = ids[end - 1]
                    if a is None:
                        end += most
                        continue
                    b += a * _P
                s = shift[(b * _P & _MASK) >> down]
                if s:
                    end += s
                    continue
                here = ids[end - m + 1 : end + 1]
                k = g.find(self.places, here) if None not in here else -1
                if k >= 0:
                    ranges.append((end - m + 1, end + 1))
                    found[k] = None
                end += 1
            for k in found:
                items.update(self.items[x] for x in g.owners[g.edges[k] : g.edges[k + 1]].tolist())
        return ranges, items

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set]:
        own = words(text)
        return len(own), *self.search(list(map(self.vocabulary.get, own)))


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorts and joins overlapping or touching ranges."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def benchmark_blocks(bench: DataFrame, item: str, text: str, limit: int = BLOCK_BYTES):
    """The stated query set as driver-side blocks whose tables take at most ``limit`` bytes (one item at least)."""
    src = bench.select(bench[item].alias("item"), bench[text].alias("text"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = src.collect() if total <= limit // 16 else cut(src).toLocalIterator()
    block, held, known = [], 0, set()
    for r in rows:
        own = words(r[1] or "")
        fresh_words = {w for w in own if w not in known}
        size = PLACE_BYTES * len(own) + WORD_BYTES * len(fresh_words)
        if block and held + size > limit:
            yield block
            block, held, known = [], 0, set()
            fresh_words = set(own)
            size = PLACE_BYTES * len(own) + WORD_BYTES * len(fresh_words)
        block.append(tuple(r))
        held += size
        known |= fresh_words
    yield block


def passes(docs: DataFrame, bench: DataFrame, item: str, item_text: str, window: int, limit: int, step, schema) -> DataFrame:
    """One pass of ``step(matcher, last)`` for each block; what a pass yields is written before the next begins."""
    spark = docs.sparkSession
    blocks = benchmark_blocks(bench, item, item_text, limit)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        shared = spark.sparkContext.broadcast(Matcher(block, window))
        docs = map_arrow(docs, step(shared, after is None), schema)
        if after is not None:
            docs = stored(docs, "benchmark-pass")
            shared.destroy()
        block = after
    return docs


def find_leaks(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: ``key``, n_words, hits (merged word ranges) and items (sorted strings that occur).

    Each row is judged by itself, so nothing is shuffled; of several blocks each adds its ranges and
    items to those of the passes before.
    """
    hit = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("hits", hit), T.StructField("items", T.ArrayType(T.StringType()))])
    arrow_hit = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def step(shared, last: bool):
        def run(batches):
            matcher = shared.value
            for whole in batches:
                for batch in slices(whole, "text"):
                    n, hits, items = [], [], []
                    earlier = zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist()) if "hits" in batch.schema.names else ((None, None) for _ in range(batch.num_rows))
                    for t, (h, i) in zip(strings(batch.column("text")), earlier):
                        count, ranges, found = matcher.scan(t)
                        n.append(count)
                        hits.append([{"start": a, "end": b} for a, b in merge([*((x["start"], x["end"]) for x in h or ()), *ranges])])
                        items.append(sorted({*(i or ()), *(str(x) for x in found if x is not None)}))
                    kept = pa.nulls(batch.num_rows, pa.string()) if last else batch.column("text")
                    yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "text": kept, "n_words": pa.array(n, pa.int64()), "hits": pa.array(hits, arrow_hit), "items": pa.array(items, pa.list_(pa.string()))})

        return run

    src = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    return passes(src, bench, item, item_text, window, block_bytes, step, schema).drop("text").withColumnRenamed("key", key)


def leak_report(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return find_leaks(docs, bench, **options).withColumn("n_hit", n_hit).select(
        options.get("key", "doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def keep_uncontaminated(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, unchanged; one pass per block."""
    at = docs.schema.names.index(text)

    def step(shared, last: bool):
        def run(batches):
            matcher = shared.value
            for whole in batches:
                for batch in slices(whole, text):
                    yield batch.filter(pa.array([not matcher.scan(t)[1] for t in strings(batch.column(at))], pa.bool_()))

        return run

    return passes(docs, bench, item, item_text, window, block_bytes, step, docs.schema)


def brute_force(docs, items, window: int = WINDOW):
    """Straight from the definition, for tests: rows of (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut_words = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    patterns = []
    for item, t in items:
        w = cut_words(t)
        patterns += [(w[i : i + window], item) for i in range(max(1, len(w) - window + 1))] if w else []
    out = []
    for doc, t in docs:
        w, hit, found = cut_words(t), set(), set()
        for p, item in patterns:
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(item)
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
