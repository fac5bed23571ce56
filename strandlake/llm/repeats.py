"""Removes every byte of a passage of ``least`` bytes or more that stands earlier too, in the same document or one of a smaller id.

1. Documents are dealt to batches of some BATCH_BYTES by id and text.  Each batch hashes its texts and
   names its anchors (``suffixes``); distinct hashes go to buckets, 8 bytes for some thirty of text.
2. A bucket answers each batch which hashes occur more than once, as bits in the order asked.
3. Back at the texts, anchors of such hashes become tiles.  Of equal tiles in a batch the first goes on; the
   others are removed there and then.  Tiles with one hash meet, and the tree over their sorted
   suffixes gives all repeats with all occurrences; each but the first is removed.
   An anchor that holds more than HOT_TILES tiles is split by the NARROW starts it covers and the bytes
   that these have in common, so that only texts with (nearly) a whole window in common
   meet; equal tiles are again reduced to the first as they are read.
4. The spans go back to their batch, are merged, and the text is rebuilt without them.

Texts are shuffled once: all three steps that read them read the same exchange.  Hashes only
choose what is compared: spans come from common bytes alone.

Defined results: null and empty texts, and those shorter than ``least``, keep all bytes; documents of equal ids are ordered by a
hash of their text, of equal rows one counts as the first; null ids count as the largest; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, table
from .suffixes import anchors, maximal_repeats

LEAST = 100
#: Bytes that anchors hash; longer ones let fewer chance matches through, shorter ones lie less densely.
GRAM = 40
#: Bytes of text in a batch, and hashes in a bucket, on average.
BATCH_BYTES = 12_000_000
BUCKET_HASHES = 1_000_000
#: Tiles of one hash that are compared as they are; more are split by what they have in common.
HOT_TILES = 500
#: Window starts of a part of a split tile.
NARROW = 4
#: Spans that a task holds before it hands them on.
HELD_SPANS = 200_000

_SPANS = pa.schema([("batch", pa.int64()), ("spans", pa.binary())])
_TILES = pa.schema([("key", pa.int64()), ("batch", pa.int64()), ("at", pa.int64()), ("unknown", pa.bool_()), ("doc", pa.int64()), ("tie", pa.int64()), ("before", pa.binary()), ("after", pa.binary())])


class _Batch:
    """The texts of a batch in their order, one after another."""

    def __init__(self, group: pa.Table):
        rows = group.take(pc.sort_indices(group, [("doc", "ascending"), ("tie", "ascending")], null_placement="at_end"))
        self.doc, self.tie = rows.column("doc").combine_chunks(), rows.column("tie").combine_chunks()
        texts = rows.column("text").to_pylist()
        self.data = b"".join(texts)
        self.bytes = np.frombuffer(self.data, np.uint8)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.lengths)

    def anchors(self, least: int, gram: int, buckets: int):
        """Anchors, the distinct hashes by (bucket, hash), their buckets and counts, and each anchor's place among them."""
        h, place, first, last = anchors(self.bytes, self.lengths, least, gram)
        distinct, where, counts = np.unique(h, return_inverse=True, return_counts=True)
        bucket = (distinct >> np.uint64(17)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        return h, place, first, last, distinct[order], bucket[order].astype(np.int64), counts[order], rank[where]


def _pack(spans: list[tuple[int, int]]) -> bytes:
    """Spans as bytes, those that touch as one."""
    found = np.array(sorted(spans), np.int64)
    ends = np.maximum.accumulate(found[:, 1])
    first = np.flatnonzero(np.append(True, found[1:, 0] > ends[:-1]))
    return np.column_stack([found[first, 0], ends[np.append(first[1:], len(ends)) - 1]]).tobytes()


def _dealt(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """Documents with tie and batch, and the bytes of all."""
    one = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))
    size = one.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, -(-size // BATCH_BYTES))
    return one.withColumn("tie", F.xxhash64("text")).withColumn("batch", F.pmod(F.xxhash64("doc", "tie"), F.lit(batches))), size


def _asked(dealt: DataFrame, least: int, gram: int, buckets: int) -> DataFrame:
    """bucket, batch, the distinct hashes of the batch in the bucket in order, and how often each occurs there (255 at most)."""

    def ask(group: pa.Table) -> pa.Table:
        batch = group.column("batch")[0].as_py()
        *_, distinct, bucket, counts, _ = _Batch(group).anchors(least, gram, buckets)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
        parts = list(zip(edges, [*edges[1:], len(bucket)]))
        few = np.minimum(counts, 255).astype(np.uint8)
        give_back()
        return pa.table({"bucket": pa.array([int(bucket[a]) for a, _ in parts], pa.int64()), "batch": pa.array([batch] * len(parts), pa.int64()), "hashes": pa.array([distinct[a:b].tobytes() for a, b in parts], pa.binary()), "counts": pa.array([few[a:b].tobytes() for a, b in parts], pa.binary())})

    return dealt.groupBy("batch").applyInArrow(ask, "bucket long, batch long, hashes binary, counts binary")


def _answered(asked: DataFrame) -> DataFrame:
    """batch, bucket and two bits for each hash asked: whether it occurs more than once, and whether more than HOT_TILES times."""

    def answer(group: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
        _, where = np.unique(np.concatenate(rows), return_inverse=True)
        totals = np.bincount(where, np.concatenate([np.frombuffer(x, np.uint8) for x in group.column("counts").to_pylist()]))[where]
        many, hot, out, at = totals > 1, totals > HOT_TILES, [], 0
        for x in rows:
            out.append((np.packbits(many[at : at + len(x)]).tobytes(), np.packbits(hot[at : at + len(x)]).tobytes()))
            at += len(x)
        give_back()
        return pa.table([group.column("batch"), group.column("bucket"), pa.array([m for m, _ in out], pa.binary()), pa.array([h for _, h in out], pa.binary())], names=["batch", "bucket", "many", "hot"])

    return asked.groupBy("bucket").applyInArrow(answer, "batch long, bucket long, many binary, hot binary")


def _tiles(dealt: DataFrame, answered: DataFrame, least: int, gram: int, buckets: int) -> DataFrame:
    """Tiles that may repeat, one of equal ones a batch; a row without ``after`` holds spans that the batch itself removes."""

    def cut(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return _TILES.empty_table()
        number = group.column("batch")[0].as_py()
        batch = _Batch(group)
        h, place, first, last, _, bucket, _, rank = batch.anchors(least, gram, buckets)
        sizes = dict(zip(*(x.tolist() for x in np.unique(bucket, return_counts=True))))
        bits = {b: (m, t) for b, m, t in zip(*(answers.column(c).to_pylist() for c in ("bucket", "many", "hot")))}
        unpack = lambda k: np.concatenate([np.unpackbits(np.frombuffer(bits[b][k], np.uint8), count=n) for b, n in sizes.items()] or [np.zeros(0, np.uint8)])
        many, hot = unpack(0)[rank] > 0, unpack(1)[rank] > 0
        keep = np.flatnonzero(many)
        data, seen, rows, gone = batch.data, set(), [], []

        def tile(key: int, at: int, a: int, b: int) -> None:
            whole = (key, at - a, data[a : b + least])
            if whole in seen:
                gone.append((a, b + least))
            else:
                seen.add(whole)
                rows.append((key, a, at, b + least))

        for key, at, a, b, split in zip(h[keep].view(np.int64).tolist(), place[keep].tolist(), first[keep].tolist(), last[keep].tolist(), hot[keep].tolist()):
            if not split:
                tile(key, at, a, b)
                continue
            for part in range((at - b) // NARROW, (at - a) // NARROW + 1):
                to = at - NARROW * part
                core = xxhash.xxh64_intdigest(data[to : to + least + 1 - NARROW], part) ^ (key & (2**64 - 1))
                tile(core - (1 << 64) if core >> 63 else core, to, max(a, to - NARROW + 1), min(b, to))
        seen.clear()
        n = len(rows)
        at = np.array([r[2] for r in rows], np.int64)
        row = np.searchsorted(batch.ends, at, "right")
        doc = batch.doc.take(pa.array(row))
        out = pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.repeat(pa.scalar(number, pa.int64()), n), pa.array(at), pc.is_null(doc), pc.fill_null(doc, 0), batch.tie.take(pa.array(row)), pa.array([data[a:x] for _, a, x, _ in rows], pa.binary()), pa.array([data[x:b] for _, _, x, b in rows], pa.binary())], schema=_TILES)
        if gone:
            out = pa.concat_tables([out, pa.Table.from_pylist([{"key": number, "batch": number, "at": -1, "unknown": False, "doc": 0, "tie": 0, "before": _pack(gone), "after": None}], schema=_TILES)])
        del batch, rows, gone
        give_back()
        return out

    kinds = "key long, batch long, at long, unknown boolean, doc long, tie long, before binary, after binary"
    return dealt.groupBy("batch").cogroup(answered.groupBy("batch")).applyInArrow(cut, kinds)


def _spans(tiles: DataFrame, least: int) -> DataFrame:
    """batch and packed spans (start, end in the batch's bytes) of all occurrences of repeats but the first."""

    def scan(batches):
        held: dict[int, list[tuple[int, int]]] = {}
        count = 0
        key, group = None, {}

        def drop(order: tuple, before: int, after: int) -> None:
            nonlocal count
            *_, at, batch = order
            held.setdefault(batch, []).append((at - before, at + after))
            count += 1

        def close() -> None:
            if len(group) < 2:
                return
            tiles, orders = list(group), list(group.values())
            for before, after, members in maximal_repeats(tiles, least):
                first = min(orders[k] for k in members)
                for k in members:
                    if orders[k] != first:
                        drop(orders[k], before, after)

        def flush():
            nonlocal count
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([_pack(x) for x in held.values()], pa.binary())], schema=_SPANS)
            held.clear()
            count = 0

        for rows in batches:
            for k, batch, at, unknown, doc, tie, before, after in zip(*(c.to_pylist() for c in rows.columns)):
                if after is None:
                    yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([before], pa.binary())], schema=_SPANS)
                    continue
                if k != key:
                    close()
                    key, group = k, {}
                order, tile = (unknown, doc, tie, at, batch), (before, after)
                if tile in group:  # of equal tiles only the first takes part
                    drop(max(order, group[tile]), len(before), len(after))
                    order = min(order, group[tile])
                group[tile] = order
                if count > HELD_SPANS:
                    yield from flush()
        close()
        yield from flush()
        give_back()

    return tiles.repartition("key").sortWithinPartitions("key").mapInArrow(scan, "batch long, spans binary")


def remove_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, spans (removed, merged: start and end in bytes) and kept (the remaining bytes) of every document."""
    if not 8 <= gram < least:
        raise ValueError("gram must be at least 8 and less than least")
    dealt, size = _dealt(docs, key, text)
    buckets = max(1, 2 * size // (least - gram) // BUCKET_HASHES)
    tiles = _tiles(dealt, _answered(_asked(dealt, least, gram, buckets)), least, gram, buckets)
    kinds = pa.schema([(key, pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def rebuild(group: pa.Table, spans: pa.Table) -> pa.Table:
        if not group.num_rows:
            return kinds.empty_table()
        batch = _Batch(group)
        found = np.frombuffer(b"".join(spans.column("spans").to_pylist()), np.int64).reshape(-1, 2)
        edge = np.bincount(found[:, 0], minlength=len(batch.data) + 1) - np.bincount(found[:, 1], minlength=len(batch.data) + 1)
        covered = np.cumsum(edge[:-1]) > 0
        out = []
        for a, b in zip((batch.ends - batch.lengths).tolist(), batch.ends.tolist()):
            edges = np.flatnonzero(np.diff(covered[a:b], prepend=False, append=False)).reshape(-1, 2)
            kept = np.delete(batch.bytes[a:b], covered[a:b]).tobytes() if len(edges) else batch.data[a:b]
            out.append((b - a, [{"start": x, "end": y} for x, y in edges.tolist()], kept))
        done = pa.Table.from_arrays([batch.doc, *(pa.array(c, k.type) for c, k in zip(zip(*out), list(kinds)[1:]))], schema=kinds)
        del batch, out, covered, edge
        give_back()
        return done

    shape = f"`{key}` long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary"
    out = dealt.groupBy("batch").cogroup(_spans(tiles, least).groupBy("batch")).applyInArrow(rebuild, shape)
    return out.withColumn(key, F.col(key).cast(docs.schema[key].dataType))


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and the digest of the bytes that remain."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(docs, **options).select(options.get("key", "doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs, least: int = LEAST):
    """Straight from the definition, for tests with distinct ids: rows of (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    seen: set[bytes] = set()
    out = []
    for doc, text in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 2, bool)
        for i in range(len(data) - least + 1):
            if data[i : i + least] in seen:
                gone[i + 1 : i + 1 + least] = True
            seen.add(data[i : i + least])
        kept = bytes(b for b, g in zip(data, gone[1:]) if not g)
        out.append((doc, len(data), int(gone.sum()), int((np.diff(gone.astype(int)) > 0).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
