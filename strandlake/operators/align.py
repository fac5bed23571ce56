"""Pair alignment over Arrow batches: the one operator that needs Python on the executors.

A block of queries of a checked size is broadcast and every reference is aligned with it where it is
read, so neither side's coordinates pass through a shuffle and no row holds a pair.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..kernels.search import Chain, align_pairs, similarity
from ..model import HITS
from ..options import SearchOptions
from .allpairs import paired

#: Bytes of query structures that are broadcast at once; a larger query set is searched in several blocks.
BROADCAST_BYTES = 64_000_000
#: What a position of a structure takes: three coordinates, a residue and a secondary structure.
POSITION_BYTES = 26
#: Hits that leave a task at once.
HIT_ROWS = 1_000
SIDE = ("struct_id", "length", "mol_type", "seq", "ss", "x", "y", "z")


@dataclass
class Block:
    """Query structures by molecule type, ascending by length, so that those of like length are a slice."""

    rows: dict[str, list[tuple[int, int, Chain]]] = field(default_factory=dict)
    size: int = 0

    def add(self, r: Row | dict) -> None:
        self.rows.setdefault(r["mol_type"], []).append((r["length"], r["struct_id"], chain(r["seq"], r["mol_type"], r["x"], r["y"], r["z"], r["ss"])))
        self.size += POSITION_BYTES * r["length"]

    def ready(self) -> Block:
        for own in self.rows.values():
            own.sort(key=lambda t: t[:2])
        return self

    def like(self, mol: str, length: int, coverage: float) -> list[tuple[int, int, Chain]]:
        """Queries of the type whose length and ``length`` cover each other by at least ``coverage`` (0: all)."""
        own = self.rows.get(mol, [])
        if not coverage:
            return own
        low = bisect_left(own, True, key=lambda t: t[0] >= length * coverage)
        return own[low : bisect_left(own, True, key=lambda t: t[0] * coverage > length)]


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time, their lists as arrays, so that a batch is never a heap of Python numbers."""
    names = batch.schema.names
    for k in range(batch.num_rows):
        row = {}
        for name, column in zip(names, batch.columns):
            value = column[k]
            row[name] = value.values.to_numpy(zero_copy_only=False) if pa.types.is_list(column.type) and value.is_valid else value.as_py()
        yield row


def chain(seq: str, mol: str, x, y, z, ss: str | None) -> Chain:
    return Chain(np.column_stack([x, y, z]), seq, mol, ss)


def hits_of(pairs: Iterator[tuple[Chain, Chain, int, int]], options: SearchOptions, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Hits of (query, reference, query_id, ref_id), HIT_ROWS at a time."""
    rows = []
    for (_, _, q_id, r_id), hit in align_pairs(pairs, options):
        if hit:
            rows.append({"query_id": q_id, "ref_id": r_id, **hit})
        if len(rows) == HIT_ROWS:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def within(structures: DataFrame, options: SearchOptions) -> DataFrame:
    """The structures that the length limits let through, with the columns that a search reads."""
    return structures.where(F.col("length").between(options.min_length, options.max_length)).select(*SIDE)


def blocks(queries: DataFrame, limit: int | None = None) -> Iterator[Block]:
    """The stated query set in blocks of at most ``limit`` bytes (one structure at least); one at a time on the driver."""
    limit = limit or BROADCAST_BYTES
    block = Block()
    for r in queries.toLocalIterator():
        if block.size and block.size + POSITION_BYTES * r.length > limit:
            yield block.ready()
            block = Block()
        block.add(r)
    if block.size:
        yield block.ready()


def align_against(refs: DataFrame, block: Block, options: SearchOptions, coverage: float = 0.0, each_once: bool = False, parts: int = 1) -> DataFrame:
    """Hits of every reference with the queries of a block, or with one of ``parts`` of them, which column ``part`` then names.

    A pair gives one row at most: none if types differ, lengths do not cover each other, or a screen by
    sequence or score ends it.  With ``each_once`` only pairs whose query has the smaller id are aligned.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(HITS))
    shared = refs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        queries = shared.value

        def pairs():
            for batch in batches:
                for r in rows_of(batch):
                    own = None
                    for _, q_id, q in queries.like(r["mol_type"], r["length"], coverage)[r["part"] if parts > 1 else 0 :: parts]:
                        if each_once and q_id >= r["struct_id"] or options.pre_similarity and similarity(q.seq, r["seq"]) < options.pre_similarity:
                            continue
                        own = own or chain(r["seq"], r["mol_type"], r["x"], r["y"], r["z"], r["ss"])
                        yield q, own, q_id, r["struct_id"]

        yield from hits_of(pairs(), options, schema)

    return refs.mapInArrow(run, HITS)


def align_all(structures: DataFrame, options: SearchOptions, coverage: float) -> DataFrame:
    """Hits of each unordered pair of structures within length coverage, once, with the smaller id as the query.

    Blocks of structures meet on the executors (``allpairs``).  The same screens end a pair as in ``align_against``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(HITS))
    left, right = paired(structures.select(*SIDE), coverage)

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        if not one.num_rows or not other.num_rows:
            return schema.empty_table()
        block = Block()
        for batch in one.to_batches():
            for r in rows_of(batch):
                block.add(r)
        block.ready()
        same = one.column("i")[0] == one.column("j")[0]

        def pairs():
            for batch in other.to_batches():
                for r in rows_of(batch):
                    own, own_id = None, r["struct_id"]
                    for _, near_id, near in block.like(r["mol_type"], r["length"], coverage):
                        if near_id == own_id or same and near_id > own_id or options.pre_similarity and similarity(near.seq, r["seq"]) < options.pre_similarity:
                            continue
                        own = own or chain(r["seq"], r["mol_type"], r["x"], r["y"], r["z"], r["ss"])
                        yield (near, own, near_id, own_id) if near_id < own_id else (own, near, own_id, near_id)

        return pa.Table.from_batches(hits_of(pairs(), options, schema), schema=schema)

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, HITS)


def align_rows(pairs: DataFrame, options: SearchOptions) -> DataFrame:
    """Hits of pairs that are known beforehand, a row each (q_id, r_id and, for each side, mol, seq, ss, x, y, z)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(HITS))

    def run(batches):
        side = lambda p, s: chain(p[f"{s}_seq"], p[f"{s}_mol"], p[f"{s}_x"], p[f"{s}_y"], p[f"{s}_z"], p[f"{s}_ss"])
        yield from hits_of(((side(p, "q"), side(p, "r"), p["q_id"], p["r_id"]) for batch in batches for p in rows_of(batch)), options, schema)

    return pairs.mapInArrow(run, HITS)
