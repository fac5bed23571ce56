"""A Python data source: spark.read.format("structures").load(path).

Files are listed by the driver through any file system that Arrow reaches; the members of a tar are
found by its headers and read one by one where they lie, so an archive of any size is many partitions' work.
"""

from __future__ import annotations

import os
from heapq import heappop, heappush

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..options import ReadOptions
from .files import DEPTH
from .parse import inflate, is_tar, members, structures, tar_members

SCHEMA = "source_path string, member string, model string, chain string, mol_type string, length int, seq string, x array<double>, y array<double>, z array<double>, res_num array<int>, ins_code string, chain_ord array<int>, error string"
FIELDS = [f.strip().split(" ")[0] for f in SCHEMA.split(", ")]


class Part(InputPartition):
    """(path, member or None, offset, size, root) of each piece."""

    def __init__(self, pieces: list[tuple[str, str | None, int, int, str]]):
        self.pieces = pieces


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


class StructureReader(DataSourceReader):
    """Deals files and tar members of all roots to partitions of about equal bytes, the largest first."""

    def __init__(self, roots: list[str], options: ReadOptions, parts: int, drop: bool):
        self.roots, self.options, self.parts, self.drop = roots, options, parts, drop

    def pieces(self, name: str):
        """What a root holds; its files may be members of a tar."""
        store, root = store_of(name)
        one = store.get_file_info(root)
        for f in [one] if one.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True)):
            below = f.path[len(root) :].strip("/").split("/")
            if f.type != fs.FileType.File or len(below) > DEPTH or any(x.startswith(".") for x in below):
                continue
            if self.options.suffixes and not f.path.endswith(self.options.suffixes):
                continue
            if f.path.lower().endswith(".tar"):
                with store.open_input_file(f.path) as file:
                    yield from ((f.path, *m, name) for m in tar_members(file))
            else:
                yield f.path, None, 0, f.size, name

    def partitions(self):
        found = {(store_of(root)[0].type_name, *p[:2]): p for root in self.roots for p in self.pieces(root)}  # a file that several roots hold is read once
        parts = [(0, k, []) for k in range(max(1, self.parts))]
        for piece in sorted(found.values(), key=lambda p: (-p[3], p[0], p[1] or "")):
            weight, k, own = heappop(parts)
            own.append(piece)
            heappush(parts, (weight + piece[3], k, own))
        return [Part(own) for _, _, own in parts if own] or [Part([])]

    def read(self, partition: Part):
        for path, member, offset, size, root in partition.pieces:
            with store_of(root)[0].open_input_file(path) as f:
                content = f.read_at(size, offset)
            try:
                own = [(member, inflate(content))] if member is not None else members(path, content) if is_tar(path) else [("", inflate(content))]
                for name, data in own:
                    for s in structures(name or path, data, self.options):
                        s.member = name
                        row = s.row(self.options) | {"source_path": path, "error": None}
                        yield tuple(row[c] for c in FIELDS)
            except (OSError, EOFError, ValueError, IndexError, KeyError) as e:
                if not self.drop:
                    row = {"source_path": path, "member": member or "", "error": f"{type(e).__name__}: {e}"}
                    yield tuple(row.get(c) for c in FIELDS)


class StructureSource(DataSource):
    """Options: path (files or folders, separated by commas), ter, split, hetatm, infmt, suffixes, aatom and natom (which atom of a
    residue counts, of proteins and nucleic acids), mol, partitions, and mode, which is ``permissive`` (a piece that cannot be
    read is a row with ``error`` set) or ``dropmalformed``."""

    @classmethod
    def name(cls) -> str:
        return "structures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StructureReader:
        o = self.options
        read = ReadOptions(ter=int(o.get("ter", 3)), split=int(o.get("split", 0)), hetatm=o.get("hetatm", "false") == "true", infmt=o.get("infmt"), suffixes=tuple(x for x in o.get("suffixes", "").split(",") if x), **{k: o[k] for k in ("aatom", "natom", "mol") if k in o})
        return StructureReader([x for x in o["path"].split(",") if x], read, int(o.get("partitions", 8)), o.get("mode", "permissive").lower() == "dropmalformed")
