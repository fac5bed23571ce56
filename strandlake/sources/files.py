"""Structure files as DataFrames."""

from __future__ import annotations

import gzip
import hashlib
import uuid
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.residues import NAMES
from ..functions.text import describe
from ..kernels.geometry import base_pairs, secondary_structure
from ..model import MOST_POSITIONS, STRUCTURES
from ..operators.filters import length_between
from ..operators.graph import shared_folder
from ..options import ReadOptions
from .parse import members, structures

#: Directories are searched so deep.
DEPTH = 3
_PARSED = "source_path string, member string, model string, chain string, mol_type string, length int, seq string, ss string, x array<double>, y array<double>, z array<double>, res_num array<int>, ins_code string, chain_ord array<int>, error string"


def input_list(items: str) -> list[str]:
    """The distinct items of a comma list, sorted; an empty item is an error."""
    parts = [p.strip() for p in items.split(",")]
    if not all(parts):
        raise ValueError("empty item in a list of inputs")
    return sorted(set(parts))


def catalog(spark: SparkSession, inputs: str, options: ReadOptions | None = None, content: bool = True) -> DataFrame:
    """(path, length, modificationTime, content) of the files that a comma list names; dot entries are skipped.

    A file that several items name is taken under the first that admits it, by its path alone, so
    nothing is shuffled to find repeats.  Without ``content`` no file is opened.
    """
    options = options or ReadOptions()
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    columns = ["path", "length", "modificationTime", *(["content"] if content else [])]
    df, before = None, F.lit(False)
    for root in input_list(inputs):
        # The root's last name occurs in the path; what follows is the part that was searched.
        at = F.locate(root.rstrip("/"), F.col("path"))
        below = F.col("path").substr(at + len(root.rstrip("/")), F.length("path"))
        deep = F.size(F.split(F.regexp_replace(below, "^/|/[^/]*$", ""), "/"))
        admits = (at > 0) & ((below == "") | below.startswith("/")) & (deep <= DEPTH) & ~below.rlike(r"(^|/)\.")
        own = reader.load(root).select(*columns).where(admits & ~before)
        df, before = own if df is None else df.unionByName(own), before | admits
    if options.suffixes:
        keep = F.lit(False)
        for s in options.suffixes:
            keep = keep | F.col("path").endswith(s)
        df = df.where(keep)
    return df


def parse_files(files: DataFrame, options: ReadOptions | None = None) -> DataFrame:
    """Structures of (path, content); a file that cannot be read gives one row with ``error`` set."""
    options = options or ReadOptions()
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(_PARSED))

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                try:
                    for member, data in members(path, content):
                        try:
                            for s in structures(member or path, data, options):
                                s.member = member
                                row = s.row(options)
                                points = np.column_stack([row["x"], row["y"], row["z"]])
                                row["ss"] = base_pairs(points, row["seq"]) if row["mol_type"] == "NA" else secondary_structure(points)
                                rows.append({"source_path": path, **row, "error": None})
                        except (ValueError, IndexError, KeyError) as e:
                            rows.append({"source_path": path, "member": member, "error": f"{type(e).__name__}: {e}"})
                except (OSError, EOFError, ValueError) as e:
                    rows.append({"source_path": path, "error": f"{type(e).__name__}: {e}"})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, _PARSED)


def read_structures(spark: SparkSession, inputs: str, options: ReadOptions | None = None, least: int = 20, most: int = MOST_POSITIONS) -> DataFrame:
    """The structures table of all files that ``inputs`` names.

    Ids are a hash of path, member, model and chain, so they do not depend on partitions.
    Unreadable files and structures out of the length limits are left out.
    """
    rows = parse_files(catalog(spark, inputs, options), options).where(F.col("error").isNull())
    return finish(length_between(rows, least, min(most, MOST_POSITIONS)))


def finish(rows: DataFrame) -> DataFrame:
    where = ["source_path", F.coalesce("member", F.lit("")), "model", "chain"]
    out = rows.withColumn("struct_id", F.xxhash64(*where)).withColumn("description", describe(F.col("source_path"), F.coalesce("member", F.lit("")), F.col("chain"), F.col("model")))
    return out.select(*[c.strip().split(" ")[0] for c in STRUCTURES.replace("\n", " ").split(",")])


def signature(spark: SparkSession, inputs: str, options: ReadOptions | None = None, least: int = 20, most: int = MOST_POSITIONS) -> str:
    """A name for what ``read_structures`` would give: its parameters, and paths, sizes and times of all files."""
    options = options or ReadOptions()
    files = catalog(spark, inputs, options, content=False)
    n, total = files.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr((input_list(inputs), options, least, most, n, str(total))).encode()).hexdigest()[:32]


def cached_structures(spark: SparkSession, inputs: str, cache: str, options: ReadOptions | None = None, least: int = 20, most: int = MOST_POSITIONS) -> DataFrame:
    """As ``read_structures``, from a table below ``cache`` if one was written whole for the same files and parameters."""
    at = f"{cache.rstrip('/')}/{signature(spark, inputs, options, least, most)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        save(read_structures(spark, inputs, options, least, most), at)
    return load(spark, at)


#: Names of residues by letter, as files spell them.
_SPELLED = {letter: names.split()[0] for letter, names in NAMES.items()}
_LOOP = ("group_PDB", "id", "label_atom_id", "label_alt_id", "label_comp_id", "auth_asym_id", "auth_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "pdbx_PDB_model_num")


def file_lines(structures: DataFrame) -> DataFrame:
    """(struct_id, kind, n, value): each structure as lines of a file, mmCIF for even ids and PDB for odd ones."""
    spelled = F.create_map(*[F.lit(x) for pair in _SPELLED.items() for x in pair])
    p = structures.select("struct_id", "mol_type", F.posexplode(F.arrays_zip("x", "y", "z", F.split("seq", "").alias("res"))).alias("k", "p"))
    n, nucleic = F.col("k") + 1, F.col("mol_type") == "NA"
    res = F.when(nucleic, F.lpad(F.col("p.res"), 3, " ")).otherwise(F.coalesce(F.get(F.transform(F.array("p.res"), lambda c: F.try_element_at(spelled, c)), F.lit(0)), F.lit("UNK")))
    at = [F.col(f"p.{a}") for a in "xyz"]
    pdb = F.format_string("ATOM  %5d %s %s A%4d    %8.3f%8.3f%8.3f  1.00  0.00", n, F.when(nucleic, " C3'").otherwise(" CA "), res, n, *at)
    atom = F.when(nucleic, "\"C3'\"").otherwise("CA")
    # Some rows of the loop are broken, as the format allows.
    cif = F.format_string("ATOM %d %s . %s%sA %d ? %.3f %.3f %.3f 1", n, atom, F.trim(res), F.when(n % 7 == 0, "\n").otherwise(" "), n, *at)
    even = F.col("struct_id") % 2 == 0
    body = p.select("struct_id", F.when(even, "cif").otherwise("pdb").alias("kind"), n.alias("n"), F.when(even, cif).otherwise(pdb).alias("value"))
    head = ["data_x", "loop_", *(f"_atom_site.{c}" for c in _LOOP)]
    ends = structures.select("struct_id", F.when(even, "cif").otherwise("pdb").alias("kind"), F.when(even, F.lit("\n".join(head))).otherwise("MODEL        1").alias("value"))
    return body.unionByName(ends.select("struct_id", "kind", F.lit(0).alias("n"), "value")).unionByName(ends.select("struct_id", "kind", F.lit(1 << 30).alias("n"), F.when(even, "#").otherwise("TER").alias("value")))


def write_structures(structures: DataFrame, path: str | None = None) -> str:
    """Writes a file for each structure below ``path`` (a new place in the shared folder), pdb/sid=<id> or, compressed, cif/sid=<id>.

    Tasks write the files themselves, each under a name of its own that it is moved from when it is whole; what is written twice is
    the same.  So no file is moved by the driver, and no folder is made for a single file.
    """
    from .datasource import store_of

    path = path or f"{shared_folder(structures.sparkSession)}/structures-{uuid.uuid4().hex}"
    for kind in ("pdb", "cif"):
        store, root = store_of(f"{path}/{kind}")
        store.create_dir(root)
    lines = file_lines(structures).withColumnRenamed("struct_id", "sid").repartition("sid").sortWithinPartitions("sid", "n").select("kind", "sid", "value")

    def run(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        written = 0
        for (kind, sid), own in groupby(rows, key=lambda r: r[:2]):
            data = "".join(f"{value}\n" for _, _, value in own).encode()
            store, at = store_of(f"{path}/{kind}/sid={sid}.{kind}{'.gz' if kind == 'cif' else ''}")
            folder, name = at.rsplit("/", 1)
            part = f"{folder}/.{name}-{uuid.uuid4().hex}"  # files of such names are skipped
            with store.open_output_stream(part, compression=None) as out:
                out.write(gzip.compress(data, mtime=0) if kind == "cif" else data)
            store.move(part, at)
            written += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([written], pa.int64())})

    lines.mapInArrow(run, "files long").agg(F.sum("files")).collect()  # one number
    return path


def save(structures: DataFrame, path: str) -> None:
    """Keeps parsed structures, bucketed by nothing: a scan of columns is all that searches need."""
    structures.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
