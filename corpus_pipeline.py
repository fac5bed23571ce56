"""The corpus pipeline: each stage keeps, cuts or encodes documents and hands on a table.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  Run one after another, each stage is written as Parquet in the shared
folder and read again, so a lost executor repeats one stage's tasks at most.  A run that is given a folder
goes on after the last stage that it holds whole.  The folder is marked with what its stages are made from: the
files of the tables (paths, sizes and times), the stages and their code.  A run on anything else refuses it.

Defined results of all stages: documents with null or empty texts are kept (they are neither toxic nor
copies, hold no window and no secret, and encode to no tokens); null ids are kept as they are, and
equal texts under null ids are copies like others; repeated rows are one document to the second
stage; empty tables give empty results; other columns are handed on, whatever their names.
"""

from __future__ import annotations

import hashlib
import inspect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import bpe, common, decontaminate, minhash, neardup, secrets, toxicity
from strandlake.llm.common import finished, table, work_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents of the corpus and drops those that score as toxic.

    Without labels of both kinds nothing is learnt and everything stays.
    """
    return toxicity.keep_clean(docs, toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id; texts without words all stay."""
    return neardup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go; an empty benchmark takes none."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced, and n_chars follows (null for a null text)."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of what they decode to."""
    return bpe.encode_documents(docs, bpe.production_ranks(), token_ids=True)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_copies), ("decontamination", drop_leaks), ("secrets", hide_secrets), ("byte_bpe", encode)]

#: SQL cannot express the scorer, the sketches or the encoder; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, work: str | None = None) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the result reads what is kept below ``work`` (a new folder by default)."""
    if work:
        claim(spark, sf_dir, work)
    work = work or work_path(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = f"{work}/{name}"
        if not finished(spark, at):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)


def made_from(spark: SparkSession, sf_dir: str) -> str:
    """A name for the files that the stages read and the code that they run."""
    seen = hashlib.sha256(repr([name for name, _ in STAGES]).encode())
    for module in (bpe, common, decontaminate, minhash, neardup, secrets, toxicity):
        seen.update(inspect.getsource(module).encode())
    for name in ("documents", "labels", "benchmark"):
        for file in sorted(table(spark, sf_dir, name).inputFiles()):
            at = spark._jvm.org.apache.hadoop.fs.Path(file)
            status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
            seen.update(repr((name, file, status.getLen(), status.getModificationTime())).encode())
    return seen.hexdigest()


def claim(spark: SparkSession, sf_dir: str, work: str) -> None:
    """Marks a folder with what its stages are made from; raises if it is marked otherwise, or holds stages without a mark."""
    mark = made_from(spark, sf_dir)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{work}/MADE_FROM")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(at):
        found = spark.read.text(str(at)).first()
        if found is None or found.value != mark:
            raise ValueError(f"{work} holds stages of other tables or other code: clear it, or give another folder")
        return
    if any(finished(spark, f"{work}/{name}") for name, _ in STAGES):
        raise ValueError(f"{work} holds stages that nothing says the origin of: clear it, or give another folder")
    out = files.create(at, False)
    out.write(bytearray(mark.encode()))
    out.close()


def clear(spark: SparkSession, work: str) -> None:
    """Deletes what a run keeps below ``work``, once its result is no longer read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(work)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
