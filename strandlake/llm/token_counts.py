"""Token counts as delta-maintained rollups.

The state is a table of signed deltas of documents and tokens by source, language and tokenizer
version, aggregated per batch.  Totals are their sums, so inserts, deletes and revised counts
are all additions.

A batch is committed by its manifest, which names the folder of its deltas.  A manifest is written
elsewhere and then renamed into place, under a name that only the batch id fixes: no reader sees half
of one, a writer that dies leaves nothing that counts, and two writers of one batch leave one
manifest, so the batch counts once however often it is applied.  ``compact`` adds the next numbered
state, a folder of summed deltas and the list of batches in it, and removes nothing.  What holds is
the highest state and all batches that it does not list, so a batch committed during a compaction stays,
a compactor that dies changes nothing, and of two at once either's state is right.

Defined results: null sources and languages are groups of their own; null texts have no tokens;
null counts add nothing; an empty batch commits and changes nothing; any string is a batch id; a
group whose documents and tokens have all gone is not listed; only the named columns are read, and
``count_tokens`` replaces a column that bears the name of its result.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, work_path

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"

#: The tokenizer versions of the query, as patterns whose matches are tokens (fixed values).
TOKENIZERS = {"words-1": r"[^ \t\n\x0B\f\r]+", "words-2": r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\x0B\f\r]"}


class Rollup:
    """Totals kept under ``path`` in any file system that Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for d in ("commits", "pending"):
            self.fs.mkdirs(self._path(f"{self.path}/{d}"))

    def _live(self) -> tuple[dict | None, dict[str, str]]:
        """The highest state and, of the batches that it does not list, the folders; one small job."""
        read = [json.loads(r[0]) for r in self.spark.read.schema("value string").text(f"{self.path}/commits", wholetext=True).collect()]
        state = max((m for m in read if "state" in m), key=lambda m: m["state"], default=None)
        within = set(state["batches"]) if state else set()
        return state, {m["batch"]: m["folder"] for m in read if "batch" in m and m["batch"] not in within}

    def committed(self) -> set[str]:
        """The ids of all batches that count."""
        state, batches = self._live()
        return {*(state["batches"] if state else ()), *batches}

    def _manifest(self, name: str, content: dict) -> bool:
        """Puts a whole manifest in place by a rename; False if there is one already."""
        pending, at = self._path(f"{self.path}/pending/{uuid.uuid4().hex}"), self._path(f"{self.path}/commits/{name}")
        stream = self.fs.create(pending, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        if not self.fs.exists(at) and self.fs.rename(pending, at):
            return True
        self.fs.delete(pending, False)
        if not self.fs.exists(at):
            raise OSError(f"{name} could not be put in place")
        return False

    def _folder(self) -> str:
        return f"{self.path}/deltas/{uuid.uuid4().hex}"

    def apply(self, batch: str, deltas: DataFrame) -> bool:
        """Adds signed ``deltas`` (KEYS, docs, tokens) under the id ``batch``; False if it was there."""
        if batch in self.committed():
            return False
        folder = self._folder()
        deltas.groupBy(*KEYS).agg(F.sum(F.coalesce("docs", F.lit(0))).alias("docs"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens")).where("docs <> 0 or tokens <> 0").write.parquet(folder)
        return self._manifest(f"batch-{hashlib.sha256(batch.encode()).hexdigest()}", {"batch": batch, "folder": folder})

    def _sum(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*folders).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        state, batches = self._live()
        return self._sum(sorted({*([state["folder"]] if state else ()), *batches.values()}))

    def compact(self) -> bool:
        """Folds what holds now into the next state; False if there was nothing to fold or another was first."""
        state, batches = self._live()
        if not batches:
            return False
        folder, number = self._folder(), state["state"] + 1 if state else 0
        self._sum(sorted({*([state["folder"]] if state else ()), *batches.values()})).write.parquet(folder)
        return self._manifest(f"state-{number:020d}", {"state": number, "batches": sorted({*(state["batches"] if state else ()), *batches}), "folder": folder})

    def vacuum(self) -> None:
        """Deletes manifests and folders that no longer hold; only while nobody writes, compacts or reads totals."""
        state, batches = self._live()
        keep = {*([state["folder"]] if state else ()), *batches.values()}
        names = {f"batch-{hashlib.sha256(b.encode()).hexdigest()}" for b in batches} | ({f"state-{state['state']:020d}"} if state else set())
        for d, wanted in (("commits", names), ("pending", set()), ("deltas", {f.rsplit("/", 1)[1] for f in keep})):
            at = self._path(f"{self.path}/{d}")
            for s in self.fs.listStatus(at) if self.fs.exists(at) else ():
                if s.getPath().getName() not in wanted:
                    self.fs.delete(s.getPath(), True)


def count_tokens(docs: DataFrame, tokenizers: dict[str, str] = TOKENIZERS, text: str = "text", out: str = "counts") -> DataFrame:
    """``docs`` with a column ``out`` of counts, a struct with one field per tokenizer version."""
    count = lambda p: F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({p})"), F.lit(1))).cast("long")
    return docs.withColumn(out, F.struct(*[count(p).alias(v) for v, p in tokenizers.items()]))


def deltas(counted: DataFrame, tokenizer: str, sign: int = 1, tokens=None) -> DataFrame:
    """Signed deltas of rows that have source, lang and counts."""
    tokens = F.col("counts")[tokenizer] if tokens is None else tokens
    return counted.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("docs"), (tokens * (sign or 1)).alias("tokens"))


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads every document under two tokenizer versions, deletes those labelled toxic, revises the
    first version's counts of those labelled of low quality to the second's, applies two batches
    twice, compacts, and returns the totals."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    flags = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic") == 1).alias("gone"), F.max(F.col("quality") == 0).alias("poor"))
    counted = cut(count_tokens(docs.select("doc_id", "source", "lang", "text")).drop("text").join(flags, "doc_id", "left"))
    first, second = TOKENIZERS
    gone, poor = counted.where("gone"), counted.where("poor and not coalesce(gone, false)")
    state = Rollup(spark, work_path(spark, "token-rollup"))
    load, drop = deltas(counted, first), deltas(gone, first, -1).unionByName(deltas(gone, second, -1))
    state.apply("load-words-1", load)
    state.apply("load-words-2", deltas(counted, second))
    state.apply("delete-toxic", drop)
    state.apply("load-words-1", load)
    state.compact()
    state.apply("revise-poor", deltas(poor, first, 0, F.col("counts")[second] - F.col("counts")[first]))
    state.apply("delete-toxic", drop)
    return state.totals()


ORACLE = r"""
with flags as (select doc_id, max(toxic = 1) as gone, max(quality = 0) as poor from labels where doc_id is not null group by doc_id),
counted as (
  select d.source, d.lang, coalesce(f.gone, false) as gone, coalesce(f.poor, false) as poor,
    len(regexp_extract_all(coalesce(d.text, ''), '[^ \t\n\x0B\f\r]+')) as one,
    len(regexp_extract_all(coalesce(d.text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\x0B\f\r]')) as two
  from documents d left join flags f using (doc_id)),
kept as (select * from counted where not gone)
select source, lang, 'words-1' as tokenizer, count(*) as docs, cast(sum(case when poor then two else one end) as bigint) as tokens from kept group by source, lang
union all
select source, lang, 'words-2', count(*), cast(sum(two) as bigint) from kept group by source, lang
"""
