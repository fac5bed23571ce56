"""Structure files that keep arriving: parsed, searched and clustered as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.filters import reportable
from ..options import ReadOptions, SearchOptions
from ..plans.search import aligned
from ..sources.files import finish, parse_files


def arriving_structures(spark: SparkSession, path: str, options: ReadOptions | None = None, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the structures table; the same parser as the batch reader."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    return finish(parse_files(files, options).where("error is null"))


def search_arrivals(arrivals: DataFrame, queries: DataFrame, out: str, checkpoint: str, options: SearchOptions | None = None):
    """Searches each batch of new references with a fixed query set and appends its hits.

    A batch writes to a folder of its own number, so a batch that runs again replaces itself.
    """
    options = options or SearchOptions()

    def batch(new: DataFrame, number: int) -> None:
        reportable(aligned(queries, new, options), options.score_threshold).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
