"""A Python data source that writes lines to files of their own: df.write.format("line_files").mode("append").save(path).

Rows are (file, line); the rows of a file must be together in one task, in order (``write_lines`` sees to it).  Tasks
write below a folder of their own in a staging folder of the job.  Files are moved to their names when all tasks have
committed; a job that fails, and tasks that were lost or ran twice, leave nothing.  A file of the same name is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .datasource import store_of

FORMAT = "line_files"


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task and the files that it has written whole."""

    folder: str
    files: list[str]


class LineFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path
        self.staging = f".staging-{uuid.uuid4().hex}"  # the same for all tasks of a job

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = store_of(self.path)
        done = Written(f"{root}/{self.staging}/{uuid.uuid4().hex}", [])
        out, current = None, None
        for batch in iterator:
            for file, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if file != current:
                    if not file or "/" in file or file.startswith("."):
                        raise ValueError(f"no name of a file: {file!r}")
                    if file in done.files:
                        raise ValueError(f"the lines of {file} are not together")
                    if out:
                        out.close()
                    store.create_dir(done.folder)
                    out, current = store.open_output_stream(f"{done.folder}/{file}"), file
                    done.files.append(file)
                out.write(((line or "") + "\n").encode())
        if out:
            out.close()
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = store_of(self.path)
        store.create_dir(root)
        for done in messages:
            for file in done.files if done else ():
                store.move(f"{done.folder}/{file}", f"{root}/{file}")
        self._clear(store, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*store_of(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


class LineFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, line string"

    def writer(self, schema, overwrite: bool) -> LineFilesWriter:
        if overwrite:
            raise ValueError("files are replaced one by one: write with mode append")
        return LineFilesWriter(self.options["path"])


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """Writes rows (file, line and the columns of ``order``) to ``path``/file, a task for each file at a time."""
    lines.sparkSession.dataSource.register(LineFiles)
    dealt = lines.repartition("file").sortWithinPartitions("file", *order).select("file", "line")
    dealt.write.format(FORMAT).mode("append").save(path)
