"""A sink for reports: one text file, lines in order, there as a whole or not at all.

    spark.dataSource.register(ReportSource)
    ordered.write.format("report").mode("overwrite").option("path", uri).option("head", "...").save()

The rows (one string column) are written by tasks as parts beside the file, in the order of their partitions; committing joins the parts and moves the
result into place, aborting removes them.  Tasks that are run again write parts of their own, and only those that the commit names count.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SLICE = 4 << 20  #: bytes copied at a time


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str


class ReportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if [f.dataType.simpleString() for f in schema] != ["string"]:
            raise ValueError("a report is one string column")
        return ReportWriter(self.options["path"], self.options.get("head", ""), self.options.get("tail", ""), overwrite)


class ReportWriter(DataSourceWriter):
    def __init__(self, uri: str, head: str, tail: str, overwrite: bool):
        self.uri, self.head, self.tail, self.overwrite = uri, head, tail, overwrite
        self.parts = f"{uri}.{uuid.uuid4().hex}.parts"

    def write(self, rows) -> Part:
        store, folder = fs.FileSystem.from_uri(self.parts)
        store.create_dir(folder, recursive=True)
        task = TaskContext.get()
        path = f"{folder}/{task.partitionId():08d}-{task.taskAttemptId()}"
        with store.open_output_stream(path) as out:
            for row in rows:
                out.write(((row[0] or "") + "\n").encode())
        return Part(task.partitionId(), path)

    def commit(self, messages) -> None:
        store, path = fs.FileSystem.from_uri(self.uri)
        there = store.get_file_info(path).type != fs.FileType.NotFound
        if there and not self.overwrite:
            self.drop()
            raise FileExistsError(self.uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        joined = f"{path}.{uuid.uuid4().hex}.joined"
        with store.open_output_stream(joined) as out:
            out.write(self.head.encode())
            for part in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
                with store.open_input_stream(part.path) as f:
                    while data := f.read(SLICE):
                        out.write(data)
            out.write(self.tail.encode())
        if there:
            store.delete_file(path)
        store.move(joined, path)
        self.drop()

    def abort(self, messages) -> None:
        self.drop()

    def drop(self) -> None:
        store, folder = fs.FileSystem.from_uri(self.parts)
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


def write_report(df: DataFrame, line: str, order: list[str], uri: str, head: str = "", tail: str = "") -> None:
    """The column line of df, ordered by other columns, as one file."""
    df.sparkSession.dataSource.register(ReportSource)
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(line).cast("string").alias(line))
    ordered.write.format("report").mode("overwrite").options(path=uri, head=head, tail=tail).save()
