"""A log that tasks append to: each task writes one Parquet file, and only files that a commit names count.

A task that is killed and tried again leaves a file that nobody names, so no row is there twice; a
stream's batch that runs again replaces its own commit. Compaction keeps the last row of each key.

    spark.dataSource.register(AppendLog)
    rows.write.format("append_log").mode("append").save(path)
    rows.writeStream.format("append_log").option("path", path)…
    read_log(spark, path)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from formulary.operators.datasets import merged
from formulary.sources.folders import Folder

COMMITS = "_commits"


@dataclass
class Written(WriterCommitMessage):
    """The file of one task; none if it had no rows."""

    file: str | None
    rows: int


def _write(path: str, batches: Iterator[pa.RecordBatch]) -> Written:
    name, rows, out = f"rows-{uuid.uuid4().hex}.parquet", 0, None
    folder = Folder(path)
    try:
        for batch in batches:
            if batch.num_rows:
                out = out or pq.ParquetWriter(folder.open_to_write(name), batch.schema)
                out.write_batch(batch)
                rows += batch.num_rows
    finally:
        if out is not None:
            out.close()
    return Written(name if rows else None, rows)


def _commit(path: str, name: str, messages: list[Written | None], over: list[str] | None = None) -> None:
    """Publishes at once what the messages name; a commit of the same name is replaced."""
    made = [m for m in messages if m is not None and m.file]
    said = {"files": [m.file for m in made], "rows": sum(m.rows for m in made), "over": over or []}
    Folder(path).publish(f"{COMMITS}/{name}.json", json.dumps(said))


def _abort(path: str, messages: list[Written | None]) -> None:
    for m in messages:
        if m is not None and m.file:
            Folder(path).delete(m.file)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _write(self.path, iterator)

    def commit(self, messages: list[Written | None]) -> None:
        _commit(self.path, f"run-{uuid.uuid4().hex}", messages)

    def abort(self, messages: list[Written | None]) -> None:
        _abort(self.path, messages)


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return _write(self.path, iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        _commit(self.path, f"batch-{batchId:012d}", messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        _abort(self.path, messages)


class AppendLog(DataSource):
    """The sink: option path names a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "append_log"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("a log is only appended to")
        return _Writer(self.options["path"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> _StreamWriter:
        return _StreamWriter(self.options["path"])


def commits(path: str) -> dict[str, dict]:
    """The commits that count, by name: those that no other one stands for. A folder without any has none."""
    folder = Folder(path)
    made = {n: json.loads(folder.read(f"{COMMITS}/{n}")) for n in folder.names(COMMITS) if n.endswith(".json")}
    gone = {n for said in made.values() for n in said["over"]}
    return {n: said for n, said in sorted(made.items()) if n not in gone}


def rows_of(path: str) -> int:
    """Rows that are committed; no file is read for it."""
    return sum(said["rows"] for said in commits(path).values())


def read_log(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of every commit; a log without any is empty."""
    files = [f"{path}/{f}" for said in commits(path).values() for f in said["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def compact(spark: SparkSession, path: str, schema: StructType | str, key: str, order: str) -> None:
    """Puts one commit in the place of all: of each key the last row by an order. Then deletes what nothing names any more. No writer may run meanwhile."""
    before = commits(path)
    rows = read_log(spark, path, schema)
    last = merged(rows, rows.limit(0), key, order).select(rows.columns)
    name = f"base-{uuid.uuid4().hex}"
    last.write.parquet(f"{path}/{name}")
    folder = Folder(path)
    files = [f"{name}/{f}" for f in folder.names(name) if f.startswith("part-")]
    counted = spark.read.schema(schema).parquet(f"{path}/{name}").count()
    folder.publish(f"{COMMITS}/{name}.json", json.dumps({"files": files, "rows": counted, "over": sorted(before)}))
    sweep(path)


def sweep(path: str) -> None:
    """Deletes files that no commit names, and commits that another one stands for."""
    folder, live = Folder(path), commits(path)
    named = {f for said in live.values() for f in said["files"]}
    for n in folder.names(COMMITS):
        if n not in live:
            folder.delete(f"{COMMITS}/{n}")
    for n in folder.names(""):
        if n != COMMITS and n not in named and not any(f.startswith(f"{n}/") for f in named):
            folder.delete(n)
