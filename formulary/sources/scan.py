"""A scan of a Parquet table that can be stopped and goes on where it was, within bounds on the rows it reads and on those that were accepted.

The source gives a table's rows file by file, so many a batch, each with its place. Offsets name a
file, a row in it and the rows scanned so far; tasks read slices of files. The next batch goes on from
the last offset in the query's checkpoint, also after a restart; how many rows were accepted is what
its log has committed. A scan that its bounds have ended hands out nothing more.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import LongType, StructType

from formulary.sources.append_log import AppendLog, read_log, rows_of
from formulary.sources.folders import Folder

PLACE = "place"
#: Rows of a batch and of a slice.
BATCH_ROWS, SLICE_ROWS = 100_000, 10_000
MOST_SCANNED, MOST_ACCEPTED = 60_000, 3_000


@dataclass
class Slice(InputPartition):
    """Rows of a file, and the place of the first of them."""

    file: str
    first: int
    rows: int
    place: int


def _files(folder: Folder) -> list[str]:
    """The data files of a table in the order of their names; a table that is one file is that file."""
    return [n for n in folder.names("") if not n.startswith(("_", "."))] or [""]


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        self.path, self.checkpoint, self.log = options["path"], options["checkpoint"], options.get("accepted")
        number = lambda key, usual: int(options.get(key, usual))
        self.batch_rows, self.slice_rows = number("batchrows", BATCH_ROWS), number("slicerows", SLICE_ROWS)
        self.most_scanned, self.most_accepted = number("mostscanned", MOST_SCANNED), number("mostaccepted", MOST_ACCEPTED)
        self.columns = columns
        self._names: list[str] | None = None
        self._rows: dict[int, int] = {}

    def _count(self, file: int) -> int:
        """Rows of a file, from its footer; only files that a batch comes to are asked."""
        if file not in self._rows:
            folder = Folder(self.path)
            with folder.open_to_read(self._list()[file]) as f:
                self._rows[file] = pq.ParquetFile(f).metadata.num_rows
        return self._rows[file]

    def _list(self) -> list[str]:
        if self._names is None:
            self._names = _files(Folder(self.path))
        return self._names

    def _on(self, offset: dict, rows: int) -> dict:
        """The offset so many rows on, or at the table's end."""
        file, row, scanned = offset["file"], offset["row"], offset["scanned"]
        while rows and file < len(self._list()):
            take = min(rows, self._count(file) - row)
            row, scanned, rows = row + take, scanned + take, rows - take
            if row == self._count(file):
                file, row = file + 1, 0
        return {"file": file, "row": row, "scanned": scanned}

    def initialOffset(self) -> dict:
        return {"file": 0, "row": 0, "scanned": 0}

    def _logged(self) -> dict:
        """The last offset that the query's checkpoint has: a batch of it that wasn't finished is run again by Spark itself."""
        folder = Folder(self.checkpoint)
        batches = [n for n in folder.names("offsets") if n.isdigit()]
        if not batches:
            return self.initialOffset()
        said = folder.read(f"offsets/{max(batches, key=int)}").strip().splitlines()[-1]
        return json.loads(said) if said.startswith("{") else self.initialOffset()

    def latestOffset(self) -> dict:
        last = self._logged()
        if self.log and rows_of(self.log) >= self.most_accepted:
            return last
        return self._on(last, max(0, min(self.batch_rows, self.most_scanned - last["scanned"])))

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        out, at = [], dict(start)
        while at["scanned"] < end["scanned"]:
            take = min(self.slice_rows, self._count(at["file"]) - at["row"], end["scanned"] - at["scanned"])
            if take:
                out.append(Slice(self._list()[at["file"]], at["row"], take, at["scanned"]))
            after = self._on(at, take)
            at = after if take else {"file": at["file"] + 1, "row": 0, "scanned": at["scanned"]}
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        with Folder(self.path).open_to_read(partition.file) as f:
            file, before = pq.ParquetFile(f), 0
            first, last = partition.first, partition.first + partition.rows
            for k in range(file.num_row_groups):
                rows = file.metadata.row_group(k).num_rows
                if before < last and before + rows > first:
                    at = before
                    for batch in file.iter_batches(4096, row_groups=[k], columns=self.columns):
                        low, high = max(first, at), min(last, at + batch.num_rows)
                        if low < high:
                            place = pa.array(range(partition.place + low - first, partition.place + high - first), pa.int64())
                            yield batch.slice(low - at, high - low).append_column(PLACE, place)
                        at += batch.num_rows
                before += rows


class Scan(DataSource):
    """Options: path, a table; checkpoint, the query's checkpointLocation; accepted, the log whose rows count as accepted; batchRows, sliceRows, mostScanned, mostAccepted."""

    @classmethod
    def name(cls) -> str:
        return "bounded_scan"

    def schema(self) -> StructType:
        folder = Folder(self.options["path"])
        with folder.open_to_read(_files(folder)[0]) as f:
            own = from_arrow_schema(pq.ParquetFile(f).schema_arrow)
        return own.add(PLACE, LongType())

    def streamReader(self, schema: StructType) -> _Reader:
        return _Reader(dict(self.options), [n for n in schema.names if n != PLACE])


def scanning(spark: SparkSession, path: str, out: str, accept: Callable[[DataFrame], DataFrame], most_scanned: int = MOST_SCANNED, most_accepted: int = MOST_ACCEPTED, batch_rows: int = BATCH_ROWS):
    """A stream, not yet started, from a table to a log at out: the rows that accept keeps, a filter row by row. Stopped at any batch and started again it goes on there. Everything that it must remember is in folders at out."""
    for source in (Scan, AppendLog):
        spark.dataSource.register(source)
    options = {"path": path, "checkpoint": f"{out}/_checkpoint", "accepted": f"{out}/rows", "mostscanned": most_scanned, "mostaccepted": most_accepted, "batchrows": batch_rows}
    stream = accept(spark.readStream.format("bounded_scan").options(**options).load())
    return stream.writeStream.format("append_log").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/_checkpoint"), stream.schema


def accepted(spark: SparkSession, out: str, schema: StructType | str, most: int = MOST_ACCEPTED) -> DataFrame:
    """The first so many accepted rows by their place. A batch that passes the bound is cut here, so batches of any size give the same rows."""
    return read_log(spark, f"{out}/rows", schema).orderBy(F.col(PLACE)).limit(most)
