"""Stages that are run once: a ledger of outputs, each under the fingerprint of what it was made from.

A stage's fingerprint covers its name, its settings, the files of the tables that it reads (names,
sizes, times) and the fingerprints of the stages before it. An output is written aside and put in its
place by one rename, so what is there is whole. Rows come back from the stored output, also on the
run that made it. Outputs that a later fingerprint has superseded are deleted when asked for.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Output:
    """A stage's stored rows, where they are, their fingerprint, and whether this run made them."""

    rows: DataFrame
    path: str
    fingerprint: str
    made: bool


class Ledger:
    """The outputs in a folder that driver and executors share. One run at a time may write to it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._used: dict[str, str] = {}

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self, name: str):
        return self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, table: str) -> list[tuple[str, int, int]]:
        """Files of a table with size and time; a table that isn't there has none."""
        files, at, out = self._files(table), self._path(table), []
        if not files.exists(at):
            return out
        found = files.listFiles(at, True)
        while found.hasNext():
            f = found.next()
            if not f.getPath().getName().startswith(("_", ".")):
                out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return sorted(out)

    def fingerprint(self, name: str, tables: list[str], after: list[Output], settings: dict) -> str:
        said = {"stage": name, "settings": settings, "tables": {t: self._listed(t) for t in tables}, "after": [o.fingerprint for o in after]}
        return hashlib.sha256(json.dumps(said, sort_keys=True, default=str).encode()).hexdigest()[:24]

    def run(self, name: str, make: Callable[[], DataFrame], tables: list[str] | tuple = (), after: list[Output] | tuple = (), settings: dict | None = None) -> Output:
        """The stage's output: as it is, if one of this fingerprint is there; else made, stored and published."""
        mark = self.fingerprint(name, list(tables), list(after), settings or {})
        path, files = f"{self.root}/{name}/{mark}", self._files(self.root)
        self._used[name] = mark
        made = not files.exists(self._path(f"{path}/_SUCCESS"))
        if made:
            aside = f"{self.root}/.{name}-{uuid.uuid4().hex}"
            try:
                make().write.parquet(aside)
                files.mkdirs(self._path(f"{self.root}/{name}"))
                files.delete(self._path(path), True)  # one that isn't whole
                if not files.rename(self._path(aside), self._path(path)):
                    raise RuntimeError(f"{path} can't be published")
            finally:
                files.delete(self._path(aside), True)
        return Output(self.spark.read.parquet(path), path, mark, made)

    def outputs(self) -> dict[str, list[str]]:
        """The fingerprints that are stored, by stage."""
        files, out = self._files(self.root), {}
        for stage in files.listStatus(self._path(self.root)) if files.exists(self._path(self.root)) else []:
            if not stage.getPath().getName().startswith("."):
                out[stage.getPath().getName()] = sorted(x.getPath().getName() for x in files.listStatus(stage.getPath()))
        return out

    def collect_garbage(self) -> list[str]:
        """Deletes, of the stages that this ledger has run, outputs other than the ones it used, and what failed runs left aside. Gives what went."""
        files, gone = self._files(self.root), []
        for stage, marks in self.outputs().items():
            gone += [f"{self.root}/{stage}/{m}" for m in marks if stage in self._used and m != self._used[stage]]
        for x in files.listStatus(self._path(self.root)):
            if x.getPath().getName().startswith("."):
                gone.append(x.getPath().toString())
        for path in gone:
            files.delete(self._path(path), True)
        return gone
