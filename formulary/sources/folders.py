"""Folders that driver and executors share, and files in them for code of data sources, which has no session."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names; it goes when the driver ends. Only a local session may leave the setting out: elsewhere a folder of the driver would be its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(named or tempfile.mkdtemp(prefix='formulary-')).rstrip('/')}/formulary-{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


class Folder:
    """A folder by its path or URI, in any store that Arrow opens."""

    def __init__(self, path: str) -> None:
        self.store, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def at(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}".rstrip("/")

    def names(self, name: str) -> list[str]:
        """Names in a folder of it, sorted; none if it isn't there or is a file."""
        if self.store.get_file_info(self.at(name)).type != fs.FileType.Directory:
            return []
        found = self.store.get_file_info(fs.FileSelector(self.at(name)))
        return sorted(f.base_name for f in found)

    def open_to_write(self, name: str):
        self.store.create_dir(self.at(name).rpartition("/")[0], recursive=True)
        return self.store.open_output_stream(self.at(name))

    def open_to_read(self, name: str):
        return self.store.open_input_file(self.at(name))

    def read(self, name: str) -> str:
        with self.open_to_read(name) as f:
            return f.read().decode()

    def publish(self, name: str, text: str) -> None:
        """Writes a file so that it is there whole or not at all, in place of one of its name."""
        other = f"{name}.{uuid.uuid4().hex}.new"
        with self.open_to_write(other) as f:
            f.write(text.encode())
        self.store.move(self.at(other), self.at(name))

    def delete(self, name: str) -> None:
        """Deletes a file, or a folder with what is in it; what isn't there is no error."""
        kind = self.store.get_file_info(self.at(name)).type
        if kind == fs.FileType.Directory:
            self.store.delete_dir(self.at(name))
        elif kind == fs.FileType.File:
            self.store.delete_file(self.at(name))
