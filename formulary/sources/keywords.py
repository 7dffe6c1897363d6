"""A catalogue searched by keywords: one partition a keyword, and a keyword whose part can't be read is a row that says so.

A snapshot of a search service is a folder with a JSON lines file of hits for each keyword, best
first. In a session with spark.sql.python.filterPushdown.enabled, filters on the keyword reach the
source, so only the parts that are asked for are opened.

    spark.dataSource.register(KeywordSearch)
    spark.read.format("keyword_search").option("path", …).option("keywords", "speech,audio").load()
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from formulary.sources.folders import Folder

SCHEMA = "keyword string, ord long, id string, tags array<string>, downloads long, gated boolean, error string"
MOST = 25


@dataclass
class Part(InputPartition):
    """One keyword, and its place among those that were asked for."""

    keyword: str
    place: int


def _hit(said: dict) -> tuple:
    """Fields of a hit; one of another type is an error of its part."""
    tags, downloads, gated = said.get("tags") or [], said.get("downloads"), said.get("gated")
    if not isinstance(said["id"], str) or not all(isinstance(t, str) for t in tags):
        raise ValueError("a hit's id and tags are texts")
    return said["id"], list(tags), None if downloads is None else int(downloads), None if gated is None else bool(gated)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.most = options["path"], int(options.get("most", MOST))
        named = options.get("keywords")
        self.keywords = [k.strip() for k in named.split(",") if k.strip()] if named is not None else self._there()
        self.only: set[str] | None = None

    def _there(self) -> list[str]:
        return [n.removesuffix(".jsonl") for n in Folder(self.path).names("") if n.endswith(".jsonl")]

    def partitions(self) -> list[Part]:
        return [Part(k, place) for place, k in enumerate(self.keywords) if self.only is None or k in self.only]

    def read(self, partition: Part) -> Iterator[tuple]:
        """The first hits of a keyword. ord is a hit's place over all keywords: an earlier keyword's hits come first."""
        start, good = partition.place * self.most, []
        try:
            with Folder(self.path).open_to_read(f"{partition.keyword}.jsonl") as f:
                for line in f.read().decode().splitlines():
                    if line.strip() and len(good) < self.most:
                        good.append(_hit(json.loads(line)))
        except Exception as error:  # whatever is wrong with this part, the others are read
            yield partition.keyword, start, None, None, None, None, f"{type(error).__name__}: {error}"
            return
        for k, hit in enumerate(good):
            yield partition.keyword, start + k, *hit, None


class _FilteredReader(_Reader):
    """One that takes filters; Spark refuses it in a session that doesn't push them."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("keyword",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = values if self.only is None else self.only & values
            else:
                yield f


class KeywordSearch(DataSource):
    """Options: path, a folder; keywords, apart by commas (all that are there); most, hits a keyword; filters, whether the session pushes filters to such sources."""

    @classmethod
    def name(cls) -> str:
        return "keyword_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return (_FilteredReader if self.options.get("filters") == "true" else _Reader)(dict(self.options))


def searched(spark: SparkSession, path: str, keywords: list[str] | None = None, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Hits (id, keyword, ord, tags, downloads, gated), as catalogue() takes them, and failures (keyword, error)."""
    spark.dataSource.register(KeywordSearch)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("keyword_search").option("path", path).option("most", most).option("filters", pushes)
    rows = (reader if keywords is None else reader.option("keywords", ",".join(keywords))).load()
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("keyword", "error")
