"""Rows as JSON lines, whole JSON documents, and tables that are written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def read_lines(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None) -> DataFrame:
    """One row a line; blank lines are no rows."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def read_splits(spark: SparkSession, pattern: str, schema: StructType | str | None = None, prefix: str = "") -> DataFrame:
    """The files that a pattern names, with the split taken from each file's name. Shard logs (.tts.) are left out."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = read_lines(spark, pattern, schema).select("*", name.alias("_file")).where(~F.col("_file").contains(".tts."))
    return rows.withColumn("split", F.regexp_replace(F.regexp_replace("_file", r"\.jsonl?(\.gz)?$", ""), f"^{prefix}", "")).drop("_file")


def read_document(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A file that is one JSON value."""
    reader = spark.read.option("multiLine", True)
    return (reader if schema is None else reader.schema(schema)).json(path)


def write_lines(df: DataFrame, path: str, once: bool = False) -> None:
    """JSON lines; with once, what is there already stays."""
    df.write.mode("ignore" if once else "overwrite").json(path)


def write_splits(df: DataFrame, path: str, once: bool = False) -> None:
    """Parquet by split; the split is a folder, not a column."""
    df.write.mode("ignore" if once else "overwrite").partitionBy("split").parquet(path)


def read_unseen(spark: SparkSession, path: str) -> DataFrame:
    """Hand-written formulas (domain, latex, spoken_text) of a JSON lines file as the unseen pool of a dataset: ord is their place by file and line, difficulty 4, held out.

    Such a pool is short, as it is written by hand; its places come from one task.
    """
    rows = read_lines(spark, path, "domain string, latex string, spoken_text string")
    rows = rows.coalesce(1).withColumn("ord", F.monotonically_increasing_id())
    return rows.select("ord", "latex", "spoken_text", "domain", F.lit(4).alias("difficulty"), F.lit("ood").alias("template"), F.lit(True).alias("heldout"))


CANDIDATE = """id string, license string, modality array<string>, tasks array<string>, size_category array<string>, downloads bigint, likes bigint, gated boolean,
is_audio boolean, permissive boolean, matched_keywords array<string>, splits_hint array<string>"""


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each candidate of a catalogue's snapshot, a JSON document {candidates: [...]}; a document without any gives no rows."""
    one = StructType.fromDDL(CANDIDATE)
    return read_document(spark, path, StructType().add("candidates", ArrayType(one))).select(F.inline("candidates"))


def read_first(spark: SparkSession, path: str, columns: list[str], most: int | None = None) -> DataFrame:
    """The columns of a Parquet table, and only so many rows of it if a bound is given."""
    rows = spark.read.parquet(path).select(*columns)
    return rows if most is None else rows.limit(most)
