"""Manifests that are stored by key: joins and merges of them find their rows side by side and shuffle nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def store_by(rows: DataFrame, table: str, *keys: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows as a table of the warehouse, dealt by key into buckets that are sorted by it; replaces a table of that name. Null keys share a bucket.

    Rows are dealt before they are written, so every bucket is one file and its order can be relied on.
    """
    spread = rows.repartition(buckets, *keys).sortWithinPartitions(*keys)
    spread.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return rows.sparkSession.table(table)


def joined(spark: SparkSession, left: str, right: str, *keys: str, how: str = "inner") -> DataFrame:
    """Two stored tables by their keys, without an exchange where both have the same buckets: merged bucket by bucket."""
    a, b = spark.table(left), spark.table(right)
    return a.join(b.hint("merge"), list(keys), how)


def last_of_each(spark: SparkSession, table: str, key: str, order: str) -> DataFrame:
    """One row a key of a stored table, the last by order (ties: the greatest), without an exchange."""
    rows = spark.table(table)
    rest = [c for c in rows.columns if c != key]
    kept = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("_last"))
    return kept.select(key, "_last.*").select(rows.columns)


def drop_stored(spark: SparkSession, *tables: str) -> None:
    reduce(lambda _, t: spark.sql(f"DROP TABLE IF EXISTS {t}"), tables, None)
