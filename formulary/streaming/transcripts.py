"""Transcripts as they arrive: normalised and scored row by row, merged into a table, counted by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from formulary.functions.names import fresh
from formulary.operators.datasets import merged
from formulary.operators.normalize import canonicalized
from formulary.operators.scoring import scored_each


def normalised(stream: DataFrame, text: str = "text") -> DataFrame:
    """The batch operator as it is: it keeps no state."""
    return canonicalized(stream, text)


def scored_stream(stream: DataFrame, hyp: str = "hyp", ref: str = "target_text") -> DataFrame:
    return scored_each(stream, hyp, ref)


def windowed_metrics(stream: DataFrame, at: str = "at", late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """n, exact match and token edit by event-time window; rows later than the watermark are not waited for."""
    window = F.window(at, size).alias("window")
    return stream.withWatermark(at, late).groupBy(window).agg(F.count(F.lit(1)).alias("n"), F.avg("exact").alias("exact_match"), F.avg("tok_edit").alias("latex_token_edit"))


#: Parts of a filled table. A batch rewrites those parts only that its keys are in.
PARTS = 256


def _folders(spark: SparkSession, path: str) -> dict[str, dict[int, str]]:
    """For each part of a filled table its generations, number to path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[str, dict[int, str]] = {}
    for part in files.listStatus(where) if files.exists(where) else []:
        if part.getPath().getName().startswith("part="):
            made = {int(g.getPath().getName().partition("=")[2]): g.getPath().toString() for g in files.listStatus(part.getPath())}
            out[part.getPath().getName()] = made
    return out


def filled(spark: SparkSession, path: str, schema: StructType, before: int | None = None, only: set[str] | None = None) -> DataFrame:
    """What fill() holds: of each part (or only some) the last generation, or the last before a number. An empty table if there is none."""
    made = {part: {n: p for n, p in old.items() if before is None or n < before} for part, old in _folders(spark, path).items()}
    paths = [old[max(old)] for part, old in made.items() if old and (only is None or part in only)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def fill(stream: DataFrame, path: str, checkpoint: str, key: str = "id", order: str = "seq", parts: int = PARTS):
    """Keeps one row a key at a path, dealt into parts by its hash: a batch merges the parts that its keys are in and writes them anew, under its own number.

    A part keeps its last generation and the one before it, so a batch that fails midway can run
    again; what is older is deleted. The path must be one that driver and executors share.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
        touched = {f"part={r[0]}" for r in batch.select(part).distinct().collect()}  # as many as there are parts at most
        rows = merged(filled(spark, path, batch.schema, number, touched), batch, key, order).select(batch.columns)
        staged, (into,) = f"{path}/_batch-{number}", fresh(batch, "_part")
        rows.withColumn(into, part).repartition(into).write.mode("overwrite").partitionBy(into).parquet(staged)
        files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        at = spark._jvm.org.apache.hadoop.fs.Path
        for name in sorted(touched):
            files.mkdirs(at(f"{path}/{name}"))
            files.delete(at(f"{path}/{name}/batch={number}"), True)
            files.rename(at(f"{staged}/{name.replace('part', into)}"), at(f"{path}/{name}/batch={number}"))
        files.delete(at(staged), True)
        for name, made in _folders(spark, path).items():
            for old in sorted(made)[:-2] if name in touched else []:
                files.delete(at(made[old]), True)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
