"""Choosing few rows: capped picks, reproducible samples, candidates of a catalogue."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from formulary.functions.names import fresh


def capped_pick(rows: DataFrame, order: list[Column], n: int = 24, per_domain: int = 3, per_split: int = 10, truth: str = "truth") -> DataFrame:
    """Rows picked greedily in an order: no formula twice, so many of a domain and of a split, so many in all. pick numbers them.

    A pick can be passed over for at most n formulas that were picked before, so the first
    per_domain + n different formulas of each domain and split are enough for the walk. Only those
    few rows meet in one task. Null is a domain, a split and a formula like any other; rows that tie
    in the order are told apart by nothing else; no rows give none.
    """
    key, first, place, rank = fresh(rows, "_key", "_first", "_place", "_rank")
    keyed = rows.withColumn(key, F.replace(truth, F.lit(" "), F.lit("")))
    at = F.row_number().over(Window.partitionBy("domain", "split", key).orderBy(*order))
    keyed = keyed.withColumn(first, at).where(F.col(first) == 1)
    at = F.row_number().over(Window.partitionBy("domain", "split").orderBy(*order))
    few = keyed.withColumn(place, at).where(F.col(place) <= per_domain + n).drop(first, place)
    few = few.withColumn(rank, F.row_number().over(Window.orderBy(*order)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), shape).sort_by(rank)  # in Arrow, so that no id becomes a float
        seen, domains, splits, out = set(), {}, {}, []
        for i, (k, d, s) in enumerate(zip(*(table[c].to_pylist() for c in (key, "domain", "split")), strict=True)):
            if len(out) < n and k not in seen and domains.get(d, 0) < per_domain and splits.get(s, 0) < per_split:
                seen.add(k)
                domains[d], splits[s] = domains.get(d, 0) + 1, splits.get(s, 0) + 1
                out.append(i)
        picked = table.take(pa.array(out, pa.int64())).drop_columns([key, rank])
        yield from picked.append_column("pick", pa.array(range(1, len(out) + 1), pa.int64())).to_batches()

    shape, schema = to_arrow_schema(few.schema), few.drop(key, rank).withColumn("pick", F.lit(0).cast("long")).schema
    return few.coalesce(1).mapInArrow(walk, schema)


def demonstrable(rows: DataFrame) -> DataFrame:
    """Rows that are right (ok_direct) with a formula of more than 12 and less than 90 characters; null counts as wrong."""
    return rows.where(F.coalesce("ok_direct", F.lit(False)) & (F.length("truth") > 12) & (F.length("truth") < 90))


def demonstration(rows: DataFrame, **caps) -> DataFrame:
    """capped_pick() of the demonstrable rows: first those that the rules get wrong, of unseen templates, difficult and long ones; then by id."""
    order = [F.col("ok_rules"), ~F.col("split").eqNullSafe("test_ood"), F.desc("difficulty"), F.desc(F.length("truth")), F.col("id")]
    return capped_pick(demonstrable(rows), order, **caps)


def sampled(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """So many rows, the same for the same seed: those with the smallest hash of key and seed."""
    (h,) = fresh(rows, "_h")
    return rows.withColumn(h, F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))).orderBy(h, key).limit(n).drop(h)


def examples(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Of each split, shuffled by seed, the first n // 2 + 2 failures and then n successes."""
    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    place = F.row_number().over(Window.partitionBy("split", "ok").orderBy(h, key))
    return rows.withColumn("place", place).where(F.col("place") <= F.when(F.col("ok"), n).otherwise(n // 2 + 2))


# Licences under which data may be used.
PERMISSIVE = ["cc-by-4.0", "cc-by-sa-4.0", "cc0-1.0", "cc-by-3.0", "cc-by-2.0", "apache-2.0", "mit", "odc-by", "cc-by-sa-3.0"]


def tagged(tags: Column | str, prefix: str) -> Column:
    """The values of the tags with a prefix."""
    return F.transform(F.filter(tags, lambda t: t.startswith(f"{prefix}:")), lambda t: F.substring(t, len(prefix) + 2, 1 << 30))


def catalogue(hits: DataFrame) -> DataFrame:
    """One row a dataset from search hits (id, keyword, ord, tags, downloads, gated): what its tags say, the keywords that found it, whether it is usable.

    Attributes are those of the first hit.
    """
    first = F.min_by(F.struct("tags", "downloads", "gated"), "ord").alias("f")
    words = F.array_sort(F.collect_set("keyword")).alias("matched_keywords")
    one = hits.groupBy("id").agg(first, words).select("id", "matched_keywords", "f.*")
    one = one.withColumns({"license": F.get(tagged("tags", "license"), F.lit(0)), "modality": tagged("tags", "modality"), "tasks": tagged("tags", "task_categories")})
    audio = F.array_contains("modality", "audio") | F.exists("tasks", lambda t: t.contains("speech") | t.contains("audio"))
    one = one.withColumns({"is_audio": audio, "permissive": F.coalesce(F.col("license").isin(PERMISSIVE), F.lit(False))})
    return one.withColumn("usable", is_usable()).drop("tags")


def is_usable() -> Column:
    """Audio under a permissive licence, not gated; unknown counts as not."""
    return F.coalesce(F.col("is_audio") & F.col("permissive") & ~F.col("gated"), F.lit(False))


def ranked(datasets: DataFrame) -> DataFrame:
    """Permissive first, audio first, then by downloads."""
    return datasets.orderBy(~F.col("permissive"), ~F.col("is_audio"), F.desc("downloads"), "id")
