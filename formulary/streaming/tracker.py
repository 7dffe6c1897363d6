"""What a stream measures, as rows: a listener that publishes each batch's progress and observed metrics.

A batch observes sums and counts (measured); the listener writes them to a folder under the query's
run and the batch's number, so a batch that runs again replaces its own rows. Summed over batches they
give what the batch operators give for all rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from formulary.functions.latex import CLASSES
from formulary.sources.folders import Folder

SCHEMA = "query string, batch long, name string, value double"
#: The name under which a stream's metrics are observed.
OBSERVED = "formulary_metrics"


def measured(stream: DataFrame) -> DataFrame:
    """A stream of scored rows that observes their number and sums."""
    total = lambda c: F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    sums = [F.count(F.lit(1)).cast("double").alias("n"), total("exact").alias("exact"), total("tok_edit").alias("tok_edit")]
    sums += [total(f"{c}_{k}").alias(f"{c}_{k}") for c in CLASSES for k in ("hit", "total")]
    return stream.observe(OBSERVED, *sums)


class Tracker(StreamingQueryListener):
    """Publishes progress to a folder: rows in, and what was observed, of each batch of every query that has a name."""

    def __init__(self, path: str) -> None:
        self.path = path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name is None:
            return
        values = {"rows_in": float(p.numInputRows or 0)}
        if (seen := p.observedMetrics.get(OBSERVED)) is not None:
            values |= {k: v for k, v in seen.asDict().items() if v is not None}
        rows = [{"query": p.name, "batch": p.batchId, "name": k, "value": v} for k, v in values.items()]
        if any(values.values()):  # an idle trigger reports the last batch again, without rows
            Folder(self.path).publish(f"{p.name}-{p.batchId:012d}.json", "\n".join(map(json.dumps, rows)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def tracked(spark: SparkSession, path: str) -> DataFrame:
    """(query, batch, name, value) of every batch that was published."""
    return spark.read.schema(SCHEMA).json(path)


def tracked_metrics(rows: DataFrame) -> DataFrame:
    """A row for each query: n, mean exact match and token edit, each class's accuracy with its items, as aggregated() names them."""
    wide = rows.groupBy("query").pivot("name", ["n", "exact", "tok_edit", *(f"{c}_{k}" for c in CLASSES for k in ("hit", "total"))]).agg(F.sum("value"))
    out = [F.col("n").cast("long").alias("n"), F.try_divide("exact", "n").alias("exact_match"), F.try_divide("tok_edit", "n").alias("latex_token_edit")]
    for c in CLASSES:
        out += [F.try_divide(f"{c}_hit", f"{c}_total").alias(f"{c}_acc"), F.col(f"{c}_total").cast("long").alias(f"{c}_support")]
    return wide.select("query", *out)
