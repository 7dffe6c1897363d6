"""Scoring predicted formulas against references, and what is summed from the scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formulary.functions.latex import CLASSES, norm_latex, scores, word_error_rate
from formulary.functions.names import fresh


def long_predictions(wide: DataFrame, key: str = "id") -> DataFrame:
    """(id, system, hyp) from one column a system; a missing prediction is no row."""
    return wide.unpivot([key], [c for c in wide.columns if c != key], "system", "hyp").where("hyp is not null")


def scored_each(rows: DataFrame, hyp: str = "hyp", ref: str = "target_text") -> DataFrame:
    """scored(), row by row: for streams, which keep no state then."""
    h, r = fresh(rows, "_h", "_r")
    return rows.withColumns({h: norm_latex(hyp), r: norm_latex(ref)}).withColumns(scores(h, r)).drop(h, r)


def scored(rows: DataFrame, hyp: str = "hyp", ref: str = "target_text") -> DataFrame:
    """rows with exact, tok_edit, and hits and total of each class. Null counts as the empty formula.

    A pair of texts is scored once, however many rows have it: scores cost far more than joining them back.
    """
    h, r = fresh(rows, "_h", "_r")
    pairs = rows.select(F.col(hyp).alias(h), F.col(ref).alias(r)).distinct()
    made = scored_each(pairs, h, r)
    return rows.join(made, rows[hyp].eqNullSafe(made[h]) & rows[ref].eqNullSafe(made[r])).drop(h, r)


def pair_counts(rows: DataFrame, *by: str, hyp: str = "hyp", ref: str = "target_text") -> DataFrame:
    """The distinct pairs of each group, scored, with the rows n that each has: sums need no scores joined back, and a pair that many rows have is counted before the shuffle."""
    return scored_each(rows.groupBy(*by, hyp, ref).agg(F.count("*").alias("n")), hyp, ref)


def aggregated_pairs(pairs: DataFrame, *by: str) -> DataFrame:
    """aggregated(), from pair_counts()."""
    n = F.sum("n")
    out = [n.alias("n"), (F.sum(F.col("exact") * F.col("n")) / n).alias("exact_match"), (F.sum(F.col("tok_edit") * F.col("n")) / n).alias("latex_token_edit")]
    for name in CLASSES:
        hit, total = (F.sum(F.col(f"{name}_{c}") * F.col("n")) for c in ("hit", "total"))
        out += [F.try_divide(hit, total).alias(f"{name}_acc"), total.alias(f"{name}_support")]
    return pairs.groupBy(*by).agg(*out)


def aggregated(rows: DataFrame, *by: str) -> DataFrame:
    """Per group: n, mean exact match and token edit, and each class's accuracy over all its items (null without any) with their number."""
    out = [F.count("*").alias("n"), F.avg("exact").alias("exact_match"), F.avg("tok_edit").alias("latex_token_edit")]
    for name in CLASSES:
        out.append(F.try_divide(F.sum(f"{name}_hit"), F.sum(f"{name}_total")).alias(f"{name}_acc"))
        out.append(F.sum(f"{name}_total").alias(f"{name}_support"))
    return rows.groupBy(*by).agg(*out)


def word_errors(rows: DataFrame, *by: str, hyp: str = "hyp", ref: str = "spoken_transcript") -> DataFrame:
    """Mean word error rate of each group."""
    return rows.groupBy(*by).agg(F.avg(word_error_rate(hyp, ref)).alias("wer_vs_spoken"))


def by_domain(rows: DataFrame, systems: list[str], times: str | None = None) -> DataFrame:
    """A row for each domain: every system's mean exact match, null where it has none, and n as the first system counts it. times names the column that says for how many rows one stands, as n does in pair_counts()."""
    n = F.col(times) if times else F.lit(1)
    wide = rows.groupBy("domain").pivot("system", systems).agg((F.sum(F.col("exact") * n) / F.sum(n)).alias("exact"), F.sum(n).alias("n"))
    n = F.coalesce(*(F.col(f"{s}_n") for s in systems))
    return wide.select("domain", *(F.col(f"{s}_exact").alias(s) for s in systems), n.alias("n"))


def flattened(metrics: DataFrame, *by: str) -> DataFrame:
    """(name, value) with names like split/system/metric; supports are left out."""
    values = [c for c in metrics.columns if c not in by and not c.endswith("support")]
    whole = metrics.select(*by, *(F.col(c).cast("double") for c in values)).unpivot(list(by), values, "metric", "value")
    return whole.where("value is not null").select(F.concat_ws("/", *by, "metric").alias("name"), "value")


def mean_loss(batches: DataFrame, *by: str) -> DataFrame:
    """Mean of losses weighted by their tokens."""
    return batches.groupBy(*by).agg((F.sum(F.col("loss") * F.col("tokens")) / F.greatest(F.lit(1), F.sum("tokens"))).alias("mean_loss"))


def running_loss(steps: DataFrame, every: int = 10) -> DataFrame:
    """(upto, mean_loss): the mean loss of every so many steps."""
    bucket = (F.floor((F.col("step") - 1) / every) + 1) * every
    return steps.groupBy(bucket.cast("long").alias("upto")).agg(F.avg("loss").alias("mean_loss"))
