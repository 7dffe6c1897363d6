"""Whole runs: predictions to metrics, and formulas to a leak-free dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formulary.functions.latex import cleaned_reference
from formulary.functions.names import fresh
from formulary.operators import datasets, normalize, scoring
from formulary.sources.grammar import checked_views

#: What is reported: a view's name, the system whose predictions it reads, and whether they go through the rules.
VIEWS = [("zeroshot", "zeroshot", False), ("rules", "zeroshot", True), ("direct", "canonical", False)]


def evaluated(predictions: DataFrame, manifest: DataFrame, views: list = VIEWS) -> dict[str, DataFrame]:
    """metrics by split and view, domains by split, and the scored rows, from wide predictions (id, one column a system).

    A clip is normalised once and scored once a view; word errors read the prediction as it was.
    """
    checked_views(views, [c for c in predictions.columns if c != "id"])
    long = scoring.long_predictions(predictions).join(manifest.select("id", "split", "domain", "target_text", "spoken_transcript"), "id")
    rows = scoring.scored(normalize.viewed(long.withColumn("said", F.col("hyp")), views))
    metrics = scoring.aggregated(rows, "split", "view").join(scoring.word_errors(rows, "split", "view", hyp="said"), ["split", "view"])
    names = [v[0] for v in views]
    return {"rows": rows, "metrics": metrics, "domains": scoring.by_domain(rows.withColumn("system", F.col("view")), names)}


def probed(rows: DataFrame, heard: str = "heard", tuned: str = "tuned", label: str = "label", spoken: str = "transcription") -> DataFrame:
    """Metrics of three systems against labels from elsewhere: what was heard as it is (zeroshot) and through the rules, and a tuned system's formulas; word errors of the first against what was spoken.

    Labels are cleaned of delimiters, spacing and size commands. What a system lacks counts as the empty formula.
    """
    read, target, system, hyp = fresh(rows, "_read", "_target", "_system", "_hyp")
    wide = normalize.canonicalized(rows.withColumn(target, cleaned_reference(label)), heard, read)
    wide = wide.select(target, F.col(heard).alias("zeroshot"), F.col(f"{read}.latex").alias("rules"), F.col(tuned).alias("tuned"))
    pairs = scoring.pair_counts(wide.unpivot([target], ["zeroshot", "rules", "tuned"], system, hyp), system, hyp=hyp, ref=target)
    errors = scoring.word_errors(rows.select(F.lit("zeroshot").alias("system"), heard, spoken), "system", hyp=heard, ref=spoken)
    return scoring.aggregated_pairs(pairs, system).withColumnRenamed(system, "system").join(errors, "system", "left")


def dataset(templates: DataFrame, held_out: DataFrame, unseen: DataFrame, composed: DataFrame) -> DataFrame:
    """Expressions with splits and dense ids, from four pools of drawn formulas (ord, latex, …).

    Templates split by hash, at most two of a formula outside train and none that train holds; the
    held-out pool once a formula; the unseen pool as it is; composed ones without any whose normal
    form one of the other pools holds.
    """
    base = templates.withColumn("split", datasets.split_of("latex", datasets.TEMPLATE_SPLITS))
    key = F.replace("latex", F.lit(" "), F.lit(""))
    base = datasets.leak_free(datasets.capped(base, ["split", key], ["ord"], 2, F.col("split") == "train"))
    hard = datasets.capped(held_out, ["latex"], ["ord"], 1).withColumn("split", F.lit("test_hard"))
    base = datasets.numbered(base.unionByName(hard.withColumn("ord", F.col("ord") + (1 << 40))), "ord", "expr_id")
    odd = datasets.numbered(unseen.withColumn("split", F.lit("test_ood")), "ord", "expr_id", "o%04d")
    trees = datasets.unbanned(composed, base.unionByName(odd)).withColumn("split", datasets.split_of("latex", datasets.TREE_SPLITS))
    return base.unionByName(odd).unionByName(datasets.numbered(trees, "ord", "expr_id", "c%06d"))
