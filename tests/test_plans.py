"""Whole runs: views scored from one reading, and a dataset built from drawn formulas."""

import pytest
from pyspark.sql import functions as F

from formulary.operators import scoring
from formulary.plans.evaluation import dataset, evaluated
from formulary.sources.formulas import Pool, expressions

def test_views_are_scored_from_one_reading(spark):
    manifest = spark.createDataFrame([("a", "test", "algebra", "x^2 = 1", "x squared equals one"), ("b", "test", "ml", r"\alpha", "alpha")], "id string, split string, domain string, target_text string, spoken_transcript string")
    predictions = spark.createDataFrame([("a", "x squared equals one", "x^{2}=1"), ("b", "alpha plus", None)], "id string, zeroshot string, canonical string")
    got = {r["view"]: r for r in evaluated(predictions, manifest)["metrics"].collect()}
    assert {v: (r["n"], r["exact_match"], r["wer_vs_spoken"]) for v, r in got.items()} == {"zeroshot": (2, 0.0, 0.5), "rules": (2, 0.5, 0.5), "direct": (1, 1.0, pytest.approx(got["direct"]["wer_vs_spoken"]))}


def test_dataset_is_leak_free_and_numbered(spark):
    pool = lambda seed, held=False: expressions(spark, 400, seed, Pool(held_out=held))
    odd = pool(5).limit(0)
    out = dataset(pool(1), pool(2, True), odd, pool(3)).cache()
    assert out.groupBy("expr_id").count().where("count > 1").count() == 0
    keys = out.withColumn("k", F.replace("latex", F.lit(" "), F.lit("")))
    train = keys.where("split = 'train' and expr_id like 'e%'").select("k")
    assert keys.where("split in ('test', 'validation') and expr_id like 'e%'").join(train, "k", "left_semi").count() == 0
    assert keys.where("split in ('test', 'validation') and expr_id like 'e%'").groupBy("split", "k").count().where("count > 2").count() == 0
    assert out.where("split = 'test_hard'").groupBy("latex").count().where("count > 1").count() == 0
    assert sorted(r[0] for r in out.where("expr_id like 'e%'").select("expr_id").collect()) == [f"e{k:06d}" for k in range(out.where("expr_id like 'e%'").count())]


def test_word_error_rate(spark):
    rows = spark.createDataFrame([("x squared!", "X squared"), ("a b", ""), ("a c d", "a b")], "hyp string, ref string")
    from formulary.functions.latex import word_error_rate

    assert [r[0] for r in rows.select(word_error_rate("hyp", "ref")).collect()] == [0.0, 2.0, 1.0]
    assert scoring.running_loss(spark.range(1, 21).selectExpr("id step", "cast(id as double) loss")).orderBy("upto").collect() == [(10, 5.5), (20, 15.5)]


def test_metrics_worked_out_by_hand(spark):
    from pytest import approx

    from formulary.plans.evaluation import evaluated

    clips = [(1, "test", "algebra", "x^{2}", "x squared"), (2, "test", "algebra", r"\frac{a}{b}", "a over b"), (3, "test", "calculus", r"\alpha+1", "alpha plus one"), (4, "test", "calculus", "y = 2", "y equals two"), (5, "hard", "ml", "z", "z")]
    manifest = spark.createDataFrame(clips, "id long, split string, domain string, target_text string, spoken_transcript string")
    said = [(1, "x squared", "x^2"), (2, "a over b", r"\frac{a}{c}"), (3, "alpha plus one", None), (4, "y equals three", "y=2"), (9, "not in the manifest", "q")]
    out = evaluated(spark.createDataFrame(said, "id long, zeroshot string, canonical string"), manifest)
    got = {r["view"]: r for r in out["metrics"].collect()}
    assert {v: (r["split"], r["n"]) for v, r in got.items()} == {"zeroshot": ("test", 4), "rules": ("test", 4), "direct": ("test", 3)}
    assert got["zeroshot"]["exact_match"] == 0 and got["rules"]["exact_match"] == 0.75 and got["direct"]["exact_match"] == approx(2 / 3)
    assert (got["rules"]["greek_acc"], got["rules"]["greek_support"]) == (1.0, 1) and (got["direct"]["greek_acc"], got["direct"]["greek_support"]) == (None, 0)
    assert got["zeroshot"]["wer_vs_spoken"] == got["rules"]["wer_vs_spoken"] == approx(1 / 12)  # one word of three, in one of four
    assert got["rules"]["latex_token_edit"] == approx(1 / 12)  # y=3 for y=2: one token of three, in one of four
    domains = {r["domain"]: (r["zeroshot"], r["rules"], r["direct"], r["n"]) for r in out["domains"].collect()}
    assert domains == {"algebra": (0.0, 1.0, 0.5, 2), "calculus": (0.0, 0.5, 1.0, 2)}
