"""Markup of spoken text, and who says what how fast."""

from pyspark.sql import functions as F

from formulary.operators.speech import marked, spoken


def test_markup(spark):
    cases = {
        "F of x equals sin theta": "[F](/ˈɛf/) of [x](/ˈɛks/) equals sine [theta](/θˈAtə/)",
        "pH equals KL": "[p](/pˈi/) [H](/ˈAʧ/) equals [k](/kˈA/) [l](/ˈɛl/)",
        "": "",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("m", marked("t")).collect()
    assert {r["t"]: r["m"] for r in rows} == cases
    many = spark.range(2000).select(marked(F.lit("u v is equal to w plus z"), "id").alias("m"))
    shares = many.select(F.avg(F.col("m").contains(", is").cast("int")), F.avg(F.col("m").contains(", plus").cast("int"))).first()
    assert abs(shares[0] - 0.25) < 0.04 and abs(shares[1] - 0.1) < 0.03


def test_voices(spark):
    rows = spark.range(400).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("expr_id"), F.element_at(F.array(*map(F.lit, ["train", "test", "test_hard", "test_ood"])), (F.col("id") % 4 + 1).cast("int")).alias("split"), F.lit("x").alias("spoken_text"))
    out = spoken(rows, ["a", "b"], ["y", "z"]).collect()
    by = lambda s: [r for r in out if r["split"] == s]
    assert [len(by(s)) for s in ("train", "test", "test_hard", "test_ood")] == [100, 100, 600, 200]
    assert {r["voice"] for r in by("train")} == {"a", "b"} and {r["voice"] for r in by("test")} == {"a", "b", "y", "z"} and {r["voice"] for r in by("test_hard")} == {"y", "z"}
    assert all(r["spoken_text"] == "x" for r in by("test_hard")) and 3 <= sum(r["spoken_text"] != "x" for r in by("train")) <= 30
    assert all(0.85 <= r["speed"] <= 1.15 for r in by("train")) and len({r["id"] for r in out}) == len(out)
