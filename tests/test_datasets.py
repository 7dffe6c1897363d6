"""Dataset operators on rows with nulls, ties, clashing names and nothing at all."""

from pyspark.sql import functions as F

from formulary.operators import datasets, normalize, scoring

CLASHING = ["_part", "_at", "_start", "_place", "_key", "_hit", "_gen", "_last", "_said", "_t", "_score", "_math", "_read", "_h", "_r", "_canon"]


def with_clashes(df):
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHING)))


def kept(df):
    return all(r[c] == k for r in df.collect() for k, c in enumerate(CLASHING))


def test_every_row_gets_a_place(spark):
    keys = [5, None, 250_000, 5, -3, None, 100_000]
    rows = with_clashes(spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "ord long, n int"))
    out = datasets.numbered(rows, "ord", "id", "e%03d").cache()
    assert kept(out)
    got = [(r["id"], r["ord"]) for r in out.orderBy("id").collect()]
    assert [i for i, _ in got] == [f"e{k:03d}" for k in range(7)] and [k for _, k in got] == [-3, 5, 5, 100_000, 250_000, None, None]
    assert sorted(r["ord"] for r in datasets.first_rows(rows, "ord", 3).collect()) == [-3, 5, 5]
    parts = [datasets.shard(rows, "ord", 3, k).collect() for k in range(3)]
    assert sorted(len(p) for p in parts) == [2, 2, 3] and sorted(r["n"] for p in parts for r in p) == list(range(7))
    assert datasets.numbered(rows.limit(0), "ord", "id").count() == 0


def test_rows_without_a_split_or_a_text_stay(spark):
    table = [(1, "train", "x^2"), (2, "test", "x ^2"), (3, None, "x^{2}"), (4, None, "y"), (5, "test", None), (6, "test", "z")]
    rows = with_clashes(spark.createDataFrame(table, "id int, split string, latex string"))
    out = datasets.leak_free(rows)
    assert sorted(r["id"] for r in out.collect()) == [1, 3, 4, 5, 6] and out.columns == rows.columns and kept(out)
    counts = {r["split"]: r["train_overlap"] for r in datasets.leakage(rows, "latex").collect()}
    assert counts == {"test": 1, None: 1}
    assert sorted(r["id"] for r in datasets.unbanned(rows, rows.where("id = 1"), "latex").collect()) == [4, 5, 6]
    assert datasets.leak_free(rows.limit(0)).count() == 0 and datasets.leakage(rows.limit(0), "latex").count() == 0


def test_recordings_and_acceptance(spark):
    spoken = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    made = spark.createDataFrame([("a", 1.0, 1), ("a", 30.0, 2), ("c", 5.0, 1), (None, 2.0, 1)], "id string, duration double, ord int")
    rows = datasets.synthesized(spoken, made)
    assert [tuple(r) for r in rows.collect()] == [("a", 30.0)] and datasets.trainable(rows).count() == 0 and datasets.trainable(rows, 30.0).count() == 1
    marks = spark.createDataFrame([(True,), (None,), (False,)], "accepted boolean")
    assert [tuple(r) for r in datasets.acceptance(marks).collect()] == [(1, 3)]


def test_names_of_the_caller_stay(spark):
    rows = with_clashes(spark.createDataFrame([(1, "x squared equals two", "x^2=2", "s"), (2, None, "y", "s"), (3, "x^2", None, "s")], "id int, hyp string, target_text string, system string"))
    assert kept(normalize.canonicalized(rows, "hyp")) and kept(scoring.scored(rows)) and scoring.scored(rows).count() == 3
    assert kept(normalize.viewed(rows, [("v", "s", True)]))
    assert kept(datasets.capped(rows, ["system"], ["id"], 5)) and kept(datasets.merged(rows, rows.limit(0), "id", "id"))


def test_a_fallback_replaces_what_is_unsure(spark):
    rows = spark.createDataFrame([(1, "x squared zebra equals two"), (2, "x squared equals two"), (3, "hello there"), (4, "zebra equals giraffe squared")], "id int, text string")
    answer = lambda c: F.when(c.contains("giraffe"), F.struct(F.lit("(").alias("latex"), F.lit(1.0).alias("confidence"))).otherwise(F.struct(F.lit("x^2 = 2").alias("latex"), F.lit(0.99).alias("confidence")))
    got = {r["id"]: r["result"] for r in normalize.with_fallback(rows, answer).collect()}
    assert (got[1]["latex"], got[1]["method"], got[1]["confidence"]) == ("x^2 = 2", "llm", 0.9)
    assert got[2]["method"] == "rules" and got[3]["method"] == "passthrough" and got[4]["method"] == "rules"  # what isn't valid doesn't count


def test_picks_keep_ids_and_names(spark):
    from formulary.operators.selection import capped_pick, sampled

    table = [(2**60 + 1, "s", "d", "a b"), (None, "s", "d", "ab"), (5, None, "d", "c"), (6, "s", "e", None), (7, "s", "d", "x"), (8, "s", "d", "y")]
    rows = with_clashes(spark.createDataFrame(table, "id long, split string, domain string, truth string"))
    out = capped_pick(rows, [F.col("id").desc()])
    assert kept(out) and [(r["pick"], r["id"]) for r in out.orderBy("pick").collect()] == [(1, 2**60 + 1), (2, 8), (3, 7), (4, 6)]
    assert capped_pick(rows.limit(0), [F.col("id")]).count() == 0 and kept(sampled(rows, "id", 3))


def test_places_of_sparse_frequent_and_huge_values(spark):
    import random

    r = random.Random(3)
    keys = [r.randrange(-(2**62), 2**62) for _ in range(1500)] + [2**62 + 7] * 900 + [2**62 + 6, 2**62 + 8, 2**62 + 9] * 20 + [None] * 150 + list(range(400)) + [-(2**63), 2**63 - 1]
    rows = with_clashes(spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "ord long, n int").repartition(5))
    out = datasets.placed(rows, "ord", "place", stretch=100).cache()
    got = sorted((x["place"], x["ord"]) for x in out.where("ord is not null").collect())
    assert kept(out) and [p for p, _ in got] == list(range(len(keys) - 150)) and [k for _, k in got] == sorted(k for k in keys if k is not None)
    assert sorted(x["place"] for x in out.where("ord is null").collect()) == list(range(len(keys) - 150, len(keys)))
    assert sorted(x["n"] for x in out.collect()) == list(range(len(keys)))
    split = datasets._stretched(rows, "ord", "part", 100)
    assert max(x["count"] for x in split.groupBy("part").count().collect()) < 400  # also of the value that 900 rows have
    first = datasets.first_rows(rows, "ord", 50).collect()
    assert sorted(x["ord"] for x in first) == sorted(k for k in keys if k is not None)[:50]


def test_caps_keep_exempt_rows_and_hot_keys_apart(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else None, k % 7 == 0) for k in range(200)], "id long, key string, free boolean").repartition(4)
    out = datasets.capped(rows, ["key"], ["id"], 3, F.col("free"))
    want = {k for k in range(200) if k % 7 == 0} | {1, 2, 4} | {3, 6, 9}
    assert {r["id"] for r in out.collect()} == want
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
