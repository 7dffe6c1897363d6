"""Sources, stages, stored manifests and trackers: what fails, what is there already, what is shuffled, what is measured."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from formulary.operators.datasets import merged
from formulary.operators.scoring import aggregated, scored, scored_each
from formulary.operators.selection import catalogue


def test_a_keyword_that_fails_is_a_row(spark, tmp_path):
    from formulary.sources.keywords import searched

    hits = {
        "speech": [{"id": "a", "tags": ["modality:audio", "license:mit"], "downloads": 5, "gated": False}, {"id": "b", "tags": None}],
        "audio": [{"id": "a", "tags": ["license:odd"], "downloads": 9}] + [{"id": f"n{k}", "tags": []} for k in range(40)],
        "empty": [],
        "odd": [{"id": 7, "tags": []}],
    }
    for name, rows in hits.items():
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n\n" for r in rows))
    (tmp_path / "broken.jsonl").write_bytes(b'{"id": "x", "tags": []}\n{"id": "y", "ta\xff')
    asked = ["speech", "broken", "audio", "empty", "missing", "odd"]
    good, failed = searched(spark, str(tmp_path), asked, most=25)
    got = [(r["keyword"], r["ord"], r["id"]) for r in good.orderBy("ord").collect()]
    assert got == [("speech", 0, "a"), ("speech", 1, "b"), ("audio", 50, "a"), *(("audio", 51 + k, f"n{k}") for k in range(24))]
    assert {r["keyword"]: r["error"].split(":")[0] for r in failed.collect()} == {"broken": "UnicodeDecodeError", "missing": "FileNotFoundError", "odd": "ValueError"}
    one = {r["id"]: r for r in catalogue(good).collect()}["a"]
    assert one["matched_keywords"] == ["audio", "speech"] and one["usable"] and one["downloads"] == 5
    every, failed = searched(spark, str(tmp_path))
    assert every.select("keyword").distinct().count() == 2 and failed.count() == 2


def test_filters_on_the_keyword_reach_the_source(spark, tmp_path):
    from formulary.sources import keywords

    for name in "abcd":
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"id": name, "tags": []}))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = keywords.searched(spark, str(tmp_path))[0]
        some = rows.where(F.col("keyword").isin("a", "c", "z") & (F.col("id") != "a"))
        assert [r["id"] for r in some.collect()] == ["c"] and some.rdd.getNumPartitions() == 2
        assert rows.where("keyword = 'b'").rdd.getNumPartitions() == 1 and rows.count() == 4
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_stages_run_once(spark, tmp_path):
    from formulary.plans.stages import Ledger

    table, runs = str(tmp_path / "in"), []
    spark.range(5).write.parquet(table)

    def plan(times, root=str(tmp_path / "out")):
        ledger = Ledger(spark, root)
        first = ledger.run("first", lambda: (runs.append("first"), spark.read.parquet(table).withColumn("x", F.col("id") * times))[1], [table], settings={"times": times})
        second = ledger.run("second", lambda: (runs.append("second"), first.rows.agg(F.sum("x").alias("x")))[1], after=[first])
        return ledger, first, second

    assert plan(2)[2].rows.first()["x"] == 20 and runs == ["first", "second"]
    ledger, first, second = plan(2)
    assert runs == ["first", "second"] and not first.made and not second.made  # nothing has changed
    assert plan(3)[2].rows.first()["x"] == 30 and len(runs) == 4  # a setting
    spark.range(5, 6).write.mode("append").parquet(table)
    ledger, _, second = plan(3)
    assert second.rows.first()["x"] == 45 and len(runs) == 6  # an input
    (tmp_path / "out" / ".first-left").mkdir()
    with pytest.raises(ZeroDivisionError):
        ledger.run("third", lambda: 1 / 0)
    assert {k: len(v) for k, v in ledger.outputs().items()} == {"first": 3, "second": 3}
    assert len(ledger.collect_garbage()) == 5 and {k: len(v) for k, v in ledger.outputs().items()} == {"first": 1, "second": 1}
    assert plan(3)[2].rows.first()["x"] == 45 and len(runs) == 6
    (tmp_path / "out" / "second" / second.fingerprint / "_SUCCESS").unlink()  # one that isn't whole is made again
    assert plan(3)[2].made and len(runs) == 7


def test_stored_manifests_meet_without_an_exchange(spark):
    from formulary.plans.bucketed import drop_stored, joined, last_of_each, store_by

    r = np.random.default_rng(2)
    spoken = spark.createDataFrame([(int(k), f"s{k}") for k in r.integers(0, 300, 400)] + [(None, "none")], "id long, said string")
    made = spark.createDataFrame([(int(k), float(n % 7), n) for n, k in enumerate(r.integers(0, 300, 500))] + [(None, 1.0, 1)], "id long, duration double, ord int")
    try:
        store_by(spoken, "stored_spoken", "id", buckets=6)
        store_by(made, "stored_made", "id", buckets=6)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        both, last = joined(spark, "stored_spoken", "stored_made", "id"), last_of_each(spark, "stored_made", "id", "ord")
        key = lambda df: sorted(map(tuple, df.collect()), key=repr)
        assert key(both) == key(spoken.join(made, "id"))
        assert key(last) == key(merged(made, made.limit(0), "id", "ord").select(made.columns))
        for df in (both, last):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        drop_stored(spark, "stored_spoken", "stored_made")


def test_what_a_stream_measures_is_what_the_batch_has(spark, tmp_path):
    from formulary.streaming.tracker import Tracker, measured, tracked, tracked_metrics

    texts = ["x^2", "x^{2}", r"\frac{a}{b}", r"\alpha+1", None, "", "y"]
    rows = [(k, texts[k % 7], texts[(k * 3 + k // 7) % 7]) for k in range(90)]
    schema = "id long, hyp string, target_text string"
    listener = Tracker(str(tmp_path / "tracked"))
    spark.streams.addListener(listener)
    try:
        for low, high in ((0, 40), (40, 41), (41, 90)):
            spark.createDataFrame(rows[low:high], schema).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
            stream = measured(scored_each(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))))
            query = stream.writeStream.format("noop").queryName("scores").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            query.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    seen = tracked(spark, str(tmp_path / "tracked"))
    assert sorted((r["batch"], r["value"]) for r in seen.where("name = 'rows_in'").collect()) == [(0, 40.0), (1, 1.0), (2, 49.0)]
    got = tracked_metrics(seen).first().asDict()
    want = aggregated(scored(spark.createDataFrame(rows, schema))).first().asDict()
    assert got.pop("query") == "scores" and got == pytest.approx(want)


@pytest.mark.parametrize("rate", [8_000, 22_050, 44_100, 48_000])
def test_resampling_against_sines(rate):
    from formulary.sources.audio import resampled

    seconds = 0.5
    for tone in (100, 440, 1_000, 3_300):
        got = resampled(np.sin(2 * np.pi * tone * np.arange(int(rate * seconds)) / rate), rate)
        want = np.sin(2 * np.pi * tone * np.arange(len(got)) / 16_000)
        inner = slice(400, -400)
        assert len(got) == 8_000 and np.abs(got[inner] - want[inner]).max() < 1e-4, tone
    if rate > 16_000:  # what the new rate can't hold is gone
        high = resampled(np.sin(2 * np.pi * 9_500 * np.arange(int(rate * seconds)) / rate), rate)
        assert np.abs(high[400:-400]).max() < 1e-3
    assert len(resampled(np.zeros(0), rate)) == 0 and len(resampled(np.ones(3), rate)) >= 1


def test_yaml_settings(tmp_path):
    from formulary.config import read_tree, setting

    (tmp_path / "a.yaml").write_text("real:\n  min_confidence: 0.8\n  voices: [a, b]\nseed: 3\n")
    (tmp_path / "b.yaml").write_text("- 1\n")
    (tmp_path / "c.yaml").write_text("# nothing\n")
    tree = read_tree(tmp_path / "a.yaml")
    assert setting(tree, "real.min_confidence") == 0.8 and setting(tree, "real.voices") == ["a", "b"] and setting(tree, "seed.more", 5) == 5
    assert read_tree(tmp_path / "c.yaml") == read_tree(tmp_path / "none.yaml") == {}
    with pytest.raises(ValueError):
        read_tree(tmp_path / "b.yaml")


def test_models_see_batches_and_rows_keep_their_ids(spark):
    from formulary.operators.models import predicted

    rows = [(2**60 + k if k % 5 else None, None if k % 7 == 0 else f"{'x' * (k % 13)}{k}", {"a": k}) for k in range(60)] + [(1, "bad", None), (2, "bad", None), (3, "worse", None)]
    frame = spark.createDataFrame(rows, "id long, said string, more struct<a: int>").repartition(2)

    def load():
        def model(items):
            assert len(items) <= 8 and None not in items
            if "bad" in items:
                raise RuntimeError("can't")
            return [None if x == "worse" else f"{x}!" for x in items]

        return model

    for size in (None, len):
        out = predicted(frame, load, "said", into="heard", batch=8, size=size)
        assert out.columns == ["id", "said", "more", "heard"]
        got = sorted(((r["id"], r["said"], r["more"] and r["more"]["a"], r["heard"]["value"], r["heard"]["error"]) for r in out.collect()), key=repr)
        want = [(i, s, m and m["a"], None if s in (None, "bad", "worse") else f"{s}!", "RuntimeError: can't" if s == "bad" else None) for i, s, m in rows]
        assert got == sorted(want, key=repr)
    numbers = predicted(frame, lambda: lambda items: [len(x) for x in items], "said", "int", "said", 5)
    assert numbers.schema["said"].dataType["value"].dataType.simpleString() == "int" and predicted(frame.limit(0), load, "said").count() == 0


def test_templates_and_notations_of_a_user(spark):
    from formulary.sources.formulas import Pool
    from formulary.sources.grammar import Grammar, checked_views

    own = Grammar().with_notation(r"choose / 4 / \binom{%1}{%2} / %1 choose %2; %1 over %2 chosen / 4 4").with_template("games", 2, "hands", "eq(choose(n|m, k|2), number)", weight=50.0)
    own = own.with_template("cs", 3, "subsets", "O(choose(n, k))", held_out=True)
    rows = own.expressions(spark, 400, seed=5).collect()
    games = [r for r in rows if r["domain"] == "games"]
    assert len(games) > 250 and all(r["latex"].startswith(r"\binom{") and "cho" in r["spoken_text"] for r in games) and not any(r["heldout"] for r in rows)
    assert [tuple(r) for r in rows[:20]] == [own.record(5, k) for k in range(20)]
    held = own.expressions(spark, 200, 1, Pool(held_out=True, domains=("cs",))).collect()
    assert {r["template"] for r in held} == {"cs.subsets"} and own.expressions(spark, 9, 1, Pool(domains=("no",))).count() == 0
    assert not Grammar().notations and own.weights == {"games": 50.0}
    for line in ("eq / 0 / %1 %2 / %1 is %2", "two / 4 / %1 / %1 %2", "three / 9 / %1 / %1", "four / 4 / x / y", "five", "var / 4 / %1 / %1"):
        with pytest.raises(ValueError):
            Grammar().with_notation(line)
    odd = Grammar().with_notation(r"open / 4 / {%1 / open %1").with_notation(r"raw / 4 / \mycommand %1 / raw %1").with_notation(r"mute / 4 / %1 / \%1")
    for text in ("open(x)", "raw(x)", "mute(x)", "missing(x)", "eq(x)"):
        with pytest.raises(ValueError):
            odd.with_template("cs", 1, "odd", text)
    for bad in ({"domain": "cs", "difficulty": 9, "name": "n", "text": "x"}, {"domain": "cs", "difficulty": 1, "name": "growth", "text": "x"}, {"domain": "new", "difficulty": 1, "name": "n", "text": "x", "weight": 0}):
        with pytest.raises(ValueError):
            Grammar().with_template(**bad)
    good = [("raw", "a", False), ("rules", "a", True)]
    assert checked_views(good, ["a"]) == good
    for views, systems in ((good, ["b"]), ([*good, ("raw", "a", True)], ["a"]), ([("x", "a", 1)], ["a"])):
        with pytest.raises(ValueError):
            checked_views(views, systems)
