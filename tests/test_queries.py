"""The registered queries against their SQL in DuckDB, and what SQL can't express against plain Python."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from formulary.registered import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the generated tables are not here")


def rows(columns, table):
    plain = lambda v: None if v is None or v != v else round(v, 7) if isinstance(v, float) else v
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(r[k]) for k in order) for r in table)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_demo_pick_is_the_greedy_walk(spark):
    from formulary.operators.selection import demonstrable
    from formulary.queries import scored_demo

    table = demonstrable(scored_demo(spark, DATA)).collect()
    assert table and all(r["ok_direct"] and 12 < len(r["truth"]) < 90 for r in table)
    table.sort(key=lambda r: (r["ok_rules"], r["split"] != "test_ood", -r["difficulty"], -len(r["truth"]), r["id"]))
    seen, domains, splits, want = set(), Counter(), Counter(), []
    for r in table:
        key = r["truth"].replace(" ", "")
        if len(want) < 24 and key not in seen and domains[r["domain"]] < 3 and splits[r["split"]] < 10:
            seen.add(key)
            domains[r["domain"]] += 1
            splits[r["split"]] += 1
            want.append(r["truth"])
    got = [r["truth"] for r in QUERIES["demo_pick"](spark, DATA).orderBy("pick").collect()]
    assert got == want


def test_tokens_and_scores(spark):
    from formulary.functions.spoken import math_score, tokenize
    from pyspark.sql import functions as F

    cases = {
        "x^2 + y = 3/4, so": ("x squared plus y equals 3 over 4 so", 6.0),
        "p-norm of v is -3.5.": ("p norm of v is minus 3.5", 3.5),
        "the pie is here": ("the pie is here", 0.0),
        "pie times 2": ("pie times 2", 3.5),
        "for all x in R n": ("for all x in R n", 3.5),
        "": ("", 0.0),
    }
    frame = spark.createDataFrame([(k,) for k in cases], "said string").withColumn("t", tokenize("said"))
    for r in frame.select("said", F.array_join("t", " ").alias("t"), math_score(F.col("t")).alias("s")).collect():
        assert (r["t"], r["s"]) == cases[r["said"]]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 8
    assert math.isfinite(__spark_entry__.entry(spark).first()["exact_match"])


def test_streams_give_the_batch_result(spark, tmp_path):
    from formulary.operators.scoring import scored
    from formulary.streaming.transcripts import _folders, fill, filled, scored_stream

    rows = [(1, 1, "x^2", "x^{2}"), (2, 1, "a", "b"), (1, 2, "y", "x^2")]
    frame = spark.createDataFrame(rows, "id long, seq long, hyp string, target_text string")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    q = scored_stream(stream).writeStream.format("memory").queryName("scored_rows").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("scored_rows").collect())) == sorted(map(str, scored(frame).collect()))
    out, want = str(tmp_path / "out"), {}
    for batch in range(4):
        if batch:
            rows = [(batch % 2 + 1, 10 + batch, f"h{batch}", "t"), (100 + batch, 1, "n", "t"), (1, 0, "late", "t")]
            spark.createDataFrame(rows, frame.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = fill(stream, out, str(tmp_path / "c2"), parts=3).start()
        q.processAllAvailable()
        q.stop()
        for i, seq, hyp, _ in sorted(rows, key=lambda r: r[1]):
            want[i] = hyp  # a later batch counts more than a larger order
        assert {r["id"]: r["hyp"] for r in filled(spark, out, frame.schema).collect()} == want
    assert all(len(made) <= 2 for made in _folders(spark, out).values()) and not list((tmp_path / "out").glob("_batch*"))
