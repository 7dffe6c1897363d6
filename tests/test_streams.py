"""Streams that are stopped and started, batches that run again, tasks that are killed: the rows are those of one batch."""

import random
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from formulary.operators.datasets import candidates, capped
from formulary.sources import append_log, scan
from formulary.streaming.caps import PROVIDER, capped_stream

TEXTS = ["the derivative of a function", "x squared", "nothing to see", None, "a plain line", "sigma over two"]


@pytest.fixture()
def table(spark, tmp_path):
    r = random.Random(4)
    rows = [(k, r.choice(TEXTS)) for k in range(1_000)]
    for n, (low, high) in enumerate([(0, 300), (300, 300), (300, 650), (650, 1000)]):
        frame = spark.createDataFrame(rows[low:high], "id long, text string").coalesce(1)
        frame.write.mode("append").option("parquet.block.size", 1024).parquet(str(tmp_path / f"part{n}"))
        files = sorted((tmp_path / f"part{n}").glob("*.parquet"))
        (tmp_path / "table").mkdir(exist_ok=True)
        files[0].rename(tmp_path / "table" / f"{n}.parquet")
    return str(tmp_path / "table"), rows


def wanted(rows, scanned, most):
    core = lambda t: t is not None and t != "nothing to see" and t != "a plain line"
    return [(i, place) for place, (i, t) in enumerate(rows) if place < scanned and core(t)][:most]


@pytest.mark.parametrize(("most_scanned", "most", "batch"), [(800, 10_000, 130), (1_000_000, 77, 41), (250, 60, 1_000), (1_000_000, 10_000, 333)])
def test_a_scan_that_is_stopped_gives_what_one_run_gives(spark, table, tmp_path, most_scanned, most, batch):
    path, rows = table
    out = str(tmp_path / "out")
    seen, before = [], -1
    for _ in range(40):
        writer, schema = scan.scanning(spark, path, out, candidates, most_scanned, most, batch)
        query = writer.trigger(once=True).start()  # a batch at a time, then stopped
        query.awaitTermination(60)
        query.stop()
        done = len(append_log.commits(f"{out}/rows"))
        seen.append(append_log.rows_of(f"{out}/rows"))
        if done == before:
            break
        before = done
    got = sorted((r["id"], r["place"]) for r in scan.accepted(spark, out, schema, most).collect())
    assert got == wanted(rows, most_scanned, most)
    if most == 77:
        assert seen[-1] < 77 + 41  # it ended with the batch that reached the bound
    if batch < 300:
        assert len(seen) > 3


def test_a_scan_in_one_go(spark, table, tmp_path):
    path, rows = table
    writer, schema = scan.scanning(spark, path, str(tmp_path / "out"), candidates, 900, 5_000, 200)
    query = writer.start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["id"], r["place"]) for r in scan.accepted(spark, str(tmp_path / "out"), schema, 5_000).collect()) == wanted(rows, 900, 5_000)


def test_a_log_has_what_is_committed(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "id long, ord int, said string"
    spark.dataSource.register(append_log.AppendLog)
    assert append_log.read_log(spark, path, schema).count() == 0 and append_log.rows_of(path) == 0
    first = spark.createDataFrame([(1, 1, "a"), (2, 1, None), (None, 1, "n")], schema).repartition(3)
    first.write.format("append_log").mode("append").save(path)
    spark.createDataFrame([(1, 2, "b"), (3, 1, "c")], schema).write.format("append_log").mode("append").save(path)
    spark.createDataFrame([], schema).write.format("append_log").mode("append").save(path)
    with pytest.raises(Exception, match="stop here"):
        fails = F.udf(lambda i: (_ for _ in ()).throw(ValueError("stop here")) if i == 9 else "x")
        rows = spark.createDataFrame([(8, 1, "y"), (9, 1, "y")], schema).coalesce(1)
        rows.withColumn("said", fails("id")).write.format("append_log").mode("append").save(path)
    (tmp_path / "log" / "rows-left-by-a-killed-task.parquet").write_bytes(b"not even whole")
    want = [(1, 1, "a"), (1, 2, "b"), (2, 1, None), (3, 1, "c"), (None, 1, "n")]
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    assert key(append_log.read_log(spark, path, schema).collect()) == key(want) and append_log.rows_of(path) == 5
    append_log.compact(spark, path, schema, "id", "ord")
    assert key(append_log.read_log(spark, path, schema).collect()) == key([w for w in want if w != (1, 1, "a")])
    assert append_log.rows_of(path) == 4 and len(append_log.commits(path)) == 1
    assert not list(Path(path).glob("rows-*"))


def test_a_batch_that_runs_again_replaces_its_commit(tmp_path):
    import pyarrow as pa

    writer, path = append_log._StreamWriter(str(tmp_path / "log")), str(tmp_path / "log")
    batch = pa.RecordBatch.from_pydict({"id": [1, 2]})
    for number in (0, 1, 1):
        writer.commit([writer.write(iter([batch])), writer.write(iter([])), None], number)
    assert append_log.rows_of(path) == 4 and len(append_log.commits(path)) == 2
    writer.abort([writer.write(iter([batch]))], 2)
    append_log.sweep(path)
    assert len(list((tmp_path / "log").glob("rows-*"))) == 2


def test_killed_tasks_leave_no_row_twice(tmp_path):
    """In a session of its own, whose tasks are tried again: the first try of each dies in its midst, by an error or with its worker."""
    script = f"""
    import os, sys
    sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
    from pyspark import TaskContext
    from pyspark.sql import SparkSession
    from formulary.sources import append_log
    spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "10").getOrCreate()
    spark.dataSource.register(append_log.AppendLog)
    def dies(batches):
        task = TaskContext.get()
        for k, b in enumerate(batches):
            if k == 2 and task.attemptNumber() == 0:
                if task.partitionId() % 2:
                    os._exit(1)
                raise ValueError("first try")
            yield b
    rows = spark.range(0, 200, 1, 4).mapInArrow(dies, "id long")
    rows.write.format("append_log").mode("append").save({str(tmp_path / "log")!r})
    got = sorted(r.id for r in append_log.read_log(spark, {str(tmp_path / "log")!r}, "id long").collect())
    assert got == list(range(200)), len(got)
    print("ROWS", append_log.rows_of({str(tmp_path / "log")!r}))
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], capture_output=True, text=True, timeout=300)
    assert "ROWS 200" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize("cuts", [[100], [1, 7, 50], [33, 34, 60, 90]])
def test_caps_hold_over_batches(spark, tmp_path, cuts):
    r = random.Random(6)
    rows = [(k, r.choice(["a", "b", "c", None, "hot", "hot", "hot"]), r.random() < 0.2) for k in range(100)]
    schema = "ord long, key string, free boolean"
    spark.conf.set(*PROVIDER)
    try:
        for low, high in zip([0, *cuts], [*cuts, 100], strict=True):
            spark.createDataFrame(rows[low:high], schema).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            out = capped_stream(stream, ["key"], ["ord"], 4, F.col("free"))
            query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            query.awaitTermination(120)
    finally:
        spark.conf.unset(PROVIDER[0])
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    got = spark.read.schema(schema).parquet(str(tmp_path / "out"))
    assert key(got) == key(capped(spark.createDataFrame(rows, schema), ["key"], ["ord"], 4, F.col("free")))
