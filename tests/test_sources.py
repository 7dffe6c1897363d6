"""Drawn formulas: valid, diverse, reproducible, and readable back from what is said."""

from pyspark.sql import functions as F

from formulary.functions.latex import norm_latex, valid_latex
from formulary.functions.render import latex_to_text, remaining_commands
from formulary.operators.normalize import canonicalized
from formulary.sources.formulas import MOST_TEX, MOST_WORDS, TEMPLATES, Pool, composed, expressions
from formulary.sources.jsonl import read_splits, write_lines


def test_formulas_are_valid_and_diverse(spark):
    rows = expressions(spark, 800, seed=3).cache()
    assert rows.select("domain").distinct().count() >= 8
    assert rows.where(~valid_latex("latex") | (F.col("spoken_text") == "")).count() == 0
    assert rows.where("heldout").count() == 0
    assert rows.groupBy(F.replace("latex", F.lit(" "), F.lit(""))).count().where("count > 40").count() == 0
    again = expressions(spark.newSession(), 800, seed=3)
    assert sorted(map(str, rows.collect())) == sorted(map(str, again.collect()))


def test_as_many_formulas_as_asked_for(spark):
    assert expressions(spark, 1500, seed=2, pool=Pool(domains=("cs", "algebra"))).count() == 1500
    assert expressions(spark, 0).count() == 0 and expressions(spark, 5, pool=Pool(domains=("none",))).count() == 0
    few = expressions(spark, 2000, seed=3, pool=Pool(held_out=True, domains=("ml", "algebra")))  # two formulas, 40 times each
    assert few.count() == 80


def test_templates_by_domain():
    count = {d: sum(t[0] == d for t in TEMPLATES) for d in {t[0] for t in TEMPLATES}}
    assert count == {"algebra": 10, "calculus": 12, "linear_algebra": 7, "probability": 7, "set_theory": 5, "analysis": 6, "ml": 8, "physics": 6, "chemistry": 3, "cs": 4}


def test_trees_are_valid_short_and_rarely_repeated(spark):
    rows = composed(spark, 600, seed=4).cache()
    assert rows.count() == 600 and rows.select("domain").distinct().count() == 10
    assert rows.where(~valid_latex("latex") | (F.col("spoken_text") == "") | (F.length("latex") > MOST_TEX) | (F.size(F.split("spoken_text", " ")) > MOST_WORDS)).count() == 0
    assert rows.groupBy(F.replace("latex", F.lit(" "), F.lit(""))).count().where("count > 3").count() == 0
    assert rows.where("difficulty < 2 or difficulty > 5").count() == 0
    assert sum(bool(remaining_commands(latex_to_text(r["latex"]))) for r in rows.collect()) == 0
    assert sorted(map(str, rows.collect())) == sorted(map(str, composed(spark.newSession(), 600, seed=4).collect()))


def test_held_out_templates_are_a_pool_of_their_own(spark):
    rows = expressions(spark, 300, seed=1, pool=Pool(held_out=True))
    assert rows.where("not heldout").count() == 0 and rows.select("template").distinct().count() == sum(t[2] for t in TEMPLATES) == 9


def test_most_formulas_survive_being_said(spark):
    rows = canonicalized(expressions(spark, 400, seed=9), "spoken_text")
    share = rows.select(F.avg((norm_latex("latex") == norm_latex("result.latex")).cast("double"))).first()[0]
    assert share > 0.78


def test_rendering_leaves_few_commands(spark):
    texts = [r["latex"] for r in expressions(spark, 600, seed=4, pool=Pool(held_out=None)).collect()]
    assert sum(bool(remaining_commands(latex_to_text(t))) for t in texts) < 0.02 * len(texts)


def test_splits_come_from_file_names(spark, tmp_path):
    for name, n in (("base_train.jsonl", 3), ("base_test.jsonl", 2), ("base_test.tts.jsonl", 5)):
        (tmp_path / name).write_text("".join(f'{{"id": {k}}}\n' for k in range(n)))
    rows = read_splits(spark, str(tmp_path / "*.jsonl"), "id long", prefix="base_")
    assert {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()} == {"train": 3, "test": 2}
    write_lines(rows, str(tmp_path / "out"))
    write_lines(rows.limit(0), str(tmp_path / "out"), once=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 5


def test_splits_are_folders_and_are_kept_once(spark, tmp_path):
    from formulary.sources.jsonl import read_document, write_splits

    rows = spark.createDataFrame([(1, "train"), (2, "test"), (3, None)], "id int, split string")
    write_splits(rows, str(tmp_path / "t"))
    write_splits(rows.limit(1), str(tmp_path / "t"), once=True)
    got = spark.read.parquet(str(tmp_path / "t"))
    assert sorted((r["id"], r["split"] or "") for r in got.collect()) == [(1, "train"), (2, "test"), (3, "")]
    assert "split" not in spark.read.parquet(str(tmp_path / "t/split=train")).columns
    (tmp_path / "d.json").write_text('{\n "a": [1, 2],\n "b": {"c": null}\n}')
    assert read_document(spark, str(tmp_path / "d.json"), "a array<int>, b struct<c:int>").collect()[0]["a"] == [1, 2]


def test_references_are_cleaned(spark):
    from formulary.functions.latex import cleaned_reference

    cases = {"\t$x^{\\prime} \\operatorname{=} {}1$\n": "x^{'} = 1", "\\displaystyle \\left( y \\right)": " ( y )", None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "s string")
    assert [r[0] for r in rows.select(cleaned_reference("s")).collect()] == list(cases.values())


def test_reports(spark):
    import json

    from formulary.sources.report import document, markdown, page

    rows = spark.createDataFrame([("a|b", 0.5, None), ("<c>", 1.0, 2)], "name string, share double, n int")
    assert json.loads(document(rows, "name")) == {"a|b": {"share": 0.5, "n": None}, "<c>": {"share": 1.0, "n": 2}}
    assert markdown(rows).splitlines()[2] == "| a\\|b | 0.500 |  |"
    assert "&lt;c&gt;" in page(rows, "x") and page(rows, "x").count("<tr>") == 3


def test_unseen_pools_and_catalogues(spark, tmp_path):
    import json

    from formulary.operators.selection import is_usable, ranked
    from formulary.sources.jsonl import read_candidates, read_first, read_unseen

    (tmp_path / "odd.jsonl").write_text("".join(json.dumps({"domain": "ml", "latex": f"x_{k}", "spoken_text": f"x sub {k}", "more": 1}) + "\n" for k in range(5)))
    rows = read_unseen(spark, str(tmp_path / "odd.jsonl")).orderBy("ord").collect()
    assert [(r["ord"], r["latex"], r["difficulty"], r["heldout"]) for r in rows] == [(k, f"x_{k}", 4, True) for k in range(5)]
    some = [{"id": "a", "license": "mit", "downloads": 3, "gated": False, "is_audio": True, "permissive": True}, {"id": "b", "downloads": 9, "gated": None, "is_audio": True, "permissive": True}]
    (tmp_path / "all.json").write_text(json.dumps({"n": 2, "candidates": some}, indent=1))
    table = read_candidates(spark, str(tmp_path / "all.json"))
    assert [r["id"] for r in ranked(table).collect()] == ["b", "a"] and [r["id"] for r in table.where(is_usable()).collect()] == ["a"]
    table.write.parquet(str(tmp_path / "p"))
    assert read_first(spark, str(tmp_path / "p"), ["id"], 1).count() == 1 and read_first(spark, str(tmp_path / "p"), ["id"]).count() == 2


def test_audio_is_decoded_and_made_noisy(spark, tmp_path):
    import wave

    import numpy as np

    from formulary.sources.audio import augmented, read_audio

    tone = np.sin(np.arange(44100) * 2 * np.pi * 440 / 44100)
    for name, width in (("a", 2), ("b", 1), ("c", 3)):
        scaled = ((tone + 1) * 127).astype(np.uint8) if width == 1 else (tone * (2 ** (8 * width - 1) - 1)).astype("<i4")
        raw = scaled.tobytes() if width == 1 else scaled.view(np.uint8).reshape(-1, 4)[:, :width]
        both = np.repeat(np.frombuffer(bytes(raw) if width == 1 else raw.tobytes(), np.uint8).reshape(-1, width), 2, 0).tobytes()
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as f:
            f.setnchannels(2), f.setsampwidth(width), f.setframerate(44100), f.writeframes(both)
    (tmp_path / "d.wav").write_bytes(b"no audio")
    rows = {r["path"][-5]: r for r in read_audio(spark, str(tmp_path), 0.5).collect()}
    assert rows["d"]["samples"] is None and rows["d"]["duration"] is None
    want = np.sin(np.arange(8000) * 2 * np.pi * 440 / 16000)
    assert all(rows[k]["duration"] == 0.5 and np.abs(np.array(rows[k]["samples"]) - want).max() < 0.05 for k in "abc")
    noise = augmented(read_audio(spark, str(tmp_path), 0.5), "path", 1.0)
    got = {r["path"][-5]: r["samples"] for r in noise.collect()}
    assert got["d"] is None and got["a"] != rows["a"]["samples"] and max(map(abs, got["a"])) <= 1
    assert got == {r["path"][-5]: r["samples"] for r in noise.collect()}
    assert augmented(read_audio(spark, str(tmp_path), 0.5), "path", 0.0).orderBy("path").collect()[0]["samples"] == rows["a"]["samples"]


def test_settings(tmp_path):
    from formulary.config import apply_settings, read_settings, rooted

    (tmp_path / ".env").write_text("A=1 # one\n# B=2\n\nC = x=y\nnothing\n")
    assert read_settings(tmp_path / ".env") == {"A": "1", "C": "x=y"} and read_settings(tmp_path / "none") == {}
    there = {"A": "0"}
    apply_settings(tmp_path / ".env", there)
    assert there == {"A": "0", "C": "x=y"} and str(rooted("a/b", "/r")) == "/r/a/b" and str(rooted("/a", "/r")) == "/a"


def test_formulas_for_rows_are_plain_draws(spark):
    from collections import Counter

    from formulary.sources.formulas import Pool, composed_for, drawn_for, record, tree_record

    table = [(1, 5, "cs"), (2, 0, "ml"), (3, 40, "chemistry"), (4, None, "ml"), (None, 3, "ml"), (6, 4, None), (7, 3, "none")]
    rows = spark.createDataFrame(table, "seed long, n int, only string").repartition(3)

    def plain(n, one, tries, most, keep=lambda r: True):
        seen, out = Counter(), []
        for k in range(tries * n):
            r = one(k)
            seen[r[1].replace(" ", "")] += 1
            if len(out) < n and seen[r[1].replace(" ", "")] <= most and keep(r):
                out.append(r)
        return out

    want = [(s, n, d, *r) for s, n, d in table if s and n and d != "none" for r in plain(n, lambda k, s=s, d=d: record(s, k, Pool(False, (d,) if d else ())), 80, 2)]
    got = list(map(tuple, drawn_for(rows, "seed", "n", "only", most_repeats=2).collect()))
    assert sorted(got, key=str) == sorted(want, key=str) and sum(g[0] == 3 for g in got) <= 40
    short = lambda r: len(r[1]) <= MOST_TEX and len(r[2].split(" ")) <= MOST_WORDS
    deep = spark.createDataFrame([(1, 5, 1), (2, 6, 3), (3, 0, 2), (None, 2, 2), (5, 2, None)], "seed long, n int, depth int")
    want = [(s, n, d, *r) for s, n, d in map(tuple, deep.collect()) if s and n for r in plain(n, lambda k, s=s, d=d: tree_record(s, k, d or 1), 30, 1, short)]
    assert sorted(map(tuple, composed_for(deep, "seed", "n", "depth", 1).collect()), key=str) == sorted(want, key=str)
    assert drawn_for(rows.limit(0), "seed", "n").count() == 0


def test_careful_trees_are_read_back(spark):
    from formulary.sources.careful import careful

    rows = careful(spark, 1000, seed=1).cache()
    assert rows.count() == 1000 and rows.select("domain").distinct().count() == 10
    assert rows.where(~valid_latex("latex") | (F.length("latex") > MOST_TEX) | (F.size(F.split("spoken_text", " ")) > MOST_WORDS)).count() == 0
    back = canonicalized(rows, "spoken_text")
    share = back.select(F.avg((norm_latex("latex") == norm_latex("result.latex")).cast("double"))).first()[0]
    assert share > 0.98
    assert rows.where("spoken_text like '%times%'").count() > 5 and rows.where("spoken_text like '%open paren%'").count() > 100
