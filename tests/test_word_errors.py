"""Queries over whole tables that SQL can't check."""

import random
import re
from collections import defaultdict

import pytest

from formulary.queries import QUERIES


def spoken(text):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", (text or "").lower())).split()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_errors_take_every_turn(spark, tmp_path):
    r = random.Random(5)
    turn = lambda n: " ".join(r.choice(["the", "to", "a"]) + str(r.randrange(300)) + r.choice(["", "", "."]) for _ in range(n))
    rows = [(k, 0, ["user", "assistant"][k % 2], turn(n)) for k, n in enumerate([3, 400, 20, 250, 8, 300])] + [(9, 0, "user", None), (10, 0, "assistant", "")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = defaultdict(list)
    for _, _, role, text in rows:
        hyp = re.sub(" t", " ", re.sub(r"(\w+) (\w+)\.", r"\2 \1", text or ""))
        ref = spoken(text) or ["x"]
        want[role].append(edits(spoken(hyp), ref) / len(ref))
    got = {x["role"]: x["wer_vs_spoken"] for x in QUERIES["word_error_by_role"](spark, str(tmp_path)).collect()}
    assert got == {k: pytest.approx(sum(v) / len(v)) for k, v in want.items()}
