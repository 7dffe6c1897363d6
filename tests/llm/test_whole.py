"""The pipeline's stages against brute force where estimates and keys by id would lose or drop rows."""

import random

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def pair(r, n, edits):
    """Two texts that differ in so many words, five shingles each."""
    a = [f"w{r.randrange(10**6)}" for _ in range(n)]
    b = list(a)
    for k in range(edits):
        b[7 + 7 * k] = f"x{r.randrange(10**6)}"
    return " ".join(a), " ".join(b)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("common", [False, True])
def test_near_duplicates_are_exact(spark, common):
    r = random.Random(1)
    head = " ".join(f"c{k}" for k in range(12)) + " " if common else ""
    rows, gone, low = [], set(), []
    for k in range(300):
        n = r.choice([60, 120, 240])
        a, b = pair(r, n, r.randint(max(1, n // 80), n // 22))
        s = similarity(head + a, head + b)
        low.append(s)
        rows += [(2 * k, head + a, "a"), (2 * k + 1, head + b, "b")]
        gone |= {2 * k + 1} if s >= 0.8 else set()
    assert sum(0.8 <= s < 0.88 for s in low) > 30 and sum(0.7 <= s < 0.8 for s in low) > 30
    chain = [f"k{k}" for k in range(100)]  # each is near the next; the far ends are not near
    for step in range(5):
        rows.append((5000 - step, " ".join(chain), "a"))
        chain[10 + 18 * step] = f"z{step}"
    gone |= {5000 - step for step in range(4)}
    kept = {x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()}
    assert {i for i, *_ in rows} - kept == gone


def test_a_crowd_in_many_blocks_is_compared_whole(spark, monkeypatch):
    from formulary.llm import shingle_join

    monkeypatch.setattr(shingle_join, "BLOCK_ROWS", 7)
    r = random.Random(9)
    base = [f"t{k}" for k in range(100)]

    def copy(edits):
        words = list(base)
        for k in r.sample(range(100), edits):
            words[k] = f"e{r.randrange(10**6)}"
        return " ".join(words)

    texts = [copy(r.choice([1, 2, 3, 4, 6, 12])) for _ in range(70)] + [" ".join(base)]
    near = copy(9).split()
    texts += [" ".join([*near[:-1], f"z{k}"]) for k in range(5)]  # near each other, not the rest
    rows = [(k + 1, t, "a") for k, t in enumerate(texts)]
    up = {i: i for i, *_ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a, _ in rows:
        for j, b, _ in rows:
            if i < j and similarity(a, b) >= 0.8:
                x, y = sorted((root(i), root(j)))
                up[y] = x
    want = {i for i in up if root(i) == i}
    assert 5 < len(want) < 60
    assert {x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()} == want


def test_rows_without_an_id_and_rows_that_share_one_stay_in_the_pipeline(spark):
    r = random.Random(2)
    make = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passage, copy = make(60), make(80)
    rows = [(k, make(r.randint(30, 200)), "ab"[k % 2]) for k in range(30)]
    rows += [(None, make(100), "a") for _ in range(15)]
    rows += [(7, make(90), "a"), (7, make(70), "b")]  # one id, other texts
    rows += [(40, copy, "a"), (None, copy, "a"), (None, copy, "a")]  # rows without an id are copies like any other
    rows += [(41, f"{make(50)} {passage}", "b"), (None, f"{make(60)} {passage}", "b"), (7, f"{passage} {make(75)}", "a")]
    docs = frame(spark, rows).cache()
    near = corpus_pipeline.near_duplicates(spark, docs, "").cache()
    assert sorted(x["text"] for x in near.collect()) == sorted({t for _, t, _ in rows})
    assert [x["doc_id"] for x in near.collect() if x["text"] == copy] == [40]
    left = corpus_pipeline.repeated_passages(spark, near, "").cache()
    want = {t if passage not in t or i == 41 else t.replace(passage, "").strip() for i, t, _ in rows}
    assert {" ".join(x["text"].split()) for x in left.collect()} == want
    out = corpus_pipeline.source_mix(spark, left, "").collect()
    size = sum(len(x["text"].split()) for x in left.collect())
    assert abs(sum(len(x["text"].split()) for x in out) - 1.5 * size) <= 0.1 * size
    seen = {x["doc_id"] for x in out}
    taken = {w for x in out for w in x["text"].split()}
    share = lambda some: sum(w in taken for t in some for w in t.split()) / sum(len(t.split()) for t in some)
    assert None in seen and share([x["text"] for x in left.collect() if x["doc_id"] is None]) > 0.5
    assert share([x["text"] for x in left.collect() if x["doc_id"] == 7]) > 0.5
