"""What every operator owes to odd rows: exact ids beside nulls, clashing names, no tables left behind."""

import math
import os

import corpus_pipeline
import public_tokenizers
import pytest

from formulary.llm import embedding_dedup, language_id, lattice_lm, mixing, packing, quality_pu, quality_rules, simhash_dedup, substring_dedup, toxicity_kn
from formulary.llm.common import keyed, scratch, settled, shared_dir, stored

BPE, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
IDS = [2**60 + 1, 2**60 + 2, -(2**59) - 1, None, 7]
TEXT = " ".join(f"word{k}" for k in range(60))


@pytest.fixture(scope="module")
def few(spark):
    rows = [(i, f"{TEXT} number {n} " + " ".join(f"u{n}x{k}" for k in range(200)), "en" if n % 2 else "fr", "a", 1) for n, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).cache()


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(i, n % 2, n % 2) for n, i in enumerate(IDS) if i is not None], "doc_id long, quality int, toxic int")


def key(ids):
    return sorted(ids, key=lambda i: (i is None, i or 0))


def test_ids_beside_a_null_stay_exact(few, marks):
    made = {
        1: lattice_lm.held_out_scores(few, PIECES),
        2: toxicity_kn.held_out_scores(few, marks),
        3: quality_rules.ledger(few),
        4: quality_pu.held_out_scores(few, marks),
        5: mixing.Mix(few).taken(),
        6: substring_dedup.repeats_removed(few),
        7: simhash_dedup.near_duplicates(few),
        8: language_id.held_out_predictions(few),
        9: packing.pack(few, BPE, capacity=4096),
        10: packing.pack(few, BPE, capacity=64).dropDuplicates(["doc_id"]),
    }
    for n, out in made.items():
        assert key(r["doc_id"] for r in out.select("doc_id").collect()) == key(IDS), n


def test_stages_keep_rows_and_ids_whatever_the_columns_are_called(spark, few):
    extra = ["_row", "__row", "_at", "_kept", "_from", "_copy", "_key", "_to", "_size", "doc", "copy", "from_word", "row", "hash", "first", "size", "_facts", "shingle", "left", "tie", "source_no", "name"]
    docs = few.select("*", *(few["lang"].alias(c) for c in extra))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "").cache()
        assert out.columns == docs.columns, name
        assert {r["doc_id"] for r in out.collect()} <= set(IDS), name
        assert all(r[c] == r["lang"] for r in out.collect() for c in extra), name
        if name != "source_mix":
            assert key(r["doc_id"] for r in out.collect()) == key(IDS), name
    assert key({r["doc_id"] for r in corpus_pipeline.packed(spark, docs, "").collect()}) == key(IDS)


def tables(spark):
    return {x for x in os.listdir(shared_dir(spark).removeprefix("file:")) if x.startswith("formulary-")}


def test_intermediate_tables_are_deleted(spark, tmp_path, few):
    before = tables(spark)
    out = settled(spark, lambda: stored(spark.range(3), "inner"), "outer")
    assert out.count() == 3 and len(tables(spark) - before) == 1
    with pytest.raises(ValueError), scratch(spark):
        stored(spark.range(3), "lost")
        raise ValueError
    assert len(tables(spark) - before) == 1
    few.write.parquet(f"{tmp_path}/documents.parquet")
    before = tables(spark)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= len(IDS)
    assert len(tables(spark) - before) == 2  # the last stage's input, and its first step


@pytest.mark.parametrize("ids", [[2**63 - 3, 5, None, None, 5], [-(2**63), 2**63 - 1, None, 0, 0], [-(2**63) + 1, None], [None, None]])
def test_keys_have_room_beside_any_ids(spark, ids):
    docs = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["key"]) for r in keyed(docs, "key").collect()]
    assert key([i for i, _ in got]) == key(ids) and len({k for _, k in got}) == len(ids)
    own = {i for i in ids if i is not None}
    assert {i for i, k in got if i == k} >= own


def test_vectors_that_share_an_id_have_their_own_links(spark):
    near = lambda angle: [math.cos(angle), math.sin(angle)]
    vectors = [(5, near(0.0)), (5, near(1.5)), (1, near(0.1)), (2, near(0.2)), (3, near(1.6)), (5, near(1.5)), (9, near(3.0))]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(frame).collect())
    want = [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 3, True), (5, 2, 1, False), (5, 2, 3, False), (5, 2, 3, False), (9, 0, 9, True)]
    assert got == want


def test_a_hot_id_with_a_label_of_many_languages_teaches_within_the_bounds(spark):
    rows = [(7, f"the same id again {k} times", "en") for k in range(400)] + [(7, "le même texte", "fr")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.sample(docs, per_language=50, in_all=60)
    assert 0 < (got["lang"] == "en").sum() < 120 and (got["lang"] == "fr").sum() <= 1
