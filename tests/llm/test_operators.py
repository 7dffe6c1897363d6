"""Every operator against brute force on a small table with nulls, empty and long texts, copies, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from formulary.llm import embedding_dedup, language_id, lattice_lm, mixing, packing, quality_pu, quality_rules, simhash_dedup, substring_dedup, toxicity_kn

BPE, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
#: Columns of the caller's that carry names which operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, bucket int, key long, fp binary, size long, word string, n long"


def words(text):
    return (text or "").encode().split()


def corpus():
    r = random.Random(4)
    vocabulary = ["".join(r.choice(["th", "er", "on", "an", "é", "ß", "st"]) for _ in range(r.randint(1, 3))) for _ in range(300)]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = make(70)
    texts = [make(r.randint(1, 160)) for _ in range(40)]
    texts += [texts[0], texts[1], texts[1] + " tail", texts[2].upper(), f"{make(30)}\n{passage} {make(10)}", f"{passage}\n{make(40)}", f"{make(5)} {passage}"]
    texts += ["", None, " \t\n", "a", "the " * 300, make(4000), "a b\n" * 60, "tab\tand  double  spaces\x0band\x0cfeeds", "!!! ### 123", "日本語 текст", make(120), "x" * 5000]
    rows = [(k, t, ["en", "fr", None][k % 3], ["b", "a", None, "c"][k % 4]) for k, t in enumerate(texts)]
    return rows + [rows[3], (None, make(60), None, None), (None, None, None, "a")]


@pytest.fixture(scope="module")
def docs(spark):
    full = [(i, t, lang, s, None if t is None else len(t), "x", 1, 2, b"y", 3, "z", 4) for i, t, lang, s in corpus()]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_text(frame):
    """(doc_id, text) of each row of the table."""
    return Counter((r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect())


def test_lattice_is_a_probability_and_base_is_exact(spark, docs, none):
    out = lattice_lm.held_out_scores(docs, PIECES).collect()
    assert lattice_lm.held_out_scores(none, PIECES).count() == 0
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    seen = Counter()
    for i, t, *_ in corpus():
        if not fold(i):
            seen.update([w.lower() for w in words(t)] + [b""])
    n, v = sum(seen.values()), len(seen)
    want = []
    for i, t, *_ in corpus():
        mine = [w.lower() for w in words(t)] + [b""]
        want.append((-1 if i is None else i, fold(i), len(mine), sum(seen[w] > 0 for w in mine), n, round(sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in mine), 6)))
    got = [(-1 if r[0] is None else r[0], r[1], r[2], r[3], r[4], round(r[5], 6)) for r in out]
    assert sorted(got) == sorted(want)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)


def test_lattice_sums_all_segmentations():
    pieces = [b" a", b" ab", b"b", b"bc", b"c", b" "]
    logp = np.log(np.random.default_rng(1).dirichlet(np.ones(len(pieces) + 256)))
    lattice = lattice_lm.Lattice(pieces, logp)

    def total(rest):
        if not rest:
            return 1.0
        own = sum(math.exp(logp[k]) * total(rest[len(p) :]) for k, p in enumerate(pieces) if rest.startswith(p))
        return own + math.exp(logp[len(pieces) + rest[0]]) * total(rest[1:])

    for w in (b"abc", b"b", b"aabbcc", "é".encode()):
        assert lattice.log_likelihoods([w])[0] == pytest.approx(math.log(total(b" " + w)))
    expected = lattice.expected([b"abc", b"ab"], np.array([1.0, 2.0]))
    assert expected @ np.array([len(p) for p in pieces] + [1] * 256) == pytest.approx(4 + 2 * 3)


def test_toxicity_separates_and_takes_any_row(spark, docs, none):
    r = random.Random(2)
    plain = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = [r.choice(plain) for _ in range(60)]
        if toxic:
            text[5:8] = ["vile", "vile", "awful"]
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "w1"), (3, rows[3][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, None, None), (5, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity_kn.held_out_scores(frame, marks).collect()
    assert len(out) == len(rows)
    held = [x for x in out if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 1000]
    assert sum((x["predicted"] == 1) == (x["doc_id"] % 4 == 0) for x in held) >= 0.95 * len(held)
    assert all(0 <= x["score"] <= 1 for x in out)
    assert toxicity_kn.held_out_scores(none, marks.where("false")).count() == 0


def naive_facts(text):
    text = text or ""
    w, lines = text.encode().split(), [x for x in text.split("\n") if x.encode().split()]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = Counter(windows)
    covered = {p for i, x in enumerate(windows) if count[x] > 1 for p in range(i, i + 8)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules_measure_and_reject(docs, none):
    book = quality_rules.judged(quality_rules.ledger(docs))
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in book.collect())
    want = Counter()
    for i, t, *_ in corpus():
        f = naive_facts(t)
        want[(i, *f, f[0] < 20 or 100 * f[4] > 30 * f[0])] += 1
    assert got == want
    assert quality_rules.ledger(none).count() == 0
    kept = quality_rules.kept(docs)
    assert kept.columns == docs.columns and kept.count() == book.where("kept").count()
    each = {r["rule"]: r for r in quality_rules.ablations(book).collect()}
    bits = [r["fail_bits"] for r in book.collect()]
    for name, bit in quality_rules.BIT.items():
        assert each[name]["n_failed"] == sum(b & bit > 0 for b in bits)
        assert each[name]["n_kept_without"] == sum(b & ~bit == 0 for b in bits)


def test_pu_classifier(spark, none):
    r = random.Random(3)
    good = lambda: " ".join(r.choice(["plain", "words", "of", "prose", "here"]) for _ in range(50))
    bad = lambda: " ".join(r.choice(["AB!!", "C##", "x|y"]) for _ in range(50))
    rows = [(i, good() if i % 5 else bad()) for i in range(500)] + [(900, None), (901, ""), (None, good()), (7, "again")]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(500)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    out = quality_pu.held_out_scores(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert len(out) == len(rows) and all(0 <= x["score"] <= 1 for x in out)
    held = [x for x in out if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 500]
    assert sum((x["predicted"] == 1) == (x["doc_id"] % 5 > 0) for x in held) >= 0.95 * len(held)
    assert quality_pu.held_out_scores(none, labels.where("false")).count() == 0


def test_mix_meets_targets(docs, none):
    out = mixing.Mix(docs, block=8).taken().collect()
    sizes = Counter()
    for _, t, _, s in corpus():
        sizes[s] += len(words(t))
    targets = mixing.targets(dict(sizes))
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, len(words(t))) for i, t, *_ in corpus())
    assert all(r["taken"] <= 2 * r["size"] for r in out)
    got = Counter()
    source = {}
    for i, t, _, s in corpus():
        source[(i, len(words(t)))] = s
    for r in out:
        got[source[(r["doc_id"], r["size"])]] += r["taken"]
        assert r["target"] == pytest.approx(targets[source[(r["doc_id"], r["size"])]])
    assert all(abs(got[s] - targets[s]) <= max(24, 0.02 * targets[s]) for s in sizes)
    again = mixing.Mix(docs, block=8).taken().collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.Mix(none).taken().count() == 0


def test_targets_share_the_excess():
    assert mixing.targets({"a": 100, "b": 100, None: 1}) == {"a": 200.0, "b": pytest.approx(99.5), None: 2.0}
    assert sorted(mixing.permuted(np.arange(97), np.full(97, 97), np.full(97, 5, np.uint64)).tolist()) == list(range(97))
    counts = mixing.shard_counts(np.array([50, 7, 0, 143]), 64)
    assert counts.sum(0).tolist() == [50, 7, 0, 143] and counts.sum(1).tolist() == [64, 64, 64, 8]


def test_mixed_rows_hold_what_is_taken(docs):
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = mixing.mixed_rows(unique, block=8)
    assert rows.columns == docs.columns
    got = Counter()
    for r in rows.select("doc_id", "text").collect():
        got[r["doc_id"]] += len(words(r["text"]))
    assert got == Counter({r["doc_id"]: r["taken"] for r in mixing.Mix(unique, block=8).taken().collect() if r["taken"]})


def test_repeats_are_removed_exactly(docs, none):
    table = [(math.inf if i is None else i, words(t)) for i, t, *_ in corpus()]
    first = {}
    for i, w in table:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, math.inf), i)
    want = Counter()
    for i, w in table:
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        want[(None if i == math.inf else i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest())] += 1
    out = substring_dedup.repeats_removed(docs, with_text=True).collect()
    assert Counter(tuple(r[:4]) for r in out) == want
    assert all(hashlib.sha256(b" ".join(words(r["kept_text"]))).hexdigest() == r["kept_sha256"] for r in out)
    assert substring_dedup.repeats_removed(none).count() == 0
    assert substring_dedup.deduplicated(docs).count() == docs.count()


def naive_fingerprint(text):
    w = [x.lower() for x in words(text)]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_simhash_links_all_close_fingerprints(spark, docs, none):
    out = simhash_dedup.near_duplicates(docs).collect()
    prints = Counter((i, f"{naive_fingerprint(t):016x}") for i, t, *_ in corpus())
    assert Counter((r["doc_id"], r["fingerprint"]) for r in out) == prints
    nodes = [(i, int(f, 16)) for i, f in prints if i is not None]
    up = {i: i for i, _ in nodes}
    for _ in nodes:
        for i, a in nodes:
            for j, b in nodes:
                if (a ^ b).bit_count() <= 4:
                    up[i] = up[j] = min(up[i], up[j])
    assert all(r["component_id"] == (None if r["doc_id"] is None else up[r["doc_id"]]) for r in out)
    assert simhash_dedup.near_duplicates(none).count() == 0


def flipped(rng, a, flips):
    b = a.copy()
    for row in b:
        for bit in rng.permutation(64 * a.shape[1])[:flips]:
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    return b


def test_pigeonring_loses_no_pair_and_prunes():
    rng = np.random.default_rng(0)
    ring = simhash_dedup.CONTRACT
    assert ring.guaranteed == ring.limit == 4
    for flips in range(5):
        a = rng.integers(0, 1 << 63, (300, 1), dtype=np.uint64)
        b = flipped(rng, a, flips)
        own, probes = simhash_dedup._keys(a, ring)[0], simhash_dedup._keys(b, ring)[1]
        assert all(set(x) & set(y) for x, y in zip(own.tolist(), probes.tolist(), strict=True))
    for ring in (simhash_dedup.CONTRACT, simhash_dedup.SIMILAR, simhash_dedup.Ring(bits=128, limit=9, segments=7)):
        a = rng.integers(0, 1 << 63, (2000, ring.bits // 64), dtype=np.uint64)
        near = flipped(rng, a, ring.limit)
        assert simhash_dedup.chained(a, near, ring).all() and simhash_dedup.close(a, near, ring).all()
        far = rng.integers(0, 1 << 63, a.shape, dtype=np.uint64)
        assert simhash_dedup.chained(a, far, ring).mean() < 0.5
        each = [[sum((int(x) ^ int(y)) >> (s % 64) & 1 for s in range(lo, hi) for x, y in [(p[s // 64], q[s // 64])]) for lo, hi in ring.bounds] for p, q in zip(a[:200], far[:200], strict=True)]
        m = ring.segments
        naive = [any(all(sum(d[(s + j) % m] for j in range(n)) <= n * ring.limit // m for n in range(1, min(8, m) + 1)) for s in range(m)) for d in each]
        assert simhash_dedup.chained(a[:200], far[:200], ring).tolist() == naive


def test_deduplicated_keeps_one_of_each_group(docs):
    out = simhash_dedup.deduplicated(docs)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert out.columns == docs.columns
    assert {0, 1, 2} <= set(ids) and not {40, 41} & set(ids) and ids.count(3) == 1 and ids.count(None) == 2


def test_language_is_told_and_rejected(spark, none):
    r = random.Random(6)
    make = lambda stems: " ".join(r.choice(stems) + r.choice(stems) for _ in range(30))
    kinds = {"en": ["the", "ing", "er"], "de": ["ung", "ß", "sch"], "fr": ["eau", "é", "oi"]}
    rows = [(i, make(kinds[(lang := ["en", "de", "fr"][i % 3])]), lang) for i in range(300)]
    rows += [(500, None, "en"), (501, "", "en"), (502, "123 !!", None), (None, make(kinds["de"]), None)]
    out = language_id.held_out_predictions(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(out) == len(rows)
    told = {x["doc_id"]: x for x in out}
    assert all(told[i]["lang_pred"] == "und" and told[i]["rejected"] for i in (500, 501, 502)) and told[None]["lang_pred"] == "de"
    assert all(0 <= x["score"] <= 1 for x in out)
    held = [x for x in out if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 300]
    assert all(x["lang_pred"] == ["en", "de", "fr"][x["doc_id"] % 3] for x in held)
    assert language_id.held_out_predictions(none).count() == 0


def tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BPE)
    whole.encode_special_tokens = True
    return whole


def test_packing_round_trip(docs, none):
    out = packing.pack(docs, BPE, capacity=64, with_ids=True).collect()
    whole = tokenizer()
    want = Counter()
    for i, t, *_ in corpus():
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        want[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    pieces, sequences = {}, {}
    for r in out:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for rows in sequences.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == np.cumsum([0, *(r["length"] for r in rows[:-1])]).tolist()
        assert sum(r["length"] for r in rows) <= 64
    for (doc, n), rows in pieces.items():
        starts = Counter((r["start"]) for r in rows)
        times = starts[0]
        assert sum(r["length"] for r in rows) == n * times
        if times == 1:
            ids = b"".join(bytes(r["ids"]) for r in sorted(rows, key=lambda r: r["start"]))
            assert want[(doc, n, zlib.crc32(ids))] == 1
    assert packing.pack(none, BPE).count() == 0
    assert sum(r["length"] for r in out) >= 0.9 * 64 * len(sequences)


def test_encoder_agrees_with_the_tokenizer():
    e, whole = packing.Encoder(BPE), tokenizer()
    odd = ["", " ", "a  b", "a\nb", "a \nb", "\n", "x\ty", "a b\n", "it's I'm 'll\n'll", "a <|endoftext|> b", "  lead", "a\n\nb", "é\n é", "a\x1cb c\x85d", " x", "1\n2 3"]
    odd += [t for _, t, *_ in corpus() if t]
    for t in odd:
        assert e.ids(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((300, 16))
    near = np.repeat(base[:20], 15, 0) + 0.05 * rng.standard_normal((300, 16))
    vectors = np.concatenate((base, near, base[:30])).astype(np.float32)
    rows = [(k, v.tolist(), "x") for k, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, None, "x"), (n + 1, [0.0] * 16, "x"), (n + 2, [float("nan")] * 16, "x"), (n + 3, [1.0, None] * 8, "x"), (n + 4, [1.0, 2.0], "x"), (None, base[0].tolist(), "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep string")
    out = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(frame, shard_rows=100).collect()}
    assert len(out) == len(rows)
    v = vectors.astype(np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    close = v @ v.T >= 0.9
    low = np.arange(n)
    for _ in range(20):
        low = np.array([low[c].min() for c in close])
    assert [out[k]["n_links"] for k in range(n)] == (close.sum(1) - 1).tolist()
    assert [out[k]["component_id"] for k in range(n)] == low.tolist()
    assert all(out[k]["n_links"] == 0 and out[k]["component_id"] == k and out[k]["kept"] for k in range(n, n + 5))
    assert out[None]["n_links"] == 0 and not out[None]["kept"]
    assert embedding_dedup.near_duplicates(frame.where("false")).count() == 0


def test_components_of_long_chains_and_stars(spark):
    from formulary.llm.components import components

    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (300, 300), (None, 3)]
    out = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert out == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)} | {300: 300}


def test_pipeline_stages(spark, docs, none):
    import corpus_pipeline

    rows, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, rows, "").cache()
        assert after.columns == docs.columns
        seen[name] = after
        rows = after
    kept = {i for i, t, *_ in corpus() if (f := naive_facts(t))[0] >= 20 and 100 * f[4] <= 30 * f[0]}
    assert {r["doc_id"] for r in seen["quality_rules"].collect()} <= kept
    assert not {40, 41} & {r["doc_id"] for r in seen["near_duplicates"].collect()}
    long = [t for t in (r["text"] for r in seen["repeated_passages"].collect())]
    windows = Counter(w for t in long for w in {tuple(words(t)[k : k + 50]) for k in range(len(words(t)) - 49)})
    assert max(windows.values(), default=1) == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, "")
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
    whole = tokenizer()
    want = sum(len(whole.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in rows.select("text").collect())
    assert packed.agg({"length": "sum"}).first()[0] == want
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(re.match(rf"op{n}_", x) for x in names) for n in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
