"""The models that are trained here, against brute force: their counts, losses, slopes and steps."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from formulary.llm import language_id, lattice_lm, quality_pu, toxicity_kn

PIECES = public_tokenizers.path("piece_bpe_32k.model")


# -- op1 ------------------------------------------------------------------------------------------


def test_whole_words_are_edges_of_the_lattice():
    pieces = [b" a", b" ab", b"b", b"c", b" "]
    logp = np.log(np.random.default_rng(2).dirichlet(np.ones(len(pieces) + 256)))
    lattice = lattice_lm.Lattice(pieces, logp)

    def spelled(rest):
        if not rest:
            return 1.0
        own = sum(math.exp(logp[k]) * spelled(rest[len(p) :]) for k, p in enumerate(pieces) if rest.startswith(p))
        return own + math.exp(logp[len(pieces) + rest[0]]) * spelled(rest[1:])

    words, whole = [b"abc", b"b", b"ab"], np.log(np.array([0.2, 1e-300, 0.01]))
    got = lattice.log_likelihoods(words, math.log(0.3), whole)
    for w, x, g in zip(words, whole, got, strict=True):
        assert g == pytest.approx(math.log(0.3 * spelled(b" " + w) + math.exp(x)))


def test_the_corpus_says_how_much_is_spelled(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice(["aa", "bb", "cc", f"w{r.randrange(400)}"]) for _ in range(30)) for _ in range(40)] + [None, ""]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    vocabulary = lattice_lm.vocabulary(PIECES)
    model = lattice_lm.Model(lattice_lm.counted(docs, "text", F.lit(True)), vocabulary)
    seen = Counter(w.encode() for t in texts for w in (t or "").split())
    once, twice = (sum(n == k for n in seen.values()) for k in (1, 2))
    tokens = sum(seen.values()) + len(texts)
    assert model.tokens == tokens and model.discount == pytest.approx(once / (once + 2 * twice))
    assert model.spelled == pytest.approx(model.discount * len(seen) / tokens)
    found = {bytes(x["word"]): 10 ** x["logp"] for x in model.lexicon.collect()}
    words = [w for w in found if w]
    plain = np.exp(model.lattice.log_likelihoods(words))
    for w, p in zip(words, plain, strict=True):
        assert found[w] == pytest.approx((seen[w] - model.discount) / tokens + model.spelled * p, rel=1e-9)
    assert found[b""] == pytest.approx(len(texts) / tokens)
    assert sum(found.values()) < 1  # what is left is for words that aren't here
    assert np.exp(model.lattice.logp).sum() == pytest.approx(1)


def test_every_type_is_counted_in_the_pieces(spark):
    words = [f"q{k}z" for k in range(300)]
    docs = spark.createDataFrame([(k, " ".join(words[k::3])) for k in range(3)], "doc_id long, text string").repartition(3)
    pieces = lattice_lm.vocabulary(PIECES)
    model = lattice_lm.Model(lattice_lm.counted(docs, "text", F.lit(True)), pieces, rounds=0)
    found = model._expected(model.lexicon.where("n > 0 and octet_length(word) > 0").select("word"))
    assert found == pytest.approx(model.lattice.expected([w.encode() for w in words], np.ones(len(words))))


def test_frequent_long_words_are_looked_up(spark):
    ruler = "=" * 500
    docs = spark.createDataFrame([(k, f"{ruler} a{k}") for k in range(50)], "doc_id long, text string")
    model = lattice_lm.Model(lattice_lm.counted(docs, "text", F.lit(True)), lattice_lm.vocabulary(PIECES))
    assert ruler.encode() in model.head() and set(model.head(most=10)) == {ruler.encode()} and model.head(most_bytes=400) == {}


# -- op2 ------------------------------------------------------------------------------------------


def naive_kn(texts, toxic, vocabulary, least_word, least_pair, shared):
    """(evidence of words, evidence of pairs) by dictionaries."""
    total, pairs = Counter(), Counter()
    own, mine = {True: Counter(), False: Counter()}, {True: Counter(), False: Counter()}
    before = defaultdict(set)
    for t, y in zip(texts, toxic, strict=True):
        for k, w in enumerate(t):
            if w in vocabulary:
                total[w] += 1
                own[y][w] += 1
                if k:
                    before[w].add(t[k - 1])
                if k and t[k - 1] in vocabulary:
                    pairs[t[k - 1], w] += 1
                    mine[y][t[k - 1], w] += 1
    often = [w for w in vocabulary if total[w] >= least_word]
    kept = [p for p, n in pairs.items() if n >= least_pair and p[1] in often]
    s = {w: len(before[w]) + 0.5 for w in often}
    size = sum(s.values())

    def discounts(counts):
        n = [max(1, sum(c == k for c in counts)) for k in (1, 2, 3, 4)]
        d = n[0] / (n[0] + 2 * n[1])
        return [0] + [min(max(k - (k + 1) * d * n[k] / n[k - 1], 0.1), k) for k in (1, 2, 3)]

    word, pair = Counter(), Counter()
    for y, sign in ((True, 1), (False, -1)):
        steps = discounts([own[y][w] for w in often])
        off = {w: steps[min(3, own[y][w])] for w in often}
        extra = shared * len(often)
        p = {w: (own[y][w] - off[w] + (sum(off.values()) + extra) * s[w] / size) / (sum(own[y][w] for w in often) + extra) for w in often}
        steps = discounts([mine[y][k] for k in kept])
        for w in often:
            word[w] += sign * math.log(p[w])
        for u, w in kept:
            left = 1 - sum(mine[y][k] - steps[min(3, mine[y][k])] for k in kept if k[0] == u) / max(1, own[y][u])
            pair[u, w] += sign * math.log(max(1e-12, (mine[y][u, w] - steps[min(3, mine[y][u, w])]) / max(1, own[y][u]) + left * p[w]))
    return word, pair


def test_kneser_ney_by_hand():
    r = random.Random(3)
    names = [f"w{k}" for k in range(25)]
    texts = [[r.choice(names[: 8 + 17 * (k % 2)] + ["rare" + str(r.randrange(50))]) for _ in range(r.randint(0, 40))] for k in range(60)]
    toxic = [k % 3 == 0 for k in range(60)]
    words = {w: k for k, w in enumerate(names)}
    code = np.array([words[w] if w in words else -1 - int(w[4:]) for t in texts for w in t])
    text = np.repeat(np.arange(60), [len(t) for t in texts])
    word, keys, pair = toxicity_kn.learned(code, text[1:] == text[:-1], np.array(toxic)[text], np.ones(len(code), bool), 25, 5, 6, 2.0)
    by_word, by_pair = naive_kn(texts, toxic, words, 5, 6, 2.0)
    assert len(by_pair) > 3 and {(int(k) // 25, int(k) % 25) for k in keys} == {(words[u], words[w]) for u, w in by_pair}
    assert {k: word[words[k]] for k in by_word} == pytest.approx(dict(by_word))
    assert {(u, w): pair[list(keys).index(words[u] * 25 + words[w])] for u, w in by_pair} == pytest.approx(dict(by_pair))
    model = toxicity_kn.Model(words, word, keys, pair, (2.0, -1.0))
    for t in texts[:20]:
        want = sum(by_pair.get((t[k - 1], w), by_word.get(w, 0.0)) if k else by_word.get(w, 0.0) for k, w in enumerate(t))
        assert model.evidence(" ".join(t)) == pytest.approx(want / max(1, len(t)))
    assert model.evidence(None) == 0 and model.probability(np.array([0.5]))[0] == pytest.approx(0.5)


def test_fitting_by_tasks_is_fitting_at_once(spark):
    r = random.Random(4)
    rows = []
    for k in range(120):
        words = [f"w{r.randrange(30)}" for _ in range(r.randint(0, 50))] + ["vile"] * (k % 4 == 0)
        rows.append((" ".join(words), int(k % 4 == 0), k * 7919 % 1000))
    model = toxicity_kn.fitted(spark.createDataFrame(rows, "text string, y int, order long").repartition(4))
    texts = [toxicity_kn.tokens(t) for t, _, _ in rows]
    by_word, _ = naive_kn(texts, [y == 1 for _, y, _ in rows], model.words, toxicity_kn.LEAST_WORD, 10**9, toxicity_kn.SHARED)
    assert {w: model.word[k] for w, k in model.words.items()} == pytest.approx(dict(by_word))
    assert model.curve[0] > 0 and model.evidence("vile") > model.evidence("w1")


# -- op4 ------------------------------------------------------------------------------------------


def test_risk_and_its_slope():
    rng = np.random.default_rng(5)
    positive, wild, w = rng.normal(0.3, 1, (40, 6)), rng.normal(0, 1, (70, 6)), rng.normal(0, 0.5, 7)
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    mean = lambda rows, f: sum(f(float(x @ w[:-1] + w[-1])) for x in rows) / len(rows)
    lp, lu = quality_pu.mean_loss(positive, w, True), quality_pu.mean_loss(wild, w, False)
    assert lp[0] == pytest.approx(mean(positive, lambda z: sigmoid(-z))) and lu[0] == pytest.approx(mean(wild, sigmoid))
    as_bad = mean(positive, sigmoid)
    for prior in (0.2, 0.99):
        value = prior * lp[0] + max(0, lu[0] - prior * as_bad)
        assert quality_pu.risk(prior, lp[0], lu[0]) == pytest.approx(value)

        def at(k, e, prior=prior):
            x = w.copy()
            x[k] += e
            p, u = quality_pu.mean_loss(positive, x, True)[0], quality_pu.mean_loss(wild, x, False)[0]
            return prior * p + u - prior * (1 - p), u - prior * (1 - p)

        below = lu[0] < prior * as_bad
        got = quality_pu.slope(prior, lp, lu)
        for k in range(7):
            whole, bad = ((a - b) / 2e-5 for a, b in zip(at(k, 1e-5), at(k, -1e-5), strict=True))
            assert got[k] == pytest.approx(-bad if below else whole, abs=1e-7)
    assert lu[0] < 0.99 * as_bad or quality_pu.slope(1.0, (0.1, np.ones(2)), (0.2, np.ones(2))).tolist() == [-2.0, -2.0]


def test_the_risk_is_over_all_documents(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice(["ab", "C!", "12", "x"]) for _ in range(r.randint(0, 30))) for _ in range(600)] + [None, "", "a " * 5000]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    w = np.random.default_rng(7).normal(0, 0.1, quality_pu.WIDTH + 1)
    x = np.stack([quality_pu.features(t) for t in texts])
    value, change = quality_pu.whole_loss(docs, w)
    want = quality_pu.mean_loss(x, w, False)
    assert value == pytest.approx(want[0], rel=1e-6) and change == pytest.approx(want[1], abs=1e-6)
    assert quality_pu.whole_loss(docs.where("false"), w) is None
    assert quality_pu.unpacked([quality_pu.packed(v) for v in x]) == pytest.approx(x, abs=1e-3)


# -- op8 ------------------------------------------------------------------------------------------


def test_a_text_is_the_average_of_its_subwords():
    def naive(text):
        letters = [b if 97 <= b <= 122 or b >= 128 else 32 for b in (" " + text.lower() + " ").encode()]
        kept = [b for k, b in enumerate(letters) if b != 32 or not k or letters[k - 1] != 32]
        out = Counter()
        for order in (2, 3, 4):
            for k in range(len(kept) - order + 1):
                code = 0
                for b in kept[k : k + order]:
                    code = (code * 0x9E3779B1 + b) % 2**32 if code else b
                out[(order - 2) * 2048 + ((code * 0x85EBCA6B) % 2**32 >> 21)] += 1
        total = sum(out.values())
        return {k: n / total for k, n in out.items()}

    for text in ("The cat", "Größe  und\nmehr", "a1b2", "日本"):
        got = language_id.subwords(text)
        assert {int(k): got[k] for k in np.flatnonzero(got)} == pytest.approx(naive(text))
        assert language_id.unpacked([language_id.packed(got)])[0] == pytest.approx(got, abs=1e-3)


def test_one_step_of_training():
    rng = np.random.default_rng(8)
    t = language_id.Trainer(3, rng)
    t.heads = rng.normal(0, 1, t.heads.shape)
    x = np.stack([language_id.subwords(s) for s in ("one two", "eins zwei", "un deux", "two")])
    y = np.array([0, 1, 2, 0])
    table, heads, bias = t.slopes(x, y)
    for array, change, places in ((t.table, table, [(int(k), 3) for k in np.flatnonzero(x[1])[:4]]), (t.heads, heads, [(0, 0), (5, 2)]), (t.bias, bias, [(1,)])):
        for at in places:
            old = array[at]
            array[at] = old + 1e-5
            up = t.loss(x, y)
            array[at] = old - 1e-5
            down = t.loss(x, y)
            array[at] = old
            assert change[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)
    before = t.table.copy(), t.heads.copy(), t.bias.copy()
    t.step(x, y, 0.7)
    for new, old, change in zip((t.table, t.heads, t.bias), before, (table, heads, bias), strict=True):
        assert new == pytest.approx(old - 0.7 * change)


@pytest.mark.parametrize("share", [0.1, 0.35, 0.8])
def test_the_prior_is_the_share_of_positives_among_the_unlabelled(share):
    r = np.random.default_rng(4)
    margin = lambda n, good: r.normal(2.0 if good else -2.0, 1.5, n)
    count = lambda x: np.bincount(quality_pu.binned(x), minlength=quality_pu.BINS)
    unlabelled = np.concatenate((margin(int(20_000 * share), True), margin(20_000 - int(20_000 * share), False)))
    assert quality_pu.estimated_prior(count(margin(4_000, True)), count(unlabelled)) == pytest.approx(share, abs=0.05)


def test_margins_of_all_documents_are_counted(spark):
    docs = spark.createDataFrame([(t,) for t in ["A b c.", None, "", "x y z", "x y z"]], "text string").repartition(3)
    w = np.random.default_rng(1).normal(size=quality_pu.WIDTH + 1)
    margins = np.array([quality_pu.features(r["text"]) @ w[:-1] + w[-1] for r in docs.collect()])
    assert (quality_pu.whole_margins(docs, w) == np.bincount(quality_pu.binned(margins), minlength=quality_pu.BINS)).all()
    assert quality_pu.whole_margins(docs.limit(0), w).sum() == 0
