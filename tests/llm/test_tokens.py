"""Token counts and alignments against the tokenizers' own results; the filter audit against filters that are run."""

import hashlib
import random
from collections import Counter
from itertools import permutations

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from formulary.llm import filter_audit, token_alignment, token_counts

BPE, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_bytes long, pair long"


def texts():
    r = random.Random(3)
    alphabets = ["ab ", "aehinrst  ", " \n\tx", "0123456789 .-", "日本語中a ", "éàüñ e", " ", "()[]{};: \n", "😀é​ a▁", "\x00a <s>|"]
    out = [None, "", " ", "▁", "  lead and trail  ", "<s> </s> <unk> <0x41> <|endoftext|>", "one\n\n\ttwo\r\n three four　five", "a" * 3000, " " * 700]
    out += ["".join(r.choice(alphabets[k % len(alphabets)]) for _ in range(r.randrange(1, 120))) for k in range(150)]
    out += [" ".join(r.choice(["the", "model", "of", "straße", "Ünïcode", "x1", "don't", "2024", "日本"]) for _ in range(n)) for n in (5, 40, 4000)]
    return out + ["the same text", "the same text"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k % 9 else None, t, "en", "ab"[k % 2], 0, 0, 0) for k, t in enumerate(texts())] + [(2**60 + 1, "an id beyond doubles", "en", None, 0, 0, 0)] * 2
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def key(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize(("chunk", "fan_in"), [(1 << 18, 256), (7, 3), (1, 2)])
def test_counts_are_the_library_s_however_texts_are_cut(docs, chunk, fan_in):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = docs if chunk > 1 else docs.where("length(text) < 200 or text is null")
    got = key(map(tuple, token_counts.token_counts(rows, PIECES, limit=30, chunk=chunk, fan_in=fan_in).collect()))
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := len(model.encode(r["text"] or "")), n > 30) for r in rows.collect()]
    assert got == key(want)


def test_states_hold_after_they_are_forgotten():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ranks = {model.id_to_piece(k): -model.get_score(k) for k in range(259, model.get_piece_size())}
    small = token_counts.Transducer(ranks, states=50, known=10)
    for text in filter(None, texts()):
        assert small.count(token_counts.spelled(text)) == len(model.encode(text))
    assert len(small.known) <= 10


def links(a_ids, b_ids, a_bytes, b_bytes):
    """Groups and overlapping pairs, token by token."""

    def spans(ids, of):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(of[i]), i))
            at += len(of[i])
        return out

    a, b = spans(a_ids, a_bytes), spans(b_ids, b_bytes)
    cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
    groups = []
    for low, high in zip([0, *cuts[:-1]], cuts, strict=True):
        groups.append("|".join(",".join(str(i) for s, _, i in side if low <= s < high) for side in (a, b)))
    return groups, [(i, j) for s, e, i in a for x, y, j in b if max(s, x) < min(e, y)]


@pytest.mark.parametrize("told", [1 << 17, 40, 0])
def test_alignment_against_every_pair(docs, told):
    a, b = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    a_bytes, b_bytes = token_alignment.byte_level(BPE).spelling, token_alignment.pieces(PIECES).spelling
    rows = docs.where("length(text) < 300 or text is null")
    made, counts = [], Counter()
    for r in rows.collect():
        text = r["text"] or ""
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if not text or any(b"".join(of[i] for i in x) != (" " + text).encode() for x, of in zip(ids, (a_bytes, b_bytes), strict=True)):
            made.append((r["doc_id"], [], [], [], []))
            continue
        made.append((r["doc_id"], *ids, *links(*ids, a_bytes, b_bytes)))
        counts.update(set(made[-1][4]))
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(n, best.get(i, 0))
    want = [
        (doc, len(x), len(y), len(groups), len(pairs), sum(counts[p] == best[p[0]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for doc, x, y, groups, pairs in made
    ]
    assert key(map(tuple, token_alignment.alignment(rows, BPE, PIECES, told=told).collect())) == key(want)


def test_bitset_ranks():
    r = random.Random(1)
    marks = sorted(r.sample(range(500), 120))
    bits = token_alignment.Bits.of(token_alignment.np.array(marks), 500)
    assert bits.places().tolist() == marks
    assert bits.rank(token_alignment.np.arange(501)).tolist() == [sum(m < k for m in marks) for k in range(501)]


def test_empty_tables(docs, spark):
    none = docs.limit(0)
    assert token_counts.token_counts(none, PIECES).count() == 0
    assert token_alignment.alignment(none, BPE, PIECES).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.cells(filter_audit.masked(none, labels))).count() == 0


def test_audit_against_filters_that_are_run(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    many = [" ".join(word() if r.random() < 0.7 else "of" for _ in range(r.choice([10, 49, 50, 80]))) for _ in range(40)]
    many += [t.upper() for t in many[:8]] + [t + " #" for t in many[8:20]] + [" ".join([word()] * 90), "", None, " \t\r\n ", "A|", "word " * 50_000]
    rows = [(r.choice([None, *range(60)]), r.choice(many), r.choice(["a", "b", None, ""])) for _ in range(400)]
    rows += [(5, many[3], "a")] * 3
    docs = spark.createDataFrame([(i, t, s, "x", "y", "z") for i, t, s in rows], "doc_id long, text string, source string, part string, mask string, own string").repartition(5)
    labels = spark.createDataFrame([(r.choice([None, *range(60)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(70)], "doc_id long, quality int, toxic int")
    marks = labels.collect()
    good, toxic = ({m["doc_id"] for m in marks if m[c] == 1 and m["doc_id"] is not None} for c in ("quality", "toxic"))

    def failed(i, text):
        text = text or ""
        words = text.encode().split()
        out = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text))
        out += "D" * any(c in text for c in "#$%&*|")
        return out + "E" * any(i is not None and j is not None and j < i and (t or "") == text for j, t, _ in rows)

    made = [(i, s or "", failed(i, t)) for i, t, s in rows]
    want = set()
    for part in {s for _, s, _ in made}:
        removed_by = Counter()
        steps = []
        for order in map("".join, permutations("ABCDE")):
            left = [(i, f) for i, s, f in made if s == part]
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                failing = [f for _, s, f in made if s == part and x in f]
                removed_by[x] += len(gone)
                steps.append((part, order, step, len(left), len(gone), len(failing) - len(gone), sum(f == x for f in failing), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
        want |= {(*s, removed_by[s[1][s[2] - 1]]) for s in steps}
    out = filter_audit.audit(filter_audit.cells(filter_audit.masked(docs, labels)))
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(want) == 600 * 3 and set(got) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
