"""The mix against a plain replay: draws, permutations and the join of blocks, one slot and one word at a time."""

import random
from collections import Counter

import numpy as np

from formulary.llm import mixing

MASK = (1 << 64) - 1


def scrambled(x):
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 & MASK
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D & MASK
    return x ^ x >> 33


def feistel(index, size, key):
    bits = 1
    while 1 << bits < size:
        bits += 1
    half = max(1, (bits + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = index >> half, index & mask
        for r in range(4):
            a, b = b, a ^ (scrambled((b + key + r * 0x9E3779B97F4A7C15) & MASK) & mask)
        index = a << half | b
        if index < size:
            return index


def drawn(slots, shard, seed):
    """For every slot its shard and source: multinomial counts of what is left, shard by shard, sources in turn within a shard."""
    left, out, number = list(slots), [], 0
    while sum(left):
        rng, n, row = np.random.default_rng([seed, number]), min(shard, sum(left)), [0] * len(left)
        while n:
            want = rng.multinomial(n, np.array(left) / sum(left))
            for k, w in enumerate(want):
                got = min(int(w), left[k])
                row[k], left[k], n = row[k] + got, left[k] - got, n - got
        out += [(number, k) for k, many in enumerate(row) for _ in range(many)]
        number += 1
    return out


def test_a_mix_is_its_replay(spark, monkeypatch):
    r = random.Random(11)
    text = lambda n: " ".join(f"w{r.randrange(999)}" for _ in range(n))
    rows = [(k, text(r.choice([0, 1, 30, 130, 700])), r.choice(["a", "b", "b", "b", "c", None])) for k in range(120)]
    rows += [(5, text(40), "b"), (5, text(40), "a"), (None, text(25), "a"), (None, None, "c"), (200, "same same", "d"), (200, "same same", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    monkeypatch.setattr(mixing, "SHARD", 37)
    monkeypatch.setattr(mixing, "STRETCH", 20)
    mix = mixing.Mix(docs, block=16, seed=3)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = mix.names
    assert sorted(names, key=str) == sorted((s for s in sizes if sizes[s]), key=str) and mix.totals == dict(sizes)
    # blocks: every word of a source is in one of them, in one place
    pieces = mix.pieces().collect()
    held, words = Counter(), Counter()
    for p in pieces:
        assert 0 <= p["from_word"] < p["to_word"] <= p["size"]
        held[p["source_no"], p["block"]] += p["to_word"] - p["from_word"]
        words[p["source_no"]] += p["to_word"] - p["from_word"]
    assert max(held.values()) <= 16 and dict(words) == {k: sizes[s] for k, s in enumerate(names)}
    blocks = [sum(1 for s, _ in held if s == k) for k in range(len(names))]
    assert [sorted(b for s, b in held if s == k) for k in range(len(names))] == [list(range(n)) for n in blocks]
    # slots: the plan, drawn and permuted
    plan = [min(round(mix.targets[s] * blocks[k] / sizes[s]), 2 * blocks[k]) for k, s in enumerate(names)]
    used, times, want = Counter(), Counter(), []
    for shard, source in drawn(plan, mix.shard, 3):
        j = used[source]
        used[source] += 1
        key = scrambled(((source * 1_000_003 + j // blocks[source]) * 0xD1342543DE82EF95 + 3) & MASK)
        block = feistel(j % blocks[source], blocks[source], key)
        want.append((shard, source, block))
        times[source, block] += 1
    assert sorted((x["shard"], x["source_no"], x["block"]) for x in mix.slots().collect()) == sorted(want)
    assert all(times[s, b] <= 2 for s, b in times)
    # the join: words taken of each row
    taken = Counter()
    for p in pieces:
        taken[p["doc_id"], p["source"], p["size"], p["tie"], p["start"], p["stretch"]] += times[p["source_no"], p["block"]] * (p["to_word"] - p["from_word"])
    plain = Counter((k[0], k[2], t) for k, t in taken.items())
    plain += Counter((i, 0, 0) for i, t, _ in rows if not (t or "").split())
    assert Counter((x["doc_id"], x["size"], x["taken"]) for x in mix.taken().collect()) == plain
