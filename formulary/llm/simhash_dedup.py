"""SimHash near-duplicates, pruned by pigeonring chains.

A fingerprint is cut into m segments on a ring. If two fingerprints differ in at most t bits, then
some segment begins a chain in which the first l segments together differ in at most l * t / m bits,
for every l. Where t is small, chains are looked up by their first segments: one side files its own
bits, the other side files every variant within the budgets, so near keys meet as equal keys. All
pairs that meet must keep within the budgets along a chain before their full Hamming distance is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formulary.llm import shingle_join
from formulary.llm.common import ascii_words, fresh, keyed, mix64, per_text, settled, stored, tidied
from formulary.llm.components import Forest, components

SEED = 42
@dataclass(frozen=True)
class Ring:
    """How fingerprints are made and compared.

    bits: a multiple of 64. limit: the most bits in which linked fingerprints differ. chain: segments
    in a lookup key. reach: bits that a variant may change in a key; with it, no pair up to
    `guaranteed` bits is missed by the lookup.
    """

    shingle: int = 4
    distinct: bool = False
    bits: int = 64
    limit: int = 4
    segments: int = 5
    chain: int = 2
    reach: int = 1

    @property
    def bounds(self) -> list[tuple[int, int]]:
        cut = [round(k * self.bits / self.segments) for k in range(self.segments + 1)]
        return list(zip(cut, cut[1:], strict=False))

    @property
    def guaranteed(self) -> int:
        """The largest t up to which some chain stays within the budgets that the variants cover."""
        t = self.limit
        while t >= 0 and any(k * t // self.segments > self._covered(k) for k in range(1, self.chain + 1)):
            t -= 1
        return t

    def _covered(self, k: int) -> int:
        own = self.limit // self.segments
        return min(own, self.reach) if k == 1 else min(k * self.limit // self.segments, self.reach)


#: The contract's fingerprint: 64 bits over four-word shingles, linked at 4 bits or fewer, all of them found.
CONTRACT = Ring()
#: For a shingle similarity (Jaccard) of 0.8 over five words, which is counted exactly afterwards. There a bit
#: differs with probability 0.15, 39 of 256 bits; sets of four and five shingles come to 48 with a deviation of
#: 6.4, so 80 bits lose about one such pair in five million. Independent texts get there once in a billion pairs.
SIMILAR = Ring(shingle=5, distinct=True, bits=256, limit=80, segments=16)


def majority(hashes: np.ndarray, bits: int = 64) -> bytes:
    """Big-endian bytes of the fingerprint of 64-bit hashes: a bit is 1 if set in over half of them. Further 64 bits come from the hashes scrambled anew."""
    ones = np.zeros(bits, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        h = hashes[at : at + (1 << 15)]
        lanes = np.stack([h if not k else mix64(h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) for k in range(bits // 64)], 1)
        ones += np.add.reduce(np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8").astype(">u8").tobytes()


def fingerprint(text: str | None, ring: Ring = CONTRACT) -> bytes:
    """Big-endian bytes of a text's fingerprint: the contract's rule, on whole texts. No words give zero bits."""
    words = ascii_words(text, lower=True)
    n = len(words)
    if not n:
        return bytes(ring.bits // 8)
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(ring.shingle, n)
    starts = [0, *ends[: n - k].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(flat[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)]
    return majority(np.array(list(set(hashes)) if ring.distinct else hashes, np.uint64), ring.bits)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ring: Ring = CONTRACT) -> DataFrame:
    """(doc_id, fp): one row per row of docs."""

    return per_text(docs, id_col, text_col, lambda: lambda texts: [[fingerprint(t, ring) for t in texts]], "fp binary")


def _segments(lanes: np.ndarray, ring: Ring) -> np.ndarray:
    """(n, m) integers: the bits of every segment."""
    bits = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8).reshape(len(lanes), -1), axis=1, bitorder="little")
    return np.stack([bits[:, a:b].astype(np.uint64) @ (np.uint64(1) << np.arange(b - a, dtype=np.uint64)) for a, b in ring.bounds], 1)


def _variants(ring: Ring, start: int) -> np.ndarray:
    """Masks over a key's bits that stay within the chain's budgets and change at most reach bits of it."""
    widths = [ring.bounds[(start + j) % ring.segments] for j in range(ring.chain)]
    owner = [j for j, (a, b) in enumerate(widths) for _ in range(b - a)]
    masks = []
    for r in range(ring.reach + 1):
        for at in combinations(range(len(owner)), r):
            spent = np.bincount([owner[x] for x in at], minlength=ring.chain).cumsum() if at else np.zeros(ring.chain)
            if all(s <= (j + 1) * ring.limit // ring.segments for j, s in enumerate(spent)):
                masks.append(sum(1 << x for x in at))
    return np.array(masks, np.uint64)


def _keys(lanes: np.ndarray, ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """Scrambled keys (n, m) of the fingerprints themselves, and (n, m * variants) of what they probe."""
    seg = _segments(lanes, ring)
    own, probes = [], []
    for s in range(ring.segments):
        key, width = np.zeros(len(lanes), np.uint64), 0
        for j in range(ring.chain):
            k = (s + j) % ring.segments
            key |= seg[:, k] << np.uint64(width)
            width += ring.bounds[k][1] - ring.bounds[k][0]
        tag = np.uint64(s << 56)
        own.append(mix64(key | tag))
        probes.append(mix64((key[:, None] ^ _variants(ring, s)[None, :]) | tag))
    return np.stack(own, 1), np.concatenate(probes, 1)


def _within(a: np.ndarray, b: np.ndarray, ring: Ring) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64) <= ring.limit


@lru_cache
def _masks(ring: Ring) -> list[list[tuple[int, np.uint64]]]:
    """For each segment its parts: the number of a 64-bit lane, and the segment's bits there."""
    out = []
    for a, b in ring.bounds:
        lanes = range(a // 64, (b - 1) // 64 + 1)
        out.append([(k, np.uint64(sum(1 << (x - 64 * k) for x in range(max(a, 64 * k), min(b, 64 * k + 64))))) for k in lanes])
    return out


def chained(a: np.ndarray, b: np.ndarray, ring: Ring, longest: int = 8) -> np.ndarray:
    """Whether some chain of 1, 2, ... segments keeps within its budgets, l * limit / segments for l of them: no pair within the limit fails."""
    x = a ^ b
    each = np.stack([sum(np.bitwise_count(x[:, k] & mask).astype(np.int16) for k, mask in parts) for parts in _masks(ring)], 1)
    good, total = np.ones_like(each, bool), np.zeros_like(each)
    for step in range(min(longest, ring.segments)):
        total = total + np.roll(each, -step, axis=1)
        good &= total <= (step + 1) * ring.limit // ring.segments
    return good.any(1)


def close(a: np.ndarray, b: np.ndarray, ring: Ring) -> np.ndarray:
    """Which pairs of fingerprints are within the limit: chains first, then the full distance of those that pass."""
    good = chained(a, b, ring)
    good[good] = _within(a[good], b[good], ring)
    return good


def _linked(own: np.ndarray, own_row: np.ndarray, probe: np.ndarray, probe_row: np.ndarray, lanes: np.ndarray, ring: Ring, block: int = 1 << 21) -> Forest:
    """Joins the fingerprints that meet in a key and are within the limit. Pairs are walked in blocks and only their joins stay."""
    forest = Forest(len(lanes))
    order = np.argsort(own, kind="stable")
    own, own_row = own[order], own_row[order]
    left, right = np.searchsorted(own, probe, "left"), np.searchsorted(own, probe, "right")
    count = right - left
    crowded = count > 512
    for key in np.unique(probe[crowded]):  # a crowd is walked outwards from one member: what is already joined is not compared again
        a, b = np.searchsorted(own, key, "left"), np.searchsorted(own, key, "right")
        rest = np.unique(np.concatenate((own_row[a:b], probe_row[probe == key])))
        while len(rest):
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                x = front.pop()
                near = _within(lanes[rest], lanes[x], ring)
                for y in rest[near]:
                    forest.join(int(x), int(y))
                front.extend(rest[near].tolist())
                rest = rest[~near]
    some = np.flatnonzero((count > 0) & ~crowded)
    upto = np.cumsum(count[some])
    at = 0
    while at < len(some):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + block, "right")))
        part = some[at:end]
        n = count[part]
        x = np.repeat(probe_row[part], n)
        y = own_row[np.repeat(left[part] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        apart = x < y  # each pair is met from both sides
        x, y = x[apart], y[apart]
        near = close(lanes[x], lanes[y], ring)
        for a, b in np.unique(np.stack((x[near], y[near]), 1), axis=0).tolist():
            forest.join(a, b)
        at = end
    return forest


def links(classes: DataFrame, ring: Ring = CONTRACT, per_group: int = 1_000_000) -> DataFrame:
    """Edges (a, b) that join all fingerprints within the limit, from (rep, fp) with distinct fingerprints.

    A batch sends each group of keys its fingerprints once and its keys as packed arrays. The number
    of groups follows the number of keys, so what a task holds stays bounded.
    """
    n = classes.count()
    per = ring.segments * (1 + len(_variants(ring, 0)))
    groups = max(16, -(-n * per // per_group))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 4096):
                b = whole.iloc[at : at + 4096]
                lanes = np.frombuffer(b"".join(b["fp"]), ">u8").astype(np.uint64).reshape(len(b), -1)
                reps = b["rep"].to_numpy(np.int64)
                own, probe = _keys(lanes, ring)
                codes = np.concatenate((own.ravel(), probe.ravel()))
                rows = np.concatenate((np.repeat(np.arange(len(b)), own.shape[1]), np.repeat(np.arange(len(b)), probe.shape[1])))
                group = codes % np.uint64(groups)
                order = np.argsort(group, kind="stable")  # own keys stay before probes within a group
                there, cut = np.unique(group[order], return_index=True)  # only the groups that occur
                out = []
                for g, idx in zip(there.tolist(), np.split(order, cut[1:]), strict=True):
                    used, row = np.unique(rows[idx], return_inverse=True)
                    out.append((g, int((idx < own.size).sum()), lanes[used].tobytes(), reps[used].tobytes(), (codes[idx] >> np.uint64(32)).astype("<u4").tobytes(), row.astype("<u2").tobytes()))
                yield pd.DataFrame(out, columns=["g", "n_own", "lanes", "reps", "codes", "rows"])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        lanes, reps = (np.frombuffer(b"".join(group[c]), t) for c, t in (("lanes", np.uint64), ("reps", np.int64)))
        lanes = lanes.reshape(len(reps), -1)
        base, own, own_row, probe, probe_row = 0, [], [], [], []
        for n_own, r, c, w in zip(group["n_own"], group["reps"], group["codes"], group["rows"], strict=True):
            codes, rows = np.frombuffer(c, "<u4"), np.frombuffer(w, "<u2").astype(np.int64) + base
            own.append(codes[:n_own]), own_row.append(rows[:n_own]), probe.append(codes[n_own:]), probe_row.append(rows[n_own:])
            base += len(r) // 8
        reps, where = np.unique(reps, return_inverse=True)
        first = np.empty(len(reps), np.int64)
        first[where] = np.arange(len(where))
        to = lambda rows: where[np.concatenate(rows)]
        roots = _linked(np.concatenate(own), to(own_row), np.concatenate(probe), to(probe_row), lanes[first], ring).roots()
        moved = np.flatnonzero(roots != np.arange(len(roots)))
        return pd.DataFrame({"a": reps[moved], "b": reps[roots[moved]]})

    sent = classes.select("rep", "fp").mapInPandas(tidied(send), "g int, n_own int, lanes binary, reps binary, codes binary, rows binary")
    return sent.groupBy("g").applyInPandas(meet, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ring: Ring = CONTRACT) -> DataFrame:
    """(doc_id, fingerprint as hex, component_id): one row per row of docs.

    component_id is the smallest doc_id that a row reaches over links, itself included. Equal
    fingerprints are one class from the start, so copies are never paired. Null and empty texts have
    the zero fingerprint, linked like any other. A row with a null id has a fingerprint but no
    component and links nothing. Repeated rows share their component; an empty table gives no rows;
    other columns of docs aren't read.
    """
    made = stored(fingerprints(docs, id_col, text_col, ring), "fingerprints")
    classes = stored(made.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = components(links(classes, ring))
    named = classes.join(found, classes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    lone = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return made.join(named, "fp", "left").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), lone.alias("component_id"))


def deduplicated(docs: DataFrame, ring: Ring = SIMILAR) -> DataFrame:
    """The documents of which each group keeps one, the smallest doc_id; all their columns.

    Texts that share a rare shingle are candidates; their fingerprints are pruned by pigeonring chains
    and the full Hamming distance; links are those whose shingle sets then have a Jaccard similarity of
    0.8 or more, counted exactly. Rows that share an id are documents of their own, and so are rows
    without one, which come after all ids. Null and empty texts, and texts without words, are like no
    other and all stay. Repeated rows leave one. An empty table gives no rows; other columns may have
    any names.
    """
    spark, row = docs.sparkSession, fresh(docs, "_row")
    rows = keyed(docs, row)
    read = rows.select(F.col(row).alias("row"), "text")
    sketch, keep = (lambda hashes: majority(hashes, ring.bits)), (lambda a, b: close(a, b, ring))
    found = settled(spark, lambda: shingle_join.firsts(read, sketch, keep, ring.shingle), "kept")
    return rows.join(found.withColumnRenamed("row", row), row, "left_semi").select(docs.columns)
