"""Alignment of two tokenizers over the same bytes, by packed bitsets of token ends.

A tokenizer marks the byte at which each of its tokens ends, all texts of a batch in one bitset. AND of
two bitsets gives the cuts that both make, and so the groups; OR gives the ends of the links, since
between two marked ends next to each other exactly one token of either side lies. Popcount ranks turn
a byte into the number of the token that holds it, so links expand to pairs of ids without a search.

How many documents hold a pair linked is counted over the whole table. The most frequent pairs, of a
bounded number, are then sent to the tasks; links of other pairs are joined with their counts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from formulary.llm.common import small_batches, stored, tidied
from formulary.llm.packing import CACHE, OTHER_SPACE, encoder

#: Pairs whose counts are sent to tasks, and distinct pairs that a task counts before it hands them on.
TOLD, HELD = 1 << 17, 1 << 20
SPACE = "▁"


class Bits:
    """A bitset over bytes, in 64-bit words, with the popcount before each word."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.before = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        marks = np.zeros(-(-size // 64) * 64, np.uint8)
        marks[places] = 1
        return cls(np.packbits(marks, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Marked bytes before each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        inside = np.append(self.words, np.uint64(0))[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)

    def places(self) -> np.ndarray:
        """Marked bytes, in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Side:
    """One tokenizer: ids of a text as little-endian 32-bit numbers, and the bytes of each id."""

    def __init__(self, spelling: list[bytes], ids: Callable[[str], bytes]) -> None:
        self.spelling, self.ids = spelling, ids
        self.length = np.array([len(b) for b in spelling], np.int64)

    def read(self, text: str, raw: bytes) -> np.ndarray | None:
        """The ids of a text, if their bytes are the raw ones."""
        ids = np.frombuffer(self.ids(text), "<u4")
        return ids if b"".join(map(self.spelling.__getitem__, ids.tolist())) == raw else None


def byte_level(path: str) -> Side:
    """Byte-level BPE of a space and the text. Words after one space each are encoded once and remembered, by the packing operator's encoder."""
    file, it = json.loads(Path(path).read_text(encoding="utf-8")), encoder(path)
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]  # a byte that prints stands for itself, the rest follow from 256 on
    hidden = [b for b in range(256) if b not in set(prints)]
    byte = {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(hidden)}
    vocabulary = file["model"]["vocab"]
    spelling = [b""] * (max(vocabulary.values()) + 1)
    for piece, k in vocabulary.items():
        spelling[k] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()

    def ids(text: str) -> bytes:
        units = text.replace("\n", " \n").split(" ")
        if "" in units or "\n" in units or any(c in text for c in OTHER_SPACE):
            return it.ids(" " + text)
        got = map(it._known.get, units)
        return b"".join([it._unit(u) if x is None else x for u, x in zip(units, got, strict=True)])

    return Side(spelling, ids)


def pieces(path: str, cache: int = CACHE) -> Side:
    """Pieces of a sentencepiece model, which puts a space before a text. Words between single spaces are encoded once, as no piece holds a space behind another character."""
    import sentencepiece

    it = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [it.id_to_piece(k) for k in range(it.get_piece_size())]
    spelling = [bytes([int(n[3:-1], 16)]) if it.is_byte(k) else n.replace(SPACE, " ").encode() for k, n in enumerate(names)]
    apart = not any(SPACE in n.lstrip(SPACE) for n in names)
    known: dict[str, bytes] = {}

    def encoded(text: str) -> bytes:
        return np.array(it.encode(text, num_threads=1), "<u4").tobytes()

    def word(text: str) -> bytes:
        out = encoded(text)
        if len(text) <= 40 and len(known) < cache:
            known[text] = out
        return out

    def ids(text: str) -> bytes:
        words = text.split(" ")
        if not apart or "" in words or SPACE in text:
            return encoded(text)
        got = map(known.get, words)
        return b"".join([word(w) if x is None else x for w, x in zip(words, got, strict=True)])

    return Side(spelling, ids)


_SIDES: dict[tuple[str, str], tuple[Side, Side, list[str]]] = {}


def sides(a: str, b: str) -> tuple[Side, Side, list[str]]:
    """This process's two tokenizers, and how an id is written with each of the signs that may follow it."""
    if (a, b) not in _SIDES:
        both = byte_level(a), pieces(b)
        most = max(len(s.spelling) for s in both)
        _SIDES[a, b] = (*both, [f"{k}{sign}" for k in range(most) for sign in ",|;"])
    return _SIDES[a, b]


def aligned(a_ids: list[np.ndarray], b_ids: list[np.ndarray], a: Side, b: Side, written: list[str]) -> dict[str, list]:
    """For texts of which both sides have the same bytes: the columns of a row each, with the links' pairs (a id << 32 | b id) and how often each occurs."""
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
    a_all, b_all = (np.concatenate(ids).astype(np.int64) if ids else np.empty(0, np.int64) for ids in (a_ids, b_ids))
    a_end, b_end = np.cumsum(a.length[a_all]), np.cumsum(b.length[b_all])
    size = int(a_end[-1]) if len(a_end) else 0
    texts = np.concatenate(([0], np.append(0, a_end)[np.cumsum(n_a)]))  # where each text begins and the last one ends
    in_a, in_b = Bits.of(a_end - 1, size), Bits.of(b_end - 1, size)
    both, either = in_a & in_b, in_a | in_b
    # links: between two marked ends lies one token of either side
    at = either.places()
    pair = a_all[in_a.rank(at)] << 32 | b_all[in_b.rank(at)]
    of = np.searchsorted(texts, at, "right") - 1
    order = np.lexsort((pair, of))
    pair, of = pair[order], of[order]
    first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (of[1:] != of[:-1]))) if len(pair) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(pair))).astype(np.int32)
    parts = np.searchsorted(of[first], np.arange(len(n_a) + 1))
    # groups: behind each shared cut so many tokens of either side have ended
    cuts = both.places()
    a_upto, b_upto = in_a.rank(cuts + 1), in_b.rank(cuts + 1)
    a_before, b_before = np.append(0, a_upto[:-1]), np.append(0, b_upto[:-1])
    code = np.zeros(len(a_all) + len(b_all), np.int64)  # tokens in the order of groups, a's before b's
    place_a = np.arange(len(a_all)) + np.repeat(b_before, a_upto - a_before)
    place_b = np.arange(len(b_all)) + np.repeat(a_upto, b_upto - b_before)
    code[place_a], code[place_b] = a_all * 3, b_all * 3
    code[a_upto + b_before - 1] += 1  # | behind a group's last token of a
    code[a_upto + b_upto - 1] += 2  # ; behind its last of b
    upto = np.cumsum(np.append(0, n_a + n_b))
    groups = np.diff(both.rank(texts))
    out: dict[str, list] = {"n_a": n_a.tolist(), "n_b": n_b.tolist(), "n_groups": groups.tolist(), "n_links": (n_a + n_b - groups).tolist(), "sha": [], "pairs": [], "times": []}
    for k in range(len(n_a)):
        said = "".join(map(written.__getitem__, code[upto[k] : upto[k + 1]].tolist()))
        out["sha"].append(hashlib.sha256(said[:-1].encode()).hexdigest())
        out["pairs"].append(pair[first[parts[k] : parts[k + 1]]].tobytes())
        out["times"].append(times[parts[k] : parts[k + 1]].tobytes())
    return out


SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def alignments(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA, stored: one row per row of docs, numbered by row; pairs and times are packed 64-bit and 32-bit numbers."""
    shape = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        left, right, written = sides(a, b)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                good, a_ids, b_ids = [], [], []
                some = texts[at : at + 256]
                for k, text in enumerate(some):
                    raw = (" " + text).encode("utf-8", "surrogatepass") if text else b""
                    x, y = (left.read(text, raw), right.read(text, raw)) if text else (None, None)
                    if x is not None and y is not None:
                        good.append(k)
                        a_ids.append(x)
                        b_ids.append(y)
                made = aligned(a_ids, b_ids, left, right, written)
                blank = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "sha": "", "pairs": b"", "times": b""}
                place = {k: n for n, k in enumerate(good)}
                columns = [[made[c][place[k]] if k in place else blank[c] for k in range(len(some))] for c in blank]
                rows = [number + k for k in range(len(some))]
                number += len(some)
                arrays = [pa.array(c, f.type) for c, f in zip([rows, *columns], [shape[0], *list(shape)[2:]], strict=True)]
                yield pa.RecordBatch.from_arrays([arrays[0], batch.column(0).slice(at, len(some)), *arrays[1:]], schema=shape)

    small_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return stored(read.mapInArrow(tidied(run), SCHEMA), "aligned")


def pair_counts(rows: DataFrame, held: int = HELD) -> DataFrame:
    """(pair, n, best), stored: in how many rows of alignments() each pair is linked, and whether no other pair of its a id is in more. Tasks count before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])

        for batch in batches:
            every = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64)  # a pair is once a row
            keys, which = np.unique(np.concatenate((keys, every)), return_inverse=True)
            counts = np.bincount(which, np.concatenate((counts, np.ones(len(every)))), len(keys)).astype(np.int64)
            if len(keys) > held:
                yield out()
                keys, counts = keys[:0], counts[:0]
        yield out()

    n = rows.select("pairs").mapInArrow(tidied(count), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    n = stored(n.withColumn("a", F.shiftright("pair", 32)), "pairs")
    most = n.groupBy("a").agg(F.max("n").alias("most"))
    return stored(n.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def alignment(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", told: int = TOLD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row per row of docs.

    a, b: the paths of a byte-level BPE file and of a sentencepiece model, the same on every executor.
    A null or empty text, or one that either side doesn't spell with its own bytes, has no tokens and
    zeros. Repeated rows are documents each, a null id stays null, an empty table gives no rows, other
    columns aren't read. The told most frequent pairs go to tasks, in 16 bytes each; the rest are
    joined, and none of them can be hot: as many pairs are at least as frequent as it.
    """
    rows = alignments(docs, a, b, id_col, text_col)
    counts = pair_counts(rows)
    frequent = counts.orderBy(F.desc("n"), "pair").limit(told).toPandas().sort_values("pair")
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast((frequent["pair"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64), frequent["best"].to_numpy(bool)))
    schema = "row long, known_sum long, known_best long, rare array<struct<pair: long, times: long>>"
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ns, bests = table.value
        for batch in batches:
            out: list[list] = [[], [], []]
            for pairs, times in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                pair, often = np.frombuffer(pairs, np.int64), np.frombuffer(times, np.int32).astype(np.int64)
                at = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
                hit = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
                out[0].append(int((ns[at[hit]] * often[hit]).sum()))
                out[1].append(int((bests[at[hit]] * often[hit]).sum()))
                out[2].append([{"pair": p, "times": t} for p, t in zip(pair[~hit].tolist(), often[~hit].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(out, list(shape)[1:], strict=True))], schema=shape)

    looked = stored(rows.select("row", "pairs", "times").mapInArrow(tidied(look_up), schema), "links")
    rare = looked.select("row", F.inline("rare")).join(counts, "pair")
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("rare_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_best"))
    both = looked.drop("rare").join(rare, "row", "left")
    total = lambda known, more: (F.col(known) + F.coalesce(more, F.lit(0))).cast("long")
    sums = both.select("row", total("known_best", "rare_best").alias("n_best"), total("known_sum", "rare_sum").alias("count_sum"))
    return rows.drop("pairs", "times").join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
