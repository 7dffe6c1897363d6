"""Bounded-space online packing of tokenised documents into fixed windows.

Each partition keeps a fixed number of open windows. A piece goes where the least room is left over
(best fit). When none has room the fullest window is emitted; if its gap is worth a cut, the piece
first fills it. What is still open at a partition's end is merged with the leftovers of others.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from formulary.llm.common import small_batches, stored, tidied

CAPACITY, OPEN_WINDOWS, MIN_GAP, CACHE = 1024, 64, 16, 100_000
#: Partitions whose leftovers are packed together.
MERGED = 64

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: White space other than a space or a line end, in Python's sense.
OTHER_SPACE = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_ENCODERS: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """This process's encoder, with what it remembers from earlier tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    """Ids of byte-level BPE. Text between single spaces is encoded once and remembered; other text is encoded whole.

    In this vocabulary's pattern a solid run together with the one space or line end before it never
    shares a token with its neighbours, so units may be encoded apart. Runs of white space, other
    white space and white space at either end of a text don't have that property: such texts take
    the whole-text path. The memory is bounded by an entry count, and long units aren't kept. A
    vocabulary's ids are the order of its merges, so its pieces serve as ranks of a faster encoder.
    """

    def __init__(self, path: str, cache: int = CACHE) -> None:
        import public_tokenizers
        import tiktoken

        file = json.loads(Path(path).read_text(encoding="utf-8"))
        special = {t["content"] for t in file.get("added_tokens", [])}
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]  # a byte that prints stands for itself, the rest follow from 256 on
        hidden = [b for b in range(256) if b not in set(prints)]
        byte = {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in piece): k for piece, k in file["model"]["vocab"].items() if piece not in special}
        self._encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._known: dict[str, bytes] = {}
        self._cache = cache

    def _all(self, text: str) -> bytes:
        return array("I", self._encode(text)).tobytes()

    def _unit(self, unit: str) -> bytes:
        out = self._all(unit if unit[0] == "\n" else " " + unit)
        if len(unit) <= 40 and len(self._known) < self._cache:
            self._known[unit] = out
        return out

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if not text:
            return b""
        units = text.replace("\n", " \n").split(" ")
        if "" in units or "\n" in units or text[0] == "\n" or any(c in text for c in OTHER_SPACE):
            return self._all(text)
        first = units.pop(0)
        got = list(map(self._known.get, units))
        if None in got:
            got = [self._unit(u) if x is None else x for u, x in zip(units, got, strict=True)]
        return self._all(first) + b"".join(got)


class Windows:
    """The open windows of one partition. A window is a list of pieces and the tokens it holds."""

    def __init__(self, capacity: int, most_open: int, min_gap: int) -> None:
        self.capacity, self.most_open, self.min_gap = capacity, most_open, min_gap
        self.open: list[tuple[int, list]] = []

    def put(self, piece: tuple, length: int, cut) -> Iterator[list]:
        """Places a piece; yields the windows that are done. cut(piece, n) splits off its first n tokens."""
        while length > self.capacity:
            head, piece = cut(piece, self.capacity)
            length -= self.capacity
            yield [head]
        if length == self.capacity:
            yield [piece]
            return
        while True:
            best = max((k for k, (used, _) in enumerate(self.open) if used + length <= self.capacity), key=lambda k: self.open[k][0], default=None)
            if best is not None:
                used, pieces = self.open.pop(best)
                pieces.append(piece)
                if used + length == self.capacity:
                    yield pieces
                else:
                    self.open.append((used + length, pieces))
                return
            if len(self.open) < self.most_open:
                self.open.append((length, [piece]))
                return
            used, pieces = self.open.pop(max(range(len(self.open)), key=lambda k: self.open[k][0]))
            gap = self.capacity - used
            if gap >= self.min_gap:
                head, piece = cut(piece, gap)
                length -= gap
                pieces.append(head)
            yield pieces


def _cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
    doc, start, ids, total = piece
    return (doc, start, ids[: 4 * n], total), (doc, start + n, ids[4 * n :], total)


def _rows(pieces: list[tuple], sequence: int, left: int, with_ids: bool) -> Iterator[tuple]:
    at = 0
    for doc, start, ids, total in pieces:
        n = len(ids) // 4
        yield (doc, start, n, zlib.crc32(ids), total, sequence, at, left, *([ids] if with_ids else []))
        at += n


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    capacity: int = CAPACITY,
    most_open: int = OPEN_WINDOWS,
    min_gap: int = MIN_GAP,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document: where its ids start in the document, its sequence and its offset there.

    tokenizer: the path of a byte-level BPE file, the same on every executor. A document is its ids
    followed by end_id; a null or empty text is that id alone. Long documents fill whole sequences
    first. with_ids adds the ids themselves (little-endian 32-bit). Repeated rows are packed each;
    a null id stays null; an empty table gives no rows; other columns of docs aren't read.

    A partition holds at most most_open windows. Leftovers, at most that many a partition, are packed
    again by groups of partitions; a group's last windows are emitted as they are. The first step's
    rows are stored once, so that no text is encoded twice.
    """
    schema = SCHEMA + ", left long" + ", ids binary" * with_ids
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(shape), shape, strict=True)], schema=shape)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, windows, n, end = encoder(tokenizer).ids, Windows(capacity, most_open, min_gap), 0, np.array([end_id], "<u4").tobytes()
        out: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                for done in windows.put((doc, 0, ids, len(ids) // 4), len(ids) // 4, _cut):
                    out.extend(_rows(done, (part << 33) + n, -1, with_ids))
                    n += 1
                if len(out) >= 4_000:
                    yield frame(out)
                    out = []
        for _, pieces in windows.open:
            out.extend(_rows(pieces, (part << 33) + n, part, with_ids))
            n += 1
        yield frame(out)

    def merge(group: pa.Table) -> pa.Table:
        sequence, offset, length, left = (group[c].to_numpy() for c in ("sequence_id", "offset", "length", "left"))
        order = np.lexsort((offset, sequence))
        _, at, which = np.unique(sequence[order], return_index=True, return_inverse=True)
        held = np.add.reduceat(length[order], at)
        windows, number = Windows(capacity, most_open, capacity), int(left[0]) // MERGED
        into, shift, n = np.empty(len(at), np.int64), np.empty(len(at), np.int64), 0
        merged = [done for k in np.argsort(-held, kind="stable") for done in windows.put(int(k), int(held[k]), None)]
        for bins in merged + [done for _, done in windows.open]:
            into[bins], shift[bins] = (1 << 62) + (number << 33) + n, np.cumsum([0, *held[bins[:-1]]])
            n += 1
        out = group.select(shape.names).take(pa.array(order))
        out = out.set_column(shape.names.index("sequence_id"), "sequence_id", pa.array(into[which]))
        return out.set_column(shape.names.index("offset"), "offset", pa.array(offset[order] + shift[which])).cast(shape)

    small_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    done = stored(read.mapInArrow(tidied(first), schema), "packed")
    merged = done.where("left >= 0").groupBy(F.floor(F.col("left") / MERGED)).applyInArrow(merge, schema)
    return done.where("left < 0").unionByName(merged).drop("left")
