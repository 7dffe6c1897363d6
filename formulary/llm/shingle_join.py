"""Pairs of texts whose sets of shingles have a Jaccard similarity of 0.8 or more: where they meet, and the exact comparison.

The shingles of all texts have one order, about from rare to common. Two sets of a similarity of t
share a shingle among the first n - ceil(t * n) + 1 of each, its head, so texts that meet in none of
these need no comparison. Those that meet are pruned by a sketch that the caller gives, and what is
left has its similarity counted on the whole sets. Only pairs with the smallest row of a shingle are
ever rows of a table; all others are met inside cells of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formulary.llm.common import Rolling, give_back, stored, tidied
from formulary.llm.components import Forest, components

SHINGLE = 5
#: Numerator and denominator of the least similarity.
LEAST = (4, 5)
#: Rows from which common shingles are learned, about, and how many are told to tasks. They order shingles and leave none out: any order finds every pair.
LEARNED, TOLD = 10_000, 200_000


def shingles(text: str | None, rolling: Rolling, length: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles, lower-cased in ASCII; a shorter text is one shingle, a text without words has none."""
    words, _, _ = rolling.words((text or "").encode("utf-8", "surrogatepass").lower())
    return np.unique(rolling.runs(words, min(length, len(words)))) if len(words) else np.empty(0, np.uint64)


def alike(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = LEAST) -> bool:
    """Whether two sets have the least similarity."""
    if min(len(a), len(b)) * least[1] < max(len(a), len(b)) * least[0]:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * least[1] >= least[0] * (len(a) + len(b) - both)


def _sets(rows: DataFrame, length: int) -> DataFrame:
    """(row, hashes) from (row, text). Sets are as long as texts, so they are made where they are needed and not stored."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rolling = Rolling()
        for b in batches:
            yield pd.DataFrame({"row": b["row"], "hashes": [shingles(t, rolling, length).tobytes() for t in b["text"]]})

    return rows.select("row", "text").mapInPandas(tidied(make), "row long, hashes binary")


def _common(rows: DataFrame, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are often seen, sorted, and how often."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rolling = Rolling()
        for b in batches:
            yield pd.DataFrame({"x": np.concatenate([shingles(t, rolling, length) for t in b["text"]]).view(np.int64) if len(b) else []}, dtype=np.int64)

    some = rows.where(F.pmod(F.xxhash64("row", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * min(1, LEARNED / max(1, n))))
    seen = some.select("text").mapInPandas(tidied(spread), "x long").groupBy("x").count().where("count > 3")
    found = seen.orderBy(F.desc("count"), "x").limit(TOLD).toPandas().sort_values("x")
    return found["x"].to_numpy(np.int64), found["count"].to_numpy(np.int64)


def _heads(rows: DataFrame, common: tuple[np.ndarray, np.ndarray], length: int, least: tuple[int, int], sketch: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(row, same, n, sketch, head): same is equal for equal sets, and a row's own without words; a similar set has one of the shingles of the head in its own."""
    told = rows.sparkSession.sparkContext.broadcast(common)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = told.value
        rolling = Rolling()
        for b in batches:
            out = []
            for row, text in zip(b["row"].tolist(), b["text"], strict=True):
                hashes = shingles(text, rolling, length)
                x, n = hashes.view(np.int64), len(hashes)
                often = np.zeros(n, np.int64)
                if len(keys) and n:
                    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                    often = np.where(keys[at] == x, counts[at], 0)
                head = x[np.argsort(often, kind="stable")[: n + (-least[0] * n // least[1]) + 1]] if n else x
                out.append((row, hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if n else b"row %d" % row, n, sketch(hashes), head))
            yield pd.DataFrame(out, columns=["row", "same", "n", "sketch", "head"])

    return rows.select("row", "text").mapInPandas(tidied(make), "row long, same binary, n long, sketch binary, head array<long>")


Keep = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _pruned(pairs: DataFrame, keep: Keep) -> DataFrame:
    """The pairs (a, b) whose sketches (x, y) pass."""

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.loc[keep(*(np.frombuffer(b"".join(b[c]), np.uint64).reshape(len(b), -1) for c in "xy")), ["a", "b"]]

    return pairs.select("a", "b", "x", "y").mapInPandas(tidied(prune), "a long, b long")


def _verified(pairs: DataFrame, rows: DataFrame, length: int, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of rows that are similar by their whole sets."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) for x, y in zip(b["x"], b["y"], strict=True)]
            yield b.loc[np.array(good, bool), ["a", "b"]]

    left, right = (_sets_of(rows, pairs, k, length).withColumnsRenamed({"row": k, "hashes": v}) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInPandas(tidied(check), "a long, b long")


def _sets_of(rows: DataFrame, some: DataFrame, named: str, length: int) -> DataFrame:
    return _sets(rows.join(some.select(F.col(named).alias("row")).distinct(), "row", "left_semi"), length)


#: A crowd's rows are compared in cells of two blocks of at most about so many rows, and about so many hashes, each.
BLOCK_ROWS, BLOCK_HASHES = 1024, 1 << 20
CELL = ["crowd", "kind", "i", "j"]


def _cells(crowds: DataFrame) -> DataFrame:
    """(crowd, kind, i, j, side, row, own group, n, sketch) from (crowd, row, group, n, sketch, home): the cells in which rows of different groups meet.

    home says that a row is of the crowd's first row's group: such rows are compared with the others
    only. The others' blocks meet each other, and each home block. A cell of two blocks compares only
    across them (side 0 and 1).
    """
    home = F.col("home")
    size = lambda of, x: F.sum(F.when(of, x).otherwise(0))
    blocks = lambda of: F.ceil(F.greatest(size(of, F.lit(1)) / BLOCK_ROWS, size(of, F.col("n")) / BLOCK_HASHES)).cast("int")
    stats = crowds.groupBy("crowd").agg(blocks(~home).alias("others"), blocks(home).alias("homes"), F.min("group").alias("lo"), F.max("group").alias("hi"))
    stats = stats.where("lo <> hi and others > 0").drop("lo", "hi")
    part = crowds.join(stats, "crowd").withColumn("part", F.pmod(F.xxhash64("row", F.lit(5)), F.when(home, F.col("homes")).otherwise(F.col("others"))).cast("int"))
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    mine = F.col("part")
    among = F.transform(upto("others"), lambda k: cell("others", F.least(mine, k), F.greatest(mine, k), mine > k))
    across = F.transform(upto("homes"), lambda k: cell("homes", mine, k, F.lit(0)))
    asked = F.transform(upto("others"), lambda k: cell("homes", k, mine, F.lit(1)))
    return part.withColumn("cell", F.explode(F.when(home, asked).otherwise(F.concat(among, across)))).select("crowd", "cell.*", "row", "group", "n", "sketch")


class _Cell:
    """The rows of one cell. partners() gives, for each row of its first side, the rows that it must be compared with."""

    def __init__(self, table: pd.DataFrame, keep: Keep, least: tuple[int, int]) -> None:
        self.table = table = table.sort_values("row")
        self.n, self.group, self.side = (table[c].to_numpy(np.int64) for c in ("n", "group", "side"))
        self.sketch = np.frombuffer(b"".join(table["sketch"]), np.uint64).reshape(len(table), -1)
        self.within = table["kind"].iloc[0] == "others" and table["i"].iloc[0] == table["j"].iloc[0]
        self.keep, self.least = keep, least

    def partners(self) -> Iterator[tuple[int, np.ndarray]]:
        p, q = self.least
        first = np.arange(len(self.n)) if self.within else np.flatnonzero(self.side == 0)
        for x in first.tolist():
            other = np.arange(len(self.n)) > x if self.within else self.side == 1
            other &= (self.group != self.group[x]) & (np.minimum(self.n, self.n[x]) * q >= np.maximum(self.n, self.n[x]) * p)
            y = np.flatnonzero(other)
            if len(y):
                y = y[self.keep(np.broadcast_to(self.sketch[x], (len(y), self.sketch.shape[1])), self.sketch[y])]
            if len(y):
                yield x, y


def _crowded(crowds: DataFrame, rows: DataFrame, keep: Keep, length: int, least: tuple[int, int]) -> DataFrame:
    """Edges (a, b) that join what links between rows of different groups in a crowd join.

    First the sketches meet, and rows without a partner go; then the sets of those that are left. No
    pair is ever a row, and a cell's size is bounded, whatever the crowd's.
    """

    def met(table: pd.DataFrame) -> pd.DataFrame:
        some = np.zeros(len(table), bool)
        cell = _Cell(table, keep, least)
        for x, y in cell.partners():
            some[x] = True
            some[y] = True
        return cell.table.loc[some]

    def linked(table: pd.DataFrame) -> pd.DataFrame:
        cell = _Cell(table, keep, least)
        sets = [np.frombuffer(h, np.uint64) for h in cell.table["hashes"]]
        names, forest = np.unique(cell.group, return_inverse=True)
        tree = Forest(len(names))
        for x, y in cell.partners():
            y = y[tree.roots()[forest[y]] != tree.root(int(forest[x]))]  # what is joined already needs no look
            if not len(y):
                continue
            every = np.concatenate([sets[k] for k in y])
            at = np.minimum(np.searchsorted(sets[x], every), len(sets[x]) - 1)
            both = np.bincount(np.repeat(np.arange(len(y)), cell.n[y]), sets[x][at] == every, len(y))
            for k in y[both * least[1] >= least[0] * (cell.n[x] + cell.n[y] - both)].tolist():
                tree.join(int(forest[x]), int(forest[k]))
        roots = tree.roots()
        moved = np.flatnonzero(roots != np.arange(len(roots)))
        return pd.DataFrame({"a": names[roots[moved]], "b": names[moved]})

    def by_cell(of: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(table: pd.DataFrame) -> pd.DataFrame:
            give_back()
            return pd.concat([of(cell) for _, cell in table.groupby(CELL, sort=False)])

        return run

    # most cells are small: a task takes several of them at a time
    cells = stored(_cells(crowds), "cells")
    buckets = -(-cells.count() // (2 * BLOCK_ROWS)) + 1
    cells = cells.withColumn("bucket", F.pmod(F.xxhash64(*CELL), F.lit(buckets)))
    near = stored(cells.groupBy("bucket").applyInPandas(by_cell(met), cells.schema), "near")
    with_sets = near.join(_sets_of(rows, near, "row", length), "row")
    return with_sets.groupBy("bucket").applyInPandas(by_cell(linked), "a long, b long")


def firsts(rows: DataFrame, sketch: Callable[[np.ndarray], bytes], keep: Keep, length: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """(row): the smallest row of each group that links of similarity join, from (row, text) with whole numbers that are unique.

    All texts that meet in shingles of which a row is the smallest are that row's crowd. They are first
    compared with it, then those that are still in different groups with each other. sketch and keep
    decide which of them have their sets compared. Equal sets are one from the start. A text without words is similar to none. An empty
    table gives no rows.
    """
    heads = stored(_heads(rows, _common(rows, rows.count(), length), length, least, sketch), "heads")
    one = stored(heads.groupBy("same").agg(F.min("row").alias("row")).select("row"), "classes")
    facts = heads.select("row", "n", "sketch")
    every = heads.join(one, "row", "left_semi").select("row", F.explode("head").alias("shingle"))
    least_there = every.groupBy("shingle").agg(F.min("row").alias("least"), F.count("*").alias("times")).where("times > 1").drop("times")
    crowd = every.join(least_there, "shingle").where("row <> least").select(F.col("least").alias("a"), F.col("row").alias("b"))
    star = stored(crowd.distinct(), "crowds")
    side = lambda k, v: facts.select(F.col("row").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(v))
    sizes = f"least(na, nb) * {least[1]} >= greatest(na, nb) * {least[0]}"
    pairs = stored(_pruned(star.join(side("b", "y"), "b").join(side("a", "x"), "a").where(sizes), keep), "pairs")
    links = stored(_verified(pairs, rows, length, least), "links")
    group = stored(components(links), "groups")
    of = lambda table, k, into: table.join(group.select(F.col("node").alias(k), "component"), k, "left").withColumn(into, F.coalesce("component", k)).drop("component")
    member = of(of(star, "a", "first"), "b", "group").join(facts.withColumnRenamed("row", "b"), "b")
    member = stored(member.select(F.col("a").alias("crowd"), F.col("b").alias("row"), "group", "n", "sketch", (F.col("group") == F.col("first")).alias("home")), "members")
    more = stored(_crowded(member, rows, keep, length, least), "links")
    if more.limit(1).count():
        group = stored(components(links.unionByName(more)), "groups")
    return one.join(group.where("node <> component").select(F.col("node").alias("row")), "row", "left_anti")
