"""Mixing sources to target weights, by fixed-length blocks of words.

Every source is a stream of its documents' words, cut into blocks of a fixed length. Each output
shard draws how many of its slots go to each source; a source's j-th slot maps through a
pseudorandom permutation of that source's block numbers (a new one each time round), and slots join
blocks by number. Only counts by source and by shard ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formulary.llm.common import SPACE, WORD, fresh, keyed, mix64, stored, tidied

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BLOCK, SEED = 128, 20240
#: Slots of a shard, and the most shards: beyond, shards grow instead.
SHARD, SHARDS = 1 << 16, 4096
#: Documents that one stretch of a source's stream holds, about, and stretches whose places are summed in one task.
STRETCH, SUMMED = 500, 4096
#: Sources up to which their few facts are broadcast.
LISTED = 10_000


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words to take from each source. Weights repeat over the sources by code point, null last; what is over a source's limit is shared again by weight."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out: dict[str | None, float] = {}
    left, free = share * sum(sizes.values()), list(names)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        free = [s for s in free if s not in over]
    return out


def shard_counts(slots: np.ndarray, shard: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources): how many slots of each shard go to each source.

    Multinomial draws by what every source still has to give, repeated over the slots that a source
    that ran out left open: shards vary at random and the columns sum to the planned slots.
    """
    left, rows = slots.astype(np.int64).copy(), []
    while left.sum():
        rng = np.random.default_rng([seed, len(rows)])
        row, n = np.zeros_like(left), min(shard, int(left.sum()))
        while n:
            got = np.minimum(rng.multinomial(n, left / left.sum()), left)
            row, left, n = row + got, left - got, n - int(got.sum())
        rows.append(row)
    return np.array(rows, np.int64).reshape(len(rows), len(slots))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """index through a pseudorandom permutation of 0..size-1 chosen by key: a four-round Feistel network, walked until it lands inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    size = size.astype(np.uint64)
    while todo.any():
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        a, b = x >> h, x & m
        for r in range(4):
            a, b = b, a ^ (mix64(b + k + np.uint64(r * 0x9E3779B97F4A7C15 % (1 << 64))) & m)
        out[todo] = a << h | b
        todo[todo] = out[todo] >= size[todo]
    return out.astype(np.int64)


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, tie): tie tells rows without an id, or with the same, apart by their text."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(text_col).alias("tie"))


class Mix:
    """A mix of documents.

    sizes: (doc_id, source, size), stored, a row for each of docs. plan: source, its size, target and
    slots. slots(): every slot with its shard, source and block. pieces(): which words of which
    document a block holds. taken(): words taken of every document. spans(): the runs taken.

    A null or empty text has size 0 and gives no words. A null source is a source. Repeated rows are
    documents of their own; rows with a null id too. An empty table gives an empty mix. Other columns
    of docs aren't read. Sources are few enough to list on the driver (labels of a mix, not hosts).
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = SEED) -> None:
        self.block, self.seed, self.spark = block, seed, docs.sparkSession
        self.sizes = stored(sized(docs, id_col, text_col, source_col), "sizes")
        totals = self.sizes.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()
        self.stretches = max(1, -(-sum(r["docs"] for r in totals) // STRETCH))
        spread = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("tie")), F.lit(seed))
        stretch = F.pmod(spread, F.lit(self.stretches)).cast("int")
        within = Window.partitionBy("source", "stretch").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
        placed = self.sizes.where("size > 0").withColumn("stretch", stretch).withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
        blocks = placed.groupBy("source", "stretch").agg(F.ceil(F.sum("size") / block).cast("long").alias("blocks"))
        blocks = stored(blocks.withColumn("part", F.floor(F.col("stretch") / SUMMED)), "stretches")
        # the first block of a stretch: what comes before its part, and before it in its part
        sums = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
        parts = blocks.groupBy("source", "part").agg(F.sum("blocks").alias("n"))
        parts = parts.select("source", "part", F.coalesce(F.sum("n").over(sums("source", "part")), F.lit(0)).alias("before"))
        same = lambda a, b, k: a["source"].eqNullSafe(b["source"]) & (a[k] == b[k])
        first = blocks.withColumn("first", F.coalesce(F.sum("blocks").over(sums("source", "part", "stretch")), F.lit(0)))
        first = first.alias("b").join(parts.alias("p"), same(first, parts, "part")).select("b.source", "b.stretch", (F.col("b.first") + F.col("p.before")).alias("first"))
        self._placed = placed.alias("p").join(first.alias("b"), same(placed, first, "stretch")).select("p.*", "b.first")
        count = {r["source"]: r["n"] for r in blocks.groupBy("source").agg(F.sum("blocks").alias("n")).collect()}
        self.totals = {r["source"]: r["n"] for r in totals}
        self.targets = targets(self.totals, weights, share, most)
        self.names = [s for s in self.targets if count.get(s)]
        self.n_blocks = np.array([count[s] for s in self.names], np.int64)
        wanted = [round(self.targets[s] * count[s] / self.totals[s]) for s in self.names]
        self.n_slots = np.minimum(np.array(wanted, np.int64), (most * self.n_blocks).astype(np.int64))
        total = int(self.n_slots.sum())
        self.shard = max(SHARD, -(-total // SHARDS))
        self.counts = shard_counts(self.n_slots, self.shard, seed)

    def slots(self) -> DataFrame:
        """(shard, slot, source_no, block): one row per slot of the output."""
        counts, n_blocks, shard, seed, total = self.counts, self.n_blocks, self.shard, self.seed, int(self.n_slots.sum())
        upto = counts.cumsum(1)
        before = np.vstack((np.zeros((1, counts.shape[1]), np.int64), counts.cumsum(0)))

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                at = b["id"].to_numpy(np.int64)
                s, k = at // shard, at % shard
                source, j = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
                for one in np.unique(s):
                    here = s == one
                    source[here] = np.searchsorted(upto[one], k[here], "right")
                    j[here] = k[here] - (upto[one] - counts[one])[source[here]] + before[one][source[here]]
                n = n_blocks[source]
                key = mix64((source * 1_000_003 + j // n).astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))
                yield pd.DataFrame({"shard": s, "slot": k, "source_no": source.astype(np.int32), "block": permuted(j % n, n, key)})

        return self.spark.range(total).mapInPandas(tidied(draw), "shard long, slot long, source_no int, block long")

    def _labelled(self, rows: DataFrame, *facts: str) -> DataFrame:
        """rows with facts of their source: its source_no (of those with words), source_size and target."""
        number = {s: k for k, s in enumerate(self.names)}
        listed = [(s, number.get(s), int(n), float(self.targets[s])) for s, n in self.totals.items()]
        known = self.spark.createDataFrame(listed, "name string, source_no int, source_size long, target double").select("name", *facts)
        if len(listed) <= LISTED:
            known = F.broadcast(known)
        return rows.join(known, rows["source"].eqNullSafe(known["name"]), "left").drop("name")

    def pieces(self) -> DataFrame:
        """(source_no, block, doc_id, source, size, start, first, from_word, to_word): the words of each document in each block."""
        b = self.block
        rows = self._labelled(self._placed, "source_no")
        rows = rows.withColumn("k", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
        return rows.select(
            "source_no",
            (F.col("first") + F.col("k")).alias("block"),
            *("doc_id", "source", "size", "tie", "start", "stretch"),
            F.greatest(F.lit(0), F.col("k") * b - F.col("start")).cast("long").alias("from_word"),
            F.least(F.col("size"), (F.col("k") + 1) * b - F.col("start")).cast("long").alias("to_word"),
        )

    def mixed(self) -> DataFrame:
        """pieces() with times, how often the mix holds each: slots joined to blocks by number."""
        times = self.slots().groupBy("source_no", "block").agg(F.count("*").alias("times"))
        return self.pieces().join(times, ["source_no", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken): one row per row of docs."""
        own = ["doc_id", "source", "size", "tie", "start", "stretch"]
        some = self.mixed().groupBy(*own).agg(F.sum(F.col("times") * (F.col("to_word") - F.col("from_word"))).cast("long").alias("taken"))
        none = self.sizes.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("taken"))
        every = some.select("doc_id", "source", "size", "taken").unionByName(none)
        return self._labelled(every, "source_size", "target").select("doc_id", "size", "source_size", "target", "taken")

    def spans(self) -> DataFrame:
        """(doc_id, copy, from_word, to_word, size): the longest runs of a document's words that the mix holds at least copy times."""
        rows = self.mixed().where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
        run = Window.partitionBy("doc_id", "start", "source_no", "stretch", "copy").orderBy("block")
        rows = rows.withColumn("run", F.col("block") - F.row_number().over(run))
        return rows.groupBy("doc_id", "start", "source_no", "stretch", "size", "copy", "run").agg(F.min("from_word").alias("from_word"), F.max("to_word").alias("to_word")).drop("run", "start", "source_no", "stretch")


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix as rows with the columns of docs: a row for each run of words taken, a whole document keeping its text as it was.

    Runs of a part of a document are its words joined by single spaces; n_chars follows the text.
    Every row is a document, also rows without an id, rows that share one, and repeated rows. Rows
    without words (null and empty texts) are not taken. An empty table gives no rows; other columns
    may have any names.
    """
    key = fresh(docs, "_row")
    rows = keyed(docs, key)
    runs = Mix(rows, id_col=key, **how).spans()
    out = rows.select(F.col(key).alias("doc_id"), F.struct("*").alias("doc")).join(runs, "doc_id")
    text = F.col("doc.text")
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    part = F.array_join(F.slice(words, (F.col("from_word") + 1).cast("int"), (F.col("to_word") - F.col("from_word")).cast("int")), " ")
    text = F.when((F.col("from_word") == 0) & (F.col("to_word") == F.col("size")), text).otherwise(part)
    doc = F.col("doc").withField("text", text)
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(doc.alias("doc")).select("doc.*").select(docs.columns)
