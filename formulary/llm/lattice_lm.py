"""Subword lattice likelihood: the probability of a text, summed over all its segmentations.

A word's lattice has an edge for every piece of an existing vocabulary (its first piece begins with a
space), for every byte, and, if training has seen the word, one for the whole word. One forward
recursion in log space sums all its paths. Whole words are counted with a discount, and what is taken
off them is the probability of leaving by way of pieces: so the corpus itself says how likely unseen
words are. Pieces are drawn independently, weighted by the vocabulary's scores and by how often the
corpus is expected to use them. A text's probability is the product over its words, times the end's;
over all texts they sum to at most 1, as an unseen word pays for its spelling. The contract's base
score is no such distribution: it charges every unseen word as one unknown type, so on texts with
unseen words the two numbers measure different things and the base is the higher one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formulary.llm.common import ascii_words, fold, per_text, stored, tidied

#: Words that are looked up where they stand: the most frequent ones, as many as fit both bounds, are sent to all tasks. All others are joined.
HEAD_WORDS, HEAD_BYTES = 1 << 17, 4 << 20
#: Rounds of re-estimation of the pieces, each over every word type of the training rows, and how many pieces the vocabulary's scores count for.
ROUNDS, PRIOR = 1, 20_000
FLUSH, BASE = 300_000, 0x9E3779B97F4A7C15 | 1


def vocabulary(path: str) -> dict[bytes, float]:
    """Pieces and scores of a sentencepiece file. A leading space stands for the word's start; pieces that no lower-cased word can hold are left out."""
    from sentencepiece import SentencePieceProcessor

    sp, out = SentencePieceProcessor(model_file=path), {}
    for k in range(sp.get_piece_size()):
        piece = sp.id_to_piece(k)
        if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or "▁" in piece[1:]) and piece.encode() == piece.encode().lower():
            out[piece.replace("▁", " ").encode()] = sp.get_score(k)
    return out


class Lattice:
    """All segmentations of many words at once. logp: natural log probabilities of the pieces, then of the 256 bytes."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray) -> None:
        self.pieces, self.logp = pieces, logp
        self.longest = max(map(len, pieces), default=1)
        with np.errstate(over="ignore"):
            codes = np.array([self._code(p) for p in pieces], np.uint64)
        self._order = np.argsort(codes)
        self._codes = codes[self._order]
        self._slot = np.searchsorted(self._codes, np.arange((1 << 18) + 1, dtype=np.uint64) << np.uint64(46))

    @staticmethod
    def _code(piece: bytes) -> int:
        h = 0
        for b in reversed(piece):  # from the end, so that each longer piece ending there costs one step
            h = (h * BASE + b + 1) % (1 << 64)
        return (h * 0xD1342543DE82EF95) % (1 << 64)

    def _edges(self, words: np.ndarray, end: int) -> np.ndarray:
        """(longest + 1, words): the piece of each length that ends here, -1 for none; last the byte."""
        w, out = len(words), np.full((self.longest + 1, len(words)), -1, np.int32)
        chain = np.zeros(w, np.uint64)
        for length in range(1, min(self.longest, end) + 1):
            chain = chain * np.uint64(BASE) + words[:, end - length] + np.uint64(1)
            h = chain * np.uint64(0xD1342543DE82EF95)
            slot = (h >> np.uint64(46)).astype(np.int64)
            at, until = self._slot[slot], self._slot[slot + 1]
            todo = np.flatnonzero(at < until)
            while len(todo):
                k = at[todo]
                same = self._codes[k] == h[todo]
                out[length - 1][todo[same]] = self._order[k[same]]
                at[todo] += 1
                todo = todo[~same & (at[todo] < until[todo])]
        out[-1] = len(self.pieces) + words[:, end - 1].astype(np.int32)
        return out

    def _forward(self, words: np.ndarray, start: float = 0.0, whole: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Log sums of the paths to every place, from a start's weight on. whole: the weights of edges over whole words, which are not on the way of any other."""
        n, edges = words.shape[1], []
        total = np.full((n + 1, len(words)), -np.inf)
        total[0] = start
        for end in range(1, n + 1):
            e = self._edges(words, end)
            back = [max(0, end - length) for length in range(1, self.longest + 1)] + [end - 1]
            terms = np.where(e >= 0, total[back] + self.logp[e], -np.inf)
            if end == n and whole is not None:
                terms = np.concatenate((terms, whole[None, :]))
            top = terms.max(0)
            total[end] = top + np.log(np.exp(terms - top).sum(0))
            edges.append(e)
        return total, edges

    def _batches(self, words: list[bytes], most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes = np.array([len(w) for w in words])
        for size in np.unique(sizes):
            which = np.flatnonzero(sizes == size)
            step = max(1, min(most, 400_000 // (int(size) + 1)))
            for at in range(0, len(which), step):
                part = which[at : at + step]
                yield part, np.frombuffer(b"".join([b" " + words[k] for k in part]), np.uint8).reshape(len(part), -1).astype(np.uint64)

    def log_likelihoods(self, words: list[bytes], start: float = 0.0, whole: np.ndarray | None = None) -> np.ndarray:
        """Natural log of the summed probability of each word's segmentations; start and whole as logs, whole of -inf where a word has no such edge."""
        out = np.zeros(len(words))
        for part, rows in self._batches(words):
            out[part] = self._forward(rows, start, None if whole is None else whole[part])[0][-1]
        return out

    def expected(self, words: list[bytes], weights: np.ndarray) -> np.ndarray:
        """How often each piece is expected over the words' segmentations."""
        out = np.zeros(len(self.logp))
        for part, rows in self._batches(words):
            total, edges = self._forward(rows)
            n, weight = rows.shape[1], np.log(weights[part])
            after = np.full_like(total, -np.inf)
            after[n] = 0
            for end in range(n, 0, -1):
                e = edges[end - 1]
                for row in range(self.longest + 1):
                    begin = end - 1 if row == self.longest else end - row - 1
                    if begin < 0:
                        continue
                    here = e[row] >= 0
                    if here.any():
                        term = self.logp[e[row][here]] + after[end][here]
                        after[begin][here] = np.logaddexp(after[begin][here], term)
                        out += np.bincount(e[row][here], np.exp(total[begin][here] + term - total[n][here] + weight[here]), len(out))
        return out


def counted(docs: DataFrame, text_col: str, learns: Column) -> DataFrame:
    """(word, n): every word of the texts, lower-cased, with its count in the rows to learn from; the end of a text is the empty word. Combined in each task first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flushed() -> pd.DataFrame:
            learned, other = seen
            words = list(learned.keys() | other.keys())
            made = pd.DataFrame({"word": words, "n": [learned.get(w, 0) for w in words]})
            learned.clear(), other.clear()
            return made

        for b in batches:
            for text, learn in zip(b["_text"], b["_learns"], strict=True):
                words = ascii_words(text, lower=True)
                if learn:
                    words.append(b"")
                seen[0 if learn else 1].update(words)
            if len(seen[0]) + len(seen[1]) > FLUSH:
                yield flushed()
        yield flushed()

    rows = docs.select(F.col(text_col).alias("_text"), F.coalesce(learns, F.lit(False)).alias("_learns")).mapInPandas(tidied(count), "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


class Model:
    """What is learned: lexicon (word, n, base, logp), stored, and the totals. base and logp are log10.

    discount: taken off the count of each word, from how many words are seen once and twice. spelled:
    the share of all tokens that this frees for spelling.
    """

    def __init__(self, counts: DataFrame, pieces: dict[bytes, float], rounds: int = ROUNDS, prior_pieces: float = PRIOR) -> None:
        counts = stored(counts, "words")
        word = F.octet_length("word") > 0
        seen = lambda k: F.count_if(word & (F.col("n") == k))
        total = counts.agg(F.sum("n").alias("tokens"), F.count_if(F.col("n") > 0).alias("types"), F.count_if(word & (F.col("n") > 0)).alias("words"), seen(1).alias("once"), seen(2).alias("twice")).first()
        self.tokens, self.types = int(total["tokens"] or 0), int(total["types"] or 0)
        self.discount = total["once"] / (total["once"] + 2 * total["twice"]) if total["once"] else 0.5
        self.spelled = self.discount * total["words"] / self.tokens if total["words"] else 1.0
        names, ranks = list(pieces), -np.array(list(pieces.values()))
        prior = np.concatenate((1 / (10 + np.maximum(ranks, 0)), np.full(256, 1e-4)))  # scores are ranks: Zipf's law gives their weights
        prior /= prior.sum()
        self.lattice = Lattice(names, np.log(prior))
        learned = counts.where(word & (F.col("n") > 0)).select("word")
        for _ in range(rounds):  # every type counts once: spelling is for words that are rare or new
            found = self._expected(learned)
            self.lattice.logp = np.log((found + prior_pieces * prior) / (found.sum() + prior_pieces))
        lattice, n_all, off, start = self.lattice, max(1, self.tokens), self.discount, math.log(self.spelled)
        add = math.log10(self.tokens + 0.5 * (self.types + 1))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                words, n = b["word"].tolist(), b["n"].to_numpy()
                end = np.array([not w for w in words], bool)
                with np.errstate(divide="ignore"):
                    whole = np.log(np.where(n > 0, n - np.where(end, 0, off), 0) / n_all)
                logp = np.where(end, whole, lattice.log_likelihoods(words, start, whole)) / math.log(10)
                yield pd.DataFrame({"word": words, "n": n, "base": np.log10(n + 0.5) - add, "logp": np.maximum(logp, -1e300)})

        self.lexicon = stored(counts.mapInPandas(tidied(score), "word binary, n long, base double, logp double"), "lexicon")
        self.end = (math.log10(0.5) - add, math.log10(0.5) - add, 0)
        row = self.lexicon.where("octet_length(word) = 0 and n > 0").first()
        if row:
            self.end = (row["base"], row["logp"], row["n"])

    def _expected(self, learned: DataFrame) -> np.ndarray:
        """How often each piece is expected over all the words. Only these sums, one a piece, come to the driver."""
        lattice = self.lattice

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(len(lattice.logp))
            for b in batches:
                out += lattice.expected(b["word"].tolist(), np.ones(len(b)))
            some = np.flatnonzero(out)
            yield pd.DataFrame({"piece": some, "x": out[some]})

        sums = learned.mapInPandas(tidied(expect), "piece int, x double").groupBy("piece").agg(F.sum("x").alias("x")).collect()
        found = np.zeros(len(lattice.logp))
        found[[r["piece"] for r in sums]] = [r["x"] for r in sums]
        return found

    def head(self, most: int = HEAD_WORDS, most_bytes: int = HEAD_BYTES) -> dict[bytes, tuple[int, float, float]]:
        """The most frequent words, as many as fit the bounds without cutting through words of one count."""
        words = self.lexicon.where(F.octet_length("word") > 0)
        least, held, size = None, 0, 0
        for r in words.groupBy("n").agg(F.count("*").alias("words"), F.sum(F.octet_length("word")).alias("bytes")).orderBy(F.desc("n")).toLocalIterator():
            held, size = held + r["words"], size + r["bytes"]
            if held > most or size > most_bytes:
                break
            least = r["n"]
        if least is None:
            return {}
        return {bytes(r["word"]): (r["n"] > 0, r["base"], r["logp"]) for r in words.where(F.col("n") >= least).collect()}


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score): one row per row of docs.

    The texts' frequent words are scored where they stand. The others, all of them rarer than those, are
    joined to the lexicon, one row for each text and word. A null or empty text is its
    end alone. Repeated rows are scored each; an id may be null; an empty table gives no rows; other
    columns of docs aren't read. A word of many thousand bytes is spelled like any other.
    """
    spark, known, end = docs.sparkSession, model.head(), model.end
    head = spark.sparkContext.broadcast(known)

    def start():
        from pyspark import TaskContext

        keys, get = count(TaskContext.get().partitionId() << 33), head.value.get

        def first(texts: list) -> list[list]:
            out = []
            for text in texts:
                words = ascii_words(text, lower=True)
                got = list(map(get, words))
                rest = Counter([w for w, g in zip(words, got, strict=True) if g is None]) if None in got else {}
                facts = [g for g in got if g is not None]
                known = int(end[2] > 0) + sum([g[0] for g in facts])
                out.append((next(keys), len(words) + 1, known, end[0] + math.fsum([g[1] for g in facts]), end[1] + math.fsum([g[2] for g in facts]), [{"word": w, "times": c} for w, c in rest.items()]))
            return list(zip(*out, strict=True)) if out else [[]] * 6

        return first

    fields = "key long, n_tokens long, n_known long, base_score double, score double, rest array<struct<word:binary,times:long>>"
    rows = stored(per_text(docs, id_col, text_col, start, fields), "heads")
    rest = rows.select("key", F.explode("rest").alias("r")).select("key", "r.word", "r.times").join(model.lexicon, "word")
    sums = rest.groupBy("key").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(F.col("times") * F.col("base")).alias("b"), F.sum(F.col("times") * F.col("logp")).alias("s"))
    plus = lambda c, x: (F.col(c) + F.coalesce(F.col(x), F.lit(0))).alias(c)
    return rows.drop("rest").join(sums, "key", "left").select("doc_id", "n_tokens", plus("n_known", "k"), plus("base_score", "b"), plus("score", "s"))


def held_out_scores(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", of: int = 5, out: int = 1) -> DataFrame:
    """Learns from the rows outside one fold of the ids and scores all: the columns of scored() with held_out and train_tokens."""
    model = Model(counted(docs, text_col, fold(F.col(id_col), of) != out), vocabulary(vocabulary_path))
    rows = scored(docs, model, id_col, text_col)
    return rows.select("doc_id", (fold(F.col("doc_id"), of) == out).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
