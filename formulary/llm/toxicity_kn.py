"""Toxicity by two Kneser-Ney models, one of toxic texts and one of ordinary ones.

Each class has a model of word pairs that backs off to one of words. Both take modified Kneser-Ney
discounts off their counts; what is taken off a class's words goes to continuation counts (how many
different words come before a word) that both classes share, so an expression that is rare in both
says little, and words too rare to tell the classes apart are left to the shared counts alone. A
text's evidence is the difference of its two log-likelihoods over its tokens. A logistic curve of that
one number, fitted on documents that the counts were not made from, turns it into a probability.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formulary.llm.common import fold, per_text, stored, tidied

#: Bounds of the labelled documents that are fitted on, chosen by the hash of their id: about so many, of about so many bytes.
SAMPLE, SAMPLE_BYTES = 16_000, 24 << 20
#: Words and pairs seen less often in both classes together are left to the counts that both share.
LEAST_WORD, LEAST_PAIR = 5, 100
#: Beside what the discounts free, so many counts a word go to the shared continuation counts.
SHARED = 4.0
TOKEN = re.compile(r"\w+")
FOLDS = 5


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


@dataclass
class Model:
    """words: their numbers. word and pair: log p_toxic - log p_ordinary of each; pairs are named by keys, first * len(words) + second, sorted. curve: slope and constant."""

    words: dict[str, int]
    word: np.ndarray
    keys: np.ndarray
    pair: np.ndarray
    curve: tuple[float, float]

    def evidence(self, text: str | None) -> float:
        """Difference of the two log-likelihoods, over all tokens."""
        said = tokens(text)
        if not said or not self.words:
            return 0.0
        get = self.words.get
        code = np.fromiter((get(w, -1) for w in said), np.int64, len(said))
        return float(_evidence(code, np.ones(len(code) - 1, bool), self.word, self.keys, self.pair).sum() / len(said))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * evidence + self.curve[1], -40, 40)))


def _evidence(code: np.ndarray, near: np.ndarray, word: np.ndarray, keys: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Evidence of each token: that of the pair with the token before it (near says whether there is one), else the word's, else none."""
    if not len(word):
        return np.zeros(len(code))
    out = np.where(code >= 0, word[np.maximum(code, 0)], 0.0)
    if len(keys) and len(code) > 1:
        key = code[:-1] * len(word) + code[1:]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        known = near & (code[:-1] >= 0) & (code[1:] >= 0) & (keys[at] == key)
        out[1:] = np.where(known, pair[at], out[1:])
    return out


def _discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken off each count: three discounts from the counts of counts 1 to 4, for 1, for 2 and for more."""
    n = [max(1, int((counts == k).sum())) for k in range(1, 5)]
    d = n[0] / (n[0] + 2 * n[1])
    steps = [min(max(k - (k + 1) * d * n[k] / n[k - 1], 0.1), k) for k in (1, 2, 3)]
    return np.where(counts <= 0, 0, np.where(counts < 2, steps[0], np.where(counts < 3, steps[1], steps[2])))


def learned(code: np.ndarray, near: np.ndarray, toxic: np.ndarray, use: np.ndarray, v: int, least_word: int = LEAST_WORD, least_pair: int = LEAST_PAIR, shared: float = SHARED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word, keys and pair of a Model, from tokens as numbers (negative ones for words that are too rare, different ones for different words).

    near: whether a token and the next are of one text. toxic, use: of each token, whether its text is
    toxic, and whether it is counted. For a class c, with D the discounts, S the shared continuation
    counts as shares, N its counted words and W the number of words:
    p_c(w) = (n_c(w) - D + (sum of D + shared * W) * S(w)) / (N + shared * W)
    p_c(w | u) = (n_c(uw) - D) / n_c(u) + (what is left after u) * p_c(w)
    """
    here = use & (code >= 0)
    often = np.bincount(code[here], minlength=v) >= least_word
    after = near & use[:-1] & here[1:]
    before = np.full(v, 0.5)
    for k in range(8):  # a word and one before it, by eighths of the words: the driver's memory is small
        part = after & (code[1:] % 8 == k)
        before += np.bincount(np.unique(code[:-1][part] << 32 | code[1:][part]) & 0xFFFFFFFF, minlength=v)
    both = after & here[:-1]
    key = code[:-1][both] * v + code[1:][both]
    share = np.where(often, before, 0.0)
    share = share / max(share.sum(), 1e-12)
    keys, which, times = np.unique(key, return_inverse=True, return_counts=True)
    keep = (times >= least_pair) & often[keys % max(1, v)]
    kept, place, keys = keep[which], (np.cumsum(keep) - 1)[which], keys[keep]
    first, second = keys // max(1, v), keys % max(1, v)
    logs_word, logs_pair = [], []
    for label in (True, False):
        own = np.bincount(code[here & (toxic == label)], minlength=v).astype(float)
        n = np.where(often, own, 0.0)
        off = _discounts(n)
        extra = shared * often.sum()
        p = (n - off + (off.sum() + extra) * share) / max(n.sum() + extra, 1e-12)
        pairs = np.bincount(place[kept & (toxic[:-1][both] == label)], minlength=len(keys)).astype(float)
        cut = _discounts(pairs)
        left = 1 - np.bincount(first, pairs - cut, v) / np.maximum(own, 1)  # what pairs that are too rare have stays with the words
        logs_word.append(np.log(np.maximum(p, 1e-12)))
        logs_pair.append(np.log(np.maximum((pairs - cut) / np.maximum(own, 1)[first] + left[first] * p[second], 1e-12)))
    return np.where(often, logs_word[0] - logs_word[1], 0.0), keys, logs_pair[0] - logs_pair[1]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Newton's method on the penalised log-likelihood."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibrated(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and constant of a logistic curve of one value."""
    spread = float(values.std()) or 1.0
    a, b = _logistic(np.stack((values / spread, np.ones(len(values))), 1), labels.astype(float))
    return float(a / spread), float(b)


def constant(labels: np.ndarray) -> float:
    """The log odds of a label, where nothing else is known."""
    return float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learns: Column, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(text, y, order), stored: labelled documents to learn from, within the bounds, by the hash of their id. A document with conflicting labels has their largest; of rows with one id the one with the smallest text counts."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y")).where(learns)
    known = known.withColumn("order", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)))
    share = min(1.0, sample / max(1, known.count()))
    known = known.where(F.col("order") < int((1 << 30) * share))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")  # about as many as the bound
    rows = stored(rows.groupBy("doc_id", "y", "order").agg(F.min("text").alias("text")).select("text", "y", "order"), "labelled")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return rows if size <= most_bytes else rows.where(F.col("order") < int((1 << 30) * share * most_bytes / size))


def fitted(rows: DataFrame, least_word: int = LEAST_WORD) -> Model:
    """A model of labelled texts (text, y, order). Words are counted by the tasks; the driver gets those that are frequent enough, and texts as their numbers. The curve is fitted on evidence from counts without the text's own fold (order modulo FOLDS)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(tokens(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    often = rows.select("text").mapInArrow(tidied(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_word)
    names = sorted(r["word"] for r in often.select("word").collect())
    words = {w: k for k, w in enumerate(names)}
    told = rows.sparkSession.sparkContext.broadcast(words)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = told.value.get
        for b in batches:
            codes = [np.array([k if (k := get(w)) is not None else -1 - (zlib.crc32(w.encode("utf-8", "surrogatepass")) >> 1) for w in tokens(t)], np.int32).tobytes() for t in b["text"]]
            yield pd.DataFrame({"y": b["y"], "order": b["order"], "code": codes})

    table = rows.select("text", F.col("y").cast("int"), "order").mapInPandas(tidied(encode), "y int, order long, code binary").toPandas().sort_values(["order", "code"])
    labels = table["y"].to_numpy()
    if not words or not len(labels) or labels.min() == labels.max():  # no word is frequent enough, or no class has a contrast
        return Model({}, np.zeros(0), np.zeros(0, np.int64), np.zeros(0), (0.0, constant(labels)))
    size = np.array([len(c) // 4 for c in table["code"]])
    code = np.frombuffer(b"".join(table["code"]), np.int32).astype(np.int64)
    text = np.repeat(np.arange(len(size), dtype=np.int32), size)
    near, toxic, side = text[1:] == text[:-1], labels[text] == 1, (table["order"].to_numpy() % FOLDS)
    seen = np.zeros(len(size))
    for f in range(FOLDS):
        each = _evidence(code, near, *learned(code, near, toxic, (side != f)[text], len(words)))
        seen = np.where(side == f, np.bincount(text, each, len(size)) / np.maximum(size, 1), seen)
    return Model(words, *learned(code, near, toxic, np.ones(len(code), bool), len(words)), calibrated(seen, labels))


def scored(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, evidence): one row per row of docs.

    Whole texts are scored. A null or empty text, or one without word characters, has no evidence
    and scores the curve's constant. Repeated rows are scored each; an id may be null; an empty
    table gives no rows; other columns aren't read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list) -> list:
        seen = np.array([held.value.evidence(t) for t in texts], np.float64)
        p = held.value.probability(seen)
        return [p, (p >= threshold).astype(np.int32), seen]

    return per_text(docs, id_col, text_col, lambda: score, "score double, predicted int, evidence double")


def held_out_scores(docs: DataFrame, labels: DataFrame, of: int = 4, out: int = 2, threshold: float = 0.3) -> DataFrame:
    """Learns from labelled rows outside one fold of the ids and scores all: the columns of scored() with held_out."""
    model = fitted(labelled_sample(docs, labels, "toxic", fold(F.col("doc_id"), of) != out))
    rows = scored(docs, model, threshold)
    return rows.select("doc_id", (fold(F.col("doc_id"), of) == out).alias("held_out"), "score", "predicted", "evidence")
