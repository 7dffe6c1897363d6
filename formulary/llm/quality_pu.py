"""Quality classifier from positive and unlabelled texts, by non-negative unbiased risk.

Trusted positives are documents labelled good; unlabelled ones are the web text at large, good and
bad. With the class prior the risk of calling a document bad is estimated from both without a
single negative: the unlabelled risk less what positives contribute to it, held at zero so that the
model can't fit noise below it. The prior comes from a model that tells trusted positives from
unlabelled texts: where it leaves the smallest share of the unlabelled for the share of held-back
positives, what is left are positives. Steps on a labelled sample, its labels unread, start the model; then
the risk is taken over every unlabelled document there is. The features are hashed byte n-grams of texts whose letters and
digits are folded to shapes, and how often words repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formulary.llm.common import fold, per_text, small_batches, tidied
from formulary.llm.toxicity_kn import calibrated, constant, labelled_sample

#: Labelled documents that are fitted on, about, chosen by the hash of their id: half of them are trusted if good, half fit the curve.
SAMPLE = 8_000
#: Steps over all unlabelled documents, after the sample's.
WHOLE_STEPS = 3
BITS, ORDERS = 10, (1, 2, 3)
EPOCHS, BATCH, RATE, PENALTY, SEED = 12, 256, 0.5, 1e-4, 5
#: The class prior: bins of a margin, how far they reach, the chance and the weight of the bound, and the trusted positives that it needs.
BINS, SPAN, DOUBT, GAMMA, LEAST_HELD = 4096, 30.0, 0.1, 0.01, 20

#: Bytes as shapes: capitals, small letters, digits, bytes of other letters, white space; punctuation stays itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:], _SHAPE[9:14] = 65, 97, 48, 97, 32
_SHAPE[10] = 10


def features(text: str | None) -> np.ndarray:
    """One row of the design: frequencies of hashed shape n-grams, square-rooted, then the text's repetition. No text is all zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = 1 << BITS
    out = np.zeros(len(ORDERS) * size + 4, np.float32)
    if not raw:
        return out
    shape = _SHAPE[np.frombuffer(raw, np.uint8)]
    keep = np.ones(len(shape), bool)
    keep[2:] = (shape[2:] != shape[1:-1]) | (shape[2:] != shape[:-2])  # runs of one shape count as two
    shape = shape[keep].astype(np.uint32)
    code = np.zeros(len(shape), np.uint32)
    for k, order in enumerate(ORDERS):
        code = code[: len(shape) - order + 1] * np.uint32(0x9E3779B1) + shape[order - 1 :] + np.uint32(1)
        if len(code):
            slot = (code * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
            out[k * size : (k + 1) * size] = np.sqrt(np.bincount(slot, minlength=size) / len(code))
    words = raw.split()
    if words:
        lines = [x for x in raw.split(b"\n") if x.strip()]
        pairs = set(zip(words, words[1:], strict=False))
        out[-4:] = len(set(words)) / len(words), len(pairs) / max(1, len(words) - 1), len(set(lines)) / max(1, len(lines)), min(1.0, np.log1p(len(words)) / 10)
    return out


WIDTH = len(ORDERS) * (1 << BITS) + 4


def packed(x: np.ndarray) -> bytes:
    """A row of features without its zeros: places, then values in half precision."""
    at = np.flatnonzero(x)
    return at.astype("<u2").tobytes() + x[at].astype("<f2").tobytes()


def unpacked(rows: list[bytes], width: int = WIDTH) -> np.ndarray:
    out = np.zeros((len(rows), width), np.float32)
    for row, raw in zip(out, rows, strict=True):
        half = len(raw) // 2
        row[np.frombuffer(raw[:half], "<u2")] = np.frombuffer(raw[half:], "<f2")
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    curve: tuple[float, float]
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * margin + self.curve[1], -40, 40)))


def loss(x: np.ndarray, w: np.ndarray, good: bool) -> tuple[float, np.ndarray]:
    """Sum of the sigmoid losses of calling rows good (or bad), and its slope. The last weight is the bias."""
    sign = 1.0 if good else -1.0
    lost = 1 / (1 + np.exp(np.clip(sign * (x @ w[:-1] + w[-1]), -30, 30)))
    d = -sign * lost * (1 - lost)
    return float(lost.sum()), np.append(d @ x, d.sum())


def risk(prior: float, positive: float, unlabelled: float) -> float:
    """Non-negative risk from the mean losses of positives as good and of unlabelled rows as bad. The sigmoid loss of positives as bad is one less theirs as good."""
    return prior * positive + max(0.0, unlabelled - prior * (1 - positive))


def slope(prior: float, positive: tuple[float, np.ndarray], unlabelled: tuple[float, np.ndarray]) -> np.ndarray:
    """The slope of the risk, from mean losses and their slopes. Where its second part is below zero, the step goes against that part instead."""
    bad = unlabelled[1] + prior * positive[1]
    return prior * positive[1] + bad if unlabelled[0] - prior * (1 - positive[0]) >= 0 else -bad


def mean_loss(x: np.ndarray, w: np.ndarray, good: bool) -> tuple[float, np.ndarray]:
    value, change = loss(x, w, good)
    return value / len(x), change / len(x)


class Steps:
    """Weights moved down a slope, each weight by its own pace."""

    def __init__(self, width: int) -> None:
        self.w, self.speed = np.zeros(width + 1), np.full(width + 1, 1e-6)

    def take(self, change: np.ndarray) -> None:
        change = change + np.append(PENALTY * self.w[:-1], 0)
        self.speed += change * change
        self.w = self.w - RATE * change / np.sqrt(self.speed)


def nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = SEED) -> Steps:
    """Weights that lower the non-negative risk, by stochastic steps."""
    return _stochastic(positive, unlabelled, lambda p, u: slope(prior, p, u), epochs, seed)


def told_apart(positive: np.ndarray, unlabelled: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Steps:
    """Weights that tell positives from unlabelled rows, both sides counting alike."""
    return _stochastic(positive, unlabelled, lambda p, u: (p[1] + u[1]) / 2, epochs, seed)


def _stochastic(positive: np.ndarray, unlabelled: np.ndarray, change: Callable, epochs: int, seed: int) -> Steps:
    rng, steps = np.random.default_rng(seed), Steps(positive.shape[1])
    count = max(1, len(unlabelled) // BATCH)
    for _ in range(epochs):
        p_order = np.concatenate([rng.permutation(len(positive)) for _ in range(-(-count * BATCH // len(positive)))])
        u_order = rng.permutation(len(unlabelled))
        for k in range(count):
            part = slice(k * BATCH, (k + 1) * BATCH)
            steps.take(change(mean_loss(positive[p_order[part]], steps.w, True), mean_loss(unlabelled[u_order[part]], steps.w, False)))
    return steps


def whole_loss(docs: DataFrame, w: np.ndarray, text_col: str = "text") -> tuple[float, np.ndarray] | None:
    """Mean loss of all documents as bad, and its slope; None without documents. Tasks send their sums, which are added up before they come to the driver."""
    small_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(w)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(WIDTH + 3), 0
        for b in batches:
            for at in range(0, len(b), 256):
                x = np.stack([features(t) for t in b["text"].iloc[at : at + 256]])
                lost, change = loss(x, told.value, False)
                total += np.concatenate(([lost, len(x)], change))
                n += len(x)
        if n:
            yield pd.DataFrame({"slot": np.arange(len(total)), "x": total})

    sums = docs.select(F.col(text_col).alias("text")).mapInPandas(tidied(add), "slot int, x double").groupBy("slot").agg(F.sum("x").alias("x")).collect()
    if not sums:
        return None
    total = np.zeros(WIDTH + 3)
    total[[r["slot"] for r in sums]] = [r["x"] for r in sums]
    return total[0] / total[1], total[2:] / total[1]


def whole_margins(docs: DataFrame, w: np.ndarray, text_col: str = "text") -> np.ndarray:
    """How many of all documents have a margin in each of BINS equal bins from -SPAN to SPAN. Tasks send counts."""
    small_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(w)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(BINS, np.int64)
        for b in batches:
            n += np.bincount(binned(np.array([features(t) @ told.value[:-1] for t in b["text"]]) + told.value[-1]), minlength=BINS)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"bin": at, "n": n[at]})

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(tidied(count), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BINS, np.int64)
    out[[r["bin"] for r in rows]] = [r["n"] for r in rows]
    return out


def binned(margins: np.ndarray) -> np.ndarray:
    return np.clip((margins + SPAN) * (BINS / (2 * SPAN)), 0, BINS - 1).astype(np.int64)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from both sides' counts by bin of a score that tells them apart.

    Above any score, at least so many of the unlabelled must be there as positives make up, so the
    ratio of the two sides' shares above it bounds the prior; the bin where that bound is least, with
    what chance may add on either side, gives the estimate.
    """
    n_p, n_u = positive.sum(), unlabelled.sum()
    above_p, above_u = (np.cumsum(c[::-1])[::-1] / max(1, c.sum()) for c in (positive, unlabelled))
    doubt = np.sqrt(np.log(4 / DOUBT) / (2 * max(1, n_p))) + np.sqrt(np.log(4 / DOUBT) / (2 * max(1, n_u)))
    use = above_p > 0
    bound = np.where(use, (above_u + (1 + GAMMA) * doubt) / np.where(use, above_p, 1), np.inf)
    at = int(np.argmin(bound))
    return float(np.clip(above_u[at] / above_p[at], 0.01, 0.99))


def fitted(labelled: DataFrame, unlabelled: DataFrame, whole_steps: int = WHOLE_STEPS) -> Model:
    """A model of labelled texts (text, y, order) and of all unlabelled ones.

    Of the labelled, those with an even order are trusted if good; the others serve as unlabelled at
    the start, and fit the curve from margins to probabilities. The class prior is estimated from
    trusted positives that were held back and from the scores of all unlabelled texts; with fewer than
    LEAST_HELD of them, or no unlabelled text, it is the good ones' share of the others.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "order": b["order"], "x": [packed(features(t)) for t in b["text"]]})

    table = labelled.select("text", F.col("y").cast("int"), "order").mapInPandas(tidied(pack), "y int, order long, x binary").toPandas().sort_values(["order", "x"])
    even = table["order"] % 2 == 0
    trusted, rest = table[even & (table["y"] == 1)], table[~even]
    labels = rest["y"].to_numpy()
    prior = float((labels.sum() + 1) / (len(labels) + 2)) if len(labels) else 0.5
    if not len(trusted) or not len(rest):
        return Model(np.zeros(WIDTH), 0.0, (0.0, float(np.log(prior / (1 - prior)))), prior)
    positive, wild = unpacked(trusted["x"].tolist()), unpacked(rest["x"].tolist())
    if len(positive[1::2]) >= LEAST_HELD:
        apart = told_apart(positive[::2], wild).w
        there = whole_margins(unlabelled, apart)
        if there.sum():
            held = np.bincount(binned(positive[1::2] @ apart[:-1] + apart[-1]), minlength=BINS)
            prior = estimated_prior(held, there)
    steps = nnpu(positive, wild, prior)
    for _ in range(whole_steps):
        found = whole_loss(unlabelled, steps.w)
        if found:
            steps.take(slope(prior, mean_loss(positive, steps.w, True), found))
    model = Model(steps.w[:-1], float(steps.w[-1]), (0.0, constant(labels)), prior)
    if labels.min() != labels.max():
        model.curve = calibrated(model.margin(wild), labels)
    return model


def scored(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted): one row per row of docs.

    Whole texts are scored. A null or empty text has no features and scores the constant. Repeated
    rows are scored each; an id may be null; an empty table gives no rows; other columns aren't read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list) -> list:
        m = held.value
        p = m.probability(np.array([features(t) @ m.weights for t in texts]) + m.bias)
        return [p, (p >= threshold).astype(np.int32)]

    return per_text(docs, id_col, text_col, lambda: score, "score double, predicted int")


def held_out_scores(docs: DataFrame, labels: DataFrame, of: int = 4, out: int = 2, threshold: float = 0.7) -> DataFrame:
    """Learns from labelled rows outside one fold of the ids and from unlabelled text, and scores all: the columns of scored() with held_out."""
    learns = fold(F.col("doc_id"), of) != out
    model = fitted(labelled_sample(docs, labels, "quality", learns, SAMPLE), docs.where(learns))
    rows = scored(docs, model, threshold)
    return rows.select("doc_id", (fold(F.col("doc_id"), of) == out).alias("held_out"), "score", "predicted")
