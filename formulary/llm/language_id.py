"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the average of its subwords' vectors: byte n-grams of its lower-cased letters, words
bounded by spaces, hashed to a fixed table. Table and softmax are trained together by stochastic
gradient descent. A temperature, and a score below which a text is rejected, are set on labelled
texts that were held back from training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formulary.llm.common import fold, per_text, tidied

#: At most about so many texts of each language, and about so many in all, are trained on, chosen by the hash of their id.
PER_LANGUAGE, IN_ALL = 1_500, 12_000
#: So many languages' counts, a few bytes each, are sent to all tasks; more are joined.
LISTED = 10_000
BITS, ORDERS, WIDTH = 11, (2, 3, 4), 16
EPOCHS, BATCH, RATE, SEED = 15, 64, 2.0, 3
#: A prediction is rejected below the score under which this share of right held-back predictions lies.
REJECTED = 0.01
UNKNOWN = "und"

_FOLDED = np.full(256, 32, np.uint8)
_FOLDED[97:123], _FOLDED[128:] = np.arange(97, 123), np.arange(128, 256)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def subwords(text: str) -> np.ndarray:
    """How often each slot of the table is hit, over all hits: the weights of the average."""
    raw = _FOLDED[np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8)]
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    raw = raw[keep].astype(np.uint32)
    out, code = np.zeros(len(ORDERS) << BITS, np.float32), raw
    for order in range(2, ORDERS[-1] + 1):
        code = code[: len(raw) - order + 1] * np.uint32(0x9E3779B1) + raw[order - 1 :]
        if order in ORDERS and len(code):
            k = ORDERS.index(order) << BITS
            out[k : k + (1 << BITS)] = np.bincount((code * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out / max(1.0, float(out.sum()))


@dataclass
class Model:
    """table: a vector for each slot; heads: a column for each language; temperature divides the logits."""

    languages: list[str]
    table: np.ndarray
    heads: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def __post_init__(self) -> None:
        self.slots = (self.table @ self.heads).astype(np.float32)  # averaging and the linear layer commute

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax((x @ self.slots + self.bias) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def packed(x: np.ndarray) -> bytes:
    """A row of weights without its zeros: places, then values in half precision."""
    at = np.flatnonzero(x)
    return at.astype("<u2").tobytes() + (x[at] * 1024).astype("<f2").tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), len(ORDERS) << BITS), np.float32)
    for row, raw in zip(out, rows, strict=True):
        half = len(raw) // 2
        row[np.frombuffer(raw[:half], "<u2")] = np.frombuffer(raw[half:], "<f2").astype(np.float32) / 1024
    return out


class Trainer:
    """Table, heads and bias, moved together by stochastic steps. Averages of many slots are small, so they are scaled up."""

    SCALE = 10.0

    def __init__(self, languages: int, rng: np.random.Generator) -> None:
        self.table = rng.normal(0, 0.1, (len(ORDERS) << BITS, WIDTH))
        self.heads, self.bias = np.zeros((WIDTH, languages)), np.zeros(languages)

    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        """Mean of the negative log probabilities of the right languages."""
        p = _softmax(self.SCALE * (x @ self.table) @ self.heads + self.bias)
        return float(-np.log(p[np.arange(len(y)), y]).mean())

    def slopes(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the loss by table, heads and bias."""
        mean = self.SCALE * (x @ self.table)
        off = _softmax(mean @ self.heads + self.bias)
        off[np.arange(len(y)), y] -= 1
        off /= len(y)
        return self.SCALE * x.T @ (off @ self.heads.T), mean.T @ off, off.sum(0)

    def step(self, x: np.ndarray, y: np.ndarray, rate: float) -> None:
        used = np.flatnonzero(x.any(0))
        mean = self.SCALE * (x[:, used] @ self.table[used])
        off = _softmax(mean @ self.heads + self.bias)
        off[np.arange(len(y)), y] -= 1
        off /= len(y)
        change = self.SCALE * x[:, used].T @ (off @ self.heads.T)
        self.heads -= rate * mean.T @ off
        self.bias -= rate * off.sum(0)
        self.table[used] -= rate * change


def fitted(rows: list[bytes], languages: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """A model of texts (packed subwords) with their languages. Every fifth text is held back for the temperature and the rejection."""
    names = sorted(set(languages))
    rng = np.random.default_rng(seed)
    t = Trainer(len(names), rng)
    if len(names) < 2:
        return Model(names, t.table, t.heads, t.bias, 1.0, 0.0)
    y, back = np.array([names.index(v) for v in languages]), np.arange(len(languages)) % 5 == 4
    own = np.flatnonzero(~back)
    for epoch in range(epochs):
        order = rng.permutation(own)
        for at in range(0, len(order), BATCH):
            k = order[at : at + BATCH]
            t.step(unpacked([rows[i] for i in k]), y[k], RATE * (1 - epoch / epochs))
    model = Model(names, t.SCALE * t.table, t.heads, t.bias, 1.0, 0.0)
    if back.any():
        x = unpacked([rows[i] for i in np.flatnonzero(back)])
        z = x @ model.slots + model.bias
        fits = [(-np.log(_softmax(z / t)[np.arange(len(z)), y[back]] + 1e-12).mean(), t) for t in 2.0 ** np.linspace(-4, 4, 65)]
        model.temperature = float(min(fits)[1])
        p = model.probabilities(x)
        right = p.max(1)[p.argmax(1) == y[back]]
        model.least = float(np.quantile(right, REJECTED)) if len(right) else 0.0
    return model


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> pd.DataFrame:
    """(x, lang, order): subwords, packed, of labelled documents, about as many of each language as the bounds allow and one at least, by the hash of id and text; those without a letter teach nothing, and repeated rows teach once. The driver gets no texts."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = rows.groupBy("lang").count()
    languages = counts.count()
    each = max(1, min(per_language, in_all // max(1, languages)))
    if languages <= LISTED:  # else texts would be dealt by language
        counts = F.broadcast(counts)
    slot = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1 << 30))
    some = rows.join(counts, "lang").where(slot < F.lit(float(1 << 30)) * each / F.col("count"))
    some = some.groupBy("lang", F.xxhash64("doc_id", "text", F.lit(17)).alias("h")).agg(F.min("text").alias("text"))
    some = some.select("text", "lang", F.pmod("h", F.lit(1 << 30)).alias("order"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[np.array([has_letter(t) for t in b["text"]], bool)]
            yield pd.DataFrame({"x": [packed(subwords(t)) for t in b["text"]], "lang": b["lang"].tolist(), "order": b["order"].tolist()}, columns=["x", "lang", "order"])

    return some.mapInPandas(tidied(pack), "x binary, lang string, order long").toPandas().sort_values(["order", "x"])


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected): one row per row of docs.

    The most likely language of the whole text and its calibrated probability; rejected marks scores
    below the model's bound. A null text or one without a letter is undetermined, at score 0, and
    rejected. Repeated rows are predicted each; an id may be null; an empty table gives no rows;
    other columns aren't read. With no languages learned every text is undetermined.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: list) -> list:
        m, out = held.value, []
        for text in texts:
            if not m.languages or not has_letter(text):
                out.append((UNKNOWN, 0.0, True))
                continue
            p = m.probabilities(subwords(text)[None, :])[0]
            k = int(p.argmax())
            out.append((m.languages[k], float(p[k]), bool(p[k] < m.least)))
        return list(zip(*out, strict=True)) if out else [[]] * 3

    return per_text(docs, id_col, text_col, lambda: predict, "lang_pred string, score double, rejected boolean")


def held_out_predictions(docs: DataFrame, of: int = 5, out: int = 0) -> DataFrame:
    """Learns from the labelled documents outside one fold of the ids and predicts all: the columns of predicted() with held_out."""
    known = sample(docs.where(fold(F.col("doc_id"), of) != out))
    rows = predicted(docs, fitted(known["x"].tolist(), known["lang"].tolist()))
    return rows.select("doc_id", (fold(F.col("doc_id"), of) == out).alias("held_out"), "lang_pred", "score", "rejected")
