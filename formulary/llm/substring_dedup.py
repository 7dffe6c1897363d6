"""Exact substring de-duplication with fixed-block anchors.

A run of 50 words that two documents share holds at least one whole block of 25 words of the first
document's own grid. So the index files the non-overlapping blocks of every document, and every
rolling window of 25 words probes it. Where a probe meets another document's block, the match is
extended: the 50-word windows around it are compared whole, each against the smallest document that
has it, and neighbouring windows join to maximal repeats.

Documents are dealt into buckets of a few megabytes. A bucket sends each window once however often
it repeats there, as packed integers by groups of keys; what comes back names only windows that
repeat. No pair of documents is ever formed, so a passage in a third of all documents costs one
entry a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formulary.llm.common import Rolling, fresh, give_back, keyed, settled, stored

SPAN, BUCKET_BYTES, GROUP_WINDOWS = 50, 4 << 20, 2_000_000
#: Null ids come after all others.
LAST = np.iinfo(np.int64).max
_SENT = "g int, bucket int, keys binary, counts array<int>"
_BACK = "bucket int, keys binary, owners binary"


def _light(of):
    """A function of a group, or of two, that gives memory back after each."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        give_back()
        return of(group)

    def two(group: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        give_back()
        return of(group, back)

    return two if of.__code__.co_argcount == 2 else one


class _Bucket:
    """The documents of one bucket, with the hashes of all their windows."""

    def __init__(self, group: pd.DataFrame, span: int, groups: int, length: int) -> None:
        roll = Rolling()
        group = group.sort_values("_order", kind="stable")
        self.ids = group["_order"].to_numpy(np.int64)
        self.raw = [(t or "").encode("utf-8", "surrogatepass") for t in group["_text"]]
        self.edges, lo, hi, self.at = [], [], [], [0]
        for raw in self.raw:
            words, start, end = roll.words(raw)
            self.edges.append((start, end))
            lo.append(roll.runs(words, length))
            hi.append(roll.runs(words, length, salt=0x632BE59BD9B4E019) % np.uint64(groups))
            self.at.append(self.at[-1] + len(lo[-1]))
        self.key = np.concatenate(lo) if lo else np.empty(0, np.uint64)
        self.group = np.concatenate(hi).astype(np.int64) if hi else np.empty(0, np.int64)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.at))
        self.place = np.arange(len(self.key)) - np.array(self.at)[self.doc]


def _rising(x: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], x[1:] != x[:-1])) if len(x) else np.empty(0, bool)


def _probe(group: pd.DataFrame, block: int, groups: int) -> pd.DataFrame:
    """What a bucket tells the index: its distinct windows, in four runs (in one document or several, on the grid or not)."""
    b = _Bucket(group, 0, groups, block)
    if not len(b.key):
        return pd.DataFrame(columns=["g", "bucket", "keys", "counts"])
    short = (b.group.astype(np.uint64) << np.uint64(32)) | (b.key >> np.uint64(32))
    order = np.argsort(short, kind="stable")
    key, doc, grid = short[order], b.ids[b.doc[order]], (b.place[order] % block == 0)
    first = np.flatnonzero(_rising(key))
    last = np.append(first[1:], len(key)) - 1
    kind = 2 * (doc[first] != doc[last]) + np.logical_or.reduceat(grid, first)
    key = key[first]
    where = (key >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((kind, where))
    where, kind, low = where[order], kind[order], (key[order] & np.uint64(0xFFFFFFFF)).astype("<u4")
    cut = np.flatnonzero(_rising(where))
    out = [(int(where[s]), int(group["bucket"].iloc[0]), low[s:e].tobytes(), np.bincount(kind[s:e], minlength=4).tolist()) for s, e in zip(cut, np.append(cut[1:], len(where)), strict=True)]
    return pd.DataFrame(out, columns=["g", "bucket", "keys", "counts"])


def _index(sent: pd.DataFrame) -> pd.DataFrame:
    """For each bucket, its windows that another document has too, with the grid block of one of them."""
    keys = [np.frombuffer(k, "<u4") for k in sent["keys"]]
    kind = np.concatenate([np.repeat(np.arange(4), c) for c in sent["counts"]])
    size = np.array([len(k) for k in keys])
    value, where = np.unique(np.concatenate(keys), return_inverse=True)
    several = np.bincount(where, weights=1 + (kind >= 2), minlength=len(value)) >= 2
    good = several & (np.bincount(where, weights=kind % 2, minlength=len(value)) > 0)
    hit, at, out = good[where], np.concatenate(([0], np.cumsum(size))), []
    g = np.uint64(int(sent["g"].iloc[0]) << 32)
    for k, bucket in enumerate(sent["bucket"]):
        here = keys[k][hit[at[k] : at[k + 1]]]
        if len(here):
            out.append((int(bucket), (np.sort(here).astype(np.uint64) | g).tobytes(), b""))
    return pd.DataFrame(out, columns=["bucket", "keys", "owners"])


def _joined(back: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    key = np.frombuffer(b"".join(back["keys"]), np.uint64)
    owner = np.frombuffer(b"".join(back["owners"]), np.int64)
    order = np.argsort(key, kind="stable")
    return key[order], owner[order] if len(owner) else owner


def _find(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at


def _extend(group: pd.DataFrame, back: pd.DataFrame, span: int, block: int, groups: int, whole_groups: int) -> pd.DataFrame:
    """The whole windows around a bucket's hits: each distinct one with the smallest document that has it here."""
    none = pd.DataFrame(columns=["g", "bucket", "keys", "counts", "owners"])
    if not len(group) or not len(back):
        return none
    b = _Bucket(group, span, groups, block)
    short = (b.group.astype(np.uint64) << np.uint64(32)) | (b.key >> np.uint64(32))
    hit, _ = _find(short, _joined(back)[0])
    w = _Bucket(group, span, whole_groups, span)
    if not len(w.key):
        return none
    seen = np.concatenate(([0], np.cumsum(hit)))
    start = np.array(b.at)[w.doc] + w.place  # a window of 50 words begins where its first window of 25 does
    near = seen[start + span - block + 1] > seen[start]
    key, g, owner = w.key[near], w.group[near], w.doc[near]
    order = np.lexsort((owner, key, g))
    key, g, owner = key[order], g[order], owner[order]
    first = np.flatnonzero(_rising(key) | _rising(g))
    several = b.ids[owner[np.append(first[1:], len(key)) - 1]] != b.ids[owner[first]] if len(first) else np.empty(0, bool)
    key, g, owner = key[first], g[first], owner[first]
    order = np.lexsort((owner, several, g))
    key, g, owner, several = key[order], g[order], owner[order], several[order]
    cut = np.flatnonzero(_rising(g))
    out = []
    for s, e in zip(cut, np.append(cut[1:], len(g)), strict=True):
        docs = np.flatnonzero(_rising(owner[s:e]) | _rising(several[s:e])) + s
        runs = np.diff(np.append(docs, e)).astype("<u4")
        out.append((int(g[s]), int(group["bucket"].iloc[0]), key[s:e].tobytes(), [int((~several[s:e]).sum())], np.concatenate((b.ids[owner[docs]].astype("<i8").view("<u4"), runs)).tobytes()))
    return pd.DataFrame(out, columns=none.columns)


def _owners(sent: pd.DataFrame) -> pd.DataFrame:
    """For each bucket, its windows of which a smaller document than one there has the words, with the smallest of all."""
    keys, owners, several = [], [], []
    for k, o, c in zip(sent["keys"], sent["owners"], sent["counts"], strict=True):
        keys.append(np.frombuffer(k, np.uint64))
        n = len(o) // 12
        owners.append(np.repeat(np.frombuffer(o[: 8 * n], "<i8"), np.frombuffer(o[8 * n :], "<u4")))
        several.append(np.arange(len(keys[-1])) >= c[0])
    at = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
    value, where = np.unique(np.concatenate(keys), return_inverse=True)
    least = np.full(len(value), LAST)
    own = np.concatenate(owners)
    np.minimum.at(least, where, own)
    least = least[where]
    tell = (least < own) | np.concatenate(several)
    out = []
    for k, bucket in enumerate(sent["bucket"]):
        here = tell[at[k] : at[k + 1]]
        if here.any():
            out.append((int(bucket), keys[k][here].tobytes(), least[at[k] : at[k + 1]][here].tobytes()))
    return pd.DataFrame(out, columns=["bucket", "keys", "owners"])


def _removed(group: pd.DataFrame, back: pd.DataFrame, span: int, with_text: bool) -> pd.DataFrame:
    """The words of each document that a repeat covers, as runs, and what is left."""
    b = _Bucket(group, span, 1, span)
    found, at = _find(b.key, (known := _joined(back))[0])
    covered = found & (known[1][at] < b.ids[b.doc]) if len(known[1]) else found
    out = []
    for k, (raw, (start, end)) in enumerate(zip(b.raw, b.edges, strict=True)):
        n = len(start)
        step = np.zeros(n + 1, np.int64)
        hits = np.flatnonzero(covered[b.at[k] : b.at[k + 1]])
        np.add.at(step, hits, 1)
        np.add.at(step, hits + span, -1)
        gone = np.cumsum(step)[:n] > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        words = raw.split()
        left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if len(hits) else words
        row = [int(b.ids[k]), n, int(gone.sum()), hashlib.sha256(b" ".join(left)).hexdigest(), [{"from_word": int(x), "to_word": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)]]
        if with_text:
            parts, done = [], 0
            for x, y in zip(edge[::2], edge[1::2], strict=True):
                parts.append(raw[done : start[x]])
                done = start[y] if y < n else len(raw)
            row.append(b"".join([*parts, raw[done:]]).decode("utf-8", "surrogatepass"))
        out.append(row)
    made = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "removed", *(["kept_text"] if with_text else [])])
    made["doc_id"] = pd.arrays.IntegerArray(b.ids, b.ids == LAST)
    return made


def repeats_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed[, kept_text]): one row per row of docs.

    A word goes if some window of span words that covers it also starts in a document with a smaller
    id. Windows are judged on the input. removed lists the runs of words that go, the maximal
    repeats; kept_text is the text without them, other white space as it was. A null or empty text
    has no words and loses none. Rows with the same id are the same document and don't remove each
    other's words; a null id counts as larger than all others. An empty table gives no rows; other
    columns of docs aren't read.

    A window is known by 64 bits of hash and by its group (a second hash), so the bits that tell
    windows apart grow with the data. Hits on anchors use 32 of them and are only candidates.
    """
    block = span // 2
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text")).alias("b"), F.count("*").alias("n")).first()
    buckets = max(16, -(-(size["b"] or 0) // BUCKET_BYTES))
    groups = max(16, -(-(size["b"] or 0) // (6 * GROUP_WINDOWS)))
    spread = F.xxhash64("_id", F.when(F.col("_id").isNull(), F.col("_text")))  # rows without an id spread by their text
    rows = rows.select(F.coalesce("_id", F.lit(int(LAST))).alias("_order"), "_text", F.pmod(spread, F.lit(buckets)).cast("int").alias("bucket"))
    sent = rows.groupBy("bucket").applyInPandas(_light(lambda g: _probe(g, block, groups)), _SENT)
    hits = stored(sent.groupBy("g").applyInPandas(_light(_index), _BACK), "anchors")
    whole = rows.groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInPandas(_light(lambda a, b: _extend(a, b, span, block, groups, groups)), _SENT + ", owners binary")
    owners = stored(whole.groupBy("g").applyInPandas(_light(_owners), _BACK), "repeats")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<from_word:long,to_word:long>>" + ", kept_text string" * with_text
    return rows.groupBy("bucket").cogroup(owners.groupBy("bucket")).applyInPandas(_light(lambda a, b: _removed(a, b, span, with_text)), schema)


def deduplicated(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """The documents without their repeated words; all their columns, n_chars following the text. A document that loses every word stays, with an empty text.

    Rows that share an id are documents of their own, and so are rows without one, which come after all
    ids. A null text stays null. An empty table gives no rows; other columns may have any names.
    """
    spark, row, kept = docs.sparkSession, fresh(docs, "_row"), fresh(docs, "_kept")
    rows = keyed(docs, row)
    left = settled(spark, lambda: repeats_removed(rows, row, span=span, with_text=True).where("n_removed > 0").select("doc_id", "kept_text"), "cut")
    rows = rows.join(left.select(F.col("doc_id").alias(row), F.col("kept_text").alias(kept)), row, "left").withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(docs.columns)


#: What repeats_removed gives in DuckDB, where ids are unique and not null.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+49], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
hit AS (SELECT doc_id, i FROM win QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM hit) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN ps IS NULL THEN array_to_string(ws, ' ')
              ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda p: NOT list_contains(ps, p)), lambda p: ws[p]), ' '), '') END) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
