"""Token counts by a compiled transducer: no tokens are made.

A byte-pair vocabulary is compiled, as texts ask for it, into a deterministic transducer over
characters. What a prefix of a text encodes to is settled by its last token: two tokens may stand
side by side only if their joined text encodes to just them, so the last token of each longer prefix
follows from those of the prefixes before it. A state holds what can still matter: the longest end of
the text that a piece may begin with and, for every place in it, the token that ends there and the
count up to there. A transition is annotated with the tokens that it adds to the prefix's count; the
annotations of a text sum to its count.

Between two characters that no piece holds side by side there is always a cut. The transducer is in
its first state again there, so stretches between such cuts are remembered as single transitions. A
long text is dealt out in chunks. A chunk's map (from the state before it to the one behind it, and
the tokens between) is what stands before its first cut, left to be read, and a fixed state and count
behind it; maps compose in any grouping, so a scan over them in levels counts the whole text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from formulary.llm.common import small_batches, stored, tidied

SPACE = "▁"
LIMIT = 4096
#: Characters of a chunk, and chunks whose maps are composed at a time.
CHUNK, FAN_IN = 1 << 18, 256
#: Bounds of what a process remembers: states, stretches and the longest of them.
STATES, KNOWN, LONGEST = 200_000, 300_000, 48

Key = tuple[str, tuple[tuple[str, int], ...]]
#: The state behind a cut: nothing is open.
START: Key = ("", (("", 0),))


class Transducer:
    """Counts of byte pairs whose merges are ranked by the piece that they make, leftmost first. pieces: their ranks, lower first; other characters count their bytes."""

    def __init__(self, pieces: dict[str, float], states: int = STATES, known: int = KNOWN) -> None:
        self.rank, self.most, self.most_known = pieces, states, known
        single = {c for p in pieces for c in p}
        if not single <= pieces.keys():
            raise ValueError("every character of a piece must be a piece")
        self.single = single
        self.beside = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        self.starts = {p[:k] for p in pieces for k in range(1, len(p))}
        # a run of spaces and what follows it, unless a space may stand behind another character within a piece
        whole = not any(b[1] == SPACE != b[0] for b in self.beside)
        alone = "" if "\n" in single else "\n"
        self._parts = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|{alone}" if alone else "") if whole else "(?s).+").findall
        self._fits = lru_cache(1 << 18)(self._fit)
        self.forget()

    def forget(self) -> None:
        self.keys: list[Key] = [START]
        self.numbers: dict[Key, int] = {START: 0}
        self.next: list[dict[str, tuple[int, int]]] = [{}]
        self.known: dict[str, int] = {}

    def encoded(self, text: str) -> list[str]:
        """The pieces of a short text, by merging: what the transducer is compiled from."""
        parts, rank = list(text), self.rank.get
        while len(parts) > 1:
            best = min((r, k) if (r := rank(parts[k] + parts[k + 1])) is not None else (float("inf"), k) for k in range(len(parts) - 1))
            if best[0] == float("inf"):
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _fit(self, before: str, piece: str) -> bool:
        """Whether a piece may follow a token (none: a cut)."""
        return self.encoded(before + piece) == ([before, piece] if before else [piece])

    def cut(self, before: str, after: str) -> bool:
        return before + after not in self.beside

    def number(self, key: Key) -> int:
        at = self.numbers.get(key)
        if at is None:
            at = self.numbers[key] = len(self.keys)
            self.keys.append(key)
            self.next.append({})
        return at

    def _made(self, state: int, c: str) -> tuple[int, int]:
        """The transition of a state by a character: the next state, and what it adds to the count."""
        if c not in self.single:
            return 0, len(c.encode("utf-8", "surrogatepass"))
        open_, ends = self.keys[state]
        text = open_ + c
        for k, (token, count) in enumerate(ends):
            piece = text[k:]
            if piece in self.rank and self._fits("" if token and self.cut(token[-1], piece[0]) else token, piece):
                break
        else:
            raise ValueError(f"no piece ends {text!r}")
        added = count + 1
        first = next((k for k in range(len(text)) if text[k:] in self.starts), len(text))
        after = [(t, n - added) for t, n in ends[first:]] + [(piece, 0)]
        if first < len(text) and after[0][0] and self.cut(after[0][0][-1], text[first]):
            after[0] = ("", after[0][1])  # behind a cut it doesn't matter what stood before
        return self.number((text[first:], tuple(after))), added

    def walk(self, text: str, state: int = 0) -> tuple[int, int]:
        """State behind a text and the tokens that it adds."""
        total, following = 0, self.next
        for c in text:
            step = following[state].get(c)
            if step is None:
                step = following[state][c] = self._made(state, c)
            state = step[0]
            total += step[1]
        return state, total

    def _stretch(self, text: str) -> int:
        if len(self.keys) > self.most:
            self.forget()
        n = self.walk(text)[1]
        if len(text) <= LONGEST and len(self.known) < self.most_known:
            self.known[text] = n
        return n

    def count(self, text: str) -> int:
        """Tokens from the first state on."""
        parts = self._parts(text)
        got = list(map(self.known.get, parts))
        if None in got:
            got = [self._stretch(p) if n is None else n for p, n in zip(parts, got, strict=True)]
        return sum(got)

    def map_of(self, text: str) -> tuple[str, int, str | None]:
        """A chunk's map: what stands before its first cut; the tokens behind that, and the state at the chunk's end (None: no cut)."""
        at = next((k for k in range(1, len(text)) if self.cut(text[k - 1], text[k])), None)
        if at is None:
            return text, 0, None
        last = max((m.start() for m in re.finditer(SPACE, text) if m.start() >= at and self.cut(text[m.start() - 1], SPACE)), default=at)
        state, n = self.walk(text[last:])
        return text[:at], self.count(text[at:last]) + n, json.dumps(self.keys[state])

    def composed(self, maps: list[tuple[str, int, str | None]]) -> tuple[str, int, str | None]:
        """The map of chunks that follow each other."""
        head, total, state = [], 0, None
        for before, n, behind in maps:
            if state is None:
                head.append(before)
            else:
                state, more = self.walk(before, state)
                total += more
            if behind is not None:
                total += n
                open_, ends = json.loads(behind)
                state = self.number((open_, tuple((t, k) for t, k in ends)))
        return "".join(head), total, None if state is None else json.dumps(self.keys[state])

    def total(self, chunk_map: tuple[str, int, str | None]) -> int:
        """Tokens of a text whose map this is."""
        return self.count(chunk_map[0]) + chunk_map[1]


_COMPILED: dict[str, Transducer] = {}


def compiled(model: str) -> Transducer:
    """This process's transducer of a model file, with what earlier tasks compiled."""
    if model not in _COMPILED:
        import sentencepiece

        it = sentencepiece.SentencePieceProcessor(model_file=model)
        plain = [k for k in range(it.get_piece_size()) if not (it.is_unknown(k) or it.is_control(k) or it.is_byte(k) or it.is_unused(k))]
        _COMPILED[model] = Transducer({it.id_to_piece(k): -it.get_score(k) for k in plain})
    return _COMPILED[model]


def spelled(text: str) -> str:
    """A text as the model reads it: a space before it, spaces as their mark; an empty text stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row per row of docs, counted as the library encodes the whole text.

    model: the path of a sentencepiece file of byte pairs with byte fallback, the same on every
    executor. A null or empty text has no bytes and no tokens. Repeated rows are counted each, a null
    id stays null, an empty table gives no rows, other columns aren't read. Texts of more than chunk
    characters are dealt to tasks in chunks, once, and their maps composed fan_in at a time until one
    a text is left.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, text_no long, chunk long, chunks long, part string"
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        it, number = compiled(model), TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                size, read = len(text.encode("utf-8", "surrogatepass")), spelled(text)
                if len(read) <= chunk:
                    rows.append((doc, size, it.count(read), None, 0, 1, None))
                    continue
                number += 1
                starts = range(0, len(read), chunk)
                rows += [(doc, size, 0, number, k, len(starts), read[at : at + chunk]) for k, at in enumerate(starts)]
            columns = zip(*rows, strict=True) if rows else [()] * len(shape)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    small_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    counted = stored(read.mapInArrow(tidied(first), schema), "counted")
    whole = counted.where("text_no is null").select("doc_id", "n_bytes", "n_tokens")
    long = counted.where("text_no is not null")
    most = long.agg(F.max("chunks")).first()[0]
    if most:
        whole = whole.unionByName(_scanned(long, model, most, fan_in))
    return whole.withColumn("over_limit", F.col("n_tokens") > limit)


def _scanned(chunks: DataFrame, model: str, most: int, fan_in: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) from the chunks of long texts: their maps, and a scan over them in levels."""
    schema = "text_no long, chunk long, doc_id long, n_bytes long, head string, n long, state string"

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        it = compiled(model)
        for b in batches:
            made = [(no, k, doc, size, *(it.map_of(t) if k else ("", *_first(it, t)))) for no, k, doc, size, t in b.itertuples(index=False)]
            yield pd.DataFrame(made, columns=["text_no", "chunk", "doc_id", "n_bytes", "head", "n", "state"]).astype({"doc_id": "Int64"})

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        it, group = compiled(model), group.sort_values("chunk")
        made = it.composed([(h, n, None if s is None or s != s else s) for h, n, s in zip(group["head"], group["n"], group["state"], strict=True)])
        row = group.iloc[:1].assign(head=made[0], n=made[1], state=made[2])
        return row.assign(chunk=row["chunk"] // fan_in)

    dealt = chunks.repartition(F.col("text_no"), F.col("chunk")).select("text_no", "chunk", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "n_bytes", "part")
    level = dealt.mapInPandas(tidied(maps), schema)
    while most > 1:
        level = level.groupBy("text_no", F.floor(F.col("chunk") / fan_in).alias("_level")).applyInPandas(lambda _, g: compose(g), schema)
        most = -(-most // fan_in)
    names = chunks.where("chunk = 0").select("text_no", F.col("doc_id").alias("_doc"))
    return level.join(names, "text_no").select(F.col("_doc").alias("doc_id"), "n_bytes", F.col("n").alias("n_tokens"))


def _first(it: Transducer, text: str) -> tuple[int, str]:
    """Count and state of a text's first chunk: it starts behind a cut."""
    last = max((m.start() for m in re.finditer(SPACE, text) if m.start() and it.cut(text[m.start() - 1], SPACE)), default=0)
    state, n = it.walk(text[last:])
    return it.count(text[:last]) + n, json.dumps(it.keys[state])
