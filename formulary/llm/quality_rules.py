"""Quality rules as a bitmask ledger.

Every rule runs once over a document and leaves a bit (set: failed) and the measurements it was made
from. Which rules decide is a policy, a mask with a version; a new policy or an ablation then reads
the ledger alone. Only built-in functions are used, a text is measured inside its row, and nothing
is shuffled before the sums of an ablation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formulary.llm.common import SPACE

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations", "n_capitals")
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """fails: from the measurements (a struct) to a condition."""

    name: str
    fails: Callable[[Column], Column]


#: The position of a rule is its bit and never changes; new rules go to the end.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 20),
    Rule("repeated_windows", lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 30),
    Rule("symbols", lambda m: m["n_symbols"] * 10 > m["n_words"]),
    Rule("word_length", lambda m: (m["n_words"] * 5 > m["word_chars"] * 2) | (m["word_chars"] > m["n_words"] * 15)),
    Rule("repeated_lines", lambda m: (m["n_dup_lines"] >= 4) & (m["n_dup_lines"] * 2 > m["n_lines"])),
    Rule("shouting", lambda m: (m["n_words"] > 0) & (m["n_exclamations"] * 2 > m["n_words"])),
    Rule("capitals", lambda m: (m["n_words"] >= 20) & (m["n_capitals"] * 2 > m["word_chars"])),
)
BIT = {rule.name: 1 << k for k, rule in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Versioned policies: the rules that reject.
POLICIES = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["word_length"],
    "v2": BASE | BIT["symbols"] | BIT["word_length"] | BIT["repeated_lines"] | BIT["shouting"] | BIT["capitals"],
}
PRODUCTION = "v2"


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once for all the places that use it."""
    return F.transform(F.array(value), use)[0]


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of so many words that occur twice or more in the array, the first included.

    Windows are compared by their 64-bit hash within one document. The union of the covered
    stretches is summed over the sorted window starts, so overlaps count once.
    """
    starts = F.sequence(F.lit(1), F.size(words) - (window - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))

    def twice(ordered: Column) -> Column:
        alike = lambda x, k: F.coalesce(F.get(ordered, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(ordered, alike), lambda x: x["i"]))

    def covered(positions: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
        step = lambda acc, p: F.struct((acc["n"] + p + window - F.greatest(p, acc["end"])).alias("n"), (p + window).alias("end"))
        return F.aggregate(positions, start, step, lambda acc: acc["n"])

    def count(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(_let(ordered, twice)))

    return F.when(F.size(words) <= window, F.lit(0)).otherwise(_let(hashes, count)).cast("long")


def facts(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of a text's measurements and fail_bits, one bit per rule.

    Words, lines and measurements are bound by lambdas, so they are made once wherever the struct
    is used: a filter that is pushed down doesn't repeat them.
    """
    text = F.coalesce(text, F.lit(""))
    long = lambda c, name: c.cast("long").alias(name)
    count = lambda chars: F.length(text) - F.length(_without(text, chars))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(_without(x, " \t\n\x0b\f\r")) > 0)

    def measures(words: Column) -> Column:
        return _let(
            lines,
            lambda ls: F.struct(
                long(F.size(words), "n_words"),
                long(F.length(_without(text, " \t\n\x0b\f\r")), "word_chars"),
                long(count(SYMBOLS), "n_symbols"),
                long(F.size(ls) - F.size(F.array_distinct(ls)), "n_dup_lines"),
                repeat_words(words).alias("n_repeat_words"),
                long(F.size(ls), "n_lines"),
                long(count("!"), "n_exclamations"),
                long(count(UPPER), "n_capitals"),
            ),
        )

    def with_bits(m: Column) -> Column:
        bits = sum((F.when(rule.fails(m), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(rules)), F.lit(0))
        return F.struct(*(m[c].alias(c) for c in MEASURES), long(bits, "fail_bits"))

    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    return _let(_let(words, measures), with_bits)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its id, its measurements and fail_bits.

    A null or empty text has no words: it measures 0 throughout and fails few_words. Repeated rows
    and null ids are rows like any other. Other columns of docs are not read, so their names don't
    matter; an empty table gives an empty ledger.
    """
    return docs.select(F.col(id_col), facts(F.col(text_col), rules).alias("_facts")).select(id_col, "_facts.*")


def judged(book: DataFrame, policy: str | int = PRODUCTION) -> DataFrame:
    """The ledger with base_failed, and kept under a policy (a version's name or a mask)."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return book.withColumns({"base_failed": F.col("fail_bits").bitwiseAND(BASE) != 0, "kept": F.col("fail_bits").bitwiseAND(mask | BASE) == 0})


def ablations(book: DataFrame, policy: str | int = PRODUCTION) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone (they come back without it), and that would be kept without it.

    Each distinct bitmask is counted first, so the sums run over at most 2 ** rules rows however
    many documents there are. Also gives the AND and OR of all masks: what every document fails, and what any does.
    """
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    masks = book.groupBy(F.col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    rules = [(rule.name, 1 << k) for k, rule in enumerate(RULES) if mask >> k & 1]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in rules))).alias("r")
    rows = masks.select("bits", "n", each).select("bits", "n", "r.*")
    hit = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias
    return rows.groupBy("rule", "bit").agg(
        hit(F.col("bits").bitwiseAND(F.col("bit")) != 0)("n_failed"),
        hit(F.col("bits") == F.col("bit"))("n_failed_alone"),
        hit((F.col("bits") == 0) | (F.col("bits") == F.col("bit")))("n_kept_without"),
        F.bit_and("bits").alias("failed_by_all"),
        F.bit_or("bits").alias("failed_by_any"),
    )


def kept(docs: DataFrame, policy: str | int = PRODUCTION) -> DataFrame:
    """The documents that a policy keeps, all their columns as they were: a filter over each row's own text."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return docs.where(facts(F.col("text"))["fail_bits"].bitwiseAND(mask | BASE) == 0)


#: What the ledger of a table is in DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) > 0) AS ls FROM d),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g FROM win),
rep AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(ls)::BIGINT AS n_lines, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclamations,
             length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals
      FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, ((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
      + 8 * (n_words > 0 AND NOT (5 * n_words <= 2 * word_chars AND word_chars <= 15 * n_words))::INT
      + 16 * (n_dup_lines >= 4 AND 2 * n_dup_lines > n_lines)::INT + 32 * (n_words > 0 AND 2 * n_exclamations > n_words)::INT
      + 64 * (n_words >= 20 AND 2 * n_capitals > word_chars)::INT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_exclamations, n_capitals, fail_bits,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""
