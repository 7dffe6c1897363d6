"""Interaction of filters, audited from a histogram of failure masks.

Built-in functions test every filter once over a document and give its mask of five bits; whether a
text has a copy with a smaller id comes from one grouping by text, which travels as its SHA-256. The
documents of a part then are 32 cells. How many documents pass a set of filters is a sum over cells,
and every order of the filters, each step of it and the mean over orders follow from those sums: no
order is ever run over documents.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formulary.llm.common import SPACE, stored

FILTERS = "ABCDE"
BIT = {f: 1 << k for k, f in enumerate(FILTERS)}
ORDERS = ["".join(p) for p in permutations(FILTERS)]
CELLS = 1 << len(FILTERS)
SPACES = " \t\n\x0b\f\r"


def fails(text: Column) -> Column:
    """The mask of the filters that look at one text (A to D); a null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.split(trimmed, SPACE + "+")  # of a text without words: one empty word
    n = F.when(trimmed == "", 0).otherwise(F.size(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = [
        n < 50,
        F.size(F.array_distinct(words)) * 100 < n * 65,
        capitals * 100 > F.length(text) * 5,
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((F.when(test, F.lit(1 << k)).otherwise(0) for k, test in enumerate(tests)), F.lit(0))


def masked(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic): one row per row of docs.

    A null text is empty, a null part the empty string. Repeated rows are documents each: copies under
    one id fail nothing by that. A row without an id has no smaller one before it, is none to others,
    and has no label. Of several labels of an id any counts; a null label is none. Only the columns
    named are read. Texts are read once: what is left of them is stored.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    facts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(part_col, F.lit("")).alias("part"), digest.alias("text"), fails(F.col(text_col)).alias("own"))
    facts = stored(facts, "facts")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
    known = known.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # the ids under which a text comes again: those but its smallest
    first = facts.where("id is not null").groupBy("text").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    rows = facts.join(known, "id", "left").join(first, ["id", "text"], "left")
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    flag = lambda c: F.coalesce(c, F.lit(False))
    return rows.select("part", (F.col("own") + F.when(copy, BIT["E"]).otherwise(0)).alias("mask"), flag("good").alias("good"), flag("toxic").alias("toxic"))


def cells(rows: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the histogram of each part, summed by tasks before the shuffle."""
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def audit(histogram: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): every step of every order, for each part.

    shapley is what a filter removes, summed over all orders: a document goes to the first of the
    filters that it fails, so each of these has it in an equal share of the orders. No part, no rows.
    """
    measures = ("n", "good", "toxic")
    entry = F.struct(F.col("mask").cast("int").alias("mask"), *measures)
    rows = histogram.groupBy("part").agg(F.collect_list(entry).alias("cells"))  # at most 32 a part

    def total(measure: str, cond) -> Column:
        return F.aggregate(F.filter("cells", cond), F.lit(0).cast("long"), lambda acc, c: acc + c[measure])

    def passes(measure: str) -> Column:
        """What passes every filter of a set, for each of the 32 sets."""
        sets = F.sequence(F.lit(0), F.lit(CELLS - 1))
        return F.transform(sets, lambda s: total(measure, lambda c: c["mask"].bitwiseAND(s) == 0)).alias(f"pass_{measure}")

    def shares(bit: int) -> Column:
        mine = F.filter("cells", lambda c: c["mask"].bitwiseAND(bit) != 0)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda acc, c: acc + (c["n"] * len(ORDERS) / F.bit_count(c["mask"])).cast("long"))

    def alone(bit: int) -> Column:
        return total("n", lambda c: c["mask"] == bit)

    bits = [1 << k for k in range(len(FILTERS))]
    rows = rows.select("part", *map(passes, measures), F.array(*map(alone, bits)).alias("alone"), F.array(*map(shares, bits)).alias("shares"))
    steps = [(order, k + 1, sum(BIT[f] for f in order[:k]), FILTERS.index(order[k]), BIT[order[k]]) for order in ORDERS for k in range(len(FILTERS))]
    column = lambda k: F.lit([s[k] for s in steps])
    at = F.explode(F.arrays_zip(column(0).alias("filter_order"), column(1).alias("step"), column(2).alias("before"), column(3).alias("filter"), column(4).alias("bit"))).alias("s")
    rows = rows.select("*", at).select("*", "s.*")
    kept = lambda m: F.get(f"pass_{m}", F.col("before").bitwiseOR(F.col("bit")))
    gone = lambda m: F.get(f"pass_{m}", F.col("before")) - kept(m)
    fail = F.get("pass_n", F.lit(0)) - F.get("pass_n", F.col("bit"))
    return rows.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        kept("n").alias("kept"),
        gone("n").alias("removed"),
        (fail - gone("n")).alias("redundant"),
        F.get("alone", F.col("filter")).alias("unique_fails"),
        gone("good").alias("good_lost"),
        gone("toxic").alias("toxic_lost"),
        F.get("shares", F.col("filter")).alias("shapley"),
    )


#: What audit() gives for documents and labels in DuckDB, every order run over the masks.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
  [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
   regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS f FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
p(o) AS (SELECT '' UNION ALL SELECT o || x FROM p, unnest(['A', 'B', 'C', 'D', 'E']) u(x) WHERE NOT contains(o, x)),
s AS (SELECT o AS filter_order, step, ascii(o[step]) - 64 AS k, [ascii(y) - 64 for y in string_split(o[1:step - 1], '') if y <> ''] AS before FROM p, range(1, 6) r(step) WHERE length(o) = 5),
j AS (SELECT c.*, s.*, len([b for b in before if f[b]]) > 0 AS gone, len([x for x in f if x]) AS many FROM c, s),
r AS (SELECT part, filter_order, step, k, sum(CASE WHEN NOT gone AND NOT f[k] THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND f[k] THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN gone AND f[k] THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN f[k] AND many = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN NOT gone AND f[k] THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND f[k] THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM j GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM r
"""
