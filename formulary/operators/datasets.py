"""Building a dataset of formulas: splits, caps, merges, leakage, checks and the rejection of transcripts."""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formulary.functions.latex import md5_share, norm_latex, split_key, valid_latex
from formulary.functions.names import fresh

#: Upper ends of the shares of the hash, by split; what is above goes to train.
TEMPLATE_SPLITS, TREE_SPLITS = {"test": 0.08, "validation": 0.11}, {"test_comp": 0.03, "validation": 0.05}


def split_of(key: Column | str, bounds: dict[str, float], rest: str = "train") -> Column:
    """The split of a formula, by the hash of its text without spaces."""
    share, out = md5_share(split_key(key)), F.lit(rest)
    for name, upto in reversed(bounds.items()):
        out = F.when(share < round(10_000 * upto), name).otherwise(out)
    return out


def capped(rows: DataFrame, by: list, order: list, most: int, exempt: Column | None = None) -> DataFrame:
    """The first so many rows of each key; exempt rows always stay and don't count. A null key is a key; rows that tie in order are told apart by nothing else, so either may stay.

    Tasks keep that many rows of a key before the shuffle, so a hot key costs no more than others;
    exempt rows aren't shuffled.
    """
    if exempt is not None:
        free = F.coalesce(exempt, F.lit(False))
        return rows.where(free).unionByName(capped(rows.where(~free), by, order, most))
    (place,) = fresh(rows, "_place")
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn(place, at).where(F.col(place) <= most).drop(place)


#: Parts over which rows of one frequent place in the order, or without a place, are spread, and stretches of the order at most.
SPREAD, STRETCHES = 64, 4096


def _stretched(rows: DataFrame, order: str, into: str, stretch: int) -> DataFrame:
    """rows with a struct that sorts like the order and is shared by about so many rows, however the order's values lie: their quantiles bound it."""
    n, bounds = rows.agg(F.count(order)).first()[0], []
    if n > stretch:
        asked = min(STRETCHES, 1 << (8 * n // stretch).bit_length())
        points = ", ".join(f"{k / asked}D" for k in range(1, asked))
        found = rows.select(F.col(order).alias("v")).agg(F.expr(f"percentile_approx(v, array({points}), {4 * asked})")).first()[0]
        step = max(1, round(asked * stretch / n))
        bounds = found[step - 1 :: step]
    frequent = sorted({float(v) for v, w in zip(bounds, bounds[1:], strict=False) if v == w})
    splits = sorted({float(v) for v in bounds} | {math.nextafter(v, math.inf) for v in frequent})
    (at,) = fresh(rows, "_at")
    if splits:
        cut = Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol=f"{at}_in", outputCol=at, handleInvalid="keep")
        out = cut.transform(rows.withColumn(f"{at}_in", F.col(order).cast("double"))).drop(f"{at}_in")
    else:
        out = rows.withColumn(at, F.lit(0.0))
    spread = F.pmod(F.xxhash64(*(F.col(c) for c in rows.columns)), F.lit(SPREAD)) + 1
    here = F.lit(0).cast("long")
    if frequent:  # a double may stand for several values: those that are frequent are stretches of their own, between the others
        hot = rows.where(F.col(order).cast("double").isin(frequent)).groupBy(order).count().where(F.col("count") >= stretch)
        own: dict[float, list[int]] = {}
        for v in sorted(r[0] for r in hot.collect()):  # each fills a stretch, so there are as many as stretches at most
            own.setdefault(float(bisect.bisect_right(splits, float(v))), []).append(v)
        if own:
            values = F.element_at(F.create_map(*(F.lit(x) for k, vs in own.items() for x in (k, vs))), F.col(at))
            zone = F.size(F.filter(values, lambda v: v < F.col(order))) * (SPREAD + 1) + F.when(F.array_contains(values, F.col(order)), spread).otherwise(0)
            here = F.when(values.isNotNull(), zone).otherwise(0)
    lacking = F.col(order).isNull()
    part = F.struct(F.when(lacking, STRETCHES * 2.0).otherwise(F.col(at)).alias("at"), F.when(lacking, spread).otherwise(here).cast("long").alias("part"))
    return out.withColumn(into, part).drop(at)


def placed(rows: DataFrame, order: str, into: str, stretch: int = 100_000) -> DataFrame:
    """rows with their place, from 0 on, in the order of a whole-number column; rows where it is null come last, and equal ones next to each other.

    Rows are counted by stretches between quantiles of the column, so that no task sorts all of them,
    whether values are dense, sparse or one of them fills many stretches; the starts of the stretches,
    a few thousand rows at most, are sent to all tasks. Only rows that are alike in every column can't
    be spread.
    """
    part, at, start = fresh(rows.withColumn(into, F.lit(0)), "_part", "_place", "_start")
    split = _stretched(rows, order, part, stretch)
    before = F.coalesce(F.sum("count").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = split.groupBy(part).count().select(part, before.alias(start))
    split = split.withColumn(at, F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1)
    return split.join(F.broadcast(starts), part).withColumn(into, F.col(start) + F.col(at)).select(*[c for c in rows.columns if c != into], into)


def numbered(rows: DataFrame, order: str, into: str, pattern: str = "e%06d", stretch: int = 100_000) -> DataFrame:
    """Dense ids in the order of a whole-number column, by placed(): every row gets one."""
    return placed(rows, order, into, stretch).withColumn(into, F.format_string(pattern, F.col(into)))


#: So many first rows are picked by the tasks and met in one; more are found by their place.
FEW = 100_000


def first_rows(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in the order of a whole-number column, nulls last, without a sort of all."""
    if n <= FEW:
        return rows.orderBy(F.col(order).asc_nulls_last()).limit(n)
    (at,) = fresh(rows, "_at")
    return placed(rows, order, at).where(F.col(at) < n).drop(at)


def merged(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last value by order (ties: the greatest), old rows before new; combined in each task before the shuffle. A null key is a key."""
    gen, last = fresh(old, "_gen", "_last")
    both = old.withColumn(gen, F.lit(0)).unionByName(new.withColumn(gen, F.lit(1)))
    rest = [c for c in both.columns if c not in (key, gen)]
    kept = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(gen, order, *rest)).alias(last))
    return kept.select(key, f"{last}.*")


def unseen(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key isn't among those that are done."""
    return rows.join(done.select(key), key, "left_anti")


def _in_train() -> Column:
    return F.col("split").eqNullSafe("train")


def without(rows: DataFrame, others: DataFrame, text: str, key: Callable[[str], Column]) -> DataFrame:
    """rows whose text, under a key, is none of the others' texts. A row whose key is null stays."""
    (own,) = fresh(rows, "_key")
    return rows.withColumn(own, key(text)).join(_keys(others, text, key, own), own, "left_anti").select(rows.columns)


def _keys(rows: DataFrame, text: str, key: Callable[[str], Column], into: str) -> DataFrame:
    """The different keys of texts, made once for each different text."""
    return rows.select(text).distinct().select(key(text).alias(into)).distinct()


def leak_free(rows: DataFrame, text: str = "latex") -> DataFrame:
    """Rows of train, and of other splits, no split among them, those whose text without spaces train doesn't hold."""
    train = rows.where(_in_train())
    return train.unionByName(without(rows.where(~_in_train()), train, text, split_key))


def unbanned(rows: DataFrame, banned: DataFrame, text: str = "latex") -> DataFrame:
    """rows without those whose normal form is that of a banned row."""
    return without(rows, banned, text, norm_latex)


def leakage(rows: DataFrame, text: str = "target_text") -> DataFrame:
    """(split, train_overlap): rows of each other split whose normal form train holds; 0 for a clean split. Rows without a split are a split, null."""
    key, hit, n = fresh(rows, "_key", "_hit", "_n")
    train = _keys(rows.where(_in_train()), text, norm_latex, key).withColumn(hit, F.lit(1))
    others = rows.where(~_in_train()).groupBy("split", text).agg(F.count("*").alias(n)).withColumn(key, norm_latex(text))
    return others.join(train, key, "left").groupBy("split").agg(F.coalesce(F.sum(F.when(F.col(hit).isNotNull(), F.col(n))), F.lit(0)).alias("train_overlap"))


def synthesized(spoken: DataFrame, made: DataFrame, order: str = "ord") -> DataFrame:
    """Spoken rows that have a recording, with its duration: the last one of an id counts, of several the longest. Rows without an id have none."""
    last = made.groupBy("id").agg(F.max_by("duration", F.struct(order, "duration")).alias("duration"))
    return spoken.drop("duration").join(last, "id")


def trainable(rows: DataFrame, most: float = 20.0) -> DataFrame:
    """Rows that last at most so many seconds; an unknown duration is too long."""
    return rows.where(F.col("duration") <= most)


def acceptance(rows: DataFrame, *by: str) -> DataFrame:
    """Rows accepted and all rows, by the columns given; null counts as not accepted."""
    return rows.groupBy(*by).agg(F.count_if(F.coalesce("accepted", F.lit(False))).alias("accepted"), F.count("*").alias("total"))


def variants(rows: DataFrame, times: Column | int, voices: list[str], speeds: list[float]) -> DataFrame:
    """Every row so many times, its k-th copy with the k-th voice and speed in turn and its id marked."""
    n = F.lit(times) if isinstance(times, int) else times
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("k") % len(values) + 1).cast("int"))
    out = rows.withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
    return out.withColumns({"voice": pick(voices), "speed": pick(speeds), "id": F.concat_ws("_", "id", "k")}).drop("k")


def shard(rows: DataFrame, order: str, n: int, which: int) -> DataFrame:
    """Every n-th row, from the one at place which on, in the order of a whole-number column."""
    (at,) = fresh(rows, "_at")
    return placed(rows, order, at).where(F.col(at) % n == which).drop(at)


def manifest(synthetic: DataFrame, real: DataFrame, root: str = "/data/") -> DataFrame:
    """Synthetic and accepted real rows under one schema, with paths relative to the root."""
    path = lambda c: F.when(F.col(c).startswith(root), F.substring(c, len(root) + 1, 1 << 30)).otherwise(F.col(c))
    columns = ["id", "audio", "spoken_transcript", "target_text", "domain", "synthetic", "speaker_id", "source", "license", "difficulty", "template", "duration", "confidence", "speed", "split"]
    made = synthetic.withColumnsRenamed({"latex": "target_text", "spoken_text": "spoken_transcript", "voice": "speaker_id"})
    made = made.withColumns({"audio": path("audio"), "synthetic": F.lit(True), "confidence": F.lit(1.0)})
    found = real.where("accepted").withColumnsRenamed({"canonical": "target_text", "asr_transcript": "spoken_transcript"})
    found = found.withColumns({"audio": path("audio"), "synthetic": F.lit(False), "speaker_id": F.coalesce("speaker_id", F.lit("unknown")), "difficulty": F.lit(3), "template": F.lit("real"), "speed": F.lit(1.0)})
    return made.select(columns).unionByName(found.select(columns))


def quality_report(rows: DataFrame) -> DataFrame:
    """Counters of each split: bad audio and durations, invalid formulas, missing sources."""
    count = lambda c, name: F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(name)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return rows.groupBy("split").agg(
        F.count("*").alias("n"),
        F.bround(F.sum("duration") / 3600, 2).alias("hours"),
        count(~F.col("audio_ok"), "bad_audio"),
        count(~F.coalesce((F.col("duration") > 0.3) & (F.col("duration") < 30), F.lit(False)), "bad_duration"),
        count(F.col("synthetic") & ~valid_latex("target_text"), "invalid_latex"),
        count(empty("license") | empty("source"), "missing_license_or_source"),
        count(F.col("synthetic"), "synthetic"),
        count(~F.col("synthetic"), "real"),
    )


COUNTERS = ["bad_audio", "bad_duration", "invalid_latex", "missing_license_or_source", "train_overlap"]


def violations(report: DataFrame) -> DataFrame:
    """(split, counter, value): every counter of a report that isn't 0."""
    here = [c for c in COUNTERS if c in report.columns]
    return report.unpivot(["split"], here, "counter", "value").where("value > 0")


def reject_reason(is_math, confidence, latex, unknown, tokens, least: float = 0.8, longest: int = 40) -> Column:
    """The first test that a transcript's formula fails; null if it passes all."""
    tests = [
        ("not_math", ~is_math),
        ("low_confidence", confidence < least),
        ("invalid_latex", ~valid_latex(latex)),
        ("unknown_words", unknown > 0),
        ("no_math_structure", ~latex.rlike(r"\\[a-zA-Z]+|[\^_=]")),
        ("too_long", tokens > longest),
    ]
    return reduce(lambda out, t: F.when(F.coalesce(t[1], F.lit(True)), t[0]).otherwise(out), reversed(tests), F.lit(None).cast("string"))


# Words of science, and words that alone make a sentence a candidate.
KEYWORDS = """equation equations derivative integral integrals variable variables theorem lemma matrix vector probability variance standard deviation
gaussian distribution function functions exponent squared cubed square root logarithm sine cosine tangent infinity sigma lambda theta alpha beta
epsilon delta gamma omega gradient limit sum fraction numerator denominator polynomial quadratic calculus algebra geometry triangle
angle velocity acceleration momentum energy force voltage current resistance frequency wavelength entropy molecule atom electron proton
neutron hypothesis regression neural network algorithm parameter""".split()
CORE = "squared cubed integral derivative sigma lambda theta alpha beta gamma delta epsilon omega infinity equals plus minus over times".split()


def candidates(rows: DataFrame, text: str = "text", duration: str | None = None, keywords: list[str] | None = None, core: list[str] | None = None) -> DataFrame:
    """Rows with two keywords or one core word, and a duration of 2 to 30 seconds if there is one; keywords lists the hits, sorted."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))
    among = lambda of: F.array_intersect(words, F.array(*map(F.lit, of)))
    out = rows.withColumn("keywords", F.array_sort(among(keywords or KEYWORDS))).where((F.size("keywords") >= 2) | (F.size(among(core or CORE)) > 0))
    return out if duration is None else out.where(F.col(duration).between(2, 30))
