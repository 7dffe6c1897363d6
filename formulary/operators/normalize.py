"""Transcripts to LaTeX. Tokens, gate, validity and confidence are built-in functions; the reader works in Arrow batches, where rows that the gate turns down are nulls."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formulary.functions.latex import valid_latex
from formulary.functions.names import fresh
from formulary.functions.phrases import read
from formulary.functions.render import latex_to_text
from formulary.functions.spoken import MATH_AT, math_score, tokenize


_READ = T.StructType([T.StructField("latex", T.StringType()), T.StructField("unknown", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])


#: Results that a process remembers of texts that come again.
REMEMBERED = 50_000


@lru_cache(REMEMBERED)
def _read_once(tokens: tuple[str, ...]) -> tuple:
    return read(list(tokens))


@F.pandas_udf(_READ)
def _read(tokens: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_read_once(tuple(t)) if t is not None else (None, None, None) for t in tokens], columns=["latex", "unknown", "error"])


def canonicalized(rows: DataFrame, text: str | Column = "text", into: str = "result") -> DataFrame:
    """rows with a struct of latex, confidence, method, is_math, math_score, unknown and error.

    No tokens: an empty formula. Not mathematics: the text itself (passthrough). A construct that
    lacks a part: the text, with the error. Null counts as empty.
    """
    said, tokens, score, math, got = fresh(rows.withColumn(into, F.lit(0)), "_said", "_t", "_score", "_math", "_read")
    step = rows.withColumn(said, F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    step = step.withColumn(tokens, tokenize(F.col(said)))
    step = step.withColumn(score, F.when(F.size(tokens) > 0, math_score(F.col(tokens))))
    step = step.withColumn(math, F.coalesce(F.col(score) >= MATH_AT, F.lit(False)))
    step = step.withColumn(got, _read(F.when(F.col(math), F.col(tokens))))
    read_ = F.col(got)
    trimmed = F.regexp_replace(said, r"(?U)^\s+|\s+$", "")
    ok = F.col(math) & read_["error"].isNull()
    sure = F.greatest(F.lit(0.0), 1.0 - F.size(read_["unknown"]) / F.greatest(F.lit(1), F.size(tokens)) * 3)
    sure = F.bround(sure * F.when(valid_latex(read_["latex"]), 1.0).otherwise(0.3), 3)
    result = F.struct(
        F.when(F.size(tokens) == 0, "").when(ok, read_["latex"]).otherwise(trimmed).alias("latex"),
        F.when(ok, sure).otherwise(0.0).alias("confidence"),
        F.when((F.size(tokens) == 0) | ok, "rules").when(F.col(math), "rules_error").otherwise("passthrough").alias("method"),
        F.col(math).alias("is_math"),
        F.col(score).alias("math_score"),
        F.when(ok, read_["unknown"]).alias("unknown"),
        read_["error"].alias("error"),
    )
    return step.withColumn(into, result).drop(said, tokens, score, math, got)


def with_fallback(rows: DataFrame, fallback: Callable[[Column], Column], text: str = "text", into: str = "result", least: float = 0.7) -> DataFrame:
    """canonicalized(), where a formula of less than the least confidence is replaced by what the fallback makes of the text, if that is valid LaTeX; its confidence is then at most 0.9 and its method llm.

    fallback gives a struct of latex and confidence, null for none: a model's batch function, or nothing offline.
    """
    (other,) = fresh(rows.withColumn(into, F.lit(0)), "_other")
    out = canonicalized(rows, text, into)
    weak = F.col(f"{into}.is_math") & (F.col(f"{into}.confidence") < least)
    out = out.withColumn(other, F.when(weak, fallback(F.col(text))))
    better = F.col(other).isNotNull() & valid_latex(F.col(f"{other}.latex"))
    value = F.col(into).withField("latex", F.col(f"{other}.latex")).withField("confidence", F.least(F.lit(0.9), F.col(f"{other}.confidence"))).withField("method", F.lit("llm"))
    return out.withColumn(into, F.when(better, value).otherwise(F.col(into))).drop(other)


@lru_cache(REMEMBERED)
def _text_once(latex: str | None, style: str) -> str:
    return latex_to_text(latex, style)


@F.pandas_udf(T.StringType())
def _text(latex: pd.Series) -> pd.Series:
    return latex.map(lambda s: _text_once(s, "unicode"), na_action=None)


@F.pandas_udf(T.StringType())
def _plain_text(latex: pd.Series) -> pd.Series:
    return latex.map(lambda s: _text_once(s, "plain"), na_action=None)


def text_of(latex: str | Column, style: str = "unicode") -> Column:
    """A formula as readable text; null as an empty one. Style plain writes scripts with ^ and _."""
    return (_plain_text if style == "plain" else _text)(F.col(latex) if isinstance(latex, str) else latex)


def viewed(predictions: DataFrame, views: list[tuple[str, str, bool]], hyp: str = "hyp") -> DataFrame:
    """(… view, hyp): predictions as each view (name, system, by rules) sees them. A prediction is normalised once, whatever the number of views."""
    spark, canon = predictions.sparkSession, fresh(predictions, "_canon")[0]
    table = spark.createDataFrame(views, "view string, system string, by_rules boolean")
    once = canonicalized(predictions, hyp, canon)
    joined = once.join(F.broadcast(table), "system")  # a few views
    return joined.withColumn(hyp, F.when(F.col("by_rules"), F.col(f"{canon}.latex")).otherwise(F.col(hyp))).drop(canon, "by_rules")
