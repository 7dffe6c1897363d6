"""Spoken formulas against known LaTeX."""

from pyspark.sql import functions as F

from formulary.functions.latex import norm_latex
from formulary.operators.normalize import canonicalized

CASES = {
    "F sub x of x equals zero": "F_x(x) = 0",
    "F sub x y": "F_{x,y}",
    "sigma squared": r"\sigma^2",
    "lambda sub i": r"\lambda_i",
    "R n": r"\mathbb{R}^n",
    "partial derivative": r"\partial",
    "greater than or equal": r"\geq",
    "for all x in R": r"\forall x \in \mathbb{R}",
    "x bar": r"\bar{x}",
    "x hat": r"\hat{x}",
    "the limit as n goes to infinity of a sub n": r"\lim_{n \to \infty} a_n",
    "the integral from zero to one of x squared d x": r"\int_0^1 x^2\,dx",
    "partial f partial x": r"\frac{\partial f}{\partial x}",
    "pi is approximately three point fourteen": r"\pi \approx 3.14",
    "the integral from zero to pie of x squared d x": r"\int_0^\pi x^2\,dx",
}


def test_known_formulas(spark):
    rows = spark.createDataFrame(list(CASES.items()), "said string, latex string")
    out = canonicalized(rows, "said").select("said", "result.latex", norm_latex("result.latex") == norm_latex("latex")).collect()
    assert not [r for r in out if not r[2]]


def test_plain_text_passes(spark):
    rows = spark.createDataFrame([("the pie is on the table",), (None,), ("",)], "said string")
    out = [r["result"] for r in canonicalized(rows, "said").collect()]
    assert [(r["latex"], r["is_math"], r["method"]) for r in out] == [("the pie is on the table", False, "passthrough"), ("", False, "rules"), ("", False, "rules")]
