"""Queries that hold the reader of spoken formulas and the renderer against SQL, construct by construct.

A group is a list of what is said (or written) and what must come of it, with slots that columns of
parts fill: {x} and {y} letters, {m} an index, {n} a number's word and {N} its digit, {g} a Greek
letter's name. The oracle writes the expected results; the query reads or renders the same inputs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formulary.operators import normalize

#: Slots as SQL for both engines.
_PICK = "split_part('{words}', ' ', CAST(({key}) % {n} AS INT) + 1)"
_LISTS = {"x": ("x y z u v w", "p_partkey"), "y": ("s t r b c", "p_partkey"), "m": ("k m n q", "p_size"), "n": ("two three four five six seven eight nine", "p_size"), "N": ("2 3 4 5 6 7 8 9", "p_size"), "g": ("alpha beta gamma theta lambda mu sigma", "p_partkey")}
SLOTS = {name: _PICK.format(words=words, key=key, n=len(words.split())) for name, (words, key) in _LISTS.items()}

SPOKEN = {
    "sequences": [  # terms, relations, operators, words that nothing explains
        ("{x} plus {n} is less than or equal to the {y}", r"{x}+{N}\leq {y}"),
        ("{x} zebra equals {n}", r"{x}\text{{zebra}}={N}"),
        ("for all {x} greater than {n} there exists {y}", r"\forall {x}>{N}\exists {y}"),
        ("{x} if and only if {y} plus or minus {n}", r"{x}\iff {y}\pm {N}"),
    ],
    "fractions": [
        ("{x} over {y} plus {n}", r"\frac{{{x}}}{{{y}}}+{N}"),
        ("{n} {x} over {y} {m}", r"\frac{{{N}{x}}}{{{y}{m}}}"),
        ("open paren {x} plus {n} close paren over {y}", r"\frac{{{x}+{N}}}{{{y}}}"),
        ("one half {x} squared plus two thirds", r"\frac{{1}}{{2}}{x}^2+\frac{{2}}{{3}}"),
        ("{x} equals three quarters {y}", r"{x}=\frac{{3}}{{4}}{y}"),
    ],
    "mappings": [("f from {x} to {y} equals {n}", r"f:{x}\to {y}={N}"), ("g from R n to R squared", r"g:\mathbb{{R}}^n\to\mathbb{{R}}^2")],
    "signs": [
        ("minus {x} equals {n} times {y}", r"-{x}={N}\times {y}"),
        ("negative {x} plus {y} times {m}", r"-{x}+{y}{m}"),
        ("{x} equals minus {n}", r"{x}=-{N}"),
        ("{x} minus {n} divided by {y}", r"{x}-{N}\div {y}"),
    ],
    "parentheses": [
        ("open paren {x} plus {y} close paren squared", r"({x}+{y})^2"),
        ("left parenthesis {x} minus {n} right parenthesis {m}", r"({x}-{N}){m}"),
        ("open bracket {x} close bracket equals {n}", r"({x})={N}"),
    ],
    "numbers": [
        ("{x} equals three point one four", r"{x}=3.14"),
        ("{x} equals twenty {n}", r"{x}=2{N}"),
        ("one hundred plus {n} equals {x}", r"100+{N}={x}"),
        ("zero point {n} plus {x} squared", r"0.{N}+{x}^2"),
    ],
    "letters": [
        ("capital sigma plus {g} equals pie", r"\Sigma+\{g}=\pi"),
        ("bold {x} equals vector {y} plus vector {g}", r"\mathbf{{{x}}}=\vec{{{y}}}+\vec{{\{g}}}"),
        ("KL plus {x} equals ABC", r"KL+{x}=ABC"),
        ("{x} {y} equals {g} {m}", r"{x}{y}=\{g} {m}"),
    ],
    "functions": [
        ("sine of {x} plus cosine {y}", r"\sin({x})+\cos {y}"),
        ("max of {x} and {y} equals {n}", r"\max({x},{y})={N}"),
        ("natural log of {g} plus log {x}", r"\ln(\{g})+\log {x}"),
        ("softmax of {x} equals exponential of {y}", r"\operatorname{{softmax}}({x})=\exp({y})"),
    ],
    "sets": [
        ("{x} is in R n by m", r"{x}\in\mathbb{{R}}^{{n\times m}}"),
        ("{x} is in Z and {y} is not in Q", r"{x}\in\mathbb{{Z}}{y}\notin\mathbb{{Q}}"),
        ("R cubed union the empty set", r"\mathbb{{R}}^3\cup\emptyset"),
        ("{x} plus {n} belongs to the real numbers", r"{x}+{N}\in\mathbb{{R}}"),
    ],
    "indices": [
        ("{x} sub {m} plus one equals {y} sub {n}", r"{x}_{{{m}+1}}={y}_{N}"),
        ("{x} sub i j plus {y} sub {g}", r"{x}_{{i,j}}+{y}_\{g}"),
        ("{x} sub {m} squared equals {n}", r"{x}_{m}^2={N}"),
        ("{x} sub twenty plus {y}", r"{x}_{{20}}+{y}"),
    ],
    "powers": [
        ("{x} to the {m} plus {y} cubed", r"{x}^{m}+{y}^3"),
        ("{x} to the power of minus {n}", r"{x}^{{-{N}}}"),
        ("{x} raised to the fifth equals {y} to the {g}", r"{x}^5={y}^\{g}"),
        ("e to the {x} squared plus e to the {x} sub {m}", r"e^{{{x}^2}}+e^{{{x}_{m}}}"),
    ],
    "marks": [
        ("{x} inverse plus {y} transpose", r"{x}^{{-1}}+{y}^T"),
        ("{x} prime equals {y} double prime plus {m} factorial", r"{x}'={y}''+{m}!"),
        ("{x} bar sub {m} plus {y} hat", r"\bar{{{x}}}_{m}+\hat{{{y}}}"),
        ("{x} sub {m} tilde equals {g} hat", r"\tilde{{{x}}}_{m}=\hat{{\{g}}}"),
        ("{x} closure equals {y} overline", r"\overline{{{x}}}=\overline{{{y}}}"),
    ],
    "applications": [
        ("f of {x} equals g of {x} and {y}", r"f({x})=g({x},{y})"),
        ("phi of {x} over {y} plus {n}", r"\phi(\frac{{{x}}}{{{y}}})+{N}"),
        ("f prime of open paren {x} plus {n} close paren", r"f'({x}+{N})"),
        ("T sub {m} of {x} equals {n}", r"T_{m}({x})={N}"),
    ],
    "closures": [("the closure of {x} equals {y} union the boundary of {x}", r"\overline{{{x}}}={y}\cup\partial {x}")],
    "integrals": [
        ("the integral from zero to {m} of {x} squared d {x}", r"\int_0^{m}{x}^2\,d{x}"),
        ("the integral of f of {x} d {x} equals {n}", r"\int f({x})\,d{x}={N}"),
        ("the integral from minus {n} to infinity of e to the {y} d {y}", r"\int_{{-{N}}}^\infty e^{y}\,d{y}"),
        ("integral of sine of x", r"\int\sin(x)\,dx"),
    ],
    "sums": [
        ("the sum from {m} equals one to {n} of {x} sub {m}", r"\sum_{{{m}=1}}^{N}{x}_{m}"),
        ("the product from {m} equals zero to infinity of {x} equals {y}", r"\prod_{{{m}=0}}^\infty {x}={y}"),
        ("the summation over {m} of {x} plus {y}", r"\sum_{m}{x}+{y}"),
    ],
    "limits": [
        ("the limit as {x} goes to infinity of {x} over {y}", r"\lim_{{{x}\to\infty}}\frac{{{x}}}{{{y}}}"),
        ("the limit as {m} approaches {n} of f of {m} equals {x}", r"\lim_{{{m}\to {N}}}f({m})={x}"),
        ("limit as {x} tends to zero of {y} squared", r"\lim_{{{x}\to 0}}{y}^2"),
    ],
    "derivatives": [
        ("the derivative of {y} with respect to {x}", r"\frac{{d{y}}}{{d{x}}}"),
        ("the second derivative of f of {x} with respect to {x}", r"\frac{{d^2}}{{d{x}^2}}f({x})"),
        ("the partial derivative of {g} with respect to {x}", r"\frac{{\partial\{g}}}{{\partial {x}}}"),
        ("d {y} over d {x} plus d squared {y} d {x} squared", r"\frac{{d{y}}}{{d{x}}}+\frac{{d^2{y}}}{{d{x}^2}}"),
        ("partial squared f over partial {x} partial {y}", r"\frac{{\partial^2f}}{{\partial {x}\partial {y}}}"),
        ("partial {g} over partial {x} squared", r"\frac{{\partial\{g}}}{{\partial {x}^2}}"),
    ],
    "roots": [
        ("the square root of {x} plus {n}", r"\sqrt{{{x}}}+{N}"),
        ("the square root of open paren {x} plus {n} close paren", r"\sqrt{{{x}+{N}}}"),
        ("the absolute value of {x} minus {y} is less than {n}", r"|{x}-{y}|<{N}"),
    ],
    "norms": [
        ("the two norm of bold {x} equals {n}", r"\|\mathbf{{{x}}}\|_2={N}"),
        ("the norm of {x} plus {n}", r"\|{x}\|+{N}"),
        ("the p norm equals {n}", r"\ell_p={N}"),
    ],
    "products": [
        ("the determinant of {x} minus {n} equals zero", r"\det({x}-{N})=0"),
        ("the trace of {x} {y}", r"\operatorname{{tr}}({x}{y})"),
        ("the inner product of {x} and {y} equals {n}", r"\langle {x},{y}\rangle={N}"),
    ],
    "probabilities": [
        ("the probability that X equals {n} given {y}", r"P(X={N}\mid {y})"),
        ("P of B squared given {x}", r"P(B^2\mid {x})"),
        ("the variance of {x} plus the covariance of {x} and {y}", r"\operatorname{{Var}}({x})+\operatorname{{Cov}}({x},{y})"),
        ("the expected value of {x} equals {n}", r"E[{x}]={N}"),
        ("the conditional expectation of {x} given {y}", r"\mathbb{{E}}[{x}\mid {y}]"),
        ("the expectation over {x} distributed as p of {x} of f of {x}", r"\mathbb{{E}}_{{{x}\sim p({x})}}[f({x})]"),
        ("the expectation of f of {x} where {x} is drawn from {y}", r"\mathbb{{E}}_{{{x}\sim {y}}}[f({x})]"),
        ("E of {x} squared equals {n}", r"E[{x}^2]={N}"),
    ],
    "measures": [
        ("the gradient of L of {g} with respect to {g}", r"\nabla_\{g} L(\{g})"),
        ("the KL divergence of {x} and {y}", r"D_{{KL}}({x}\|{y})"),
        ("log base {n} of {x} equals {y}", r"\log_{N}{x}={y}"),
        ("{x} equals big O of {m} squared", r"{x}=O({m}^2)"),
    ],
    "extremes": [
        ("the supremum over {x} of f of {x}", r"\sup_{x}f({x})"),
        ("the infimum over {x} in A of f of {x}", r"\inf_{{{x}\in A}}f({x})"),
        ("arg min over {g} of L of {g}", r"\arg\min_\{g} L(\{g})"),
        ("argmax over {x} of f of {x} equals {y}", r"\arg\max_{x}f({x})={y}"),
    ],
    "normals": [
        ("X is normally distributed with mean {g} and variance {x} squared", r"X\sim\mathcal{{N}}(\{g},{x}^2)"),
        ("{x} is distributed as normal {n} {y}", r"{x}\sim\mathcal{{N}}({N},{y})"),
    ],
}

WRITTEN = {
    "cleaning": [("${x}-{N}$", "{x} − {N}"), (r"{x} , {y}", "{x}, {y}"), (r"\text{{a-b}} {x}", "a−b {x}")],
    "arguments": [(r"\frac{N}{x}", "{N}/{x}"), (r"\sqrt {x}", "√{x}"), (r"\frac{{{x}}}{y}", "{x}/{y}"), (r"\vec {x}", "{x}\u20d7")],
    "scripts": [(r"{x}^{{{N}n}} + {y}", "{x}{p}ⁿ + {y}"), (r"{x}_{{{N}}}^{{-{N}}}", "{x}{b}⁻{p}"), (r"{x}_{{b}}", "{x}_b"), (r"{x}^{{\infty+q}}", "{x}^(∞+q)"), (r"{x}'^{N}", "{x}′{p}")],
    "symbols": [(r"\{g} \leq \infty", "{g} ≤ ∞"), (r"{x} \in \emptyset", "{x} ∈ ∅"), (r"{x} \cup {y} \times {N}", "{x} ∪ {y} × {N}"), (r"\sin {x} - {N}", "sin {x} − {N}")],
    "fractions": [(r"\frac{{1}}{{2}} {x}", "½ {x}"), (r"\frac{{{x} + {N}}}{{{y}}}", "({x} + {N})/{y}"), (r"\frac{{{x}}}{{{N}{y}}}", "{x}/({N}{y})"), (r"\dfrac{{\partial {x}}}{{\partial {y}}}", "∂{x}/∂{y}")],
    "roots": [(r"\sqrt{{{x}}}", "√{x}"), (r"\sqrt[3]{{{x} + {N}}}", "∛({x} + {N})"), (r"\binom{{{x}}}{{{N}}}", "C({x}, {N})"), (r"\sqrt[n]{{{x}}}", "ⁿ√{x}")],
    "alphabets": [(r"\mathbb{{R}}^n \ni {x}", "ℝⁿ ∋ {x}"), (r"\mathbf{{v}} + {x}", "𝐯 + {x}"), (r"\mathcal{{L}}({x})", "ℒ({x})"), (r"\operatorname{{tr}}({x})", "tr({x})"), (r"\text{{if }}{x}", "if {x}")],
    "accents": [(r"\vec{{{x}}}", "{x}\u20d7"), (r"\overline{{{x}{y}}}", "{x}\u0305{y}\u0305")],
    "environments": [
        (r"\begin{{pmatrix}} {x} & {y} \\ 0 & {N} \end{{pmatrix}}", "({x} {y}; 0 {N})"),
        (r"\begin{{bmatrix}} {x} \\ {y} \end{{bmatrix}}", "[{x}; {y}]"),
        (r"\begin{{vmatrix}} {x} & {N} \end{{vmatrix}}", "|{x} {N}|"),
    ],
    "delimiters": [(r"\left( {x} \right)", "({x})"), (r"\left\{{ {x} \right\}}", "{{ {x} }}"), (r"{x} \not= {y}", "{x} ≠ {y}"), (r"{x} \pmod {N}", "{x} (mod {N})"), (r"\overset{{*}}{{{x}}}\phantom{{{y}}}", "{x}"), (r"\odd {x}", r"\odd {x}")],
    "spacing": [(r"{x}+{y}={N}", "{x} + {y} = {N}"), (r"-{x}", "−{x}"), (r"{x}=-{N}", "{x} = −{N}"), (r"{N}\sum_{{i=1}}^n x_i", "{N} ∑ᵢ₌₁ⁿ xᵢ"), (r"\int {x}\,d{x}", "∫ {x} d{x}"), (r"({x}, -{y})", "({x}, −{y})")],
}
#: In what is shown: {p} and {b} are the number raised and lowered, {g} is the letter.
_SHOWN = {"p": ("² ³ ⁴ ⁵ ⁶ ⁷ ⁸ ⁹", "p_size"), "b": ("₂ ₃ ₄ ₅ ₆ ₇ ₈ ₉", "p_size"), "g": ("α β γ θ λ μ σ", "p_partkey")}
SHOWN_SLOTS = SLOTS | {name: _PICK.format(words=words, key=key, n=len(words.split())) for name, (words, key) in _SHOWN.items()}


def _sql(template: str, slots: dict[str, str]) -> str:
    """A template as SQL text for both engines; backslashes and quotes as characters, which the engines' literals read differently."""
    parts = []
    for text, slot in re.findall(r"((?:[^{}]|\{\{|\}\})+)|\{(\w)\}", template):
        if slot:
            parts.append(slots[slot])
            continue
        for piece in re.split(r"([\\'])", text.replace("{{", "{").replace("}}", "}")):
            parts.append({"\\": "chr(92)", "'": "chr(39)"}.get(piece) or f"'{piece}'")
    return f"concat({', '.join([*(p for p in parts if p != repr('')), repr('')])})"


def _choice(cases: list[tuple[str, str]], side: int, slots: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {k} THEN {_sql(case[side], slots)}" for k, case in enumerate(cases))
    return f"CASE CAST(p_partkey % {len(cases)} AS INT) {whens} END"


def _inputs(spark: SparkSession, sf_dir: str, cases: list[tuple[str, str]]) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("formulary_phrases")
    return spark.sql(f"SELECT p_partkey AS id, {_choice(cases, 0, SLOTS)} AS said FROM formulary_phrases")


def _reading(cases):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Spoken formulas of a group, read."""
        rows = normalize.canonicalized(_inputs(spark, sf_dir, cases), "said")
        return rows.select("id", "said", "result.latex", "result.method")

    return run, f"SELECT p_partkey AS id, {_choice(cases, 0, SLOTS)} AS said, {_choice(cases, 1, SLOTS)} AS latex, 'rules' AS method FROM part"


def _rendering(cases, style: str = "unicode"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Written formulas of a group, rendered."""
        return _inputs(spark, sf_dir, cases).select("id", F.col("said").alias("latex"), normalize.text_of("said", style).alias("shown"))

    return run, f"SELECT p_partkey AS id, {_choice(cases, 0, SLOTS)} AS latex, {_choice(cases, 1, SHOWN_SLOTS)} AS shown FROM part"


PLAIN = [(r"{x}^{N} + {y}_{{{N}}}", "{x}^{N} + {y}_{N}"), (r"{x}^{{{N}{y}}}", "{x}^({N}{y})"), (r"\sum_{{i=1}}^n {x}", "∑_(i=1)^n {x}")]
QUERIES, ORACLES = {}, {}
for _name, _cases in SPOKEN.items():
    QUERIES[f"read_{_name}"], ORACLES[f"read_{_name}"] = _reading(_cases)
for _name, _cases in WRITTEN.items():
    QUERIES[f"shown_{_name}"], ORACLES[f"shown_{_name}"] = _rendering(_cases)
QUERIES["shown_plain"], ORACLES["shown_plain"] = _rendering(PLAIN, "plain")
