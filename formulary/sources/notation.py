"""Notations: how an operation is written in LaTeX and how it is said.

A formula is a tree of notations over symbols. Each notation is one line with both sides, so what is
written and what is said always agree. A short text describes a tree, with choices: `le(sum, n|k)`.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import cache

from formulary.functions.spoken import ONES, TENS

GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi rho sigma tau phi psi omega".split()
CAPITAL_GREEK = "Gamma Delta Theta Lambda Sigma Phi Psi Omega".split()

#: How tightly a notation holds: what is looser than its place asks for is said and written as a quantity.
RELATION, SUM, PRODUCT, POWER, ATOM = range(5)


@dataclass(frozen=True)
class Piece:
    """A formula: as written, as said, and how tightly it holds together."""

    tex: str
    said: str
    holds: int = ATOM

    def script(self) -> str:
        return self.tex if len(self.tex) == 1 or re.fullmatch(r"\\[a-zA-Z]+", self.tex) else "{" + self.tex + "}"


@dataclass(frozen=True)
class Notation:
    """tex has %1, %2 … (%1~ as a script, %1@ without the parentheses that are said); ways are what may be said; needs: how tightly each part must hold."""

    holds: int
    tex: str
    ways: tuple[str, ...]
    needs: tuple[int, ...] = ()

    def of(self, parts: list[Piece], r: random.Random) -> Piece:
        fit = [p if p.holds >= need else quantity(p) for p, need in zip(parts, self.needs + (RELATION,) * len(parts), strict=False)]

        def put(m: re.Match) -> str:
            k = int(m[1]) - 1
            return fit[k].script() if m[2] == "~" else (parts if m[2] == "@" else fit)[k].tex

        tex = re.sub(r"%(\d)([~@]?)", put, self.tex)
        said = re.sub(r"%(\d)", lambda m: fit[int(m[1]) - 1].said, r.choice(self.ways))
        return Piece(tex, said, self.holds)


def quantity(p: Piece) -> Piece:
    return Piece(f"({p.tex})", f"open paren {p.said} close paren")


def _lines(text: str) -> dict[str, Notation]:
    """name / how tightly it holds / LaTeX / what is said, ways apart by ; / needs of the parts."""
    out = {}
    for line in filter(None, map(str.strip, text.splitlines())):
        name, holds, tex, ways, *needs = (x.strip() for x in line.split(" / "))
        out[name] = Notation(int(holds), tex, tuple(w.strip() for w in ways.split(";")), tuple(map(int, needs[0].split())) if needs else ())
    return out


NOTATIONS = _lines(r"""
    eq / 0 / %1 = %2 / %1 equals %2; %1 is equal to %2
    ne / 0 / %1 \neq %2 / %1 is not equal to %2; %1 does not equal %2
    lt / 0 / %1 < %2 / %1 is less than %2; %1 less than %2
    gt / 0 / %1 > %2 / %1 is greater than %2; %1 greater than %2
    le / 0 / %1 \leq %2 / %1 is less than or equal to %2; %1 less than or equal to %2
    ge / 0 / %1 \geq %2 / %1 is greater than or equal to %2; %1 greater than or equal to %2
    approx / 0 / %1 \approx %2 / %1 is approximately %2; %1 approximately equal to %2
    to / 0 / %1 \to %2 / %1 goes to %2; %1 converges to %2
    propto / 0 / %1 \propto %2 / %1 proportional to %2
    implies / 0 / %1 \implies %2 / %1 implies %2
    iff / 0 / %1 \iff %2 / %1 if and only if %2
    in / 0 / %1 \in %2 / %1 is in %2; %1 belongs to %2; %1 is an element of %2
    within / 0 / %1 \in %2 / %1 is in %2; %1 in %2
    notin / 0 / %1 \notin %2 / %1 is not in %2
    subset / 0 / %1 \subset %2 / %1 is a subset of %2
    subseteq / 0 / %1 \subseteq %2 / %1 is a subset of or equal to %2
    maps / 0 / %1 : %2 \to %3 / %1 from %2 to %3
    yields / 0 / %1 \to %2 / %1 yields %2
    chain / 0 / %1 < %2 < %3 / %1 is less than %2 is less than %3
    plus / 1 / %1 + %2 / %1 plus %2 / 1 1
    minus / 1 / %1 - %2 / %1 minus %2 / 1 2
    pm / 1 / %1 \pm %2 / %1 plus or minus %2 / 1 2
    neg / 1 / -%1 / minus %1 / 2
    cup / 1 / %1 \cup %2 / %1 union %2 / 2 2
    cap / 1 / %1 \cap %2 / %1 intersection %2 / 2 2
    setminus / 1 / %1 \setminus %2 / %1 set minus %2 / 2 2
    cross / 2 / %1 \times %2 / %1 cross %2 / 2 2
    dot / 2 / %1 \cdot %2 / %1 dot %2 / 2 2
    mul / 2 / %1 %2 / %1 %2 / 2 2
    mul3 / 2 / %1 %2 %3 / %1 %2 %3 / 2 2 2
    times / 2 / %1 %2 / %1 times %2 / 2 2
    over / 2 / \frac{%1@}{%2@} / %1 over %2 / 2 3
    fraction / 4 / \frac{%1}{%2} / the fraction %1 over %2 end fraction
    sq / 3 / %1^2 / %1 squared; %1 to the second / 4
    cube / 3 / %1^3 / %1 cubed; %1 to the third / 4
    pow / 3 / %1^%2~ / %1 to the %2; %1 to the power of %2; %1 raised to the %2 / 4
    inv / 3 / %1^{-1} / %1 inverse; %1 to the minus one / 4
    down / 3 / %1^{-%2} / %1 to the minus %2 / 4 3
    fact / 3 / %1! / %1 factorial / 4
    sub / 4 / %1_%2~ / %1 sub %2
    sub2 / 4 / %1_{%2,%3} / %1 sub %2 %3
    next / 4 / %1_{%2+1} / %1 sub %2 plus one
    call / 4 / %1(%2@) / %1 of %2 / 0 2
    call2 / 4 / %1(%2,%3) / %1 of %2 and %3
    dash / 4 / %1'(%2) / %1 prime of %2
    dashes / 4 / %1''(%2) / %1 double prime of %2
    sin / 3 / \sin(%1@) / sine of %1; sin of %1 / 2
    cos / 3 / \cos(%1@) / cosine of %1; cos of %1 / 2
    tan / 3 / \tan(%1@) / tangent of %1; tan of %1 / 2
    log / 3 / \log(%1@) / log of %1 / 2
    ln / 3 / \ln(%1@) / natural log of %1 / 2
    exp / 3 / \exp(%1@) / exponential of %1 / 2
    sine / 2 / \sin %1 / sine %1 / 4
    cosine / 2 / \cos %1 / cosine %1 / 4
    logof / 2 / \log %1 / log %1 / 4
    logbase / 2 / \log_%1~ %2 / log base %1 of %2 / 4 4
    sqrt / 4 / \sqrt{%1@} / the square root of %1 / 4
    root / 4 / \sqrt{%1} / the square root of open paren %1 close paren
    abs / 4 / |%1| / the absolute value of %1; absolute value of %1
    paren / 4 / (%1) / open paren %1 close paren; left paren %1 right paren
    bar / 4 / \bar{%1} / %1 bar / 4
    hat / 4 / \hat{%1} / %1 hat / 4
    tilde / 4 / \tilde{%1} / %1 tilde / 4
    vec / 4 / \vec{%1} / vector %1
    bold / 4 / \mathbf{%1} / bold %1
    closure / 4 / \overline{%1} / the closure of %1; %1 closure
    boundary / 4 / \partial %1 / the boundary of %1; partial %1
    int / 2 / \int_%1~^%2~ %3\,d%4 / the integral from %1 to %2 of %3 d %4 / 0 0 2
    prim / 2 / \int %1\,d%2 / the integral of %1 d %2 / 2
    iint / 2 / \iint_%1 %2\,d%3 / the double integral over %1 of %2 d %3 / 0 2
    dby / 2 / \frac{d}{d%2} %1 / the derivative of %1 with respect to %2 / 3
    d2by / 2 / \frac{d^2}{d%2^2} %1 / the second derivative of %1 with respect to %2 / 3
    pdby / 2 / \frac{\partial}{\partial %2} %1 / the partial derivative of %1 with respect to %2 / 3
    nablaof / 2 / \nabla (%1) / nabla of %1
    sum / 2 / \sum_{%1=%2}^%3~ %4 / the sum from %1 equals %2 to %3 of %4 / 0 0 0 2
    prod / 2 / \prod_{%1=%2}^%3~ %4 / the product from %1 equals %2 to %3 of %4 / 0 0 0 2
    sumover / 2 / \sum_%1 %2 / the sum over %1 of %2 / 0 2
    lim / 2 / \lim_{%1 \to %2} %3 / the limit as %1 goes to %2 of %3; the limit as %1 approaches %2 of %3 / 0 0 2
    d / 4 / \frac{d%1}{d%2} / d %1 d %2; d %1 over d %2; the derivative of %1 with respect to %2
    d2 / 4 / \frac{d^2 %1}{d%2^2} / d squared %1 d %2 squared; the second derivative of %1 with respect to %2
    pd / 4 / \frac{\partial %1}{\partial %2} / partial %1 partial %2; partial %1 over partial %2; the partial derivative of %1 with respect to %2
    pd2 / 4 / \frac{\partial^2 %1}{\partial %2^2} / partial squared %1 partial %2 squared
    pdd / 4 / \frac{\partial^2 %1}{\partial %2 \partial %3} / partial squared %1 partial %2 partial %3
    nabla / 3 / \nabla %1 / nabla %1 / 3
    grad / 3 / \nabla_%2~ %1 / the gradient of %1 with respect to %2
    T / 3 / %1^T / %1 transpose / 4
    det / 4 / \det(%1) / the determinant of %1; determinant of %1
    tr / 4 / \operatorname{tr}(%1) / the trace of %1
    norm / 4 / \|%2\|_%1~ / the %1 norm of %2
    ell / 4 / \ell_%1~ / the %1 norm
    inner / 4 / \langle %1, %2 \rangle / the inner product of %1 and %2
    P / 4 / P(%1) / the probability that %1; P of %1; the probability of %1
    given / 0 / %1 \mid %2 / %1 given %2
    E / 4 / E[%1] / the expectation of %1; the expected value of %1
    cond / 4 / \mathbb{E}[%1 \mid %2] / the conditional expectation of %1 given %2
    Var / 4 / \operatorname{Var}(%1) / the variance of %1; variance of %1
    Cov / 4 / \operatorname{Cov}(%1, %2) / the covariance of %1 and %2
    normal / 0 / %1 \sim \mathcal{N}(%2, %3) / %1 is normally distributed with mean %2 and variance %3
    drawn / 4 / \mathbb{E}_{%1 \sim %2(%1)}[%3] / the expectation over %1 distributed as %2 of %1 of %3
    KL / 4 / D_{KL}(%1 \| %2) / the KL divergence of %1 and %2
    argmin / 2 / \arg\min_%1~ %2 / arg min over %1 of %2 / 0 2
    argmax / 2 / \arg\max_%1~ %2 / arg max over %1 of %2 / 0 2
    sup / 2 / \sup_{%1} %2 / the supremum over %1 of %2 / 0 2
    inf / 2 / \inf_{%1} %2 / the infimum over %1 of %2 / 0 2
    all / 0 / \forall %1 \in %2 / for all %1 in %2
    some / 0 / \exists %1 \in %2 / there exists %1 in %2
    any / 0 / \forall %1 > 0 / for all %1 greater than zero
    O / 4 / O(%1) / big O of %1
    concat / 0 / %1 \; %2 / %1 %2
""")

#: Symbols that aren't said as they are spelled.
SYMBOLS = {
    "inf_": Piece(r"\infty", "infinity"), "nothing": Piece(r"\emptyset", "the empty set"), "hbar": Piece(r"\hbar", "h bar"), "ell_": Piece(r"\ell", "ell"),
    "RR": Piece(r"\mathbb{R}", "R"), "NN": Piece(r"\mathbb{N}", "N"), "ZZ": Piece(r"\mathbb{Z}", "Z"), "QQ": Piece(r"\mathbb{Q}", "Q"), "CC": Piece(r"\mathbb{C}", "C"),
    "Rn": Piece(r"\mathbb{R}^n", "R n"), "Rd": Piece(r"\mathbb{R}^d", "R d"), "half": Piece(r"\frac{1}{2}", "one half", PRODUCT), "third": Piece(r"\frac{1}{3}", "one third", PRODUCT),
    "quarters": Piece(r"\frac{3}{4}", "three quarters", PRODUCT), "minus1": Piece("-1", "minus one", SUM), "minusinf": Piece(r"-\infty", "minus infinity", SUM),
}
SYMBOLS |= {g: Piece("\\" + g, g) for g in GREEK + ["pi"]} | {g: Piece("\\" + g, f"capital {g.lower()}") for g in CAPITAL_GREEK}
#: Phrases that trees share.
PHRASES = {
    "var": "x|y|z|t|n|k|m|u|v|w|a|b|c",
    "index": "i|j|k|m|n",
    "greek": "|".join(GREEK),
    "digit": "2|3|4|5|6|7|8|9",
    "number": "1|2|3|4|5|6|7|8|9|0.5|2.5|1.5|9.8|0.1",
    "set": "A|B|S|U|X",
    "matrix": "A|B|C|M|Q",
    "power": "sq(var)|sq(var)|cube(var)|pow(var, n|k|m|p)|inv(var)|pow(var, 4|5|6)",
    "indexed": "sub(var, index)|sub(var, index)|sub(var, 0|1|2)|sub2(var, i|j, k|m|n)",
    "named": "sin(var)|cos(var)|tan(var)|log(var)|ln(var)|exp(greek)|sine(var)|cosine(greek)|logof(var)",
    "called": "call(f|g|h, var)|call(f|g|h, greek)|named",
    "growth": "pow(e, var)|down(e, var)|pow(e, sq(var))",
    "term": "var|var|number|greek|power|power|indexed|called|growth|mul(digit, var)",
    "sums": "plus(term, term)|minus(term, term)|plus(plus(term, term), term)",
    "inside": "sq(x)|cube(x)|sin(x)|cos(x)|down(e, x)|over(1, x)|call(f, x)|mul(x, pow(e, x))",
}

# -- trees from texts -----------------------------------------------------------------------------

_WORD = re.compile(r"\$\d|[\w.]+|[(),|:]")


@cache
def tree(text: str) -> list:
    """Alternatives of a text. Each is (place or None, name, parts); a part is a list of alternatives too."""
    words = _WORD.findall(text)[::-1]

    def alternatives() -> list:
        out = [one()]
        while words and words[-1] == "|":
            words.pop()
            out.append(one())
        place = next((p for p, _, _ in out if p), None)
        return [(place, name, parts) for _, name, parts in out]

    def one() -> tuple:
        name, place = words.pop(), None
        if words and words[-1] == ":":
            words.pop()
            place, name = name, words.pop()
        parts = []
        while words and words[-1] in ("(", ",") and (words[-1] == "(") == (not parts):
            words.pop()
            parts.append(alternatives())
        if parts:
            words.pop()
        return place, name, parts

    return alternatives()


def said_number(text: str) -> str:
    whole, _, digits = text.partition(".")
    n = int(whole)
    out = ONES[n] if n < 20 else "one hundred" if n == 100 else " ".join(filter(None, (TENS[n // 10 - 2], ONES[n % 10] if n % 10 else "")))
    return " ".join([out, "point", *(ONES[int(d)] for d in digits)]) if digits else out


def symbol(name: str) -> Piece:
    if name in SYMBOLS:
        return SYMBOLS[name]
    return Piece(name, said_number(name) if name[0].isdigit() else name)


def drawn(alternatives: list, r: random.Random, places: dict[str, Piece], notations: dict[str, Notation] = NOTATIONS) -> Piece:
    """One of the alternatives, drawn all the way down. places holds what $1, $2 … were drawn as."""
    place, name, parts = r.choice(alternatives)
    if name[0] == "$":
        return places[name]
    if parts:
        out = notations[name].of([drawn(p, r, places, notations) for p in parts], r)
    else:
        out = drawn(tree(PHRASES[name]), r, places, notations) if name in PHRASES else symbol(name)
    if place:
        places[place] = out
    return out


def formula(text: str, r: random.Random) -> Piece:
    return drawn(tree(text), r, {})
