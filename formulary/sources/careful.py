"""Random trees said so carefully that the rules read them back: an attribute grammar over the spoken form.

Beside how tightly a piece holds (notation.Piece), each carries what its spoken ends do to their
neighbours. Upwards come: whether it begins with a number; whether it ends in an index, which takes a
letter that follows for a second one, or in two, of which what follows takes the second; whether it
ends open, so that it takes all that follows; whether it is a fraction, which takes the factors on
either side; whether it is a name or number, or else one factor. Downwards goes what a place can bear.
Where the two don't fit, parentheses are said, and written where the reader keeps them; factors that
would run together are said with times, numbers come first. Of 1,000 trees the tests ask 98 % to come
back in normal form.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from formulary.sources.formulas import INNER, LEAVES, TREE_WEIGHTS, short_and_rare
from formulary.sources.notation import ATOM, POWER, PRODUCT, SUM, Piece, formula

NUMBER, INDEX, INDICES, OPEN, OVER = "number", "index", "indices", "open", "over"


@dataclass(frozen=True)
class Said:
    """A piece with its attributes: starts and ends as above, plain if it is a name, a number or one with an index, single if it is one factor."""

    piece: Piece
    starts: str = ""
    ends: str = ""
    plain: bool = False
    single: bool = False

    @property
    def tex(self) -> str:
        return self.piece.tex

    @property
    def said(self) -> str:
        return self.piece.said

    @property
    def holds(self) -> int:
        return self.piece.holds


def within(s: Said, written: bool = True) -> Said:
    """In parentheses that are said; written too, unless the reader drops them in that place."""
    tex = f"({s.tex})" if written else s.tex
    return Said(Piece(tex, f"open paren {s.said} close paren", ATOM), single=True)


def leaf(text: str, r: random.Random) -> Said:
    p = formula(text, r)
    number = p.tex[0].isdigit()
    ends = INDICES if "," in p.tex else INDEX if "_" in p.tex else ""
    return Said(p, NUMBER if number else "", ends, p.holds == ATOM, True)


def argument(s: Said, written: bool) -> Said:
    """What one word such as sine or root applies to: a plain piece, or one in parentheses."""
    return s if s.plain else within(s, written)


def summand(s: Said, least: int, last: bool) -> Said:
    return s if s.holds >= least and (last or s.ends != OPEN) else within(s)


def factor(s: Said, last: bool) -> Said:
    """A factor takes no fraction beside it, and nothing open before another."""
    return s if s.holds >= PRODUCT and OVER not in (s.starts, s.ends) and (last or s.ends != OPEN) else within(s)


def product(a: Said, b: Said) -> Said:
    a, b = factor(a, False), factor(b, True)
    if b.starts == NUMBER and a.starts != NUMBER:
        a, b = factor(b, False), factor(a, True)
    if b.starts == NUMBER:
        made = Piece(rf"{a.tex} \cdot {b.tex}", f"{a.said} dot {b.said}", PRODUCT)
    elif a.ends in (INDEX, INDICES):
        made = Piece(f"{a.tex} {b.tex}", f"{a.said} times {b.said}", PRODUCT)
    else:
        made = Piece(f"{a.tex} {b.tex}", f"{a.said} {b.said}", PRODUCT)
    return Said(made, a.starts, b.ends)


def fraction(a: Said, b: Said) -> Said:
    """Over takes the factors on either side, so only plain pieces stand bare; parentheses around a whole side are said and not written."""
    a = a if a.plain and a.ends != INDICES else within(a, False)
    b = argument(b, b.holds < PRODUCT)  # below, the reader drops them around factors only
    return Said(Piece(rf"\frac{{{a.tex}}}{{{b.tex}}}", f"{a.said} over {b.said}", PRODUCT), OVER, OVER)


def raised(base: Said, exponent: str, said: str) -> Said:
    base = base if base.plain and base.ends != INDICES else within(base)
    return Said(Piece(f"{base.tex}^{exponent}", f"{base.said} {said}", POWER), base.starts, single=True)


def grown(depth: int, r: random.Random) -> Said:
    """A random tree that is at most so deep."""
    if depth <= 0 or r.random() < 0.15:
        return leaf(LEAVES, r)
    name = r.choices(list(INNER), list(INNER.values()))[0]
    one = grown(depth - 1, r) if name not in ("sub", "hat", "call", "pow") else None
    if name in ("plus", "minus"):
        a, b = summand(one, SUM, False), summand(grown(depth - 1, r), SUM if name == "plus" else PRODUCT, True)
        return Said(Piece(f"{a.tex} {'+' if name == 'plus' else '-'} {b.tex}", f"{a.said} {name} {b.said}", SUM), a.starts, b.ends)
    if name == "mul":
        return product(one, grown(depth - 1, r))
    if name == "fraction":
        return fraction(one, grown(depth - 1, r))
    if name in ("sq", "cube"):
        return raised(one, "2" if name == "sq" else "3", "squared" if name == "sq" else "cubed")
    if name == "pow":
        power = r.choice("nkm")
        return raised(leaf("var", r), power, f"to the {power}")
    if name == "sub":
        return leaf("sub(var, index)", r)
    if name == "hat":
        return Said(formula("hat(x|y|theta)", r), single=True)
    if name == "call":
        f, x = r.choice("fgh"), argument(grown(depth - 1, r), False)
        return Said(Piece(f"{f}({x.tex})", f"{f} of {x.said}", PRODUCT), ends=x.ends, single=True)
    if name == "sqrt":
        x = argument(one, False)
        return Said(Piece(rf"\sqrt{{{x.tex}}}", f"the square root of {x.said}", PRODUCT), ends=x.ends, single=True)
    if name == "abs":
        return Said(Piece(f"|{one.tex}|", f"the absolute value of {one.said}", PRODUCT), ends=OPEN)
    x = argument(one, False)
    tex, said = {"sin": (r"\sin", "sine"), "cos": (r"\cos", "cosine"), "ln": (r"\ln", "natural log")}[name]
    return Said(Piece(f"{tex}({x.tex})", f"{said} of {x.said}", PRODUCT), ends=x.ends, single=True)


#: By domain what a tree begins with: as written, as said, and for each hole what stands there (any: all of it; term: a plain piece or parentheses that are written; bare: one whose parentheses aren't; first: nothing open, and no fraction at its start).
ROOTS = {
    "algebra": ["%1 = %2 / %1 equals %2 / first any", r"%1 \leq %2 / %1 is less than or equal to %2 / first any", "%1 > %2 / %1 is greater than %2 / first any"],
    "calculus": [r"\int_0^1 %1\,dx / the integral from zero to one of %1 d x / first", r"\sum_{i=1}^n %1 / the sum from i equals one to n of %1 / any", r"\lim_{x \to 0} %1 / the limit as x goes to zero of %1 / any", "f(x) = %1 / f of x equals %1 / any"],
    "linear_algebra": [r"\det(%1) / the determinant of %1 / bare", r"\|%1\|_2 / the two norm of %1 / term", r"\langle %1, %2 \rangle / the inner product of %1 and %2 / term term"],
    "probability": ["P(X \\leq %1) / P of X is less than or equal to %1 / any", r"E[%1] = \mu / the expected value of %1 equals mu / term", r"\operatorname{Var}(%1) = \sigma / the variance of %1 equals sigma / term"],
    "set_theory": [r"%1 \in A / %1 is in A / first", r"\forall x \in A %1 = %2 / for all x in A %1 equals %2 / first any"],
    "analysis": [r"%1 < \epsilon / %1 is less than epsilon / first", r"\sup_{x \in A} %1 / the supremum over x is in A of %1 / any", r"x_n \to %1 / x sub n goes to %1 / any"],
    "ml": [r"\arg\min_w %1 / arg min over w of %1 / any", r"\hat{y} = %1 / y hat equals %1 / any"],
    "physics": ["E = %1 / E equals %1 / any", r"F = m %1 / F equals m %1 / term"],
    "chemistry": ["k = %1 / k equals %1 / any"],
    "cs": ["O(%1) / big O of %1 / any", "T(n) = %1 / T of n equals %1 / any"],
}
_FITS = {"any": lambda s: s, "first": lambda s: s if s.ends != OPEN and s.starts != OVER else within(s), "term": lambda s: argument(s, True), "bare": lambda s: argument(s, False)}


def careful_record(seed: int, k: int, most_depth: int = 3) -> tuple:
    """The columns of formulas.record() for one tree that is said carefully."""
    r = random.Random(f"careful:{seed}:{k}")
    domain = r.choices(list(TREE_WEIGHTS), list(TREE_WEIGHTS.values()))[0]
    depth = min(most_depth, r.choice([1, 2, 2, 3]))
    tex, said, needs = r.choice(ROOTS[domain]).split(" / ")
    for n, need in enumerate(needs.split(), 1):
        part = _FITS[need](grown(depth, r))
        tex, said = tex.replace(f"%{n}", part.tex), said.replace(f"%{n}", part.said)
    return k, tex, said, domain, min(5, 2 + depth), f"careful.{domain}", False


def careful(spark: SparkSession, n: int, seed: int = 0, most_depth: int = 3, most_repeats: int = 3) -> DataFrame:
    """n such trees, as formulas.composed() gives its own: in the order drawn, few repeats, none that is too long."""
    return short_and_rare(spark, n, lambda k: careful_record(seed, k, most_depth), most_repeats)
