"""Formulas with what is said for them: drawn from templates, or grown as random trees.

Templates and trees are made of the same notations, so what is written and what is said always
agree. Row k of a seed is drawn by its own generator: any task makes any row, and a rerun makes the
same rows. Templates marked held out are a pool of their own.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from formulary.operators.datasets import capped, first_rows
from formulary.sources.folders import shared_folder
from formulary.sources.notation import NOTATIONS, POWER, PRODUCT, RELATION, SUM, Piece, formula

# How often a domain is drawn, for templates and for trees.
WEIGHTS = {"algebra": 1.3, "calculus": 2.2, "linear_algebra": 1.6, "probability": 1.6, "set_theory": 1.1, "analysis": 1.0, "ml": 1.6, "physics": 1.3, "chemistry": 0.6, "cs": 0.7}
TREE_WEIGHTS = {"algebra": 3, "calculus": 3.5, "linear_algebra": 1.5, "probability": 2, "set_theory": 1.2, "analysis": 1, "ml": 2, "physics": 1.5, "chemistry": 0.5, "cs": 0.7}

#: domain, difficulty, held out, name, tree.
TEMPLATES = [
    ("algebra", 1, False, "straight_line", "eq(var, plus(mul(number, var), number))|eq(plus(mul(digit, x), digit), digit)"),
    ("algebra", 1, False, "comparison", "lt(term, term)|gt(term, term)|ne(term, term)"),
    ("algebra", 2, False, "bounded_sum", "le(sums, term)|ge(sums, term)|eq(sums, number)"),
    ("algebra", 2, False, "proportion", "eq(over(a, b), over(c, d))|eq(term, over(power, term))|propto(var, over(1, power))"),
    ("algebra", 2, False, "surd", "eq(var, sqrt(var))|eq(var, root(plus(power, power)))|approx(sqrt(digit), 1.5|2.5)"),
    ("algebra", 3, False, "factored_square", "eq(minus(sq($1:a|x|p), sq($2:b|y|q)), mul(paren(plus($1, $2)), paren(minus($1, $2))))"),
    ("algebra", 3, False, "cubes", "plus(cube(var), cube(var))|minus(cube(x), cube(a))|eq(plus(cube(x), mul(digit, x)), digit)"),
    ("algebra", 2, False, "distance", "eq(abs(minus(var, number)), number)|le(abs(plus(x, y)), number)"),
    ("algebra", 2, False, "shares", "mul(half|third|quarters, var)|eq(var, mul(half|third, sq(var)))"),
    ("algebra", 4, True, "sum_of_roots", "eq(plus(sub(x, 1), sub(x, 2)), neg(over(b, a)))"),
    ("calculus", 2, False, "named_function", "eq(call(f|g|h, $1:x|t), sin($1)|cos($1)|exp($1)|ln($1)|sq($1)|down(e, $1))"),
    ("calculus", 2, False, "slope", "d(y|u|s, x|t)|eq(d(y, x), sums)|dash(f|g, x)"),
    ("calculus", 3, False, "curvature", "d2(y|u, x|t)|eq(dashes(f|g, x), neg(call(f|g, x)))|dashes(h, t)"),
    ("calculus", 3, False, "partial_slope", "pd(f|u|V, x|y|t)|pd2(f|u, x|y)|eq(pd(u, t), mul(c, pd2(u, x)))"),
    ("calculus", 4, False, "mixed_slope", "pdd(f|u, x, y)|pdd(g, y|s, t)"),
    ("calculus", 3, False, "area", "int(0|1|a|minus1|minusinf, 2|b|pi|inf_|T, inside, x)"),
    ("calculus", 3, False, "primitive", "prim(inside, x)|prim(over(1, x), x)"),
    ("calculus", 3, False, "finite_sum", "sum($1:i|k|j, 1|0, n|N|m, sub(a|x|y, $1))|sum($1:i|k, 1, n, sq($1))"),
    ("calculus", 4, False, "tail_sum", "sum($1:k|j, 0|1, inf_, over(1, sq($1)|fact($1)))|sum(n, 0, inf_, mul(sub(c, n), pow(x, n)))"),
    ("calculus", 3, False, "running_product", "prod($1:k|i, 1, n|m, sub(b|p|r, $1))"),
    ("calculus", 3, False, "approach", "lim($1:x|h|t, 0|inf_|a, call(f|g, $1)|sin($1)|over(1, $1))"),
    ("calculus", 4, True, "by_parts", "eq(prim(u, v), minus(mul(u, v), prim(v, u)))"),
    ("linear_algebra", 2, False, "of_a_matrix", "inv(matrix)|T(matrix)|det(matrix)|tr(matrix)"),
    ("linear_algebra", 3, False, "system", "eq(mul(matrix, bold(x|u)), bold(b|v))|eq(mul(A, bold(v)), mul(lambda, bold(v)))"),
    ("linear_algebra", 3, False, "orthogonal", "eq(mul(T($1:Q|U), $1), I)|eq(inv($1:Q|U), T($1))"),
    ("linear_algebra", 3, False, "lengths", "norm(2|1|p, bold(x|v|w))|ell(1|2|p)|le(norm(2, x), norm(1, x))"),
    ("linear_algebra", 3, False, "products", "inner(bold(u|x), bold(v|y))|eq(dot(bold(u), bold(v)), 0)|mul(T(bold(x)), bold(y))"),
    ("linear_algebra", 3, False, "spaces", "in(x|v|w, Rn|Rd)|eq(det(T($1:A|B)), det($1))"),
    ("linear_algebra", 4, True, "diagonal_form", "eq(A, mul3(P, D, inv(P)))"),
    ("probability", 2, False, "chance", "P(eq(X, x)|le(X, t)|cap(A, B)|given(A, B))|P(cup(A, B))"),
    ("probability", 2, False, "spread", "Var(X|Y|Z)|Cov(X, Y|Z)|eq(Var(X), sq(sigma))"),
    ("probability", 2, False, "mean_value", "E(X|Y|Z)|eq(E(X), mu)|eq(E($1:X|Y), 0)"),
    ("probability", 3, False, "bell", "normal(X|Y|Z, mu|0, sq(sigma)|1)"),
    ("probability", 3, False, "on_condition", "cond(X|Z, Y)|cond(Y, eq(X, x))"),
    ("probability", 3, False, "estimates", "hat(theta|mu|beta|sigma)|bar(x|y)|tilde(x|y)|eq(bar($1:x|y), mul(over(1, n), sum(i, 1, n, sub($1, i))))"),
    ("probability", 4, True, "standard_score", "eq(z, over(minus(x, mu), sigma))"),
    ("set_theory", 1, False, "elements", "in(x|a|b|n, set)|notin(x|y|a, set)|in(n|k, NN|ZZ)"),
    ("set_theory", 2, False, "combined", "cup(A|C, B|S)|cap(A|C, B|S)|setminus(A|U, B|S)|subset(A|C, B|S)|subseteq(A|C, B|U)"),
    ("set_theory", 3, False, "every_and_some", "all(x|y, RR|ZZ|set)|some(n|k, NN|ZZ|set)"),
    ("set_theory", 3, False, "reasoned", "implies(p, q)|iff(p, q)|eq(set, nothing)|implies(in(x, A), in(x, B))"),
    ("set_theory", 3, True, "number_tower", "subset(NN, ZZ)|subset(QQ, RR)|subset(RR, CC)"),
    ("analysis", 2, False, "edges", "closure(A|B|U|K)|boundary(A|B|U|K)"),
    ("analysis", 2, False, "small_numbers", "gt(epsilon|delta|eta, 0)|lt(delta, epsilon)"),
    ("analysis", 3, False, "nearby", "lt(abs(minus(x, a|y)), delta|epsilon)|lt(abs(minus(sub(x, n), L)), epsilon)"),
    ("analysis", 3, False, "mapping", "maps(f|g, X|A, Y|B)|to(sub(x, n), x|a)"),
    ("analysis", 4, False, "extremes", "sup(within(x, set), call(f, x))|inf(within(x, set), call(f|g, x))"),
    ("analysis", 5, True, "for_any_there_is", "concat(any(epsilon), some(N, NN))"),
    ("ml", 3, False, "gradients", "grad(call(L, $1:theta|phi), $1)|nabla(call(f|L, x|theta))"),
    ("ml", 3, False, "best_fit", "argmin($1:theta|w|phi, call(L|J, $1))|argmax($1:theta|w, call(f, $1))"),
    ("ml", 4, False, "expected_loss", "drawn(x, p, call(f, x))|drawn(z, q, call(g, z))"),
    ("ml", 4, False, "gates", "eq(call(sigma, x), over(1, plus(1, down(e, x))))|call(sigma, z|t)"),
    ("ml", 3, False, "update", "eq(next($1:theta|w, t), minus(sub($1, t), mul(eta|alpha, call(L, sub($1, t)))))"),
    ("ml", 4, False, "divergence", "KL(p, q)|ge(KL(p|q, q|p), 0)"),
    ("ml", 3, False, "prediction", "eq(hat(y), plus(mul(w, x), b))|eq(sub(hat(y), i), call(f, sub(x, i)))"),
    ("ml", 5, True, "squared_error", "mul(over(1, n), sum(i, 1, n, sq(paren(minus(sub(y, i), sub(hat(y), i))))))"),
    ("physics", 1, False, "laws", "eq(F, mul(k, x))|eq(E, mul(h, nu))|eq(v, over(d, t))|eq(P, mul(I, V))"),
    ("physics", 2, False, "arrows", "vec(F|E|B|v)|eq(vec(p), mul(m, vec(v)))|eq(vec(F), mul(q, vec(E)))"),
    ("physics", 3, False, "fall", "eq(x, plus(mul(v, t), mul(half, mul(g, sq(t)))))|eq(a, d2(x, t))|eq(v, d(x, t))"),
    ("physics", 3, False, "small_world", "eq(p, mul(hbar, k))|eq(lambda, over(h, p))|eq(E, mul(hbar, omega))"),
    ("physics", 4, False, "fields", "eq(dot(nabla(vec(B)), 1), 0)|eq(cross(vec(E), vec(B)), vec(S))|eq(dot(vec(F), vec(v)), P)"),
    ("physics", 5, True, "waves", "eq(pd2(u, t), mul(sq(c), pd2(u, x)))"),
    ("chemistry", 2, False, "balance", "eq(mul(P, V), mul3(n, R, T))|eq(mul(c, V), n)"),
    ("chemistry", 3, False, "energies", "eq(mul(Delta, G), minus(mul(Delta, H), mul3(T, Delta, S)))|eq(k, mul(A, down(e, x)))"),
    ("chemistry", 3, True, "rate", "eq(r, mul3(k, sq(A), B))"),
    ("cs", 2, False, "growth", "O(n|sq(n)|cube(n)|logof(n)|pow(2, n)|mul(n, logof(n)))"),
    ("cs", 3, False, "halving", "eq(call(T, n), plus(mul(2, call(T, over(n, 2))), n))|eq(call(T, n), plus(call(T, minus(n, 1)), 1))"),
    ("cs", 3, False, "logarithms", "logbase(2|10|b, n|m)|eq(logbase(2, n), k)"),
    ("cs", 2, False, "counting", "fact(n|m|k)|eq(fact(n), mul(n, fact(minus(n, 1))))"),
]
COLUMNS = ["ord", "latex", "spoken_text", "domain", "difficulty", "template", "heldout"]
SCHEMA = "ord long, latex string, spoken_text string, domain string, difficulty int, template string, heldout boolean"


@dataclass(frozen=True)
class Pool:
    """Which templates are drawn from."""

    held_out: bool | None = False
    domains: tuple[str, ...] = ()

    @property
    def by_domain(self) -> dict[str, list]:
        out: dict[str, list] = {}
        for t in TEMPLATES:
            if (self.held_out is None or t[2] == self.held_out) and (not self.domains or t[0] in self.domains):
                out.setdefault(t[0], []).append(t)
        return out


@cache
def _pools(pool: Pool) -> tuple[list[str], list[float], dict[str, list]]:
    by = pool.by_domain
    return list(by), [WEIGHTS[d] for d in by], by


def record(seed: int, k: int, pool: Pool = Pool()) -> tuple:
    """(ord, latex, spoken_text, domain, difficulty, template, heldout) of one draw from the templates."""
    r = random.Random(f"{seed}:{k}")
    names, weights, by = _pools(pool)
    domain, difficulty, held, name, text = r.choice(by[r.choices(names, weights)[0]])
    made = formula(text, r)
    return k, made.tex, made.said, domain, difficulty, f"{domain}.{name}", held


# -- trees ----------------------------------------------------------------------------------------

#: By domain, what a tree begins with; a part that is only a name is grown, the rest is drawn as it stands.
ROOTS = {
    "algebra": "eq(@, @)|le(@, @)|plus(@, @)|eq(var, @)",
    "calculus": "int(0|a|1, b|1|pi|inf_, @, x)|sum($1:i|k, 1, n, @)|lim(x|h, 0|inf_, @)|prim(@, x|t)|eq(d(y, x), @)|eq(call(f|g, x), @)|iint(D|R|S, @, A|V)|dby(@, x|t)|d2by(@, x|t)|pdby(@, x|t)|nablaof(@)",
    "linear_algebra": "det(@)|norm(2|1, @)|inner(@, @)|eq(mul(A, bold(x)), @)",
    "probability": "P(le(X, @))|E(@)|Var(@)|cond(@, Y)",
    "set_theory": "all(x, RR|set)|in(@, set)|cup(set, B|C)|subseteq(A|C, B|U)",
    "analysis": "lt(abs(@), epsilon|delta)|sup(within(x, set), @)|to(sub(x, n), @)",
    "ml": "argmin(theta|w, @)|grad(@, theta|w)|eq(hat(y), @)|drawn(x, p, @)",
    "physics": "eq(vec(F|p), mul(m, @))|eq(E, @)|eq(d2(x, t), @)",
    "chemistry": "eq(mul(P, V), @)|eq(k, @)",
    "cs": "O(@)|eq(call(T, n), @)|logbase(2, @)",
}
#: What may stand between root and leaves, with how often.
INNER = {"plus": 4, "minus": 3, "mul": 3, "fraction": 3, "sq": 3, "cube": 1, "pow": 2, "sqrt": 2, "abs": 1, "sin": 1, "cos": 1, "ln": 1, "call": 2, "hat": 1, "sub": 2}
LEAVES = "var|var|greek|number|indexed|power"
MOST_TEX, MOST_WORDS = 95, 42


def spoken_quantity(p: Piece) -> Piece:
    return Piece(f"({p.tex})", f"the quantity {p.said} end quantity")


def grown(depth: int, r: random.Random) -> Piece:
    """A random tree that is at most so deep. Parts that hold too loosely for their place become quantities; neighbours that would run together are said with times."""
    if depth <= 0 or r.random() < 0.15:
        return formula(LEAVES, r)
    name = r.choices(list(INNER), list(INNER.values()))[0]
    note = NOTATIONS[name]
    if name in ("sub", "hat", "call", "pow"):
        first = formula({"call": "f|g|h", "hat": "x|y|theta"}.get(name, "var"), r)
        second = formula("index", r) if name == "sub" else grown(depth - 1, r) if name == "call" else formula("n|k|2|m", r)
        return note.of([first, second], r)
    parts = [grown(depth - 1, r) for _ in range(2 if "%2" in note.tex else 1)]
    needs = (PRODUCT, PRODUCT) if name == "mul" else note.needs or (RELATION,) * 2
    parts = [spoken_quantity(p) if p.holds < need else p for p, need in zip(parts, needs, strict=False)]
    if name == "mul" and parts[1].tex[0].isdigit():
        return Piece(rf"{parts[0].tex} \cdot {parts[1].tex}", f"{parts[0].said} dot {parts[1].said}", PRODUCT)
    return note.of(parts, r)


def tree_record(seed: int, k: int, most_depth: int = 3) -> tuple:
    """The columns of record() for one random tree."""
    r = random.Random(f"tree:{seed}:{k}")
    domain = r.choices(list(TREE_WEIGHTS), list(TREE_WEIGHTS.values()))[0]
    depth = min(most_depth, r.choice([1, 2, 2, 3]))
    holes: list[Piece] = []

    def hole() -> str:
        holes.append(grown(depth, r))
        return f"hole{len(holes) - 1}"

    text = r.choice(_alternatives(ROOTS[domain]))
    while "@" in text:
        text = text.replace("@", hole(), 1)
    made = formula(text, r)
    tex, said = made.tex, made.said
    for n in reversed(range(len(holes))):
        tex, said = tex.replace(f"hole{n}", holes[n].tex), said.replace(f"hole{n}", holes[n].said)
    difficulty = min(5, 2 + depth + (max((h.holds for h in holes), default=SUM) >= POWER))
    return k, tex, said, domain, difficulty, f"tree.{domain}", False


def _alternatives(text: str) -> list[str]:
    """The alternatives of a text, outside parentheses."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


# -- tables ---------------------------------------------------------------------------------------


def _drawn(spark: SparkSession, n: int, one: Callable[[int], tuple], first: int = 0) -> DataFrame:
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([one(int(k)) for k in b["id"]], columns=COLUMNS)

    return spark.range(first, n).mapInPandas(make, SCHEMA)


def _until(spark: SparkSession, n: int, tries: int, one: Callable[[int], tuple], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The first n rows that are kept, of as many draws as that takes, tries times n at most. Draws are stored, so each is made once."""
    if not n:
        return _drawn(spark, 0, one)
    into, done, draws = shared_folder(spark, "draws"), 0, n
    while True:
        _drawn(spark, draws, one, done).write.mode("append").parquet(into)
        rows = keep(spark.read.schema(SCHEMA).parquet(into))
        if draws >= tries * n or rows.count() >= n:
            return first_rows(rows, "ord", n)
        done, draws = draws, min(tries * n, 2 * draws)


def _key() -> Column:
    return F.replace("latex", F.lit(" "), F.lit(""))


def expressions(spark: SparkSession, n: int, seed: int = 0, pool: Pool = Pool(), most_repeats: int | None = 40) -> DataFrame:
    """n formulas from the templates, in the order drawn, each (without its spaces) as often as most_repeats allows; fewer only if 80 draws a row don't give them. No templates or n = 0: no rows."""
    if not pool.by_domain:
        return _drawn(spark, 0, lambda k: record(seed, k, pool))
    if most_repeats is None:
        return _drawn(spark, n, lambda k: record(seed, k, pool))
    return _until(spark, n, 80, lambda k: record(seed, k, pool), lambda rows: capped(rows, [_key()], ["ord"], most_repeats))


def composed(spark: SparkSession, n: int, seed: int = 0, most_depth: int = 3, most_repeats: int = 3) -> DataFrame:
    """n random trees, in the order drawn, with the columns of expressions(). A formula that is too long counts as a repeat and is then left out; fewer than n rows only if 30 draws a row don't give them."""
    return short_and_rare(spark, n, lambda k: tree_record(seed, k, most_depth), most_repeats)


def short_and_rare(spark: SparkSession, n: int, one: Callable[[int], tuple], most_repeats: int) -> DataFrame:
    """The first n draws that are neither too long nor repeats too many; a formula that is too long counts as a repeat."""
    short = (F.length("latex") <= MOST_TEX) & (F.size(F.split("spoken_text", " ")) <= MOST_WORDS)
    return _until(spark, n, 30, one, lambda rows: capped(rows, [_key()], ["ord"], most_repeats).where(short))


# -- formulas for the rows of a table ----------------------------------------------------------------


class _Draws:
    """A table function: formulas until so many are kept, one draw after the other; each (without its spaces) as often as most_repeats allows, and none once the tries are used up."""

    def eval(self, seed: int, n: int, domain: str, held_out: bool, most_repeats: int) -> Iterator[tuple]:
        pool = Pool(held_out, (domain,) if domain is not None else ())
        if seed is not None and pool.by_domain:
            yield from _kept(n or 0, 80, most_repeats, lambda k: record(seed, k, pool))


class _Trees:
    """A table function: random trees until so many are kept. One that is too long counts as a repeat and is left out."""

    def eval(self, seed: int, n: int, most_depth: int, most_repeats: int) -> Iterator[tuple]:
        short = lambda r: len(r[1]) <= MOST_TEX and len(r[2].split(" ")) <= MOST_WORDS
        if seed is not None:
            yield from _kept(n or 0, 30, most_repeats, lambda k: tree_record(seed, k, most_depth or 1), short)


def _kept(n: int, tries: int, most_repeats: int, one: Callable[[int], tuple], keep: Callable[[tuple], bool] = lambda r: True) -> Iterator[tuple]:
    seen: Counter = Counter()
    kept = 0
    for k in range(tries * n):
        row = one(k)
        key = row[1].replace(" ", "")
        seen[key] += 1
        if seen[key] <= most_repeats and keep(row):
            yield row
            kept += 1
            if kept == n:
                return


def drawn_for(rows: DataFrame, seed: str, n: str, domain: str | None = None, held_out: bool = False, most_repeats: int = 40) -> DataFrame:
    """rows with the columns of expressions(): for each row n formulas of its own seed and domain (null: any), drawn once each. A null seed or number, or a domain that isn't, gives none.

    A row's formulas are one task's work; many are asked for by many rows.
    """
    make = udtf(_Draws, returnType=SCHEMA)
    only = F.col(domain) if domain else F.lit(None)
    whole = lambda c: F.col(c).cast("long").outer()
    return rows.lateralJoin(make(whole(seed), whole(n), only.cast("string").outer() if domain else only.cast("string"), F.lit(held_out), F.lit(most_repeats)))


def composed_for(rows: DataFrame, seed: str, n: str, most_depth: str, most_repeats: int = 3) -> DataFrame:
    """rows with the columns of composed(): for each row n random trees of its own seed and depth. A null seed or number gives none."""
    make = udtf(_Trees, returnType=SCHEMA)
    whole = lambda c: F.col(c).cast("long").outer()
    return rows.lateralJoin(make(whole(seed), whole(n), whole(most_depth), F.lit(most_repeats)))
