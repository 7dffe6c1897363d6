r"""Templates and notations of a user's own, beside those of the library: checked when they are registered, sent to the tasks that draw.

    own = Grammar().with_notation("choose / 4 / \binom{%1}{%2} / %1 choose %2").with_template("cs", 2, "subsets", "choose(n, k|m)")
    own.expressions(spark, 1_000, seed=1)
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from formulary.functions.latex import ALLOWED
from formulary.sources import notation
from formulary.sources.formulas import COLUMNS, SCHEMA, TEMPLATES, WEIGHTS, Pool
from formulary.sources.notation import NOTATIONS, Notation, Piece

#: Draws by which a template is tried.
TRIED = 64


def _sound(p: Piece) -> str | None:
    """What is wrong with a drawn formula."""
    depth = 0
    for c in re.sub(r"\\[{}]", "", p.tex):
        depth += (c == "{") - (c == "}")
        if depth < 0:
            break
    if depth:
        return f"unbalanced braces in {p.tex!r}"
    if odd := {c for c in re.findall(r"\\([a-zA-Z]+)", p.tex) if c not in ALLOWED}:
        return f"commands that validity doesn't know: {sorted(odd)}"
    if "%" in p.tex + p.said:
        return f"a part that isn't given in {p.tex!r} or {p.said!r}"
    if not p.said.strip() or re.search(r"[\\{}^_]", p.said):
        return f"not something that is said: {p.said!r}"
    return None


@dataclass(frozen=True)
class Grammar:
    """Added notations by name, added templates, and how often added domains are drawn. Immutable: each registration gives a new one."""

    notations: dict[str, Notation] = field(default_factory=dict)
    templates: tuple = ()
    weights: dict[str, float] = field(default_factory=dict)

    def with_notation(self, line: str) -> Grammar:
        """One line: name / how tightly it holds / LaTeX / what is said, ways apart by ; / needs of the parts. A name that is taken is an error."""
        if line.count(" / ") not in (3, 4):
            raise ValueError(f"a notation has four or five fields: {line!r}")
        ((name, note),) = notation._lines(line).items()
        if name in NOTATIONS or name in self.notations or name in notation.SYMBOLS or name in notation.PHRASES:
            raise ValueError(f"{name} is there already")
        if not 0 <= note.holds <= notation.ATOM or not all(note.ways):
            raise ValueError(f"{name} holds in no known way or isn't said")
        written, *said = (set(re.findall(r"%(\d)", x)) for x in (note.tex, *note.ways))
        if not written or any(way != written for way in said) or written != {str(k + 1) for k in range(len(written))}:
            raise ValueError(f"{name} is written and said of other parts")
        return replace(self, notations=self.notations | {name: note})

    def with_template(self, domain: str, difficulty: int, name: str, text: str, held_out: bool = False, weight: float = 1.0) -> Grammar:
        """A template of a domain, known or new (then with its weight); tried before it is taken."""
        if not 1 <= difficulty <= 5 or weight <= 0:
            raise ValueError("a difficulty is from 1 to 5, a weight above zero")
        if any(t[0] == domain and t[3] == name for t in (*TEMPLATES, *self.templates)):
            raise ValueError(f"{domain}.{name} is there already")
        for k in range(TRIED):
            try:
                wrong = _sound(self._formula(text, random.Random(k)))
            except (KeyError, IndexError) as error:
                raise ValueError(f"{domain}.{name} can't be drawn: {error!r}") from error
            if wrong:
                raise ValueError(f"{domain}.{name}: {wrong}")
        weights = self.weights if domain in WEIGHTS or domain in self.weights else self.weights | {domain: weight}
        return replace(self, templates=(*self.templates, (domain, difficulty, held_out, name, text)), weights=weights)

    def _formula(self, text: str, r: random.Random) -> Piece:
        return notation.drawn(notation.tree(text), r, {}, NOTATIONS | self.notations)

    def record(self, seed: int, k: int, pool: Pool = Pool()) -> tuple:
        """formulas.record() over all templates."""
        r, by = random.Random(f"{seed}:{k}"), {}
        for t in (*TEMPLATES, *self.templates):
            if (pool.held_out is None or t[2] == pool.held_out) and (not pool.domains or t[0] in pool.domains):
                by.setdefault(t[0], []).append(t)
        weights = WEIGHTS | self.weights
        domain, difficulty, held, name, text = r.choice(by[r.choices(list(by), [weights[d] for d in by])[0]])
        made = self._formula(text, r)
        return k, made.tex, made.said, domain, difficulty, f"{domain}.{name}", held

    def expressions(self, spark: SparkSession, n: int, seed: int = 0, pool: Pool = Pool()) -> DataFrame:
        """n formulas, in the order drawn. A pool without templates gives none."""
        if not any((pool.held_out is None or t[2] == pool.held_out) and (not pool.domains or t[0] in pool.domains) for t in (*TEMPLATES, *self.templates)):
            n = 0

        def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame([self.record(seed, int(k), pool) for k in b["id"]], columns=COLUMNS)

        return spark.range(n).mapInPandas(make, SCHEMA)


def checked_views(views: list[tuple[str, str, bool]], systems: list[str]) -> list[tuple[str, str, bool]]:
    """The views of an evaluation (name, system, whether by the rules), if their names are different and the systems are there; else an error."""
    names = [v[0] for v in views]
    if len(set(names)) != len(names) or not all(names):
        raise ValueError("views have different names")
    if missing := sorted({s for _, s, _ in views} - set(systems)):
        raise ValueError(f"no predictions of {missing}")
    if not all(isinstance(by, bool) for _, _, by in views):
        raise ValueError("a view goes through the rules or doesn't")
    return views

