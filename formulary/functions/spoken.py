"""Spoken formulas as text: tokens, whether they are mathematics, and numbers in words. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters and what they are called, in the order of replacement.
NAMED = {
    "²": " squared ", "³": " cubed ", "π": " pi ", "∞": " infinity ", "∫": " integral ", "∑": " sum ", "∂": " partial ",
    "≥": " greater than or equal to ", "≤": " less than or equal to ", "≈": " approximately ", "∈": " in ", "∇": " nabla ",
    "θ": " theta ", "λ": " lambda ", "σ": " sigma ", "μ": " mu ", "ε": " epsilon ", "δ": " delta ", "α": " alpha ", "β": " beta ",
    "γ": " gamma ", "ω": " omega ", "φ": " phi ", "ρ": " rho ", "τ": " tau ", "∀": " for all ", "∃": " there exists ",
    "×": " times ", "÷": " divided by ", "−": " minus ", "√": " square root of ",
}
_W = r"[\p{L}\p{N}_]"
_EDGE = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
# Written shorthand and how it is said, in order (Java patterns; a word character is Python's).
SHORTHAND = (
    (rf"{_EDGE}({_W})\^2{_EDGE}", "$1 squared"),
    (rf"{_EDGE}({_W})\^3{_EDGE}", "$1 cubed"),
    (rf"{_EDGE}({_W})\^({_W}){_EDGE}", "$1 to the $2"),
    (rf"{_EDGE}({_W})_({_W}){_EDGE}", "$1 sub $2"),
    (r"(?U)(?<=\d)\s*/\s*(?=\d)", " over "),
    (rf"(?U)(?<={_W})\s*\+\s*(?={_W})", " plus "),
    (rf"(?U)(?<={_W})\s*=\s*(?={_W})", " equals "),
    (rf"{_EDGE}d([a-zA-Z]){_EDGE}", "d $1"),
    (rf"{_EDGE}epsilon[- ]delta{_EDGE}", "epsilon delta"),
)
# Words that point to mathematics.
TRIGGERS = """equals equal squared cubed integral derivative partial sum limit infinity sigma lambda theta alpha beta gamma
delta epsilon omega mu nu rho tau phi psi chi eta zeta kappa sub over norm vector matrix transpose inverse determinant
approximately plus minus times divided probability expectation variance covariance gradient nabla subset union intersection
exists forall det trace implies iff element bold closure absolute inner normally distributed divergence yields converges softmax
supremum infimum greater less factorial sine cosine tangent log exponential prime hat bar tilde square root fraction""".split()
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
#: Number words and their values.
NUMBERS = {w: k for k, w in enumerate(ONES)} | {w: 20 + 10 * k for k, w in enumerate(TENS)} | {"hundred": 100}
MATH_AT = 1.5


def _list(words) -> Column:
    return F.array(*map(F.lit, words))


def tokenize(c: Column | str) -> Column:
    """The tokens of a spoken formula. Null has none."""
    s = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    for char, said in NAMED.items():
        s = F.replace(s, F.lit(char), F.lit(said))
    for mark in ("$", "\\(", "\\)"):
        s = F.replace(s, F.lit(mark), F.lit(" "))
    for pattern, said in SHORTHAND:
        s = F.regexp_replace(s, pattern, said)
    s = F.regexp_replace(s, r"(?U)(?<=\d)\.(?=\d)", "<DOT>")
    s = F.regexp_replace(s, '[,;:?!"“”()]', " ")
    s = F.regexp_replace(s, r"(?U)\.(\s|$)", " $1")
    s = F.replace(s, F.lit("<DOT>"), F.lit("."))
    s = F.regexp_replace(s, rf"({_W})'s{_EDGE}", "$1 s")
    words = F.transform(F.split(s, r"(?U)\s+"), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    hyphen = lambda w: w.rlike(r"^(?i)(?:p|two|l|one|infinity)-[a-zA-Z]+$")
    parts = lambda w: F.when(hyphen(w), F.split(w, "-")).when(w.rlike(r"(?U)^-\d+(\.\d+)?$"), F.array(F.lit("minus"), F.substring(w, 2, 1 << 30))).otherwise(F.array(w))
    return F.flatten(F.transform(F.filter(words, lambda w: w != ""), parts))


def is_number(token: Column) -> Column:
    return token.rlike(r"(?U)^\d+(\.\d+)?$") | F.array_contains(_list(NUMBERS), F.lower(token))


def math_score(tokens: Column) -> Column:
    """How much a list of tokens looks like mathematics. Pi, and pie, count only with other evidence."""
    low = F.transform(tokens, F.lower)
    count = lambda test, of=low: F.size(F.filter(of, test))
    triggers = count(lambda w: F.array_contains(_list(sorted(set(TRIGGERS))), w))
    numbers = count(is_number)
    letters = count(lambda w: (F.length(w) == 1) & w.rlike(r"\p{L}") & ~F.lower(w).isin("a", "i"), tokens)
    pies = count(lambda w: w.isin("pi", "pie"))
    text = F.array_join(low, " ")
    space = text.rlike("(^| )[rnzqc] [nmdk]( |$)") & F.exists(tokens, lambda w: w.isin(*"RNZQC"))
    stated = text.contains("for all") | text.contains("there exists") | text.contains("is in") | text.contains("is not in")
    pi = F.when((pies > 0) & ((triggers > 0) | (numbers > 0)), 1.0 + pies).when(F.array_contains(low, "pi"), 0.5).otherwise(0.0)
    return triggers + 0.5 * numbers + 0.5 * letters + space.cast("int") + stated.cast("int") + pi


def is_math(tokens: Column, least: float = MATH_AT) -> Column:
    return math_score(tokens) >= least


def say_integer(n: Column) -> Column:
    """An integer in words: up to a hundred as one says it, beyond digit by digit."""
    size = F.abs(n)
    digit = lambda d: F.element_at(_list(ONES), (d + 1).cast("int"))
    ten = F.element_at(_list(TENS), F.greatest(F.lit(1), F.least(F.lit(8), F.floor(size / 10) - 1)).cast("int"))
    long = F.array_join(F.transform(F.split(size.cast("string"), ""), lambda d: digit(F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0)))), " ")
    small = F.when(size < 20, digit(F.least(size, F.lit(19)))).when(size < 100, F.when(size % 10 == 0, ten).otherwise(F.concat_ws(" ", ten, digit(size % 10))))
    said = small.when(size == 100, "one hundred").otherwise(long)
    return F.when(n < 0, F.concat(F.lit("minus "), said)).otherwise(said)


def say_number(c: Column) -> Column:
    """A decimal's text in words: the whole part, then its digits after the point."""
    text = F.regexp_replace(c, "^-", "")
    whole = say_integer(F.split(text, r"\.")[0].cast("long"))
    digits = F.filter(F.split(F.coalesce(F.get(F.split(text, r"\."), F.lit(1)), F.lit("")), ""), lambda d: d != "")
    said = F.array_join(F.transform(digits, lambda d: F.element_at(_list(ONES), d.cast("int") + 1)), " ")
    out = F.when(F.size(digits) == 0, whole).otherwise(F.concat_ws(" point ", whole, said))
    return F.when(c.startswith("-"), F.concat(F.lit("minus "), out)).otherwise(out)
