"""Comparing LaTeX: a canonical form, its tokens, and how far two of them are apart. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The canonical form's rewrites, in order. A pattern is Java's; a pair of plain strings is replaced literally.
_DROPPED = r"\\(?:left|right|,|;|!|:|quad|qquad|displaystyle)(?![a-zA-Z])"
_PLAIN = (("\\dfrac", "\\frac"), ("\\tfrac", "\\frac"), ("\\varepsilon", "\\epsilon"), ("\\text", "\\mathrm"))
_FRACTIONS = (
    (r"\\frac\s*(\d)\s*(\d)", r"\\frac{$1}{$2}"),
    (r"\\frac\s*\{([^{}]*)\}\s*(\d)", r"\\frac{$1}{$2}"),
    (r"\\frac\s*(\d)\s*\{", r"\\frac{$1}{"),
    (r"(?<![\p{L}\p{N}_}])(\d+)\s*/\s*(\d+)(?![\p{L}\p{N}_])", r"\\frac{$1}{$2}"),
    (r"\\(sqrt|hat|bar|vec|tilde|overline|mathbb|mathbf|mathcal|mathrm)\s*([A-Za-z0-9])", r"\\$1{$2}"),
    (r"([\^_])\s*(\\[a-zA-Z]+|[A-Za-z0-9])", r"$1{$2}"),
    (r"\{\{([^{}]*)\}\}", r"{$1}"),
)
TOKEN = r"\\[a-zA-Z]+|\\.|[A-Za-z]|\d+(?:\.\d+)?|[^\sA-Za-z\d]"
GREEK = r"\\(?:var)?(?:alpha|beta|gamma|delta|epsilon|zeta|eta|theta|iota|kappa|lambda|mu|nu|xi|pi|rho|sigma|tau|upsilon|phi|chi|psi|omega|Gamma|Delta|Theta|Lambda|Xi|Pi|Sigma|Phi|Psi|Omega)(?![a-zA-Z])"
OPERATOR = r"\\(?:int|sum|prod|lim|partial|nabla|leq|geq|neq|approx|pm|times|cdot|in|notin|subset|subseteq|cup|cap|to|sim|forall|exists|infty|frac|sqrt)(?![a-zA-Z])|[=+\-<>]"
SCRIPT = r"[\^_](?:\{[^{}]*\}|\\[a-zA-Z]+|[A-Za-z0-9])"
BRACKET = r"[()\[\]]|\\\{|\\\}|\\\|"
SYMBOL = r"\\[a-zA-Z]+|[=+\-<>|!]"
#: The classes whose recall is measured.
CLASSES = {"symbol": SYMBOL, "greek": GREEK, "operator": OPERATOR, "script": SCRIPT, "bracket": BRACKET}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_latex(c: Column | str) -> Column:
    """The form in which spellings of the same formula are equal. Null is the empty formula."""
    s = F.regexp_replace(F.coalesce(_col(c), F.lit("")), _DROPPED, "")
    for old, new in _PLAIN:
        s = F.replace(s, F.lit(old), F.lit(new))
    for pattern, to in _FRACTIONS:
        s = F.regexp_replace(s, pattern, to)
    s = F.replace(F.replace(s, F.lit("\\operatorname{"), F.lit("\\mathrm{")), F.lit("\\mid"), F.lit("|"))
    return F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", ""), r"^\$+|\$+$", "")


def found(normal: Column | str, pattern: str) -> Column:
    """Every match of a pattern, in order."""
    return F.regexp_extract_all(_col(normal), F.lit(pattern), F.lit(0))


def tokens(normal: Column | str) -> Column:
    return found(normal, TOKEN)


def bound(value: Column, use) -> Column:
    """use(value), with the value made once however often it is used."""
    return F.transform(F.array(value), use)[0]


#: One character for each of so many distinct items: private-use ones.
_CODES = "".join(map(chr, range(0xE000, 0xF900)))


def edit_distance(a: Column, b: Column) -> Column:
    """Unit-cost edits between two arrays: each distinct item stands for one character, and the strings are compared. Beyond 6,400 distinct items characters of the further planes follow."""

    def code(k: Column) -> Column:
        return F.when(k <= len(_CODES), F.substr(F.lit(_CODES), k.cast("int"), F.lit(1))).otherwise(F.decode(F.unhex(F.lpad(F.hex(k + 0x20000), 8, "0")), "UTF-32"))

    def apart(s: Column) -> Column:
        coded = lambda x: F.array_join(F.transform(x, lambda t: code(F.array_position(s["kinds"], t))), "")
        return F.levenshtein(coded(s["a"]), coded(s["b"]))

    pair = F.struct(a.alias("a"), b.alias("b"))
    return bound(bound(pair, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.array_distinct(F.concat(s["a"], s["b"])).alias("kinds"))), apart)


def token_edit(hyp: Column, ref: Column) -> Column:
    """Token edits over the reference's tokens (at least one), for normal forms."""
    r = tokens(ref)
    return F.when(hyp == ref, 0.0).otherwise(edit_distance(tokens(hyp), r) / F.greatest(F.lit(1), F.size(r)))


def multiset_hits(hyp: Column, ref: Column) -> Column:
    """How many items of ref, with repeats, occur in hyp."""
    count = lambda xs, k: F.size(F.filter(xs, lambda x: x == k))
    hits = lambda s: F.aggregate(F.array_distinct(s["r"]), F.lit(0), lambda n, k: n + F.least(count(s["h"], k), count(s["r"], k)))
    return bound(F.struct(hyp.alias("h"), ref.alias("r")), hits)


def spoken_words(c: Column | str) -> Column:
    """Lower-cased words without punctuation."""
    s = F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), r"(?U)[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def word_error_rate(hyp: Column | str, ref: Column | str) -> Column:
    """Word edits over the reference's words; an empty reference counts as the word x."""
    r, h = spoken_words(ref), spoken_words(hyp)
    split = lambda s: F.filter(F.split(s, " "), lambda w: w != "")
    r = split(F.when(r == "", "x").otherwise(r))
    return edit_distance(split(h), r) / F.size(r)


def scores(hyp: Column | str, ref: Column | str) -> dict[str, Column]:
    """exact, tok_edit, and hits and total of each class, as named columns. hyp and ref are in normal form."""
    h, r = _col(hyp), _col(ref)
    out = {"exact": (h == r).cast("double"), "tok_edit": token_edit(h, r)}
    for name, pattern in CLASSES.items():
        theirs = found(r, pattern)
        hits = F.when(h == r, F.size(theirs)).otherwise(multiset_hits(found(h, pattern), theirs))
        out |= {f"{name}_hit": hits, f"{name}_total": F.size(theirs)}
    return out


# The commands that a generated or parsed formula may use.
ALLOWED = """frac int sum prod lim partial nabla sqrt pi alpha beta gamma delta epsilon varepsilon zeta eta theta iota kappa lambda mu nu xi rho
sigma tau upsilon phi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega infty in notin subset subseteq supset cup cap setminus
forall exists emptyset leq geq neq approx pm times cdot div to mapsto implies iff sim propto mid mathbb mathbf mathcal mathrm vec bar hat tilde
overline sin cos tan log ln exp arg min max sup inf det operatorname hbar ell langle rangle left right ldots text tanh dagger begin end binom
iint iiint oint bigcup bigcap cdots dots colon vert Vert lfloor rfloor lceil rceil arctan arcsin arccos leftarrow rightarrow Rightarrow
leftrightarrow Leftrightarrow top mathsf mathscr boldsymbol dot ddot underline kernel ker dim rank deg gcd lcm lg sinh cosh tanh coth mod""".split()


def balanced(c: Column | str) -> Column:
    """Each kind of bracket on its own: never closed before it opens, and closed in the end."""
    text = F.coalesce(_col(c), F.lit(""))

    def one(a: str, b: str) -> Column:
        chars = F.split(F.regexp_replace(text, rf"[^\{a}\{b}]+", ""), "")  # only these are walked

        def step(s: Column, x: Column) -> Column:
            depth = s["d"] + (x == a).cast("int") - (x == b).cast("int")
            return F.struct(depth.alias("d"), (s["ok"] & (depth >= 0)).alias("ok"))

        return F.aggregate(chars, F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")), step, lambda s: s["ok"] & (s["d"] == 0))

    return one("(", ")") & one("[", "]") & one("{", "}")


def valid_latex(c: Column | str) -> Column:
    """Not empty, balanced, and every command known."""
    s = F.coalesce(_col(c), F.lit(""))
    known = F.array(*map(F.lit, sorted(set(ALLOWED))))
    commands = F.regexp_extract_all(s, F.lit(r"\\([a-zA-Z]+)"), F.lit(1))
    return (s != "") & balanced(s) & F.forall(commands, lambda x: F.array_contains(known, x))


def md5_share(c: Column | str, of: int = 10_000) -> Column:
    """md5 of the text as a 128-bit number, modulo of (2^30 at most). Its hexadecimal digits are taken 15 at a time, the most that fit a long."""
    h = F.md5(_col(c).cast("binary"))
    digits = lambda at, n: F.conv(F.substring(h, at, n), 16, 10).cast("long") % of
    return ((digits(1, 2) * pow(2, 120, of) + digits(3, 15) * pow(2, 60, of) + digits(18, 15)) % of).cast("int")


def split_key(c: Column | str) -> Column:
    """A formula without its spaces: what the splits and caps go by."""
    return F.replace(_col(c), F.lit(" "), F.lit(""))


def cleaned_reference(c: Column | str) -> Column:
    """A reference label of the outside probe, without delimiters, spacing and size commands."""
    s = F.regexp_replace(F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", ""), r"^\$+|\$+$", "")
    s = F.replace(s, F.lit("\\operatorname{=}"), F.lit("="))
    s = F.regexp_replace(s, r"\\(?:displaystyle|textstyle|,|;|!|quad|left|right)", "")
    return F.replace(F.replace(s, F.lit("{}"), F.lit("")), F.lit("\\prime"), F.lit("'"))
