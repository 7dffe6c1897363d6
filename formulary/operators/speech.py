"""Text to be spoken: markup for what a synthesiser would misread, fillers, voices and speeds. Chance comes from hashes of a row's id, so reruns agree. Built-in functions only."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formulary.operators.datasets import variants

# How letters and words sound.
LETTERS = dict(a="ˈA", b="bˈi", c="sˈi", d="dˈi", e="ˈi", f="ˈɛf", g="ʤˈi", h="ˈAʧ", i="ˈI", j="ʤˈA", k="kˈA", l="ˈɛl", m="ˈɛm", n="ˈɛn", o="ˈO", p="pˈi", q="kjˈu", r="ˈɑɹ", s="ˈɛs", t="tˈi", u="jˈu", v="vˈi", w="dˈʌbᵊlju", x="ˈɛks", y="wˈI", z="zˈi")
WORDS = dict(xi="ksˈI", phi="fˈI", chi="kˈI", psi="sˈI", tau="tˈW", rho="ɹˈO", nu="nˈu", mu="mjˈu", eta="ˈAtə", zeta="zˈAtə", theta="θˈAtə", kappa="kˈæpə", omega="OmˈɛɡƏ", hbar="ˈAʧ bˈɑɹ")
RESPELLED = {"sin": "sine", "cos": "cosine"}
WHOLE = {"kl": "[k](/kˈA/) [l](/ˈɛl/)", "relu": "[ReLU](/ɹˈɛlju/)", "tanh": "[tanh](/tˈæn ˈAʧ/)"}
LEADS = ["so", "we have", "consider", "now", "then", "that is", "we get"]


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(values.items())))


def chance(key: Column | str, salt: str) -> Column:
    """A number from 0 to 1, the same for the same key and salt."""
    return F.pmod(F.xxhash64(F.col(key) if isinstance(key, str) else key, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def chosen(values: list[str], key: Column | str, salt: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(chance(key, salt) * len(values)) + 1).cast("int"))


def marked(text: Column | str, pauses: Column | str | None = None) -> Column:
    """Letters, Greek and jargon with their sounds; with a key for pauses, a comma before one equality in four and one sum in ten."""

    def word(w: Column) -> Column:
        low = F.lower(w)
        sound = F.coalesce(F.when(F.length(w) == 1, F.element_at(_map(LETTERS), low)), F.element_at(_map(WORDS), low))
        whole = F.when(w == "pH", "[p](/pˈi/) [H](/ˈAʧ/)").otherwise(F.coalesce(F.element_at(_map(WHOLE), low), F.element_at(_map(RESPELLED), low)))
        return F.coalesce(F.when(sound.isNotNull(), F.concat(F.lit("["), w, F.lit("](/"), sound, F.lit("/)"))), whole, w)

    said = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    words = F.filter(F.split(said, r"(?U)\s+"), lambda w: w != "")
    if pauses is None:
        return F.array_join(F.transform(words, word), " ")
    key = F.col(pauses) if isinstance(pauses, str) else pauses

    def paused(w: Column, at: Column) -> Column:
        after = F.get(words, at + 1)
        equality = (after == "equals") | ((after == "is") & (F.get(words, at + 2) == "equal") & (F.get(words, at + 3) == "to"))
        rate = F.when(equality, 0.25).when(after.isin("plus", "minus"), 0.1).otherwise(0.0)
        return F.concat(word(w), F.when(chance(F.concat_ws(":", key.cast("string"), at.cast("string")), "pause") < rate, ",").otherwise(""))

    return F.array_join(F.transform(words, paused), " ")


def led_in(text: str, key: str, split: str = "split", rate: float = 0.15) -> Column:
    """Now and then a filler in front, but not in the test splits of unseen templates."""
    some = (chance(key, "filler") < rate) & ~F.col(split).isin("test_hard", "test_ood")
    return F.when(some, F.concat_ws(" ", chosen(LEADS, key, "lead"), text)).otherwise(F.col(text))


def spoken(rows: DataFrame, train_voices: list[str], held_voices: list[str], key: str = "expr_id", hard_times: int = 6, slow: float = 0.85, fast: float = 1.15) -> DataFrame:
    """Expressions with id, voice and speed: held-out splits in several copies by held-out voices, test splits with more of those, all others by training voices."""
    led = rows.withColumn("spoken_text", led_in("spoken_text", key)).withColumn("id", F.col(key))
    hard = F.col("split").isin("test_hard", "test_ood")
    copies = variants(led.where(hard), F.when(F.col("split") == "test_hard", hard_times).otherwise(2), held_voices, [0.9, 1.0, 1.1])
    pool = F.when(F.col("split").isin("test", "test_comp"), chosen(held_voices * 3 + train_voices, key, "voice")).otherwise(chosen(train_voices, key, "voice"))
    speed = F.bround(F.lit(slow) + (fast - slow) * chance(key, "speed"), 2)
    return led.where(~hard).withColumns({"voice": pool, "speed": speed}).unionByName(copies)
