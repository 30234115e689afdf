"""Column functions on words and letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRAP_LETTERS = ("r", "s", "t")


def trap_letters(letters=None) -> tuple[str, ...]:
    """The trap set in force: lower-case, sorted; an empty or missing one means r, s, t."""
    return tuple(sorted({x.lower() for x in letters or ()})) or TRAP_LETTERS


def is_trap(word, letters=TRAP_LETTERS) -> Column:
    """Whether the word starts with a trap letter, whatever its case; null and empty words don't."""
    word = F.col(word) if isinstance(word, str) else word
    return F.coalesce(F.lower(F.substring(word, 1, 1)).isin(*letters), F.lit(False))


def clean_word(word) -> Column:
    """Lower-case without white space around it."""
    word = F.col(word) if isinstance(word, str) else word
    return F.lower(F.regexp_replace(word, r"^\s+|\s+$", ""))


def number(text) -> Column:
    """A finite double, or null: only plain decimal or exponent notation counts."""
    text = F.col(text) if isinstance(text, str) else text
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def plain_word(word, longest: int) -> Column:
    """a-z only and at most `longest` letters."""
    word = F.col(word) if isinstance(word, str) else word
    return word.rlike("^[a-z]+$") & (F.length(word) <= longest)


def richness(n) -> Column:
    """Neighbourhood size on a logarithmic scale that reaches 1 at 49 neighbours."""
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n > 0, F.least(F.lit(1.0), F.log(n.cast("double") + 1.0) / F.log(F.lit(50.0)))).otherwise(F.lit(0.0))


def surprise(p) -> Column:
    """-p * log2(p)."""
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))


def chance(*columns) -> Column:
    """A number in (0, 1) from a hash of the columns' text, the same on every run and in every engine."""
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in columns]).cast("binary")), 1, 8), 16, 10)
    return (digits.cast("double") + 0.5) / float(1 << 32)


def half_up(x: Column, places: int) -> Column:
    """A double rounded as C and SQL engines do it: times 10^places, half away from zero, divided. Spark's round() goes by the decimal digits instead."""
    far = F.abs(x * 10.0**places)
    whole = F.floor(far)
    return F.signum(x) * (whole + F.when(far - whole >= 0.5, 1).otherwise(0)).cast("double") / 10.0**places


def half_even(x: Column, places: int = 6) -> Column:
    """A double rounded by its binary value, half to even, to the double next to the result (of a size up to some 10^9).

    x is split in two halves whose products with 10^places are exact, so ties and near ties are told apart."""
    scale, c = 10.0**places, x * 134217729.0
    high = c - (c - x)
    whole, rest = high * scale, (x - high) * scale
    carried = F.floor(rest + 0.5)
    below, left = F.floor(whole) + carried, rest - carried  # left is -.5 to .5
    part = whole - F.floor(whole)
    odd = below % 2 != 0
    step = F.when(part - 0.5 > -left, 1).when((part - 0.5 == -left) & odd, 1).when((part == 0) & (left == -0.5) & odd, -1).otherwise(0)
    return (below + step).cast("double") / scale
