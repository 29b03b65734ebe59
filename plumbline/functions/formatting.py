"""Text forms of numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of the byte formatter, each 1024 times the one before.
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB")


# A fraction of a double, times this, is cut to a whole number that fits a bigint.
_FRACTION_BITS = 62


def fmt_fixed(value: Column, digits: int) -> Column:
    """``value`` with a fixed number of decimals, rounded as its binary value stands.

    A double such as 0.15 lies a little off the number its shortest text names, and
    that decides which way it rounds: 0.15 gives 0.1 and 0.35 gives 0.3.  Only values
    that are ties in binary go to the even digit.  All steps are exact: splitting off the
    whole part, scaling the fraction by a power of two, and comparing remainders of
    whole numbers.  Values are expected below 2^63.
    """
    x = value.cast("double")
    size = F.abs(x)
    whole = F.floor(size)
    scaled = (size - whole) * float(2**_FRACTION_BITS)
    cut = F.floor(scaled)
    # What the cut leaves off tells a tie from a little more than one.
    more = scaled > cut
    # Thousandths of a fraction need 10 bits more than a bigint has.
    shifted = cut.cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(10,0)")
    unit = F.lit(2**_FRACTION_BITS).cast("decimal(20,0)")
    rest = shifted % unit
    steps = ((shifted - rest) / unit).cast("bigint")
    half = F.lit(2 ** (_FRACTION_BITS - 1)).cast("decimal(20,0)")
    odd = (steps + whole * 10**digits) % 2 == 1
    up = (rest > half) | ((rest == half) & (more | odd))
    steps = steps + F.when(up, 1).otherwise(0)
    whole = whole + F.when(steps == 10**digits, 1).otherwise(0)
    text = whole.cast("string")
    if digits:
        text = F.concat(text, F.lit("."), F.lpad((steps % 10**digits).cast("string"), digits, "0"))
    return F.when(value.isNotNull(), F.concat(F.when(x < 0, "-").otherwise(""), text))


def round_fixed(value: Column, digits: int) -> Column:
    """``value`` rounded in the same way, as a double."""
    return fmt_fixed(value, digits).cast("double")


def fmt_bytes(n: Column) -> Column:
    """Bytes with one decimal in the largest unit that keeps the number under 1024.

    Terabytes are the last unit, so larger volumes show as thousands of them.
    """
    size = n.cast("double")
    last = len(BYTE_UNITS) - 1
    text = F.concat(fmt_fixed(size / 1024**last, 1), F.lit(BYTE_UNITS[last]))
    for power in reversed(range(last)):
        shown = F.concat(fmt_fixed(size / 1024**power, 1), F.lit(BYTE_UNITS[power]))
        text = F.when(F.abs(size) < 1024 ** (power + 1), shown).otherwise(text)
    return text


def pct_change(before: Column, after: Column) -> Column:
    """Change in percent of ``before``; null where ``before`` is zero."""
    base = F.nullif(before.cast("double"), F.lit(0.0))
    return (after.cast("double") - before.cast("double")) / base * 100


def fmt_pct_change(before: Column, after: Column) -> Column:
    """Arrow and whole percent; a start from zero has no percentage.

    No change at all carries the upward arrow.
    """
    pct = pct_change(before, after)
    moved = F.concat(F.when(pct < 0, "↓").otherwise("↑"), fmt_fixed(F.abs(pct), 0), F.lit("%"))
    from_zero = F.when(after == 0, "n/a").otherwise("new")
    return F.when(before == 0, from_zero).otherwise(moved)
