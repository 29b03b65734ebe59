"""Deterministic stand-ins for seeded randomness.

A task that is run again gives the same values, and SQL can state them too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Lehmer generator with prime modulus 2^31 - 1.
LEHMER_MODULUS = 2_147_483_647
LEHMER_MULTIPLIER = 48_271


def mixed_bucket(number: Column, seed: int, buckets: int) -> Column:
    """Spread a whole number over ``0 .. buckets-1`` with plain integer arithmetic."""
    start = F.pmod(number.cast("bigint") + F.lit(seed), F.lit(LEHMER_MODULUS))
    once = F.pmod(start * F.lit(LEHMER_MULTIPLIER), F.lit(LEHMER_MODULUS))
    twice = F.pmod((once + F.lit(seed)) * F.lit(LEHMER_MULTIPLIER), F.lit(LEHMER_MODULUS))
    return F.pmod(twice, F.lit(buckets)).cast("bigint")


def row_salt(columns: list[str], salts: Column | int) -> Column:
    """Salt in ``0 .. salts-1`` from the content of a row."""
    salts = salts if isinstance(salts, Column) else F.lit(salts)
    return F.pmod(F.xxhash64(*columns), salts).cast("int")
