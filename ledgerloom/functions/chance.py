"""Repeatable draws in plain arithmetic, the same in any SQL engine and on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647


def drawn(value: Column, seed: int) -> Column:
    """An integer from 0 to PRIME - 1 for an integer value; null draws as -1 does."""
    first = F.pmod(F.pmod(F.coalesce(value.cast("long"), F.lit(-1)), F.lit(PRIME)) * 48271 + F.lit(seed), F.lit(PRIME))
    return F.pmod(first.bitwiseXOR(F.shiftright(first, 15)) * 69621 + 1013904223, F.lit(PRIME))


def drawn_sql(value: str, seed: int) -> str:
    """The same as SQL text."""
    first = f"((((coalesce({value}, -1) % {PRIME}) + {PRIME}) % {PRIME}) * 48271 + {seed}) % {PRIME}"
    return f"((xor({first}, ({first}) >> 15) * 69621 + 1013904223) % {PRIME})"
