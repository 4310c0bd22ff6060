"""Money as signed 64-bit minor units: checked arithmetic and exact text, never through floating point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Minor units of one major unit.
SCALE = 100
MAX_MINOR = 2**63 - 1
MIN_MINOR = -(2**63)
WIDE = "decimal(38,0)"


def of_major(major: Column) -> Column:
    """Minor units of whole major units; null where they don't fit."""
    return F.try_multiply(major.cast("long"), F.lit(SCALE).cast("long"))


def plus(a: Column, b: Column) -> Column:
    return F.try_add(a, b)


def minus(a: Column, b: Column) -> Column:
    return F.try_subtract(a, b)


def times(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b)


def negated(a: Column) -> Column:
    return F.try_subtract(F.lit(0).cast("long"), a)


def wide_sum(amount: Column) -> Column:
    """A sum that can't overflow; compare it with ``fits`` before narrowing."""
    return F.sum(amount.cast(WIDE))


def long_sum(amount: Column) -> Column:
    """``wide_sum`` of longs, added up in three parts of 21 bits and more, each a long for up to 2 ** 41 rows: wide decimals are objects, which cost much a row."""
    part = lambda c, shift: F.sum(c).cast("decimal(20,0)") * F.lit(str(1 << shift)).cast("decimal(14,0)")
    low = lambda c: c.bitwiseAND(F.lit((1 << 21) - 1))
    value = amount.cast("long")
    return (part(F.shiftright(value, 42), 42) + part(low(F.shiftright(value, 21)), 21) + part(low(value), 0)).cast(WIDE)


def long_sum_of_absolutes(amount: Column) -> Column:
    """The same of the amounts without their signs; the least long has no opposite, so negative ones are counted up by one."""
    return (long_sum(F.when(amount < 0, -(amount + 1)).otherwise(amount)) + F.count(F.when(amount < 0, 1)).cast("decimal(20,0)")).cast(WIDE)


def fits(wide: Column) -> Column:
    return wide.between(F.lit(str(MIN_MINOR)).cast(WIDE), F.lit(str(MAX_MINOR)).cast(WIDE))


def narrow(wide: Column) -> Column:
    return F.when(fits(wide), wide.cast("long"))


def major_string(minor: Column) -> Column:
    """Text like -0.05 or 123.45, right for the least long, too (digits are text, so nothing is negated)."""
    digits = F.regexp_replace(minor.cast("string"), "^-", "")
    padded = F.lpad(digits, F.greatest(F.length(digits), F.lit(3)), F.lit("0"))
    whole = F.substring(padded, F.lit(1), F.length(padded) - 2)
    return F.concat(F.when(minor < 0, "-").otherwise(""), whole, F.lit("."), F.right(padded, F.lit(2)))


def signed(side: Column, amount: Column) -> Column:
    """Debits count up, credits down; amounts are positive, so this can't overflow."""
    return F.when(side == "DEBIT", amount).otherwise(-amount)


def normal_side(kind: Column) -> Column:
    return F.when(kind == "ASSET", "DEBIT").otherwise("CREDIT")


def is_natural(kind: Column, balance: Column) -> Column:
    return F.when(kind == "ASSET", balance >= 0).otherwise(balance <= 0)
