"""Identifiers: short ASCII names from a fixed alphabet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "A-Za-z0-9._-"
LIMITS = {"account": 64, "merchant": 64, "key": 255}


def is_valid(value: Column, kind: str = "account") -> Column:
    return F.coalesce(value.rlike(rf"\A[{ALPHABET}]{{1,{LIMITS[kind]}}}\z"), F.lit(False))


def problem(value: Column, kind: str = "account") -> Column:
    """EMPTY, TOO_LONG or BAD_CHARACTER; null for a valid identifier."""
    return (
        F.when(value.isNull() | (F.length(value) == 0), "EMPTY")
        .when(F.length(value) > LIMITS[kind], "TOO_LONG")
        .when(~is_valid(value, kind), "BAD_CHARACTER")
    )
