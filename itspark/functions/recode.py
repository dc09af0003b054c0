"""Column recodes. Every function keeps an unknown input unknown unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_suffix(col: Column, n: int = 6) -> Column:
    """Last ``n`` characters; shorter text is returned whole."""
    return F.right(col, F.lit(n))


def sentinel_to_null(col: Column, *sentinels) -> Column:
    return F.when(~col.isin(*sentinels), col)


def null_where(col: Column, predicate: Column) -> Column:
    """Null where the predicate holds; an unknown predicate leaves the value alone."""
    return F.when(~F.coalesce(predicate, F.lit(False)), col)


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def binary(predicate: Column) -> Column:
    """1/0 for true/false and null for unknown, unlike ``when().otherwise()``."""
    return predicate.cast("int")


def either(predicate: Column, yes: Column, no: Column) -> Column:
    """Two-way choice that is null, not ``no``, when the predicate is unknown."""
    return F.when(predicate, yes).when(~predicate, no)


def observed_flag(col: Column) -> Column:
    """1 where a value is present, 0 where it is missing."""
    return col.isNotNull().cast("int")


def yes_no_to_int(col: Column) -> Column:
    """Tick box: missing or ``N`` is 0, ``Y`` is 1, other text is read as a number or null."""
    return (
        F.when(col.isNull() | (col == "N"), F.lit(0.0))
        .when(col == "Y", F.lit(1.0))
        .otherwise(col.try_cast("double"))
    )


def exclusive_flag(target: Column, *others: Column) -> Column:
    """1 when ``target`` is the only box ticked, 0 for another pattern, null when none is."""
    ticked = target
    for other in others:
        ticked = ticked + other
    return F.when(ticked == 0, F.lit(None)).otherwise(binary((ticked == 1) & (target == 1)))


def slash_date(col: Column) -> Column:
    """Date from ``year/month/day`` text; unreadable text becomes null."""
    return F.try_to_date(col, "y/M/d")
