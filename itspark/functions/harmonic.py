"""Seasonal terms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CYCLE = 52


def harmonic_terms(t: Column, pairs: int = 2, cycle: int = CYCLE) -> dict[str, Column]:
    """``sin1..sinK`` then ``cos1..cosK`` of ``2*pi*k*t/cycle``."""
    angle = {k: t.cast("double") * F.lit(2.0 * math.pi * k / cycle) for k in range(1, pairs + 1)}
    terms = {f"sin{k}": F.sin(a) for k, a in angle.items()}
    terms.update({f"cos{k}": F.cos(a) for k, a in angle.items()})
    return terms


def harmonic_value(name: Column, t: Column, cycle: int = CYCLE) -> Column:
    """The value of the seasonal term of that name, ``sinK`` or ``cosK``; null for any other name."""
    pair = F.substring(name, 4, 9).try_cast("double")
    angle = t.cast("double") * (F.lit(2.0 * math.pi) * pair / F.lit(cycle))
    return F.when(name.startswith("sin"), F.sin(angle)).when(name.startswith("cos"), F.cos(angle))
