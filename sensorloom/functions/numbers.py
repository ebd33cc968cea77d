"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import PROFILES, VALID_RANGES, Profile


def finite(x: Column) -> Column:
    """Null for NaN and infinity: Spark orders NaN above every number, so it must not get into comparisons."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def out_of_range(kind: Column, value: Column, ranges: dict[str, tuple[float, float]] | None = None) -> Column:
    """Whether a reading is outside its class's valid range; classes without one are never invalid."""
    known = [F.when(kind == k, (value < low) | (value > high)) for k, (low, high) in (VALID_RANGES if ranges is None else ranges).items()]
    return F.coalesce(*known, F.lit(False))


def profile(kind: Column, what: str) -> Column:
    """A setting of the class's detector profile, or the default's."""
    odd = [k for k, p in PROFILES.items() if getattr(p, what) != getattr(Profile(), what)]
    usual = F.lit(getattr(Profile(), what))
    return F.when(kind.isin(*odd), ~usual).otherwise(usual) if odd else usual


def clipped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def relative_difference(a: Column, b: Column, floor: float = 1e-6) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(floor))


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    return F.round(F.lit(100.0) * part / whole, places)
