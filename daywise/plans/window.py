"""Day windows with independent endpoints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_window(day: Column, low: Column, high: Column, include_low: Column, include_high: Column) -> Column:
    """Whether ``day`` lies between the bounds; never null.

    A null bound is open, a null day lies in no window, a null inclusion flag excludes the endpoint.
    """
    above = low.isNull() | (day > low) | ((day == low) & F.coalesce(include_low, F.lit(False)))
    below = high.isNull() | (day < high) | ((day == high) & F.coalesce(include_high, F.lit(False)))
    return F.coalesce(day.isNotNull() & above & below, F.lit(False))


@dataclass(frozen=True)
class DayWindow:
    """A window as plans declare it. ``contains`` gives its predicate on a day column."""

    low: int | None = None
    high: int | None = None
    include_low: bool = False
    include_high: bool = False

    def contains(self, day: Column) -> Column:
        return in_window(day, F.lit(self.low).cast("int"), F.lit(self.high).cast("int"), F.lit(self.include_low), F.lit(self.include_high))

    @classmethod
    def up_to(cls, cutoff: int | None, low: int | None = None, include_low: bool = False, high: int | None = None, include_high: bool = True) -> DayWindow:
        """The variant in which a cutoff day closes the window whatever its declared end."""
        return cls(low, cutoff if cutoff is not None else high, include_low, True if cutoff is not None else include_high)
