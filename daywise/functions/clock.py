"""Clock-of-day expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: HH:MM or HH:MM:SS with two digits each, 00:00 to 23:59:59.
CLOCK_PATTERN = r"^([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?$"
#: Precisions under which a clock was not observed.
DAY_PRECISIONS = ("", "day", "date")


def clock_seconds(clock: Column, precision: Column) -> Column:
    """Seconds of the day of a usable clock, else null.

    A clock at day precision (or with a null or blank precision) is an artifact, never an observation; ``HH:MM``
    counts as second 0.
    """
    text = F.trim(clock)
    seen = F.lower(F.trim(precision))
    usable = precision.isNotNull() & ~seen.isin(*DAY_PRECISIONS) & text.rlike(CLOCK_PATTERN)
    part = lambda start: F.substring(text, start, 2).cast("int")
    second = F.when(F.length(text) > 5, part(7)).otherwise(F.lit(0))
    return F.when(usable, part(1) * 3600 + part(4) * 60 + second)
