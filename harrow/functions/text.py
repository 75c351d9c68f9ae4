"""Numbers and series as short text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of a sparkline, filled and empty part of a bar.
STEPS, FULL, EMPTY = "▁▂▃▄▅▆▇█", "█", "░"


def short_number(n: Column) -> Column:
    """1234 as 1.2K, 1234567 as 1.2M."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000)).when(n >= 1_000, F.format_string("%.1fK", n / 1_000)).otherwise(n.cast("string"))


def percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, F.format_string("%5.1f%%", part / total * 100)).otherwise("  0.0%")


def bar(value: Column, most: Column, width: int = 30) -> Column:
    """A bar of the value's share of the most."""
    filled = F.least(F.floor(value / most * width), F.lit(width)).cast("int")
    return F.when(most > 0, F.concat(F.repeat(F.lit(FULL), filled), F.repeat(F.lit(EMPTY), width - filled))).otherwise("")


def sparkline(values: Column) -> Column:
    """An array of numbers as one character each, between their least and their greatest."""
    low, high = F.array_min(values), F.array_max(values)
    span = F.when(high == low, 1).otherwise(high - low)
    return F.array_join(F.transform(values, lambda v: F.substring(F.lit(STEPS), F.least(F.floor((v - low) / span * 7), F.lit(7)).cast("int") + 1, F.lit(1))), "")


def with_provider(model: Column, provider: str = "anthropic") -> Column:
    """A model's name with its provider; a bare name gets the default one."""
    return F.when(F.contains(model, F.lit(":")), model).otherwise(F.concat(F.lit(f"{provider}:"), model))
