"""Numbers as short text, for exports and reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def compact(n: Column) -> Column:
    """1.23B, 4.56M, 7.8K, 90; nothing counts as 0."""
    n = F.coalesce(n.cast("double"), F.lit(0.0))
    a = F.abs(n)
    return F.when(a >= 1e9, F.format_string("%.2fB", n / 1e9)).when(a >= 1e6, F.format_string("%.2fM", n / 1e6)).when(a >= 1e3, F.format_string("%.1fK", n / 1e3)).otherwise(F.floor(n + 0.5).cast("string"))


def money(n: Column) -> Column:
    """Dollars: more digits for less."""
    n = F.coalesce(n.cast("double"), F.lit(0.0))
    a = F.abs(n)
    return F.when(n == 0, "$0").when(a < 0.01, F.format_string("$%.4f", n)).when(a < 1, F.format_string("$%.3f", n)).otherwise(F.concat(F.lit("$"), F.format_number(n, 2)))


def percent(n: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", F.coalesce(n.cast("double"), F.lit(0.0)))
