"""Unit prices: missing-price policies and the cost of tokens."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# For a price without cache rates, their factors on the input price (read, write).
POLICIES = {"ratio10": (0.1, 1.25), "zero": (0.0, 0.0), "inputprice": (1.0, 1.0)}
COUNTERS = (("cache_read", "cache_read"), ("cache_write", "cache_write"), ("input", "input"), ("output", "output"))


def normalized(policy: str = "ratio10", prefix: str = "price_") -> dict[str, Column]:
    """The four unit prices of price columns under a policy, `ok` and `estimated`. Without an input price nothing is known."""
    read, write = POLICIES.get(policy, POLICIES["ratio10"])
    p = {k: F.col(prefix + k).cast("double") for k in ("input", "output", "cache_read", "cache_write")}
    ok = p["input"].isNotNull()
    missing = lambda k: F.when(ok & p[k].isNull(), F.lit(k))
    return {
        "unit_input": p["input"],
        "unit_cache_read": F.when(ok, F.coalesce(p["cache_read"], p["input"] * read)),
        "unit_cache_write": F.when(ok, F.coalesce(p["cache_write"], p["input"] * write)),
        "unit_output": F.when(ok, F.coalesce(p["output"], p["input"])),
        "price_ok": ok,
        "estimated": F.array_compact(F.array(missing("cache_read"), missing("cache_write"), missing("output"))),
    }


def cost(tokens: str = "", units: str = "unit_") -> Column:
    """Dollars for the token counters at prices for a million; a missing price counts 0."""
    parts = [F.col(tokens + c) / 1e6 * F.coalesce(F.col(units + u), F.lit(0.0)) for c, u in COUNTERS]
    return parts[0] + parts[1] + parts[2] + parts[3]
