"""Token use and its price."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS = ["input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"]


def total_usage(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums of the four counters."""
    return calls.groupBy(*(by or [])).agg(*[F.sum(c).alias(c) for c in COUNTERS])


def estimate_cost(usage: DataFrame, prices: DataFrame, on: str = "model") -> DataFrame:
    """Add ``cost`` from prices per million tokens (same counter names with _price); null for an unknown model."""
    joined = usage.join(prices, on, "left")  # one row a model on either side
    cost = sum((F.col(c) / 1e6 * F.col(f"{c}_price") for c in COUNTERS), F.lit(0.0))
    return joined.withColumn("cost", cost).drop(*[f"{c}_price" for c in COUNTERS])
