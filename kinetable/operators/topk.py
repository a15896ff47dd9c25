"""Top-k and first-match operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each key with the smallest ``order`` tuple, by partial aggregation.

    Negate a numeric column for descending order; end with columns that make it total.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*")


def first_where(df: DataFrame, keys: Sequence[str], order: str, condition: Column) -> DataFrame:
    """Position of the first row that qualifies."""
    return df.filter(condition).groupBy(*keys).agg(F.min(order).alias("first"))
