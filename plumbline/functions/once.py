"""Evaluate an expensive column once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions and filters refer to by value.

    They come out of a one-row generator, which the optimizer does not fold into the
    expressions above it, so an expensive column is evaluated once per row.
    """
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(made)))
