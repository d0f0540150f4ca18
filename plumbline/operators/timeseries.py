"""Chunks, rollups, retention and gaps of event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NTZ = "timestamp_ntz"


def trunc(unit: str, ts: str) -> Column:
    return F.date_trunc(unit, F.col(ts)).cast(_NTZ)


def calendar(df: DataFrame, ts: str, unit: str) -> DataFrame:
    """Every ``unit`` between the first and last event.  One row per unit, independent of rows."""
    span = df.agg(F.min(trunc(unit, ts)).alias("lo"), F.max(trunc(unit, ts)).alias("hi"))
    return span.select(F.explode(F.expr(f"sequence(lo, hi, INTERVAL 1 {unit})")).alias("bucket"))


def gap_fill(df: DataFrame, ts: str, unit: str) -> DataFrame:
    """Rows per time bucket including the empty ones."""
    counts = df.groupBy(trunc(unit, ts).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    return calendar(df, ts, unit).join(counts, "bucket", "left").select("bucket", F.coalesce("rows", F.lit(0)).alias("rows"))


def chunk_sizing(df: DataFrame, ts: str, unit: str) -> DataFrame:
    """Smallest, largest and empty chunks at a chunk interval."""
    return gap_fill(df, ts, unit).agg(
        F.lit(unit).alias("chunk"),
        F.count(F.lit(1)).alias("chunks"),
        F.min("rows").alias("min_rows"),
        F.max("rows").alias("max_rows"),
        F.count_if(F.col("rows") == 0).alias("empty_chunks"),
    )


def rollup_hourly(df: DataFrame, ts: str, keys: list[str], value: str) -> DataFrame:
    """Continuous aggregate: counts and exact sums (minor units) per hour and key."""
    minor = (F.sum(F.col(value).cast("decimal(18,2)")) * 100).cast("long")
    return df.groupBy(trunc("hour", ts).alias("bucket"), *keys).agg(F.count(F.lit(1)).alias("n"), minor.alias("total_minor"))


def _label(c: str) -> Column:
    return F.when(F.grouping(c) == 1, "*").otherwise(F.col(c).cast("string"))


def rollup_grains(df: DataFrame, grains: list[str]) -> DataFrame:
    """Hierarchical totals along ``grains`` (``*`` marks a rolled-up level)."""
    out = df.rollup(*grains).agg(F.count(F.lit(1)).alias("n"), *[_label(c).alias(f"{c}_level") for c in grains])
    return out.select(*[F.col(f"{c}_level").alias(c) for c in grains], "n")


def cube_grains(df: DataFrame, dims: list[str]) -> DataFrame:
    """Totals over every combination of ``dims``, with the grouping id."""
    out = df.cube(*dims).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("grouping"), *[_label(c).alias(f"{c}_level") for c in dims]
    )
    return out.select(*[F.col(f"{c}_level").alias(c) for c in dims], F.col("grouping").cast("int").alias("grouping"), "n")


def rollup_staleness(base: DataFrame, ts: str, unit: str, stored: DataFrame) -> DataFrame:
    """Buckets of a stored rollup (bucket, n) that differ from the base table."""
    fresh = base.groupBy(trunc(unit, ts).alias("bucket")).agg(F.count(F.lit(1)).alias("fresh_n"))
    kept = stored.select(F.col("bucket").cast(_NTZ).alias("bucket"), F.col("n").alias("stored_n"))
    return (
        fresh.join(kept, "bucket", "full_outer")
        .where(~F.col("fresh_n").eqNullSafe(F.col("stored_n")))
        .select(
            "bucket",
            F.coalesce("stored_n", F.lit(0)).alias("stored_n"),
            F.coalesce("fresh_n", F.lit(0)).alias("fresh_n"),
            F.when(F.col("stored_n").isNull(), "missing").when(F.col("fresh_n").isNull(), "extra").otherwise("stale").alias("state"),
        )
    )


def retention_report(df: DataFrame, ts: str, cutoff: str) -> DataFrame:
    """Rows past the retention cutoff per month."""
    expired = F.col(ts) < F.lit(cutoff).cast(_NTZ)
    return df.groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(expired).alias("expired")
    )
