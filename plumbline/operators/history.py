"""Versioned rows, paging and batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordered import Ordered


def validity_overlap(df: DataFrame, key: str, start: str, end: str, tie: str, bucket: Column) -> DataFrame:
    """Versions of an entity that overlap an earlier one or leave a gap after all earlier ones.

    A version is held against the earlier one that lasts longest, so one that lies within another, or follows
    such a one, is judged by what is still open when it starts.  A version holds from its start to before its end; a null end is
    open, a null start is before all others.  Of versions that last equally long the one of the greatest ``tie`` is named.
    """
    lasts = F.struct(F.col(end).isNull().alias("open"), F.col(end).alias("end"), F.col(tie).alias("version"))
    swept = Ordered(df, [key], [start, tie], bucket).running_max(lasts, "before")
    begins, open_end = F.col(start), F.col("before.open")
    overlap = open_end | begins.isNull() | (begins < F.col("before.end"))
    return (
        swept.where(F.col("before").isNotNull())
        .withColumn("problem", F.when(overlap, "overlap").when(begins > F.col("before.end"), "gap"))
        .where("problem IS NOT NULL")
        .select(key, F.col("before.version").alias("previous_version"), F.col(tie).alias("version"), "problem")
    )


def keyset_page(df: DataFrame, key: str, after: int, size: int) -> DataFrame:
    """The page after a key; the filter reaches the scan."""
    return df.where(F.col(key) > after).orderBy(key).limit(size)


def offset_page(df: DataFrame, key: str, offset: int, size: int) -> DataFrame:
    """The page at a row offset, which reads and sorts everything before it."""
    return df.orderBy(key).offset(offset).limit(size)


def backfill_batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """Bounded key-range batches of a table, each resumable on its own."""
    batch = F.floor(F.col(key) / F.lit(size)).cast("long")
    return df.groupBy(batch.alias("batch")).agg(F.min(key).alias("from_key"), F.max(key).alias("to_key"), F.count(F.lit(1)).alias("rows"))
