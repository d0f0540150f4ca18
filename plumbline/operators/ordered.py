"""Ordered computations per key that stay spread out when one key holds most rows.

A plain ``Window.partitionBy(key).orderBy(ts)`` sorts all rows of a key in one task.  Here the
order column is cut into buckets: rows are windowed per (key, bucket), and what must cross a
bucket edge travels in a frame with one row per (key, bucket), itself ordered in runs of buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN = 4096  # buckets to a run
_PART = "__part"  # struct of the key columns and the bucket; a struct compares NULL keys as equal


def time_bucket(ts: str, seconds: int) -> Column:
    """Bucket number of a timestamp (with or without zone); monotone in ``ts``."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def id_bucket(column: str, width: int) -> Column:
    return F.floor(F.col(column) / F.lit(width)).cast("long")


class Ordered:
    """Rows ordered by ``order`` within ``keys``; ``bucket`` must be monotone in ``order``.

    Windowing and the join that hands values over bucket edges use the same key, so the rows are
    shuffled once.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], bucket: Column):
        self.order = order
        self.df = df.withColumn(_PART, F.struct(*keys, bucket.alias("__bucket")))
        self._rows = Window.partitionBy(_PART).orderBy(*order)
        self._names = keys
        self._keys = [F.col(f"{_PART}.{k}").alias(k) for k in keys]

    def _tails(self, df: DataFrame, value: Column) -> DataFrame:
        """One row per (key, bucket) with what the bucket hands on."""
        return df.groupBy(_PART).agg(value.alias("__tail"))

    def _join(self, local: DataFrame, tails: DataFrame) -> DataFrame:
        return local.join(tails.drop("__tail"), _PART, "left")

    def _carried(self, tails: DataFrame, within, total: Column, across, merge) -> DataFrame:
        """Adds ``__carry``: what all earlier buckets of the key hand on.

        Buckets are ordered within runs of ``FAN`` buckets, and only one row per run is ordered
        along the key, so a table without keys has no task with a row per bucket either.
        """
        run = F.struct(*self._keys, F.floor(F.col(f"{_PART}.__bucket") / FAN).alias("__run"))
        runs = tails.withColumn("__top", run)
        local = runs.withColumn("__in", within(Window.partitionBy("__top").orderBy(F.col(f"{_PART}.__bucket"))))
        tops = runs.groupBy("__top").agg(total.alias("__total"))
        along = Window.partitionBy(*[F.col(f"__top.{k}") for k in self._names]).orderBy(F.col("__top.__run"))
        tops = tops.withColumn("__before", across(along)).select("__top", "__before")
        return local.join(tops, "__top").withColumn("__carry", merge(F.col("__in"), F.col("__before"))).drop("__top", "__in", "__before")

    def previous(self, columns: list[str], name: str = "prev") -> DataFrame:
        """Adds struct ``name`` with ``columns`` of the preceding row of the key."""
        value = F.struct(*columns)
        local = self.df.withColumn("__local", F.lag(value).over(self._rows))
        tails = self._tails(self.df, F.max_by(value, F.struct(*self.order)))
        place = F.col(f"{_PART}.__bucket")
        carried = self._carried(tails, lambda w: F.lag("__tail").over(w), F.max_by("__tail", place), lambda w: F.lag("__total").over(w), F.coalesce)
        joined = self._join(local, carried)
        return joined.withColumn(name, F.coalesce("__local", "__carry")).drop("__local", "__carry", _PART)

    def latest(self, when: Column, columns: list[str], name: str) -> DataFrame:
        """Adds struct ``name``: ``columns`` of the latest earlier row of the key where ``when``."""
        marked = self.df.withColumn("__value", F.when(when, F.struct(*columns)))
        before = self._rows.rowsBetween(Window.unboundedPreceding, -1)
        local = marked.withColumn("__local", F.last("__value", ignorenulls=True).over(before))
        place = F.when(F.col("__value").isNotNull(), F.struct(*self.order))
        tails = self._tails(marked, F.max_by("__value", place))
        held = F.when(F.col("__tail").isNotNull(), F.col(f"{_PART}.__bucket"))
        carried = self._carried(
            tails,
            lambda w: F.last("__tail", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            F.max_by("__tail", held),
            lambda w: F.last("__total", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            F.coalesce,
        )
        joined = self._join(local, carried)
        return joined.withColumn(name, F.coalesce("__local", "__carry")).drop("__local", "__carry", "__value", _PART)

    def running_sum(self, column: str, name: str) -> DataFrame:
        """Adds the sum of ``column`` over the key's rows up to and including this one."""
        upto = self._rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = self.df.withColumn("__local", F.sum(column).over(upto))
        tails = self._tails(self.df, F.sum(column))
        carried = self._carried(
            tails,
            lambda w: F.sum("__tail").over(w.rowsBetween(Window.unboundedPreceding, -1)),
            F.sum("__tail"),
            lambda w: F.sum("__total").over(w.rowsBetween(Window.unboundedPreceding, -1)),
            lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
        )
        joined = self._join(local, carried)
        return joined.withColumn(name, F.col("__local") + F.coalesce("__carry", F.lit(0))).drop("__local", "__carry", _PART)

    def running_max(self, value: Column, name: str) -> DataFrame:
        """Adds ``name``: the greatest ``value`` of all earlier rows of the key."""
        before = self._rows.rowsBetween(Window.unboundedPreceding, -1)
        marked = self.df.withColumn("__value", value)
        local = marked.withColumn("__local", F.max("__value").over(before))
        tails = self._tails(marked, F.max("__value"))
        carried = self._carried(
            tails,
            lambda w: F.max("__tail").over(w.rowsBetween(Window.unboundedPreceding, -1)),
            F.max("__tail"),
            lambda w: F.max("__total").over(w.rowsBetween(Window.unboundedPreceding, -1)),
            F.greatest,
        )
        joined = self._join(local, carried)
        return joined.withColumn(name, F.greatest("__local", "__carry")).drop("__local", "__carry", "__value", _PART)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key.  The rank filter is pushed below the shuffle by the optimizer
    (a group limit per input partition), so a hot key sends at most ``n`` rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame to every row, as scalar subqueries."""
    return df.withColumns({c: totals.select(c).scalar() for c in totals.columns})
