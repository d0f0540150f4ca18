"""Erasure of data subjects across linked tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordered import with_totals


def erase_subjects(
    tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], root: str, key: str, subjects: DataFrame
) -> dict[str, DataFrame]:
    """Tables without any row that belongs to ``subjects`` (a frame with column ``key``).

    ``links`` are ``(child, fk, parent, pk)``, parents before children.  The keys to drop are
    handed down link by link, so each table needs one anti join.
    """
    doomed: dict[str, tuple[str, DataFrame]] = {root: (key, subjects.select(key).distinct())}
    kept = {root: tables[root].join(doomed[root][1], key, "left_anti")}
    for child, fk, parent, pk in links:
        parent_key, parent_doomed = doomed[parent]
        if parent_key == pk:
            lost = parent_doomed.select(F.col(pk).alias(fk))
        else:
            lost = tables[parent].join(parent_doomed, parent_key, "left_semi").select(F.col(pk).alias(fk)).distinct()
        doomed[child] = (fk, lost)
        kept[child] = tables[child].join(lost, fk, "left_anti")
    return {**tables, **kept}


def erasure_counts(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Rows per table before and after an erasure."""

    def one(name: str) -> DataFrame:
        left = after[name].agg(F.count(F.lit(1)).alias("rows_after"))
        counted = before[name].agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows_before"))
        return with_totals(counted, left)

    return reduce(DataFrame.unionByName, [one(name) for name in before])
