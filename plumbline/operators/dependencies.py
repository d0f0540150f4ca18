"""Dependencies and keys that nobody declared, found by a search up the lattice of column sets."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import constant_frame, cut_lineage, drop_stage

SETS_PER_SCAN = 16
ROWS = "*"  # stands for the whole row where a set of columns is asked for being a key


def _varies(column: str) -> Column:
    """Has a group more than one value of a column?  Null is a value, as in GROUP BY."""
    seen = F.count(column)
    return F.coalesce(F.min(column) != F.max(column), F.lit(False)) | ((seen > 0) & (seen < F.count(F.lit(1))))


def _holding(df: DataFrame, asked: dict[tuple[str, ...], list[str]]) -> dict[tuple[str, ...], list[str]]:
    """Which of the dependents asked for each set of columns it determines, on all rows of ``df``.

    One scan answers a block of sets.  A group is least, greatest and count of each dependent, all
    combined map-side, so no group's rows meet in a task and nothing is counted distinct.
    """
    held: dict[tuple[str, ...], list[str]] = {}
    sets = list(asked)
    for first in range(0, len(sets), SETS_PER_SCAN):
        block = sets[first : first + SETS_PER_SCAN]
        every = [c for c in df.columns if any(c in s for s in block)]
        numbers = {sum(1 << len(every) - 1 - k for k, c in enumerate(every) if c not in s): s for s in block}
        dependents = sorted({y for s in block for y in asked[s]} - {ROWS})
        # dependents travel under names of their own, since grouping sets blank the columns outside a set
        rows = df.select(*[F.col(f"`{c}`").alias(f"x{k}") for k, c in enumerate(every)], *[F.col(f"`{y}`").alias(f"y{k}") for k, y in enumerate(dependents)])
        grouped = rows.groupingSets([[f"x{every.index(c)}" for c in s] for s in block], *[f"x{k}" for k in range(len(every))]) if every else rows.groupBy()
        groups = grouped.agg(
            (F.grouping_id() if every else F.lit(0)).cast("long").alias("g"),
            F.count(F.lit(1)).alias("n"),
            *[_varies(f"y{k}").alias(f"v{k}") for k in range(len(dependents))],
        )
        answers = groups.groupBy("g").agg(F.max("n").alias("n"), *[F.max(f"v{k}").alias(f"v{k}") for k in range(len(dependents))])
        held |= {s: list(asked[s]) for s in block}  # an empty table refutes nothing
        for r in answers.collect():  # one row for each set of the block
            refuted = {y for k, y in enumerate(dependents) if r[f"v{k}"]} | ({ROWS} if r["n"] > 1 else set())
            s = numbers[r["g"]]
            held[s] = [y for y in asked[s] if y not in refuted]
    return {s: ys for s, ys in held.items() if ys}


def minimal_dependencies(df: DataFrame, columns: list[str], most: int = 2, sample_rows: int = 100_000) -> DataFrame:
    """``determinant, dependent, columns``: all minimal dependencies and keys of up to ``most`` columns.

    ``determinant`` lists column names in the order of ``columns``, joined by commas; none for a
    column with one value.  ``dependent`` is a column, or ``*`` where the determinant is a key: no
    two rows share its values.  Minimal: no part of the determinant will do.  Exact for all rows;
    null is a value like others; rows that repeat leave no key; in an empty table all holds, so
    the empty set is a key and determines every column.

    Sets are asked level by level.  A set with a known key in it, or with a column that the others
    determine, is not asked; neither is a dependent known for a part of a set.  Each level is first put to about ``sample_rows`` rows: what fails
    there fails on the table, and only what survives is put to the whole table.
    """
    if len(set(columns)) != len(columns) or any("," in c for c in columns) or ROWS in columns:
        raise ValueError("columns must be distinct names without commas")
    table = df.select(*[F.col(f"`{c}`") for c in columns])
    total = table.count()
    sample = cut_lineage(table.sample(sample_rows / total, seed=7), "dependency-sample") if total > 2 * sample_rows else None
    found: dict[str, list[set[str]]] = {y: [] for y in [*columns, ROWS]}
    out: list[tuple[str, str, int]] = []
    for size in range(most + 1):
        asked: dict[tuple[str, ...], list[str]] = {}
        for s in combinations(columns, size):
            known = {y for y, sets in found.items() if any(x <= set(s) for x in sets)}
            free = not any(x <= set(s) - {c} for c in s for x in found[c])
            if ROWS not in known and free:
                asked[s] = [y for y in [*columns, ROWS] if y not in s and y not in known]
        if sample is not None and asked:
            asked = _holding(sample, asked)
        if not asked:
            continue
        for s, ys in _holding(table, asked).items():
            for y in ys:
                found[y].append(set(s))
                out.append((",".join(s), y, size))
    if sample is not None:
        drop_stage(sample)
    return constant_frame(df.sparkSession, out, "determinant string, dependent string, columns int")
