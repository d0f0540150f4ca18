"""Binding of operators to the supplied tables, each with its SQL oracle.

``@query(name, sql)`` registers a callable ``(Inputs) -> DataFrame``.  In the SQL,
``{name}`` refers to a derived fixture; its definition is prepended as a CTE.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans.fixtures import FIXTURES
from plumbline.session import TABLES, read_table

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}
_REF = re.compile(r"\{(\w+)\}")


class Inputs:
    """Lazy access to supplied tables and derived fixtures by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            frame = read_table(self.spark, self.sf_dir, name)
        elif name in FIXTURES:
            sql = FIXTURES[name]
            frame = self.spark.sql(sql, **{dep: getattr(self, dep) for dep in refs(sql)})
        else:
            raise AttributeError(name)
        setattr(self, name, frame)  # the same frame each time, so that operators can share its scan
        return frame


def refs(sql: str) -> list[str]:
    """Fixture or table names a template mentions, in order of first mention."""
    return [n for n in dict.fromkeys(_REF.findall(sql)) if n in FIXTURES or n in TABLES]


def oracle(sql: str) -> str:
    """Inline every fixture that ``sql`` mentions as a CTE, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in order:
            return
        for dep in refs(FIXTURES[name]):
            visit(dep)
        order.append(name)

    for name in refs(sql):
        visit(name)

    def plain(text: str) -> str:
        return _REF.sub(lambda m: m.group(1) if m.group(1) in FIXTURES or m.group(1) in TABLES else m.group(0), text)

    body = plain(sql).strip()
    ctes = [f"{name} AS ({plain(FIXTURES[name])})" for name in order]
    if not ctes:
        return body
    head = re.match(r"(?is)^WITH\s+(RECURSIVE\s+)?", body)
    if head:
        return f"WITH {head.group(1) or ''}{', '.join(ctes)}, {body[head.end():]}"
    return f"WITH {', '.join(ctes)} {body}"


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[Inputs], DataFrame]) -> Callable:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = oracle(sql)
        return fn

    return register


def _bind(fn: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Inputs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: _bind(fn) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def _load() -> None:
    """Import every module that registers queries."""
    import plumbline.plans.catalog_plans  # noqa: F401
    import plumbline.plans.evidence_plans  # noqa: F401
    import plumbline.plans.log_plans  # noqa: F401
    import plumbline.plans.scoring_plans  # noqa: F401
    import plumbline.plans.special_plans  # noqa: F401
    import plumbline.plans.stream_plans  # noqa: F401
