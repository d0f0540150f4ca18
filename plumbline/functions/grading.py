"""Column expressions shared by the scoring operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Paradigm names, in the order their patterns are tried.
PARADIGMS = ["relational", "document", "key-value", "wide-column", "vector", "time-series", "graph"]

# Engine -> paradigm.
ENGINE_PARADIGM = {
    "postgres": "relational",
    "mysql": "relational",
    "mariadb": "relational",
    "sqlite": "relational",
    "cockroachdb": "relational",
    "yugabyte": "relational",
    "planetscale": "relational",
    "supabase": "relational",
    "neon": "relational",
    "turso": "relational",
    "d1": "relational",
    "mongodb": "document",
    "firestore": "document",
    "redis": "key-value",
    "dynamodb": "key-value",
    "cassandra": "wide-column",
    "scylla": "wide-column",
    "pgvector": "vector",
    "qdrant": "vector",
    "pinecone": "vector",
    "weaviate": "vector",
    "timescaledb": "time-series",
    "influxdb": "time-series",
    "clickhouse": "time-series",
    "neo4j": "graph",
}

# URL scheme -> engine.
SCHEME_ENGINE = {
    "postgres": "postgres",
    "postgresql": "postgres",
    "mysql": "mysql",
    "mariadb": "mariadb",
    "mongodb+srv": "mongodb",
    "mongodb": "mongodb",
    "redis": "redis",
    "rediss": "redis",
    "cassandra": "cassandra",
    "sqlserver": "generic",
    "libsql": "turso",
}

# ORM provider name -> engine.
PROVIDER_ENGINE = {
    "postgresql": "postgres",
    "postgres": "postgres",
    "mysql": "mysql",
    "mariadb": "mariadb",
    "sqlite": "sqlite",
    "mongodb": "mongodb",
    "cockroachdb": "cockroachdb",
    "sqlserver": "generic",
}

# Dialect text -> paradigm, first match wins.
DIALECT_PATTERNS = [
    ("mongo|document|firestore", "document"),
    ("dynamo", "key-value"),
    ("cassandra|scylla|wide", "wide-column"),
    ("redis", "key-value"),
    ("neo4j|graph", "graph"),
    ("pgvector|vector|qdrant|pinecone|weaviate", "vector"),
    ("timescale|influx|clickhouse|time-?series", "time-series"),
]


def constant_map(mapping: dict[str, str]) -> Column:
    """A map literal, written as one SQL expression."""
    quoted = ", ".join("'" + str(x).replace("'", "''") + "'" for kv in mapping.items() for x in kv)
    return F.expr(f"map({quoted})")


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of a small constant map, NULL when absent."""
    return F.try_element_at(constant_map(mapping), key)


def engine_paradigm(engine: Column) -> Column:
    return F.coalesce(lookup(ENGINE_PARADIGM, engine), F.lit("relational"))


def provider_engine(provider: Column) -> Column:
    return lookup(PROVIDER_ENGINE, F.lower(provider))


def scheme_engine(url: Column) -> Column:
    return lookup(SCHEME_ENGINE, F.lower(F.regexp_extract(url, r"^(\w[\w+]*)://", 1)))


def infer_paradigm(dialect: Column) -> Column:
    text = F.lower(F.coalesce(dialect, F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for pattern, paradigm in DIALECT_PATTERNS:
        out = out.when(text.rlike(pattern), F.lit(paradigm))
    return out.otherwise(F.lit("relational"))


def parent_module(module: Column) -> Column:
    return F.regexp_replace(module, "[a-z]$", "")


def band(value: Column) -> Column:
    return F.when(value >= 90, "A").when(value >= 80, "B").when(value >= 70, "C").when(value >= 60, "D").otherwise("F")


def tenths(numerator: str, denominator: str) -> Column:
    """numerator / denominator in tenths, rounded half up, in integer arithmetic."""
    return F.expr(f"CAST((20 * ({numerator}) + ({denominator})) div (2 * ({denominator})) AS BIGINT)")
