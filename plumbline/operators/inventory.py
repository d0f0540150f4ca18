"""Which database stacks a set of repositories uses, from file paths and contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.grading import PROVIDER_ENGINE, SCHEME_ENGINE, engine_paradigm, lookup
from plumbline.operators.ordered import top_n

# Dependency name pattern, ORM, engine, in the order they are tried.  An ORM alone
# says nothing of an engine.
DEPENDENCIES = [
    (r"drizzle-orm", "drizzle", None),
    (r"@prisma/client|^prisma$", "prisma", None),
    (r"typeorm", "typeorm", None),
    (r"sequelize", "sequelize", None),
    (r"mongoose", "mongoose", "mongodb"),
    (r"kysely", "kysely", None),
    (r"\bpg\b|postgres", None, "postgres"),
    (r"mysql2?|mariadb", None, "mysql"),
    (r"better-sqlite3|^sqlite3?$", None, "sqlite"),
    (r"mongodb", None, "mongodb"),
    (r"ioredis|^redis$", None, "redis"),
    (r"@planetscale/database", None, "planetscale"),
    (r"@supabase/supabase-js", None, "supabase"),
    (r"@neondatabase/serverless", None, "neon"),
    (r"@libsql/client|@turso", None, "turso"),
    (r"@aws-sdk/client-dynamodb|dynamodb", None, "dynamodb"),
    (r"cassandra-driver", None, "cassandra"),
    (r"neo4j-driver", None, "neo4j"),
    (r"pgvector", None, "pgvector"),
    (r"@qdrant/js-client", None, "qdrant"),
    (r"@pinecone-database", None, "pinecone"),
]
# Container image pattern -> engine, tried for every image.
IMAGE_ENGINES = [
    (r"postgres|pgvector", "postgres"),
    (r"mysql|mariadb", "mysql"),
    (r"mongo", "mongodb"),
    (r"redis", "redis"),
    (r"cassandra|scylla", "cassandra"),
    (r"neo4j", "neo4j"),
    (r"clickhouse", "clickhouse"),
    (r"timescale", "timescaledb"),
]
IGNORED_DIRS = r"(^|/)(node_modules|\.git|dist|build|\.next|vendor|target|__pycache__|\.venv|venv)/"
RAW_SQL = 7  # signal groups before this one stand on their own; later ones only fill gaps


def _any_like(names: Column, pattern: str) -> Column:
    return F.exists(names, lambda n: n.rlike("(?i)" + pattern))


def _engines_of(names: Column, table: list[tuple[str, str]]) -> Column:
    """Distinct engines whose pattern matches any of ``names``."""
    return F.array_compact(F.array(*[F.when(_any_like(names, p), F.lit(e)) for p, e in table]))


_DETECTION = "array<struct<signal_group:int,orm:string,confidence:string,engine:string,platform:string>>"


def _detection(group: int, orm: str, confidence: str, engine: Column, platform: str | None = None) -> Column:
    return F.struct(
        F.lit(group).alias("signal_group"), F.lit(orm).alias("orm"), F.lit(confidence).alias("confidence"),
        engine.alias("engine"), F.lit(platform).cast("string").alias("platform"),
    )


def _signal(group: int, orm: str, confidence: str, when: Column, engines: Column, platform: str | None = None) -> Column:
    """One signal group as an array of detections, empty when the file does not carry it."""
    make = F.transform(engines, lambda e: _detection(group, orm, confidence, e, platform))
    return F.when(when, make).otherwise(F.array().cast(_DETECTION))


def _dependency_signal(when: Column, names: Column) -> Column:
    """Engines that dependencies stand for, each by the first row of the table that names it."""
    rows, taken = [], {}
    for pattern, orm, engine in DEPENDENCIES:
        if engine is not None:
            hit = _any_like(names, pattern)
            earlier = taken.get(engine)
            rows.append(F.when(hit & ~earlier if earlier is not None else hit, _detection(9, orm or "unknown", "directional", F.lit(engine))))
            taken[engine] = hit if earlier is None else hit | earlier
    return F.when(when, F.array_compact(F.array(*rows))).otherwise(F.array().cast(_DETECTION))


def stack_inventory(files: DataFrame) -> DataFrame:
    """Stacks per repository from ``(repo, path, content)``; nothing found means no row.  ``platform``
    is known for edge databases, and for Postgres schemas of repositories with a platform folder."""
    path, content = F.col("path"), F.col("content")

    def one(engine: str) -> Column:
        return F.array(F.lit(engine))

    providers = F.transform(
        F.regexp_extract_all(content, F.lit(r'provider\s*=\s*"(\w+)"'), F.lit(1)), lambda p: lookup(PROVIDER_ENGINE, p)
    )
    prisma = F.array(F.coalesce(F.try_element_at(F.array_compact(providers), F.lit(1)), F.lit("postgres")))
    dialect = F.get_json_object(content, "$.dialect")
    drizzle = F.array(F.when(dialect.isin("mysql", "sqlite"), dialect).otherwise("postgres"))
    dep_names = F.concat(
        F.coalesce(F.json_object_keys(F.get_json_object(content, "$.dependencies")), F.array().cast("array<string>")),
        F.coalesce(F.json_object_keys(F.get_json_object(content, "$.devDependencies")), F.array().cast("array<string>")),
    )
    images = F.regexp_extract_all(content, F.lit(r"""(?i)image:\s*["']?([\w./:-]+)"""), F.lit(1))
    schemes = F.regexp_extract_all(
        content,
        F.lit(r"""(?im)^\s*[\w.]*?(?:DATABASE|DB|MONGO|REDIS|POSTGRES|MYSQL)?_?URL\s*=\s*["']?(\w[\w+]*)://"""),
        F.lit(1),
    )
    env_engines = F.array_compact(F.transform(schemes, lambda s: lookup(SCHEME_ENGINE, F.lower(s))))
    signals = F.concat(
        _signal(1, "prisma", "established", path.rlike(r"schema\.prisma$"), prisma),
        _signal(2, "drizzle", "established", path.rlike(r"drizzle/meta/.*_snapshot\.json$|drizzle-snapshot\.json$"), drizzle),
        _signal(2, "drizzle", "directional", path.rlike(r"drizzle\.config\.[tj]s$"), one("postgres")),
        _signal(3, "activerecord", "established", path.rlike(r"(^|/)(schema\.rb|structure\.sql)$"), one("postgres")),
        _signal(4, "django", "directional", path.rlike(r"(^|/)models\.py$"), one("postgres")),
        _signal(5, "alembic", "directional", path.rlike(r"(^|/)alembic\.ini$|alembic/versions/.*\.py$"), one("postgres")),
        _signal(6, "mongoose", "directional", content.rlike(r"""require\(['"]mongoose|from ['"]mongoose"""), one("mongodb")),
        _signal(7, "raw-sql", "established", path.rlike(r"\.sql$"), one("postgres")),
        _signal(8, "raw-sql", "directional", path.rlike(r"(^|/)wrangler\.toml$") & content.rlike(r"\[\[\s*d1_databases"), one("d1"), "cloudflare-d1"),
        _dependency_signal(path.rlike(r"(^|/)package\.json$"), dep_names),
        _signal(10, "docker-compose", "directional", path.rlike(r"(^|/)(docker-compose|compose)(\.\w+)?\.ya?ml$"), _engines_of(images, IMAGE_ENGINES)),
        _signal(11, "connection-string", "directional", path.rlike(r"(^|/)\.env(\.\w+)?$"), env_engines),
    )
    watched = files.where(~path.rlike(IGNORED_DIRS))
    # one row per repository, file patterns being combined map-side
    traits = watched.groupBy("repo").agg(
        F.bool_or(path.rlike(r"(^|/)manage\.py$|/migrations/\d+.*\.py$")).alias("django"),
        F.min(F.when(path.rlike(r"/migrations/\d+.*\.py$"), path)).alias("django_source"),
        F.bool_or(path.rlike(r"(^|/)supabase/")).alias("supabase"),
    )
    found = (
        watched.select("repo", "path", F.explode(F.array_distinct(signals)).alias("s"))
        .groupBy("repo", "s.engine", "s.signal_group", "s.orm", "s.platform")
        .agg(F.min_by("s.confidence", "path").alias("confidence"), F.min("path").alias("source_of_truth"))
        .join(traits, "repo")
        .where((F.col("orm") != "django") | F.col("django"))
        .withColumn("source_of_truth", F.when(F.col("orm") == "django", F.coalesce("django_source", "source_of_truth")).otherwise(F.col("source_of_truth")))
        .withColumn("platform", F.coalesce("platform", F.when(F.col("supabase") & (F.col("engine") == "postgres") & (F.col("signal_group") < 9), "supabase")))
        .drop("django", "django_source", "supabase")
    )
    # Raw SQL counts only where no schema artifact was found; later groups add engines not seen before.
    earliest = found.groupBy("repo").agg(F.min("signal_group").alias("repo_first"))
    found = found.join(earliest, "repo").where((F.col("signal_group") != RAW_SQL) | (F.col("repo_first") == RAW_SQL))
    first = found.groupBy("repo", "engine").agg(F.min("signal_group").alias("first_group"))
    kept = found.join(first, ["repo", "engine"])
    alone = F.col("signal_group") < RAW_SQL
    fills = F.col("signal_group") == F.col("first_group")
    return kept.where(alone | fills).select(
        "repo", "engine", engine_paradigm(F.col("engine")).alias("paradigm"), "orm", "platform", "confidence", "source_of_truth"
    )


def source_precedence(sources: DataFrame) -> DataFrame:
    """The authoritative source per database: live, then declarative, then migration, then ORM source."""
    rank = (
        F.when(F.col("kind") == "live", 1)
        .when(F.col("kind") == "declarative", 2)
        .when(F.col("kind") == "migration", 3)
        .otherwise(4)
    )
    ranked = sources.withColumn("precedence", rank)
    return top_n(ranked, ["store"], [F.asc("precedence"), F.asc("source")], 1).drop("rank")
