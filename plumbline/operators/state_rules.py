"""Rules as rows: metric histories and configuration snapshots of a fleet.

A rule table holds a few dozen rows (a constant of the program), so it rides along as a
literal; the history is reduced to one row per object and metric before it meets the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import redact_secrets
from plumbline.operators.ordered import top_n
from plumbline.session import constant_frame

_DAY_US = 86_400_000_000

# Rule, metric, comparison, threshold, days of history asked for, module, status, severity.
METRIC_RULES = [
    ("index_unused", "idx_scan", "<=", 0.0, 7, "M12", "warn", 3),
    ("dead_tuples", "dead_ratio", ">", 0.2, 1, "M18", "warn", 3),
    ("vacuum_wraparound", "xid_age_pct", ">=", 80.0, 0, "M18", "fail", 5),
    ("pool_capacity", "open_conn_pct", ">=", 90.0, 0, "M15", "warn", 4),
    ("replica_lag", "replay_lag_bytes", ">", 100000000.0, 0, "M17", "warn", 3),
    ("partition_inventory", "size_bytes", ">", 1000000000.0, 0, "M16", "warn", 3),
]

# Rule, conditions "key~pattern" that must all match (or "key!" for a missing key),
# module, status, severity.
CONFIG_RULES = [
    ("conn_insecure", "url~sslmode=disable", "M10", "warn", 4),
    ("pooler_session_features", "url~:6543/ url~prepared_statements=true", "M15", "warn", 4),
    ("serverless_direct", "runtime~^(vercel|lambda|netlify|cloudflare)$ url~:5432/", "M15", "warn", 4),
    ("charset", "charset~^utf8(mb3)?$", "M4", "warn", 3),
    ("doc_validator_off", "validator~^none$", "M5", "warn", 3),
    ("doc_validator_missing", "validator!", "M5", "warn", 3),
    ("kv_not_durable", "appendonly~^no$", "M12", "warn", 4),
    ("kv_no_ttl", "ttl_policy!", "M8", "warn", 3),
    ("timeseries_no_retention", "retention_policy!", "M8", "warn", 3),
    ("timeseries_no_compression", "compression_policy!", "M18", "warn", 3),
    ("timeseries_no_rollup", "rollup_policy!", "M17", "warn", 3),
    ("matview_no_refresh", "matview_refresh!", "M17", "warn", 2),
    ("matview_blocks_readers", "matview_refresh~^blocking$", "M17", "warn", 2),
    ("autovacuum_disabled", "autovacuum~^off$", "M18", "warn", 3),
    ("graph_lookup_unindexed", "lookup_index!", "M11", "warn", 3),
    ("vector_model_unversioned", "model_version!", "M19", "warn", 3),
    ("vector_no_index", "ann_index!", "M11", "warn", 4),
]

# Platforms and what they do with declared foreign keys.
NO_FK_PLATFORMS = ["planetscale", "dynamodb", "firestore", "mongodb"]
PRAGMA_FK_PLATFORMS = ["d1", "sqlite", "turso"]


def latest_metrics(history: DataFrame) -> DataFrame:
    """Latest value and length of history per object and metric."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return history.groupBy("store", "object", "metric").agg(
        F.max_by("value", F.struct(micros, "value")).alias("value"), (F.max(micros) - F.min(micros)).alias("window_us")
    )


def metric_rules(history: DataFrame, rules: list[tuple] = METRIC_RULES) -> DataFrame:
    """Every object against every rule.  A metric that was never recorded is ``needs_api``; a
    history shorter than the rule asks for makes the result directional.  An index that its
    latest ``enforces_constraint`` marks as unique or backing a constraint is never unused."""
    latest = latest_metrics(history)
    spark = history.sparkSession
    schema = "rule string, metric string, cmp string, threshold double, days int, module string, rule_status string, severity int"
    table = F.broadcast(constant_frame(spark, rules, schema))
    every = F.explode(F.array(*[F.lit(m) for m in sorted({r[1] for r in rules})]))
    grid = latest.select("store", "object").distinct().withColumn("metric", every)
    backing = latest.where("metric = 'enforces_constraint' AND value > 0").select("store", "object", F.lit(True).alias("backs"))
    known = grid.join(latest, ["store", "object", "metric"], "left").join(table, "metric").join(backing, ["store", "object"], "left")
    hit = (
        F.when(F.col("cmp") == "<=", F.col("value") <= F.col("threshold"))
        .when(F.col("cmp") == ">", F.col("value") > F.col("threshold"))
        .otherwise(F.col("value") >= F.col("threshold"))
    )
    needed = (F.col("rule") == "index_unused") & F.col("backs").isNotNull()
    status = F.when(F.col("value").isNull(), "needs_api").when(hit & ~needed, F.col("rule_status")).otherwise("pass")
    short = F.col("window_us") < F.col("days").cast("long") * _DAY_US
    confidence = F.when(F.col("value").isNull(), "speculative").when(short, "directional").otherwise("established")
    return known.select(
        "store",
        F.concat_ws(".", "module", "object", "rule").alias("id"),
        "module",
        status.alias("status"),
        "severity",
        F.lit("performance").alias("axis"),
        confidence.alias("confidence"),
        "object",
    )


def top_dead_tuples(history: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` tables of each store with the highest share of dead rows."""
    latest = latest_metrics(history.where("metric = 'dead_ratio'")).select("store", "object", F.col("value").alias("dead_ratio"))
    return top_n(latest, ["store"], [F.desc("dead_ratio"), F.asc("object")], n)


def pool_capacity(history: DataFrame, reserved: int = 3) -> DataFrame:
    """Connections that all pools may open against what the server takes and can usefully run.

    Latest ``pool_size`` times ``instances`` above ``max_connections`` less the ``reserved`` ones
    fails; above ``2 * cores + 1`` it is a warning; without the first three it is needs_api.
    """
    asked = ["pool_size", "instances", "max_connections", "cores"]
    latest = latest_metrics(history.where(F.col("metric").isin(asked)))
    wide = latest.groupBy("store", "object").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in asked])
    opened, room = F.col("pool_size") * F.col("instances"), F.col("max_connections") - reserved
    status = (
        F.when(opened.isNull() | room.isNull(), "needs_api")
        .when(opened > room, "fail")
        .when(opened > 2 * F.col("cores") + 1, "warn")
        .otherwise("pass")
    )
    return wide.select("store", "object", opened.alias("connections"), room.alias("room"), status.alias("status"))


def metric_trend(history: DataFrame, metric: str, ceiling: float) -> DataFrame:
    """Change of a metric per object between first and last sample, and whole days until a
    ceiling; -1 where it does not grow."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = history.where(F.col("metric") == metric).groupBy("store", "object").agg(
        F.count(F.lit(1)).alias("samples"),
        F.min_by("value", F.struct(micros, "value")).alias("first_value"),
        F.max_by("value", F.struct(micros, "value")).alias("last_value"),
        (F.max(micros) - F.min(micros)).alias("span_us"),
    )
    gained = F.col("last_value") - F.col("first_value")
    days = F.floor(((F.lit(ceiling) - F.col("last_value")) / gained) * (F.col("span_us") / _DAY_US)).cast("long")
    left = F.when((gained <= 0) | (F.col("span_us") == 0), F.lit(-1).cast("long")).when(F.col("last_value") >= ceiling, 0).otherwise(days)
    return span.withColumn("days_to_ceiling", left)


def _condition(text: str) -> Column:
    """One space-separated conjunction over the store's settings map."""
    settings = F.col("settings")
    out = F.lit(True)
    for part in text.split(" "):
        if part.endswith("!"):
            out = out & F.try_element_at(settings, F.lit(part[:-1])).isNull()
        else:
            key, pattern = part.split("~", 1)
            out = out & F.coalesce(F.try_element_at(settings, F.lit(key)).rlike(pattern), F.lit(False))
    return out


def config_rules(config: DataFrame, rules: list[tuple] = CONFIG_RULES) -> DataFrame:
    """Settings per store against the rule rows.  Only keys the rules name are gathered, so a
    store's map is as small as the rule table; evidence is redacted."""
    keys = sorted({part.rstrip("!").split("~", 1)[0] for r in rules for part in r[1].split(" ")})
    latest = config.groupBy("store", "key").agg(F.max("value").alias("value"))
    maps = latest.groupBy("store").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("key").isin(keys), F.struct("key", "value")))).alias("settings")
    )
    checks = F.array(
        *[
            F.when(
                _condition(cond),
                F.struct(
                    F.lit(rule).alias("rule"), F.lit(module).alias("module"), F.lit(status).alias("status"), F.lit(sev).alias("severity"),
                    F.lit(cond.split(" ")[-1].rstrip("!").split("~", 1)[0]).alias("key"),
                ),
            )
            for rule, cond, module, status, sev in rules
        ]
    )
    hits = maps.withColumn("r", F.explode(F.array_compact(checks)))
    return hits.select(
        "store",
        F.concat_ws(".", "r.module", "store", "r.rule").alias("id"),
        "r.module",
        "r.status",
        "r.severity",
        F.coalesce(redact_secrets(F.try_element_at("settings", F.col("r.key"))), F.lit("(missing)")).alias("observed"),
    )


def platform_capability(stores: DataFrame, fks: DataFrame) -> DataFrame:
    """Stores that declare foreign keys on a platform that does not enforce them (or only on request)."""
    declared = fks.groupBy("store").agg(F.count(F.lit(1)).alias("declared_fks"))
    joined = stores.join(declared, "store")
    unenforced = F.col("platform").isin(NO_FK_PLATFORMS)
    pragma = F.col("platform").isin(PRAGMA_FK_PLATFORMS)
    return joined.where(unenforced | pragma).select(
        "store",
        "platform",
        "declared_fks",
        F.when(unenforced, "fail").otherwise("needs_api").alias("status"),
        F.when(unenforced, 4).otherwise(3).alias("severity"),
    )


def old_engine_versions(stores: DataFrame, oldest: dict[str, int]) -> DataFrame:
    """Engines below an oldest acceptable major version given by the caller; no end-of-life dates."""
    floor = F.try_element_at(F.create_map(*[F.lit(x) for kv in oldest.items() for x in kv]), F.col("platform"))
    return stores.where(F.col("major_version") < floor).select("store", "platform", "major_version")


def rls_state(policies: DataFrame, tenant_tables: DataFrame) -> DataFrame:
    """Row-level security per tenant table: off is a severity-5 failure, on without policies a warning."""
    scoped = policies.join(tenant_tables, ["store", "table_name"], "left_semi")
    off, bare = ~F.col("rls_enabled"), F.col("policy_count") == 0
    return scoped.select(
        "store",
        "table_name",
        F.when(off, "fail").when(bare, "warn").otherwise("pass").alias("status"),
        F.when(off, 5).when(bare, 3).otherwise(1).alias("severity"),
    )


def derived_as_source(roles: DataFrame, writes: DataFrame) -> DataFrame:
    """Derived objects (views, search indexes) that receive direct writes."""
    counted = writes.groupBy("object_id").agg(F.count(F.lit(1)).alias("writes"))
    return roles.where("role = 'derived'").join(counted, "object_id").select("object_id", "writes")


def vector_dimension(measured: DataFrame, models: DataFrame) -> DataFrame:
    """Vectors whose measured dimension differs from the declared model's, per model."""
    sizes = measured.groupBy("model", "dim").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(models, "model").groupBy("model", "declared_dim").agg(
        F.sum("n").alias("vectors"), F.coalesce(F.sum(F.when(F.col("dim") != F.col("declared_dim"), F.col("n"))), F.lit(0)).alias("mismatched")
    )


def largest_tables(sizes: DataFrame, n: int = 20) -> DataFrame:
    """Largest tables of the fleet, partitioned or not."""
    return sizes.orderBy(F.desc("size_bytes"), "store", "table_name").limit(n)


def premature_sharding(stores: DataFrame, max_bytes: int) -> DataFrame:
    """Stores split over several shards while small."""
    return stores.where((F.col("shards") > 1) & (F.col("size_bytes") < max_bytes))


def tier_reached(frames: dict[str, DataFrame | None]) -> int:
    """0 files or catalog declarations, 1 data or live catalog, 2 runtime statistics."""
    if frames.get("metrics") is not None or frames.get("log") is not None:
        return 2
    return 1 if frames.get("data") is not None else 0


def stamp_missing(spark: SparkSession, stores: DataFrame, frames: dict[str, DataFrame | None], needs: dict[str, tuple[str, str, int]]) -> DataFrame:
    """needs_api findings for every check ``rule -> (frame, module, severity)`` whose frame is absent."""
    absent = [(rule, module, sev) for rule, (frame, module, sev) in needs.items() if frames.get(frame) is None]
    rows = [F.struct(F.lit(r).alias("rule"), F.lit(m).alias("module"), F.lit(s).alias("severity")) for r, m, s in absent]
    if not rows:
        return stores.select("store").where("false").selectExpr("store", "'' AS id", "'' AS module", "'' AS status", "0 AS severity", "0 AS tier")
    out = stores.select("store").distinct().withColumn("r", F.explode(F.array(*rows)))
    return out.select(
        "store",
        F.concat_ws(".", "r.module", "store", "r.rule").alias("id"),
        "r.module",
        F.lit("needs_api").alias("status"),
        "r.severity",
        F.lit(tier_reached(frames)).alias("tier"),
    )
