"""Scoring profiles: per paradigm and axis, weighted categories of modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import constant_frame

# Paradigm, axis, category, weight, modules.
PROFILES = [
    ("relational", "design", "modeling", 16, ["M1", "M19"]),
    ("relational", "design", "keys", 14, ["M2"]),
    ("relational", "design", "referential integrity", 16, ["M3"]),
    ("relational", "design", "types", 14, ["M4", "M6"]),
    ("relational", "design", "constraints", 12, ["M5"]),
    ("relational", "design", "naming", 6, ["M7"]),
    ("relational", "design", "security", 14, ["M9", "M10", "M20", "M21"]),
    ("relational", "design", "temporal", 8, ["M8"]),
    ("relational", "performance", "indexing", 20, ["M11"]),
    ("relational", "performance", "index hygiene", 16, ["M12"]),
    ("relational", "performance", "query patterns", 18, ["M13", "M3", "M19"]),
    ("relational", "performance", "concurrency", 12, ["M14"]),
    ("relational", "performance", "pooling", 10, ["M15"]),
    ("relational", "performance", "scale topology", 12, ["M16", "M17", "M2", "M9"]),
    ("relational", "performance", "storage", 12, ["M18", "M22", "M20", "M21"]),
    ("document", "design", "access pattern", 26, ["M19", "M20"]),
    ("document", "design", "keys", 12, ["M2"]),
    ("document", "design", "types", 14, ["M4", "M6"]),
    ("document", "design", "schema validation", 16, ["M5"]),
    ("document", "design", "security", 18, ["M9", "M10", "M21"]),
    ("document", "design", "naming", 6, ["M7"]),
    ("document", "design", "temporal", 8, ["M8"]),
    ("document", "performance", "indexing", 30, ["M11", "M12"]),
    ("document", "performance", "query patterns", 22, ["M13", "M14", "M19"]),
    ("document", "performance", "document growth", 18, ["M18", "M20", "M22"]),
    ("document", "performance", "shard key", 16, ["M16"]),
    ("document", "performance", "pooling", 14, ["M15"]),
    ("key-value", "design", "access pattern", 30, ["M19", "M20"]),
    ("key-value", "design", "keys", 12, ["M2"]),
    ("key-value", "design", "types", 12, ["M4"]),
    ("key-value", "design", "idempotency", 18, ["M14"]),
    ("key-value", "design", "security", 18, ["M9", "M10", "M21"]),
    ("key-value", "design", "ttl", 10, ["M8"]),
    ("key-value", "performance", "partition", 34, ["M16"]),
    ("key-value", "performance", "access and secondary index", 22, ["M13", "M11"]),
    ("key-value", "performance", "item size", 14, ["M18"]),
    ("key-value", "performance", "throughput", 14, ["M15"]),
    ("key-value", "performance", "durability", 16, ["M12", "M17", "M22"]),
    ("wide-column", "design", "table per query", 28, ["M19", "M20"]),
    ("wide-column", "design", "partition key", 22, ["M2"]),
    ("wide-column", "design", "types", 12, ["M4"]),
    ("wide-column", "design", "idempotency", 12, ["M14"]),
    ("wide-column", "design", "security", 16, ["M9", "M10", "M21"]),
    ("wide-column", "design", "naming", 10, ["M7"]),
    ("wide-column", "performance", "partition sizing", 30, ["M16"]),
    ("wide-column", "performance", "tombstones", 24, ["M18", "M22"]),
    ("wide-column", "performance", "query patterns", 20, ["M13", "M11"]),
    ("wide-column", "performance", "consistency", 14, ["M17"]),
    ("wide-column", "performance", "connection", 12, ["M15", "M12"]),
    ("vector", "design", "metric and dimension", 24, ["M20", "M4"]),
    ("vector", "design", "model version", 16, ["M19"]),
    ("vector", "design", "keys", 12, ["M2"]),
    ("vector", "design", "types", 12, ["M6"]),
    ("vector", "design", "metadata", 18, ["M1", "M9"]),
    ("vector", "design", "security", 18, ["M10", "M21"]),
    ("vector", "performance", "index", 30, ["M11"]),
    ("vector", "performance", "filtered search", 22, ["M13"]),
    ("vector", "performance", "recall", 18, ["M12"]),
    ("vector", "performance", "scale", 16, ["M16", "M17", "M22"]),
    ("vector", "performance", "connection", 14, ["M15"]),
    ("time-series", "design", "fit", 24, ["M1", "M20"]),
    ("time-series", "design", "timestamp precision", 18, ["M4"]),
    ("time-series", "design", "retention", 18, ["M8"]),
    ("time-series", "design", "tags", 12, ["M2"]),
    ("time-series", "design", "types", 12, ["M6"]),
    ("time-series", "design", "security", 16, ["M9", "M10", "M21"]),
    ("time-series", "performance", "chunks", 26, ["M16"]),
    ("time-series", "performance", "continuous aggregates", 22, ["M17"]),
    ("time-series", "performance", "compression", 16, ["M18", "M22"]),
    ("time-series", "performance", "query patterns", 22, ["M13", "M11"]),
    ("time-series", "performance", "connection", 14, ["M15", "M12"]),
    ("graph", "design", "edges", 28, ["M3", "M19"]),
    ("graph", "design", "nodes", 22, ["M1", "M20"]),
    ("graph", "design", "keys", 12, ["M2"]),
    ("graph", "design", "types", 10, ["M4"]),
    ("graph", "design", "security", 18, ["M9", "M10", "M21"]),
    ("graph", "design", "naming", 10, ["M7"]),
    ("graph", "performance", "lookup index", 26, ["M11"]),
    ("graph", "performance", "traversal", 26, ["M13"]),
    ("graph", "performance", "supernode", 20, ["M16"]),
    ("graph", "performance", "query patterns", 16, ["M12"]),
    ("graph", "performance", "connection", 12, ["M15", "M17", "M22"]),
]


def profile_rows() -> list[tuple[str, str, str, int, list[str]]]:
    return PROFILES


def paradigm_profiles(spark: SparkSession) -> DataFrame:
    """One row per (paradigm, axis, category); a constant frame of under a hundred rows."""
    schema = "paradigm string, axis string, category string, weight int, modules array<string>"
    return constant_frame(spark, profile_rows(), schema)


def profile_modules(spark: SparkSession) -> DataFrame:
    """One row per (paradigm, axis, module), the form findings join against."""
    return paradigm_profiles(spark).select("paradigm", "axis", "category", "weight", F.explode("modules").alias("module"))


def profile_check(profiles: DataFrame) -> DataFrame:
    """Weights sum to 100 per axis and no module sits in two categories of one axis."""
    weights = profiles.groupBy("paradigm", "axis").agg(F.sum("weight").alias("total_weight"), F.count(F.lit(1)).alias("categories"))
    placed = profiles.select("paradigm", "axis", F.explode("modules").alias("module"))
    twice = (
        placed.groupBy("paradigm", "axis", "module")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("paradigm", "axis")
        .agg(F.count_if(F.col("n") > 1).alias("repeated_modules"))
    )
    return weights.join(twice, ["paradigm", "axis"]).withColumn(
        "balanced", (F.col("total_weight") == 100) & (F.col("repeated_modules") == 0)
    )
