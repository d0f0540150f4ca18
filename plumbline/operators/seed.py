"""Deterministic typed rows for the tables of a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import jvm

# Type families and the shape of their seed values.
INT_TYPE = jvm(r"(?i)\b(serial|bigserial|bigint|integer|int|number|smallint)\b")
DATE_TYPE = "(?i)(timestamp|datetime|date)"
ARRAY_TYPE = r"(?i)\[\d*\]\s*$|^array\b"
NUMERIC_TYPE = "(?i)(numeric|decimal|float|double|real|money)"


def seed_value(i: Column, name: Column, type_name: Column, pk: Column, allowed: Column) -> Column:
    """Value ``i`` (0-based) of a column; a pure function of its arguments."""
    n = (i + 1).cast("string")
    return (
        F.when(type_name.rlike(ARRAY_TYPE), "{}")
        .when(F.size(allowed) > 0, F.try_element_at(allowed, (i % F.greatest(F.size(allowed), F.lit(1)) + 1).cast("int")))
        .when(type_name.rlike("(?i)uuid"), F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(n, 12, "0")))
        .when(pk | type_name.rlike(INT_TYPE), n)
        .when(type_name.rlike("(?i)bool"), F.when(i % 2 == 0, "true").otherwise("false"))
        .when(type_name.rlike(DATE_TYPE), F.concat(F.lit("2026-01-0"), (i % 9 + 1).cast("string"), F.lit("T12:00:00Z")))
        .when(type_name.rlike(NUMERIC_TYPE), F.concat((i + 10).cast("string"), F.lit(".00")))
        .when(F.lower(name).rlike("email"), F.concat(F.lit("user"), n, F.lit("@example.com")))
        .when(type_name.rlike("(?i)json"), F.lit("{}"))
        .otherwise(F.concat(name, F.lit("_"), n))
    )


def seed_rows(columns: DataFrame, fks: DataFrame, n: int) -> DataFrame:
    """``n`` rows per table in long form (store, table_name, row_no, column_name, value).

    Identity and defaulted columns are left to the database.  A foreign key takes the value the
    parent's key column has in the same row.  ``columns`` may carry ``allowed ARRAY<STRING>``.
    """
    if "allowed" not in columns.columns:
        columns = columns.withColumn("allowed", F.array().cast("array<string>"))
    writable = columns.where((F.col("is_identity") == F.lit(False)) & (F.trim(F.coalesce("default_expr", F.lit(""))) == ""))
    links = (
        fks.select("store", "table_name", "ref_table", F.explode(F.arrays_zip("columns", "ref_columns")).alias("z"))
        .select("store", "table_name", F.col("z.columns").alias("column_name"), "ref_table", F.col("z.ref_columns").alias("ref_column"))
        .groupBy("store", "table_name", "column_name")
        .agg(F.min_by(F.struct("ref_table", "ref_column"), F.struct("ref_table", "ref_column")).alias("ref"))
    )
    parents = columns.select(
        "store", F.struct(F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column")).alias("ref"), F.col("type").alias("parent_type")
    )
    typed = writable.join(links, ["store", "table_name", "column_name"], "left").join(parents, ["store", "ref"], "left")
    rows = typed.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    own = seed_value(F.col("i"), F.col("column_name"), F.col("type"), F.col("pk"), F.col("allowed"))
    none = F.array().cast("array<string>")
    ref = seed_value(F.col("i"), F.col("column_name"), F.coalesce("parent_type", F.lit("bigint")), F.lit(True), none)
    value = F.when(F.col("ref").isNotNull(), ref).otherwise(own)
    return rows.select("store", "table_name", F.col("i").alias("row_no"), "column_name", value.alias("value"))
