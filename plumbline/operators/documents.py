"""The shape of documents at every depth, read off VARIANT values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.profile import bp
from plumbline.session import cut_lineage

KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def _kind(value: str) -> Column:
    """JSON kind of a variant; whatever is none of the named types is a number."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    named = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.when(F.col(value).isNotNull(), F.coalesce(F.try_element_at(named, name), F.lit("number")))


def _step(path: Column, key: Column) -> Column:
    """Path of a member; keys that are no plain name are quoted, places of arrays are all one."""
    quoted = F.concat(F.lit("['"), F.replace(key, F.lit("'"), F.lit("\\'")), F.lit("']"))
    return F.concat(path, F.when(key.isNull(), F.lit("[*]")).when(key.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit("."), key)).otherwise(quoted))


def _members(level: DataFrame) -> DataFrame:
    """A row for each member of each object and array (``path, kind, value``); others keep one row without a
    ``member``, so that the first row of each value (``first``) counts it."""
    sides = level.sparkSession.sql("SELECT r.*, m.* FROM {level} AS r, LATERAL variant_explode_outer(r.value) AS m(pos, member_key, member)", level=level)
    told = sides.select(F.col("path").alias("parent"), F.col("kind").alias("parent_kind"), F.coalesce(F.col("pos") == 0, F.lit(True)).alias("first"), "member_key", "member")
    told = told.withColumn("kind", _kind("member"))
    inner = F.when(F.col("kind").isin("object", "array"), F.col("member"))
    return told.select("parent", "parent_kind", "first", F.when(F.col("kind").isNotNull(), _step(F.col("parent"), F.col("member_key"))).alias("path"), "kind", inner.alias("value"))


def json_path_profile(df: DataFrame, column: str, stable_bp: int = 9500) -> DataFrame:
    """``path, parents, values, share_bp, kinds, mixed, stable`` for every path of a JSON text column, at any depth.

    ``values`` counts what stands at a path and ``parents`` the objects or arrays that could hold it (for the
    root: all rows), so ``share_bp`` is the exact share of objects with a key; it is null for places of
    arrays, which are one path ``[*]``.  ``kinds`` lists the JSON kinds met; ``mixed`` if there are several
    besides null.  Stable paths are column candidates.  Rows that are null or no valid JSON (a key twice in one
    object is not valid) lower the root's share; a column without any valid document has the root alone,
    an empty table nothing.

    The table is read once.  Each level writes its members to the shared folder, values only where they nest
    further, and the next level reads these alone; counts are combined map-side.
    """
    roots = df.select(F.lit("$").alias("path"), F.try_parse_json(column).alias("value")).select("path", _kind("value").alias("kind"), "value")
    stage = cut_lineage(_members(roots), "json-level")
    top = stage.where("first").groupBy(F.lit("").alias("parent"), F.lit("root").alias("parent_kind"), F.col("parent").alias("path"), F.col("parent_kind").alias("kind"))
    counts = [top.agg(F.count(F.lit(1)).alias("n"))]
    while True:
        told = stage.where("kind IS NOT NULL").groupBy("parent", "parent_kind", "path", "kind").agg(F.count(F.lit(1)).alias("n"))
        counts.append(told)
        inner = stage.where("value IS NOT NULL").select("path", "kind", "value")
        if inner.isEmpty():
            break
        stage = cut_lineage(_members(inner), "json-level")
    seen = cut_lineage(reduce(DataFrame.unionByName, counts), "json-paths")
    values = seen.groupBy("parent", "parent_kind", "path").agg(
        F.coalesce(F.sum(F.when(F.col("kind").isNotNull(), F.col("n"))), F.lit(0)).alias("values"),
        F.sum("n").alias("rows"),
        F.array_sort(F.collect_set("kind")).alias("found"),
    )
    holders = seen.where("kind IN ('object', 'array')").groupBy(F.col("path").alias("parent"), F.col("kind").alias("parent_kind")).agg(F.sum("n").alias("held"))
    both = values.join(holders, ["parent", "parent_kind"], "left").withColumn("parents", F.when(F.col("parent_kind") == "root", F.col("rows")).otherwise(F.col("held")))
    share = F.when(F.col("parent_kind") != "array", bp("values", "parents"))
    return both.select(
        "path",
        "parents",
        "values",
        share.alias("share_bp"),
        F.array_join("found", ",").alias("kinds"),
        (F.size(F.array_remove("found", "null")) > 1).alias("mixed"),
        F.coalesce((F.col("parent_kind") == "object") & (share >= stable_bp), F.lit(False)).alias("stable"),
    )
