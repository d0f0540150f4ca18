"""Differences between catalogs, histories and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import is_generic_type, map_type, quote_ident, sql_default

_SIDE = ["type", "not_null", "default_expr", "pk", "is_identity", "ordinal"]


def column_ddl(prefix: str, dialect: str) -> Column:
    """DDL of one column from the struct ``prefix``; identity columns carry no default."""
    c = F.col
    default = F.trim(c(f"{prefix}.default_expr"))
    return F.concat(
        quote_ident(c("column_name"), dialect),
        F.lit(" "),
        map_type(c(f"{prefix}.type"), dialect),
        F.when(c(f"{prefix}.not_null"), " NOT NULL").otherwise(""),
        F.when((default != "") & ~c(f"{prefix}.is_identity"), F.concat(F.lit(" DEFAULT "), sql_default(default))).otherwise(""),
        F.when(c(f"{prefix}.pk"), " PRIMARY KEY").otherwise(""),
    )


def _sides(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both versions of every column side by side, and whether each side has the table at all."""
    key = ["store", "table_name", "column_name"]
    a = before.select(*key, F.struct(*_SIDE).alias("a"))
    b = after.select(*key, F.struct(*_SIDE).alias("b"))
    joined = a.join(b, key, "full_outer")
    tables = joined.groupBy("store", "table_name").agg(
        F.bool_or(F.col("a").isNotNull()).alias("in_a"), F.bool_or(F.col("b").isNotNull()).alias("in_b")
    )
    return joined.join(tables, ["store", "table_name"])


def _change(kind: str, when: Column) -> Column:
    return F.when(when, F.lit(kind))


def _column_changes(sides: DataFrame) -> DataFrame:
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    both = a & b
    retyped = both & (F.col("a.type") != F.col("b.type"))
    same_type = both & (F.col("a.type") == F.col("b.type"))
    kinds = F.array_compact(
        F.array(
            _change("add_column", ~a),
            _change("drop_column", ~b),
            _change("alter_type", retyped),
            _change("set_not_null", same_type & ~F.col("a.not_null") & F.col("b.not_null")),
            _change("set_default", same_type & (F.col("a.default_expr") != F.col("b.default_expr"))),
        )
    )
    return sides.where("in_a AND in_b").withColumn("kind", F.explode(kinds))


def schema_diff(before: DataFrame, after: DataFrame, dialect: str = "postgres") -> DataFrame:
    """One row per change from ``before`` to ``after`` with the SQL up and down.

    Kinds: add_table, drop_table, add_column, drop_column, alter_type, set_not_null, set_default.
    A type change hides the nullability and default changes of that column.
    """
    sides = _sides(before, after)
    t, c = quote_ident(F.col("table_name"), dialect), quote_ident(F.col("column_name"), dialect)
    alter = F.concat(F.lit("ALTER TABLE "), t)
    k = F.col("kind")

    def column_sql(verb: str) -> Column:
        return F.concat(alter, F.lit(f" {verb} COLUMN "), c)

    def set_default(side: str) -> Column:
        value = F.trim(F.col(f"{side}.default_expr"))
        return F.concat(
            column_sql("ALTER"), F.when(value == "", F.lit(" DROP DEFAULT;")).otherwise(F.concat(F.lit(" SET DEFAULT "), sql_default(value), F.lit(";")))
        )

    def set_type(side: str) -> Column:
        return F.concat(column_sql("ALTER"), F.lit(" TYPE "), map_type(F.col(f"{side}.type"), dialect), F.lit(";"))

    def add(side: str) -> Column:
        return F.concat(alter, F.lit(" ADD COLUMN "), column_ddl(side, dialect), F.lit(";"))

    drop = F.concat(column_sql("DROP"), F.lit(";"))
    up = (
        F.when(k == "add_column", add("b"))
        .when(k == "drop_column", F.concat(F.lit("-- DESTRUCTIVE\n"), drop))
        .when(k == "alter_type", set_type("b"))
        .when(k == "set_not_null", F.concat(column_sql("ALTER"), F.lit(" SET NOT NULL;")))
        .otherwise(set_default("b"))
    )
    down = (
        F.when(k == "add_column", drop)
        .when(k == "drop_column", add("a"))
        .when(k == "alter_type", set_type("a"))
        .when(k == "set_not_null", F.concat(column_sql("ALTER"), F.lit(" DROP NOT NULL;")))
        .otherwise(set_default("a"))
    )
    note = (
        F.when((k == "add_column") & F.col("b.not_null") & (F.trim(F.col("b.default_expr")) == ""), "backfill before enforcing NOT NULL")
        .when(k == "alter_type", "check that the type is not narrower")
        .when(k == "set_not_null", "backfill NULLs first")
        .otherwise("")
    )
    columns = _column_changes(sides).select(
        "store",
        "kind",
        F.concat_ws(".", "table_name", "column_name").alias("object"),
        F.coalesce("a.type", F.lit("")).alias("from_type"),
        F.coalesce("b.type", F.lit("")).alias("to_type"),
        (k == "drop_column").alias("destructive"),
        note.alias("note"),
        up.alias("up_sql"),
        down.alias("down_sql"),
    )
    return columns.unionByName(_table_changes(sides, dialect))


def _table_changes(sides: DataFrame, dialect: str) -> DataFrame:
    """Tables on one side only; their columns (a table's worth) are gathered into one CREATE."""
    moved = sides.where("in_a <> in_b").withColumn("side", F.coalesce("b", "a"))
    ddl = moved.withColumn("ddl", column_ddl("side", dialect))
    tables = ddl.groupBy("store", "table_name", "in_a").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("side.ordinal", "ddl"))), lambda x: x["ddl"]), ",\n  "
        ).alias("body")
    )
    t = quote_ident(F.col("table_name"), dialect)
    create = F.concat(F.lit("CREATE TABLE "), t, F.lit(" (\n  "), F.col("body"), F.lit("\n);"))
    drop = F.concat(F.lit("DROP TABLE "), t, F.lit(";"))
    gone = F.col("in_a")
    return tables.select(
        "store",
        F.when(gone, "drop_table").otherwise("add_table").alias("kind"),
        F.col("table_name").alias("object"),
        F.lit("").alias("from_type"),
        F.lit("").alias("to_type"),
        gone.alias("destructive"),
        F.lit("").alias("note"),
        F.when(gone, F.concat(F.lit("-- DESTRUCTIVE\n"), drop)).otherwise(create).alias("up_sql"),
        F.when(gone, F.concat(F.lit("-- structure only\n"), create)).otherwise(drop).alias("down_sql"),
    )


def schema_diff_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    return schema_diff(before, after).select("store", "kind", "object", "from_type", "to_type", "destructive", "note")


def schema_diff_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per store: destructive, needs review, number of notes, and how far the SQL is a translation."""
    changes = schema_diff(before, after).groupBy("store").agg(
        F.count(F.lit(1)).alias("changes"),
        F.bool_or("destructive").alias("destructive"),
        F.count_if(F.col("note") != "").alias("notes"),
    )
    generic = (
        before.select("store", "type").unionByName(after.select("store", "type")).groupBy("store").agg(F.bool_or(is_generic_type(F.col("type"))).alias("g"))
    )
    return changes.join(generic, "store").select(
        "store",
        "changes",
        "destructive",
        "notes",
        (F.col("destructive") | (F.col("notes") > 0)).alias("requires_review"),
        F.when(F.col("g"), "directional").otherwise("established").alias("confidence"),
    )


def _listed(df: DataFrame, kind: str, key: Column) -> DataFrame:
    return df.select("store", F.lit(kind).alias("what"), F.concat(F.col("table_name"), F.lit("("), key, F.lit(")")).alias("object")).distinct()


def key_changes(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Changes that the column diff leaves out: indexes and foreign keys added or dropped, and
    NOT NULL lifted.  ``before`` and ``after`` hold the frames columns, indexes and fks."""

    def keys(frames: dict[str, DataFrame]) -> DataFrame:
        index = F.concat(F.when(F.col("is_unique"), "unique ").otherwise(""), F.array_join("columns", ","))
        fk = F.concat(F.array_join("columns", ","), F.lit(" -> "), F.col("ref_table"), F.lit("."), F.array_join("ref_columns", ","))
        required = frames["columns"].where("not_null")
        return (
            _listed(frames["indexes"], "index", index)
            .unionByName(_listed(frames["fks"], "fk", fk))
            .unionByName(_listed(required, "not_null", F.col("column_name")))
        )

    on = ["store", "what", "object"]
    old, new = keys(before), keys(after)
    live = after["columns"].select("store", F.concat("table_name", F.lit("("), "column_name", F.lit(")")).alias("object"))
    dropped = old.join(new, on, "left_anti")
    lifted = dropped.where("what = 'not_null'").join(live, ["store", "object"], "left_semi")
    gone = dropped.where("what <> 'not_null'").unionByName(lifted)
    made = new.where("what <> 'not_null'").join(old, on, "left_anti")
    return gone.withColumn("kind", F.concat(F.lit("drop_"), "what")).unionByName(made.withColumn("kind", F.concat(F.lit("add_"), "what"))).drop("what")


def schema_drift(artifact: DataFrame, history: DataFrame, key: list[str]) -> DataFrame:
    """Objects of one description that the other lacks, both ways."""
    a, h = artifact.select(*key), history.select(*key)
    return a.exceptAll(h).withColumn("drift", F.lit("artifact_only")).unionByName(h.exceptAll(a).withColumn("drift", F.lit("history_only")))


def catalog_union(catalogs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, catalogs)


def shared_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """Table names two catalogs have in common."""
    return left.select("store", "table_name").intersect(right.select("store", "table_name"))


def data_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows added, removed or changed between two snapshots, with the columns that differ."""
    a = before.select(key, F.struct(*columns).alias("a"))
    b = after.select(key, F.struct(*columns).alias("b"))
    joined = a.join(b, key, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns]))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size("changed") > 0, "changed")
    return (
        joined.withColumn("changed", changed)
        .withColumn("change", change)
        .where("change IS NOT NULL")
        .select(key, "change", F.when(F.col("change") == "changed", F.array_join("changed", ",")).otherwise("").alias("columns"))
    )
