"""Catalog frames from DataFrame schemas, JSON schema snapshots and DDL corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import lexer
from plumbline.functions.once import compute_once
from plumbline.functions.text import jvm
from plumbline.session import constant_frame

COLUMN_SCHEMA = (
    "store string, table_name string, column_name string, ordinal int, type string, not_null boolean, pk boolean, "
    "is_unique boolean, default_expr string, is_identity boolean, has_check boolean"
)

# Spark type -> catalog type name.
TYPE_NAMES = {
    "string": "text",
    "bigint": "bigint",
    "int": "int",
    "double": "double precision",
    "float": "real",
    "boolean": "boolean",
    "date": "date",
    "timestamp": "timestamptz",
    "timestamp_ntz": "timestamp",
}


def catalog_from_frames(
    spark: SparkSession, frames: dict[str, DataFrame], primary_keys: dict[str, list[str]], store: str = "warehouse"
) -> DataFrame:
    """Column rows from DataFrame schemas; touches no data."""
    rows = []
    for table, df in frames.items():
        keys = primary_keys.get(table, [])
        for n, field in enumerate(df.schema.fields):
            name = field.dataType.simpleString()
            rows.append(
                (store, table, field.name, n, TYPE_NAMES.get(name, name), not field.nullable or field.name in keys, field.name in keys, False, "", False, False)
            )
    return constant_frame(spark, rows, COLUMN_SCHEMA)


def nested_fields(schema: T.StructType, table: str) -> list[tuple[str, str, int, bool]]:
    """(table, path, depth, is array of structs) of every nested field of a schema."""
    out = []

    def walk(t: T.DataType, path: str, depth: int) -> None:
        if isinstance(t, T.ArrayType):
            out.append((table, path, depth, isinstance(t.elementType, T.StructType)))
            walk(t.elementType, path, depth)
        elif isinstance(t, T.StructType):
            for f in t.fields:
                child = f"{path}.{f.name}" if path else f.name
                if isinstance(f.dataType, T.StructType):
                    out.append((table, child, depth + 1, False))
                walk(f.dataType, child, depth + 1)

    walk(schema, "", 0)
    return out


def table_statistics(frames: dict[str, DataFrame]) -> DataFrame:
    """Measured rows per table and filled values per column, one scan per table."""
    out = None
    for table, df in frames.items():
        cols = df.columns
        counted = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(cols)])
        arms = ", ".join(f"'{table}', '{c}', rows, c{i}" for i, c in enumerate(cols))
        long = counted.selectExpr(f"stack({len(cols)}, {arms}) AS (table_name, column_name, rows, filled)")
        out = long if out is None else out.unionByName(long)
    return out


# --- JSON snapshots -----------------------------------------------------------------------------

_SNAPSHOT = (
    "store string, dialect string, tables map<string, struct<name:string,"
    "columns:map<string,struct<name:string,type:string,notNull:boolean,primaryKey:boolean,default:string,identity:boolean>>,"
    "indexes:map<string,struct<name:string,columns:array<string>,isUnique:boolean>>,"
    "foreignKeys:map<string,struct<columnsFrom:array<string>,tableTo:string,columnsTo:array<string>>>,"
    "compositePrimaryKeys:map<string,struct<columns:array<string>>>,"
    "uniqueConstraints:map<string,struct<columns:array<string>>>>>"
)


def parse_snapshots(documents: DataFrame, text: str = "value") -> DataFrame:
    """(store, dialect, t): one row per table of every snapshot document."""
    doc = documents.select(F.from_json(F.col(text), _SNAPSHOT).alias("d"))
    return doc.select("d.store", "d.dialect", F.explode("d.tables").alias("key", "t")).drop("key")


def snapshot_columns(tables: DataFrame) -> DataFrame:
    """Columns of parsed snapshots, keys included whether per column or composite."""
    composite = F.coalesce(F.flatten(F.transform(F.map_values("t.compositePrimaryKeys"), lambda c: c["columns"])), F.array().cast("array<string>"))
    unique = F.transform(
        F.filter(F.map_values("t.uniqueConstraints"), lambda u: F.size(u["columns"]) == 1), lambda u: F.element_at(u["columns"], 1)
    )
    rows = tables.select(
        "store",
        F.col("t.name").alias("table_name"),
        composite.alias("composite"),
        F.coalesce(unique, F.array().cast("array<string>")).alias("uniques"),
        F.explode("t.columns").alias("key", "c"),
    )
    kind = F.lower("c.type")
    return rows.select(
        "store",
        "table_name",
        F.col("c.name").alias("column_name"),
        kind.alias("type"),
        F.coalesce("c.notNull", F.lit(False)).alias("not_null"),
        (F.coalesce("c.primaryKey", F.lit(False)) | F.array_contains("composite", F.col("c.name"))).alias("pk"),
        F.array_contains("uniques", F.col("c.name")).alias("is_unique"),
        F.coalesce("c.default", F.lit("")).alias("default_expr"),
        (kind.contains("serial") | F.coalesce("c.identity", F.lit(False))).alias("is_identity"),
    )


def snapshot_indexes(tables: DataFrame) -> DataFrame:
    return tables.select("store", F.col("t.name").alias("table_name"), F.explode("t.indexes").alias("k", "i")).select(
        "store", "table_name", F.col("i.name").alias("index_name"), F.col("i.columns").alias("columns"), F.coalesce("i.isUnique", F.lit(False)).alias("is_unique")
    )


def snapshot_fks(tables: DataFrame) -> DataFrame:
    return tables.select("store", F.col("t.name").alias("table_name"), F.explode("t.foreignKeys").alias("k", "f")).select(
        "store", "table_name", F.col("f.columnsFrom").alias("columns"), F.col("f.tableTo").alias("ref_table"), F.col("f.columnsTo").alias("ref_columns")
    )


def catalog_from_snapshot_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Catalog frames from a folder of JSON snapshots, one document per file."""
    tables = parse_snapshots(spark.read.text(path, wholetext=True))
    return {"columns": snapshot_columns(tables), "indexes": snapshot_indexes(tables), "fks": snapshot_fks(tables)}


# --- DDL corpora --------------------------------------------------------------------------------

_NAME = r'(?:"(?:[^"]|"")+"|`[^`]+`|\[[^\]]+\]|[\w$]+)'
_PATH = rf"((?:{_NAME}\.)*{_NAME})"

# The statements and clauses read from DDL text.  Clauses are matched with a hole for each
# string literal (``lexer.hollow``), so words in a literal are no keywords.
CREATE_TABLE = rf"(?i)^CREATE\s+(?:(?:GLOBAL|LOCAL)\s+)?(?:TEMP(?:ORARY)?\s+|UNLOGGED\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{_PATH}\s*\(([\s\S]*)$"
ALTER_TABLE = rf"(?i)^ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?{_PATH}\s+(ADD\b[\s\S]*)$"
CREATE_INDEX = rf"(?i)^CREATE\s+(UNIQUE\s+)?INDEX\s+(?:CONCURRENTLY\s+)?(?:IF\s+NOT\s+EXISTS\s+)?(?:{_PATH}\s+)?ON\s+(?:ONLY\s+)?{_PATH}\s*(?:USING\s+\w+\s*)?\(([\s\S]*)$"
_BRACKETS = r"\((?:[^()]|\((?:[^()]|\([^()]*+\))*+\))*+\)"
COLUMN_HEAD = (
    rf"(?i)^({_NAME})\s+([A-Za-z0-9_]+(?:\s+varying)?(?:\s*\([^)]*\))?(?:\s+with(?:out)?\s+time\s+zone)?(?:\s+precision)?(?:\s+unsigned)?(?:\s*\[\])*)"
)
_AFTER_DEFAULT = r"NOT\s+NULL|NULL|UNIQUE|PRIMARY|REFERENCES|CHECK|CONSTRAINT|GENERATED|COLLATE|COMMENT|ON\s+UPDATE|AUTO_INCREMENT"
COLUMN_DEFAULT = rf"(?i)\bDEFAULT\s+((?:[^\s(]|{_BRACKETS}|\s+(?!(?:{_AFTER_DEFAULT})\b|$))+)"
IDENTITY = r"(?i)\b(GENERATED\s+(?:ALWAYS|BY\s+DEFAULT)\s+AS\s+IDENTITY|AUTO_INCREMENT|(?:big|small)?serial)\b"
ALLOWED = r"(?i)\bCHECK\s*\([^)]*?\bIN\s*\(([^)]+)\)"
REFERENCES = rf"(?i)REFERENCES\s+{_PATH}\s*(?:\(([^)]+)\))?"
_CONSTRAINT = rf"(?i)^(?:CONSTRAINT\s+{_NAME}\s+)?"
TABLE_PK = _CONSTRAINT + r"PRIMARY\s+KEY\s*(?:USING\s+\w+\s*)?\(([^)]+)\)"
TABLE_UNIQUE = _CONSTRAINT + rf"UNIQUE\s*(?:KEY\s*|INDEX\s*)?({_NAME})?\s*\(([^)]+)\)"
TABLE_KEY = rf"(?i)^(?:FULLTEXT\s+|SPATIAL\s+)?(?:KEY|INDEX)\s+({_NAME})?\s*(?:USING\s+\w+\s*)?\(([\s\S]+)\)"
TABLE_FK = _CONSTRAINT + rf"FOREIGN\s+KEY\s*(?:{_NAME}\s*)?\(([^)]+)\)\s*REFERENCES\s+{_PATH}\s*(?:\(([^)]+)\))?"
TABLE_CONSTRAINT = (
    r"(?i)^(?:CONSTRAINT\s|PRIMARY\s+KEY\b|UNIQUE\s*(?:KEY|INDEX)?[^(]*\(|FOREIGN\s+KEY\b|CHECK\s*\(|EXCLUDE\s|LIKE\s|PERIOD\s+FOR\s"
    r"|(?:FULLTEXT\s+|SPATIAL\s+)?(?:KEY|INDEX)\s+[^(]*\()"
)


def _bare(name: Column) -> Column:
    """An identifier without its quotes."""
    return F.regexp_replace(F.regexp_replace(name, r'^["`\[]|["`\]]$', ""), '""', '"')


def _names(column: Column) -> Column:
    """Clauses that name columns, in order: identifiers without quotes, lengths and directions; expressions as they are."""
    named = rf"(?i)^({_NAME})(?:\s*\(\d+\))?(?:\s+(?:ASC|DESC|NULLS|FIRST|LAST|COLLATE|\w+_ops)\b[\s\S]*)?$"
    return F.transform(lexer.clauses(column), lambda c: F.when(c.rlike(jvm(named)), _bare(F.regexp_extract(c, jvm(named), 1))).otherwise(c))


def _local(name: Column) -> Column:
    """A table's name without its schema, which may stand within the quotes too."""
    return F.regexp_replace(_bare(F.regexp_extract(name, rf"({_NAME})$", 1)), r"^.*\.", "")


def ddl_statements(corpus: DataFrame, store: str, text: str) -> DataFrame:
    """(store, statement): every statement of the corpus, without comments."""
    return corpus.select(F.col(store).alias("store"), F.explode(lexer.statements(F.col(text))).alias("statement"))


def ddl_parts(corpus: DataFrame, store: str, text: str) -> DataFrame:
    """(store, table_name, pos, part, hollow, literals): the clauses of every CREATE TABLE, and the constraints that
    ALTER TABLE adds, without place.  What follows the bracket that closes a table, as storage options, is none of its clauses."""
    found = ddl_statements(corpus, store, text)
    s = F.col("statement")

    def held(pattern: str) -> DataFrame:
        """Statements of a kind with their table and clauses, each worked out once."""
        named = _local(F.regexp_extract(s, pattern, 1))
        return compute_once(found.where(s.rlike(pattern)), table_name=named, parts=lexer.clauses(F.regexp_extract(s, pattern, 2))).drop("statement")

    made = held(CREATE_TABLE).select("store", "table_name", F.posexplode("parts").alias("pos", "part"))
    added = held(jvm(ALTER_TABLE)).select("store", "table_name", F.lit(None).cast("int").alias("pos"), F.explode("parts").alias("part"))
    added = added.withColumn("part", F.regexp_replace("part", r"(?i)^ADD\s+", ""))
    every = made.unionByName(added.where(F.col("part").rlike(jvm(TABLE_CONSTRAINT))))
    return compute_once(every, hollow=lexer.hollow(F.col("part")), literals=lexer.literals(F.col("part")))


def _filled(pattern: str) -> Column:
    """The first group of a pattern in a clause, with its literals."""
    whole = r"^([\s\S]*?)" + pattern
    return lexer.filled(F.regexp_extract("hollow", whole, 2), F.regexp_extract("hollow", whole, 1), F.col("literals"))


def _value(item: Column) -> Column:
    """An item of a list of values: a literal without its quotes."""
    return F.when(item.startswith("'"), F.replace(F.regexp_replace(item, "^'|'$", ""), F.lit("''"), F.lit("'"))).otherwise(item)


def ddl_columns(parts: DataFrame) -> DataFrame:
    """Column rows of a parsed corpus; a table-level PRIMARY KEY marks its columns."""
    p = F.col("hollow")
    table_pk = (
        parts.where(p.rlike(TABLE_PK))
        .select("store", "table_name", F.explode(_names(F.regexp_extract(p, TABLE_PK, 1))).alias("column_name"))
        .distinct()
        .withColumn("in_pk", F.lit(True))
    )
    cols = parts.where(F.col("pos").isNotNull() & ~p.rlike(jvm(TABLE_CONSTRAINT)) & p.rlike(COLUMN_HEAD)).select(
        "store",
        "table_name",
        _bare(F.regexp_extract(p, COLUMN_HEAD, 1)).alias("column_name"),
        F.col("pos").cast("int").alias("ordinal"),
        F.lower(F.trim(lexer.filled(F.regexp_extract(p, COLUMN_HEAD, 2), F.lit(""), F.col("literals")))).alias("type"),
        p.rlike(jvm(r"(?i)\bNOT\s+NULL\b")).alias("not_null"),
        p.rlike(jvm(r"(?i)\bPRIMARY\s+KEY\b")).alias("own_pk"),
        p.rlike(jvm(r"(?i)\bUNIQUE\b")).alias("is_unique"),
        F.trim(_filled(jvm(COLUMN_DEFAULT))).alias("default_expr"),
        p.rlike(jvm(IDENTITY)).alias("is_identity"),
        p.rlike(jvm(r"(?i)\bCHECK\b")).alias("has_check"),
        F.when(p.rlike(jvm(ALLOWED)), F.transform(lexer.clauses(_filled(jvm(ALLOWED))), _value)).alias("allowed"),
    )
    return (
        cols.join(table_pk, ["store", "table_name", "column_name"], "left")
        .withColumn("pk", F.col("own_pk") | F.coalesce("in_pk", F.lit(False)))
        .drop("own_pk", "in_pk")
    )


def ddl_fks(parts: DataFrame) -> DataFrame:
    """Foreign keys declared on columns and on tables; the target column is ``id`` where none is named."""
    p = F.col("hollow")

    def target(pattern: str, n: int) -> Column:
        named = F.regexp_extract(p, pattern, n)
        return F.when(named == "", F.array(F.lit("id"))).otherwise(_names(named))

    table_level = parts.where(p.rlike(TABLE_FK)).select(
        "store",
        "table_name",
        _names(F.regexp_extract(p, TABLE_FK, 1)).alias("columns"),
        _local(F.regexp_extract(p, TABLE_FK, 2)).alias("ref_table"),
        target(TABLE_FK, 3).alias("ref_columns"),
    )
    inline = parts.where(~p.rlike(jvm(TABLE_CONSTRAINT)) & p.rlike(REFERENCES)).select(
        "store",
        "table_name",
        F.array(_bare(F.regexp_extract(p, COLUMN_HEAD, 1))).alias("columns"),
        _local(F.regexp_extract(p, REFERENCES, 1)).alias("ref_table"),
        target(REFERENCES, 2).alias("ref_columns"),
    )
    return table_level.unionByName(inline)


def ddl_indexes(corpus: DataFrame, store: str, text: str, parts: DataFrame) -> DataFrame:
    """UNIQUE constraints and keys declared on tables, and CREATE INDEX statements."""
    p, s = F.col("hollow"), F.col("statement")

    def declared(pattern: str, unique: bool) -> DataFrame:
        named = F.coalesce(_bare(F.regexp_extract(p, pattern, 1)), F.lit(""))
        return parts.where(p.rlike(pattern)).select(
            "store", "table_name", named.alias("index_name"), _names(F.regexp_extract(p, pattern, 2)).alias("columns"), F.lit(unique).alias("is_unique")
        )

    made = ddl_statements(corpus, store, text).where(s.rlike(CREATE_INDEX)).select(
        "store",
        _local(F.regexp_extract(s, CREATE_INDEX, 3)).alias("table_name"),
        _local(F.regexp_extract(s, CREATE_INDEX, 2)).alias("index_name"),
        _names(F.regexp_extract(s, CREATE_INDEX, 4)).alias("columns"),
        (F.regexp_extract(s, CREATE_INDEX, 1) != "").alias("is_unique"),
    )
    return declared(TABLE_UNIQUE, True).unionByName(declared(TABLE_KEY, False)).unionByName(made)


def catalog_from_ddl_corpus(corpus: DataFrame, store: str = "store", text: str = "value") -> dict[str, DataFrame]:
    """Catalog frames from DDL text, one or more statements to a row.

    Comments, string literals, quoted names and dollar-quoted bodies are lexed, so what stands in them neither
    ends a statement nor counts as a keyword; a table ends with the bracket that closes it.
    """
    parts = ddl_parts(corpus, store, text)
    return {"columns": ddl_columns(parts), "fks": ddl_fks(parts), "indexes": ddl_indexes(corpus, store, text, parts)}
