"""Operators over corpora of SQL: statement logs, migration files, commands, source lines.

Classifiers are tables of patterns compiled into one ``when`` chain, so the first match wins
and later patterns are not tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import lexer
from plumbline.functions.grading import lookup
from plumbline.functions.once import compute_once
from plumbline.functions.text import jvm, mentions_any, redact_secrets
from plumbline.operators.ordered import time_bucket

# --- splitting --------------------------------------------------------------------------------

def split_statements(files: DataFrame, path: str, body: str) -> DataFrame:
    """Top-level statements of each file in order, comments dropped, quotes and dollar-quoted bodies respected."""
    return files.select(path, F.posexplode(lexer.statements(F.col(body))).alias("pos", "statement"))


def fold(statement: Column) -> Column:
    return F.trim(F.regexp_replace(statement, r"\s+", " "))


def shorten(text: Column, limit: int = 240) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


# --- migration classes ------------------------------------------------------------------------

# Operation classes in the order they are tried, as (class, words one of
# which must occur, patterns one of which must match).
OPERATION_PATTERNS = [
    ("drop_table", "drop", [r"^DROP\s+TABLE\b", r"\bDROP\s+COLUMN\b[\s\S]*DROP\s+TABLE", r"DROP\s+TABLE[\s\S]*\bDROP\s+COLUMN\b"]),
    ("drop_column", "drop", [r"\bDROP\s+COLUMN\b"]),
    ("drop_object", "drop", [r"^DROP\s+(INDEX|VIEW|SEQUENCE|TYPE|SCHEMA|DATABASE)\b"]),
    ("add_column", "add", [r"\bADD\s+COLUMN\b"]),
    ("alter_type", "alter", [r"\bALTER\s+COLUMN\b[\s\S]*\b(TYPE|SET\s+DATA\s+TYPE)\b"]),
    ("create_index_concurrently", "concurrently", [r"\bCREATE\s+(UNIQUE\s+)?INDEX\b[\s\S]*\bCONCURRENTLY\b"]),
    ("add_unique", "unique", [r"\bADD\s+(CONSTRAINT\s+\S+\s+)?UNIQUE\b", r"\bCREATE\s+UNIQUE\s+INDEX\b"]),
    (
        "add_fk",
        "foreign references",
        [
            r"\bADD\s+(CONSTRAINT\s+\S+\s+)?FOREIGN\s+KEY\b",
            r"\bREFERENCES\b[\s\S]*\bADD\b",
            r"\bADD\b[\s\S]*\bREFERENCES\b",
        ],
    ),
    ("set_not_null", "null", [r"\bSET\s+NOT\s+NULL\b"]),
    ("create_index", "index", [r"^CREATE\s+INDEX\b"]),
    ("update", "update", [r"^UPDATE\b"]),
    ("delete", "delete", [r"^DELETE\s+FROM\b"]),
    ("enum_remove_value", "drop", [r"\bALTER\s+TYPE\b[\s\S]*\bDROP\b", r"\bDROP\b[\s\S]*\bALTER\s+TYPE\b"]),
    ("enum_add_value", "value", [r"\bALTER\s+TYPE\b[\s\S]*\bADD\s+VALUE\b"]),
    ("create_table", "create", [r"^CREATE\s+TABLE\b"]),
    ("rename", "rename", [r"^ALTER\s+TABLE\b[\s\S]*\bRENAME\b"]),
    ("truncate", "truncate", [r"^TRUNCATE\b"]),
]

# Lock taken by each class when nothing in the statement changes it.
LOCKS = {
    "drop_table": "ACCESS EXCLUSIVE",
    "drop_column": "ACCESS EXCLUSIVE",
    "drop_object": "none",
    "add_column": "ACCESS EXCLUSIVE (brief, metadata-only)",
    "alter_type": "ACCESS EXCLUSIVE",
    "create_index_concurrently": "SHARE UPDATE EXCLUSIVE (non-blocking)",
    "add_unique": "ACCESS EXCLUSIVE",
    "add_fk": "SHARE ROW EXCLUSIVE",
    "set_not_null": "ACCESS EXCLUSIVE",
    "create_index": "SHARE (blocks writes)",
    "update": "none",
    "delete": "none",
    "enum_remove_value": "ACCESS EXCLUSIVE",
    "enum_add_value": "none",
    "create_table": "none",
    "rename": "ACCESS EXCLUSIVE (brief)",
    "truncate": "ACCESS EXCLUSIVE",
}
IRREVERSIBLE = ["drop_table", "drop_column", "drop_object", "update", "delete", "enum_remove_value", "enum_add_value", "truncate"]
DESTRUCTIVE = ["drop_table", "drop_column", "drop_object", "enum_remove_value", "truncate"]

NOTES = {
    "drop_table": "Loses data and cannot be undone by a down migration; deprecate, stop writing, then drop.",
    "drop_column": "Loses data and cannot be undone by a down migration; deprecate, stop writing, then drop.",
    "alter_type": "Rewrites the table while blocking it; check that the new type is not narrower.",
    "create_index_concurrently": "Does not block writes; cannot run inside a transaction.",
    "add_unique": "Fails when duplicates exist; check duplicate_keys first.",
    "add_fk": "Checks existing rows under a lock; add as NOT VALID, validate afterwards.",
    "set_not_null": "Scans the whole table; check null_profile first.",
    "create_index": "Blocks writes while it builds; build concurrently.",
    "update": "Bulk change; irreversible without a backup, run it in batches.",
    "delete": "Bulk change; irreversible without a backup, run it in batches.",
    "enum_remove_value": "Enum values cannot be removed without recreating the type.",
    "enum_add_value": "Cannot be removed later; a lookup table evolves better.",
    "rename": "Breaks code that uses the old name.",
    "truncate": "Empties the table; irreversible without a backup.",
}


def _has(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + jvm(pattern))


def _mentions(folded: Column, words: str) -> Column:
    return mentions_any(folded, words.split(" "))


def _any(text: Column, patterns: list[str]) -> Column:
    return text.rlike("(?i)(?:" + "|".join(jvm(p) for p in patterns) + ")")


def _pick(key: Column, values: dict[str, str], default: str) -> Column:
    return F.coalesce(lookup(values, key), F.lit(default))


def classify_migration(statements: DataFrame, column: str = "statement", known_gaps: bool = False) -> DataFrame:
    """Adds ``op, reversible, lock_level, rewrite, destructive, note`` and ``excerpt`` to each statement.

    Everything is decided on the whole statement, which stays whole in ``column`` (white space
    folded).  ``excerpt`` is for display: credentials are redacted before it is cut.
    ``known_gaps`` leaves TRUNCATE unclassified, as tools that look only at DDL do.
    """
    u, folded = F.col("__u"), F.col("__folded")
    op = F.when(F.lit(False), "")
    for name, words, alternatives in OPERATION_PATTERNS:
        if not (known_gaps and name == "truncate"):
            op = op.when(_mentions(folded, words) & _any(u, alternatives), name)
    k = F.col("__class")
    not_null, default = _has(u, r"\bNOT\s+NULL\b"), _has(u, r"\bDEFAULT\b")
    constant = _has(u, r"DEFAULT\s+(NULL|TRUE|FALSE|'[^']*'|-?\d+(\.\d+)?|CURRENT_DATE)\b")
    volatile = default & ~constant & _has(u, r"DEFAULT\s+\w+\s*\(")
    rewrites = ((k == "add_column") & ((not_null & default) | volatile)) | (k == "alter_type")
    unscoped = k.isin("update", "delete") & ~_has(u, r"\bWHERE\b")
    narrowing = (k == "alter_type") & _any(u, [r"\b(VARCHAR|CHAR)\s*\(\s*\d+\s*\)", r"\b(SMALLINT|INT(EGER)?)\b"])
    blocking_drop = (k == "drop_object") & _has(u, r"DROP\s+INDEX") & ~_has(u, "CONCURRENTLY")
    lock = (
        F.when((k == "add_column") & rewrites, "ACCESS EXCLUSIVE")
        .when(blocking_drop, "ACCESS EXCLUSIVE")
        .when((k == "add_unique") & _has(u, "CONCURRENTLY"), "SHARE UPDATE EXCLUSIVE")
        .when((k == "create_index") & _has(u, "CONCURRENTLY"), "SHARE UPDATE EXCLUSIVE")
        .otherwise(_pick(k, LOCKS, "none"))
    )
    note = (
        F.when(unscoped, "No WHERE: touches every row, irreversible.")
        .when((k == "add_column") & rewrites, "May rewrite the table under an exclusive lock.")
        .when(blocking_drop, "Blocks the table; drop the index concurrently.")
        .otherwise(_pick(k, NOTES, ""))
    )
    staged = compute_once(compute_once(statements, __u=fold(F.col(column))), __folded=F.lower(u))
    classed = compute_once(staged, __class=F.coalesce(op, F.lit("other")))
    out = compute_once(
        classed,
        op=F.when(k == "create_index_concurrently", "create_index").otherwise(k),
        reversible=~(k.isin(IRREVERSIBLE) | narrowing),
        lock_level=lock,
        rewrite=rewrites,
        destructive=k.isin(DESTRUCTIVE) | unscoped,
        note=note,
        excerpt=shorten(redact_secrets(u)),
    )
    return out.withColumn(column, u).drop("__u", "__folded", "__class")


# Migration finding rules, as rule -> (status, severity, confidence, fixable).
MIGRATION_RULES = {
    "destructive_irreversible": ("fail", "5", "established", "proposed"),
    "enum_value_removed": ("warn", "3", "established", "proposed"),
    "notnull_no_default": ("fail", "4", "established", "proposed"),
    "lock_blocking": ("warn", "4", "directional", "auto"),
    "enum_value_added": ("warn", "3", "established", "advisory"),
}
BLOCKING_LOCKS = ["ACCESS EXCLUSIVE", "SHARE (blocks writes)", "SHARE ROW EXCLUSIVE"]


def migration_findings(classified: DataFrame, key: str, column: str = "statement") -> DataFrame:
    """Migration-safety findings of classified statements: only those with something to report."""
    u = F.col(column)
    bare_not_null = (F.col("op") == "add_column") & _has(u, r"\bNOT\s+NULL\b") & ~_has(u, r"\bDEFAULT\b")
    rule = (
        F.when(F.col("op") == "enum_remove_value", "enum_value_removed")
        .when(F.col("destructive") & ~F.col("reversible"), "destructive_irreversible")
        .when(bare_not_null, "notnull_no_default")
        .when(F.col("lock_level").isin(BLOCKING_LOCKS), "lock_blocking")
        .when(F.col("op") == "enum_add_value", "enum_value_added")
    )
    found = compute_once(classified, rule=rule).where(F.col("rule").isNotNull())

    def part(position: int) -> Column:
        return _pick(F.col("rule"), {r: v[position] for r, v in MIGRATION_RULES.items()}, "")

    return found.select(
        F.concat(F.lit("M22."), F.col(key).cast("string"), F.lit("."), F.col("rule")).alias("id"),
        F.lit("M22").alias("module"),
        part(0).alias("status"),
        part(1).cast("int").alias("severity"),
        F.lit("performance").alias("axis"),
        part(2).alias("confidence"),
        F.lit("high").alias("magnitude"),
        part(3).alias("fixable"),
        F.col("excerpt").alias("observed"),
    )


_NAME_PART = r'(?:"(?:[^"]|"")+"|`[^`]+`|\[[^\]]+\]|[\w$]+)'
_NAME = rf"(?:{_NAME_PART}\.)*{_NAME_PART}"
_TARGET = (
    r"(?i)^(?:ALTER\s+TABLE|DROP\s+TABLE|TRUNCATE(?:\s+TABLE)?|UPDATE|DELETE\s+FROM"
    r"|CREATE\s+(?:(?:GLOBAL|LOCAL)\s+)?(?:TEMP(?:ORARY)?\s+|UNLOGGED\s+|FOREIGN\s+)?TABLE"
    rf"|CREATE\s+(?:UNIQUE\s+)?INDEX\s+(?:CONCURRENTLY\s+)?(?:(?:IF\s+NOT\s+EXISTS\s+)?{_NAME}\s+)?ON|DROP\s+INDEX\s+{_NAME}\s+ON)"
    rf"\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?(?:ONLY\s+)?({_NAME})"
)
_LISTED = rf"(?i)^(?:DROP\s+TABLE|TRUNCATE(?:\s+TABLE)?)\s+(?:IF\s+EXISTS\s+)?((?:ONLY\s+)?{_NAME}(?:\s*,\s*(?:ONLY\s+)?{_NAME})*+)"


def _bare(name: Column) -> Column:
    """Last part of a name, lower-cased and without quotes."""
    last = F.regexp_extract(name, "(" + _NAME_PART + ")$", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(last, r"^[\"`\[]|[\"`\]]$", ""), '""', '"'))


def target_table(statement: Column) -> Column:
    """Table a statement changes, the first of several: the last part of its name, lower-cased and without
    quotes; empty when none is named."""
    return _bare(F.regexp_extract(statement, _TARGET, 1))


def target_tables(statement: Column) -> Column:
    """All tables a statement changes: those that ``DROP TABLE`` or ``TRUNCATE`` lists, else its target; one empty
    name when none is named."""
    listed = F.regexp_extract(statement, _LISTED, 1)
    names = F.transform(lexer.clauses(listed), lambda n: _bare(F.regexp_replace(n, r"(?i)^ONLY\s+", "")))
    return F.when(listed != "", F.array_distinct(names)).otherwise(F.array(target_table(statement)))


def migration_risk_by_size(classified: DataFrame, sizes: DataFrame, big_rows: int, column: str = "statement") -> DataFrame:
    """Blocking statements against the measured size of each table they change; unknown size is needs_api."""
    blocking = F.col("rewrite") | F.col("lock_level").isin(BLOCKING_LOCKS)
    risky = classified.where(blocking).withColumn("table_name", F.explode(target_tables(F.col(column))))
    known = sizes.select("table_name", "rows")
    joined = risky.join(known, "table_name", "left")
    return joined.withColumn(
        "status", F.when(F.col("rows").isNull(), "needs_api").when(F.col("rows") >= big_rows, "fail").otherwise("warn")
    ).withColumn("severity", F.when(F.col("status") == "fail", 4).otherwise(3))


def missing_down(files: DataFrame, path: str, body: str) -> DataFrame:
    """Migration files without a rollback section."""
    has_down = F.col(body).rlike(r"(?im)^\s*(--|#|/\*)?\s*(@?down|rollback)(?![A-Za-z0-9_])")
    return files.where(~has_down).select(path)


# --- guards -----------------------------------------------------------------------------------

# Blocked commands, first match wins, as (label, words one of which must occur, pattern).
GUARD_RULES = [
    ("drop object", "drop", r"\bDROP\s+(TABLE|DATABASE|SCHEMA|INDEX|COLUMN|VIEW|MATERIALIZED\s+VIEW|SEQUENCE|TYPE|TRIGGER|FUNCTION|ROLE|USER|OWNED)\b"),
    ("truncate", "truncate", r"\bTRUNCATE\b"),
    ("alter drop", "drop", r"\bALTER\s+\w+[\s\S]*?\bDROP\b"),
    ("alter system", "system", r"\bALTER\s+SYSTEM\b"),
    ("copy program", "program", r"\bCOPY\b[\s\S]*?\bPROGRAM\b"),
    ("server file access", "pg_ lo_", r"\b(pg_read_file|pg_read_binary_file|pg_ls_dir|pg_stat_file|lo_export|lo_import|lo_get|lo_put)\s*\("),
    ("create extension", "extension", r"\bCREATE\s+EXTENSION\b"),
    ("into outfile", "outfile dumpfile", r"\bINTO\s+(OUTFILE|DUMPFILE)\b"),
    ("load file", "load", r"\bLOAD_FILE\s*\(|\bLOAD\s+DATA\b[\s\S]*?\bINFILE\b"),
    ("psql meta command", "\\", r"(^|\s)\\(i|ir|include|include_relative|o|out|copy)\b"),
    ("role escalation", "superuser bypassrls replication createrole createdb", r"\b(CREATE|ALTER)\s+(ROLE|USER|GROUP)\b[\s\S]*?\b(SUPERUSER|BYPASSRLS|REPLICATION|CREATEROLE|CREATEDB)\b"),
    ("grant or revoke", "grant revoke", r"\b(GRANT|REVOKE)\b"),
    ("role password", "password", r"\b(CREATE|ALTER)\s+(ROLE|USER)\b[\s\S]*?\bPASSWORD\b"),
    ("backend termination", "_backend", r"\bpg_(terminate|cancel)_backend\s*\("),
    ("drop keyspace", "keyspace", r"\bDROP\s+KEYSPACE\b"),
    ("dropDatabase()", "dropdatabase", r"\bdropDatabase\s*\("),
    ("collection drop()", "drop", r"\.\s*drop\s*\(\s*\)"),
    ("deleteMany without filter", "deletemany", r"\bdeleteMany\s*\(\s*\{\s*\}\s*\)"),
    ("updateMany without filter", "updatemany", r"\bupdateMany\s*\(\s*\{\s*\}"),
    ("remove without filter", "remove", r"\bremove\s*\(\s*\{\s*\}\s*\)"),
    ("flush", "flush", r"\bFLUSH(ALL|DB)\b"),
    ("shutdown", "shutdown", r"\bSHUTDOWN\b"),
]
# Paths that must not be written.
PROTECTED_PATHS = [
    r"(^|/)\.git(/|$)",
    r"(?i)(^|/)\.env(\.|$)",
    r"(^|/)(id_rsa|id_ed25519|id_ecdsa|id_dsa)(\.|$)",
    r"(?i)\.(pem|key|p12|pfx|keystore|jks)$",
    r"(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|bun\.lockb|Gemfile\.lock|poetry\.lock|Cargo\.lock|composer\.lock)$",
    r"(?i)\.lock$",
    r"(^|/)\.ssh(/|$)",
    r"(^|/)\.aws(/|$)",
    r"(?i)(^|/)\.pgpass$",
    r"(?i)(^|/)\.my\.cnf$",
    r"(?i)(^|/)secrets?(/|\.|$)",
    r"(?i)(^|/)credentials?(/|\.|$)",
]


def without_block_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"/\*[\s\S]*?\*/", " ")


def unscoped_write(text: Column, strict: bool = False) -> Column:
    """Label of the first DELETE/UPDATE with no WHERE before the next semicolon, else NULL.

    ``strict`` also reports FOR UPDATE, ON UPDATE, DO UPDATE and KEY UPDATE, which write nothing
    by themselves.
    """
    lead = "" if strict else r"(?<!(?:for|on|do|key)\s{1,8})"
    pattern = "(?i)" + lead + jvm(r"\b(DELETE\s+FROM|UPDATE)\b(?![^;]*\bWHERE\b)")
    word = F.upper(F.regexp_extract(text, pattern, 1))
    return F.when(word.startswith("DELETE"), "DELETE without WHERE").when(word == "UPDATE", "UPDATE without WHERE")


def guard_commands(commands: DataFrame, column: str, strict: bool = True) -> DataFrame:
    """Adds ``label``: the first blocking rule a command trips, else NULL (allowed)."""
    text, folded = F.col("__text"), F.col("__folded")
    label = F.when(F.lit(False), F.lit(""))
    for name, words, pattern in GUARD_RULES:
        label = label.when(_mentions(folded, words) & _has(text, pattern), F.lit(name))
    write = F.when(_mentions(folded, "delete update"), unscoped_write(text, strict))
    staged = compute_once(commands, __text=without_block_comments(F.col(column)))
    staged = compute_once(staged, __folded=F.lower(text))
    return compute_once(staged, label=label.otherwise(write)).drop("__text", "__folded")


def guard_path(path: Column) -> Column:
    """Does a path match any protected pattern?"""
    hit = F.lit(False)
    for pattern in PROTECTED_PATHS:
        hit = hit | path.rlike(pattern)
    return hit


def payload_strings(payloads: DataFrame, key: str, column: str) -> DataFrame:
    """Every string value of a JSON payload at any depth (object keys are not values)."""
    string = F.lit(r'"((?:[^"\\]|\\.)*+)"(\s*+:)?')
    bodies = F.regexp_extract_all(F.col(column), string, F.lit(1))
    colons = F.regexp_extract_all(F.col(column), string, F.lit(2))
    values = F.filter(F.zip_with(bodies, colons, lambda b, c: F.when(c == "", b)), lambda b: b.isNotNull())
    text = F.from_json(F.concat(F.lit('["'), F.array_join(values, '","'), F.lit('"]')), "array<string>")
    return payloads.select(key, F.posexplode(F.when(F.size(values) > 0, text)).alias("pos", "value"))


# --- query log --------------------------------------------------------------------------------

# Statement shapes to flag, as (name, pattern).
QUERY_FLAGS = [
    ("select_star", r"\bSELECT\s+\*"),
    ("offset_page", r"\bOFFSET\s+\d"),
    ("function_wrapped", r"\bWHERE\s[^;]*[a-z_]\s*\(\s*[a-z_.]+\s*\)\s*(=|<|>|LIKE\b|IN\b)"),
    ("leading_wildcard", r"\bLIKE\s+'%"),
]
LOCK_FLAGS = [
    ("for_update", r"\bFOR\s+UPDATE\b"),
    ("skip_locked", r"\bSKIP\s+LOCKED\b"),
    ("session_advisory_lock", r"\bpg_advisory_lock\s*\("),
    ("sets_isolation", r"\bISOLATION\s+LEVEL\b"),
]
INJECTION = [
    r"\b(SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM)\b[^\n]*[\"']\s*\+",
    r"\b(SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM)\b[^\n]*\$\{",
    r"\bf[\"'][^\n]*\b(SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM)\b[^\n]*\{",
    r"\b(SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM)\b[^\n]*[\"']\s*(%|\.format\()",
]


def _flags(df: DataFrame, column: str, flags: list[tuple[str, str]]) -> DataFrame:
    return df.withColumns({name: _has(F.col(column), pattern) for name, pattern in flags})


def query_antipatterns(df: DataFrame, column: str = "statement") -> DataFrame:
    return _flags(df, column, QUERY_FLAGS)


def lock_patterns(df: DataFrame, column: str = "statement") -> DataFrame:
    out = _flags(df, column, LOCK_FLAGS)
    return out.withColumn("queue_contention", F.col("for_update") & ~F.col("skip_locked"))


def sql_injection_shape(source_line: Column) -> Column:
    return _any(source_line, INJECTION)


def fingerprint_text(statement: Column) -> Column:
    """Statement with literals replaced by ``?`` and whitespace folded."""
    no_strings = F.regexp_replace(statement, r"'(?:[^']|'')*'", "?")
    no_numbers = F.regexp_replace(no_strings, r"(?<![A-Za-z0-9_])\d+(?:\.\d+)?(?![A-Za-z0-9_])", "?")
    return F.lower(fold(no_numbers))


def statement_fingerprint(statement: Column) -> Column:
    return F.sha2(fingerprint_text(statement), 256)


def hot_statements(log: DataFrame, elapsed: str, k: int, column: str = "statement") -> DataFrame:
    """Top ``k`` statement shapes by total time, in exact milli-units."""
    milli = (F.sum(F.col(elapsed).cast("decimal(18,3)")) * 1000).cast("long")
    return (
        log.groupBy(fingerprint_text(F.col(column)).alias("shape"))
        .agg(F.count(F.lit(1)).alias("calls"), milli.alias("total_milli"))
        .orderBy(F.desc("total_milli"), "shape")
        .limit(k)
    )


def n_plus_one_bursts(
    log: DataFrame, session: str, ts: str, event: str, gap_seconds: int, more_than: int, column: str = "statement"
) -> DataFrame:
    """Runs of one statement shape in a session with no gap above ``gap_seconds``, longer than
    ``more_than``.

    Rows are cut into runs per (session, shape, time bucket) with a single shuffle.  Only the first
    and last run of a bucket can continue in another one, so only those travel along the key.
    """
    limit = gap_seconds * 1_000_000
    keys = [session, "shape"]
    bucket = time_bucket(ts, max(3600, gap_seconds))
    shaped = log.select(
        session, ts, event, fingerprint_text(F.col(column)).alias("shape"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), bucket.alias("bucket")
    )
    part = Window.partitionBy(*keys, "bucket")
    rows = part.orderBy(ts, event)
    gap = F.col("us") - F.lag("us").over(rows)
    starts = shaped.withColumn("starts", F.when(gap.isNull() | (gap > limit), 1).otherwise(0))
    pieces = (
        starts.withColumn("run", F.sum("starts").over(rows))
        .groupBy(*keys, "bucket", "run")
        .agg(F.count(F.lit(1)).alias("repeats"), F.min(event).alias("first_event"), F.min("us").alias("lo"), F.max("us").alias("hi"))
        .withColumn("last_run", F.max("run").over(part))
    )
    edge = (F.col("run") == 1) | (F.col("run") == F.col("last_run"))
    along = Window.partitionBy(*keys).orderBy("lo", "first_event")
    continues = F.coalesce(F.col("lo") - F.lag("hi").over(along) <= limit, F.lit(False))
    joined = (
        pieces.where(edge)
        .withColumn("fresh", F.when(continues, 0).otherwise(1))
        .withColumn("chain", F.sum("fresh").over(along))
        .groupBy(*keys, "chain")
        .agg(F.sum("repeats").alias("repeats"), F.min("first_event").alias("first_event"), (F.max("hi") - F.min("lo")).alias("span_us"))
        .drop("chain")
    )
    inside = pieces.where(~edge).select(*keys, "repeats", "first_event", (F.col("hi") - F.col("lo")).alias("span_us"))
    return joined.unionByName(inside).where(F.col("repeats") > more_than)
