"""Rules over catalog frames: set-based predicates that emit finding rows.

A catalog is three flat frames keyed by (store, table_name): ``columns`` (one row per column),
``fks`` and ``indexes`` (ordered column arrays).  Rules on single columns, tables or keys are
predicates evaluated together in one pass; rules that relate frames are joins on equality.  Prefix
rules explode the prefixes of each index, so no pairs of indexes or keys are ever compared.

Rules return hits ``(store, rule, object)``; ``findings`` turns hits into finding rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.grading import lookup
from plumbline.functions.text import is_reserved, jvm
from plumbline.session import cut_lineage

# Name and type hints.
MONEY_HINT = r"(?i)(price|amount|cost|total|balance|fee|salary|revenue|payment|wage|tax|discount|subtotal|charge|refund|money|currency)"
FLOAT_TYPE = r"(?i)\b(float|double|real|float4|float8|double\s+precision)\b"
CSV_HINT = r"(?i)(tags|ids|categories|roles|emails|skus|list|csv|values|items)"
TEXT_TYPE = r"(?i)\b(text|varchar|char|string)\b"
TEXT_OR_ENUM = r"(?i)\b(text|varchar|char|string|enum)\b"
EAV_ATTRIBUTE = "^(attribute|attr|key|name|prop|property|field|meta_key)$"
EAV_VALUE = "^(value|val|meta_value|data)$"
NATURAL_KEY = "^(email|username|slug|external_id|ssn|phone)$"
SENSITIVE_TABLE = "(payment|invoice|transaction|account|permission|order|user)"
FINANCIAL_TABLE = "(payment|invoice|transaction|account|order)"
PII_HINT = "(email|ssn|phone|birth|dob|address|addr|card|full_name)"
SECRET_COLUMN = "(password|secret|token|api_key|private_key)"
RETENTION_HINT = "(retention|purge|anonymi|expires)"
TENANT_COLUMNS = ["tenant_id", "org_id", "account_id"]
SOFT_DELETE = ["deleted_at", "is_deleted"]
CONTAINMENT_METHODS = ["gin", "gist", "spgist", "fulltext", "inverted"]
DERIVED_HINT = "(^total|_total|full_name|_count$|search_vector)"
OPAQUE = "^(data|info|value|flag|temp|tmp|col[0-9]*)$"
DATE_LIKE = "(_at$|^valid_)"


# What each rule reports.  Confidence "catalog" is that of the catalog it ran on.
RULE_COLUMNS = ["rule", "module", "status", "severity", "axis", "confidence", "magnitude", "fixable"]
RULE_ROWS = [
    ("money_as_float", "M19", "fail", "5", "design", "catalog", "high", "advisory"),
    ("csv_in_column", "M19", "needs_api", "3", "design", "speculative", "medium", "advisory"),
    ("eav", "M19", "needs_api", "3", "both", "speculative", "medium", "advisory"),
    ("no_primary_key", "M19", "fail", "5", "both", "catalog", "high", "advisory"),
    ("polymorphic_fk", "M19", "warn", "3", "both", "catalog", "medium", "advisory"),
    ("boolean_soup", "M19", "warn", "3", "design", "directional", "medium", "advisory"),
    ("fk_unindexed", "M11", "warn", "3", "performance", "catalog", "medium", "proposed"),
    ("esr_order", "M11", "warn", "3", "performance", "directional", "medium", "proposed"),
    ("index_type", "M11", "warn", "3", "performance", "directional", "medium", "proposed"),
    ("redundant_prefix", "M12", "warn", "3", "performance", "catalog", "medium", "proposed"),
    ("repeating_group", "M1", "warn", "3", "design", "directional", "medium", "advisory"),
    ("denormalized_label", "M1", "warn", "3", "design", "directional", "medium", "proposed"),
    ("int4_pk", "M2", "warn", "4", "both", "directional", "medium", "auto"),
    ("uuidv4_clustered_pk", "M2", "warn", "3", "performance", "directional", "medium", "advisory"),
    ("natural_key_pk", "M2", "warn", "3", "design", "directional", "medium", "advisory"),
    ("composite_pk_order", "M2", "warn", "3", "performance", "directional", "medium", "advisory"),
    ("no_fk_financial", "M3", "fail", "5", "both", "catalog", "high", "auto"),
    ("no_fk", "M3", "warn", "3", "both", "catalog", "medium", "auto"),
    ("fk_cascades_financial", "M3", "warn", "4", "design", "catalog", "medium", "proposed"),
    ("fk_no_action", "M3", "warn", "3", "design", "catalog", "medium", "proposed"),
    ("composite_fk_mismatch", "M3", "warn", "3", "design", "catalog", "medium", "advisory"),
    ("naive_timestamp", "M4", "warn", "4", "design", "catalog", "medium", "proposed"),
    ("free_text_status", "M4", "warn", "2", "design", "directional", "medium", "proposed"),
    ("json_catch_all", "M4", "warn", "3", "design", "directional", "medium", "proposed"),
    ("nullable", "M5", "warn", "3", "design", "catalog", "medium", "auto"),
    ("no_check", "M5", "warn", "3", "design", "catalog", "medium", "proposed"),
    ("no_unique", "M5", "warn", "4", "design", "directional", "medium", "proposed"),
    ("over_nullable_unique", "M5", "warn", "4", "design", "catalog", "medium", "advisory"),
    ("not_validated", "M5", "warn", "3", "design", "catalog", "medium", "auto"),
    ("no_default", "M6", "warn", "2", "design", "catalog", "low", "auto"),
    ("app_maintained", "M6", "warn", "3", "design", "directional", "medium", "proposed"),
    ("default_empty_string", "M6", "warn", "2", "design", "catalog", "low", "advisory"),
    ("serial_not_identity", "M6", "warn", "2", "design", "catalog", "low", "proposed"),
    ("boolean_no_default", "M6", "warn", "2", "design", "catalog", "low", "auto"),
    ("reserved_word", "M7", "warn", "2", "design", "directional", "low", "proposed"),
    ("fk_naming", "M7", "warn", "1", "design", "directional", "low", "proposed"),
    ("boolean_unprefixed", "M7", "warn", "1", "design", "directional", "low", "proposed"),
    ("opaque_name", "M7", "warn", "1", "design", "directional", "low", "advisory"),
    ("soft_delete_inconsistent", "M8", "warn", "3", "design", "directional", "medium", "proposed"),
    ("no_audit_trail", "M8", "warn", "3", "design", "directional", "medium", "proposed"),
    ("pii_no_retention_or_erasure", "M8", "warn", "4", "design", "directional", "medium", "advisory"),
    ("no_tenant_scope", "M9", "warn", "4", "both", "catalog", "medium", "proposed"),
    ("index_not_tenant_leading", "M9", "warn", "3", "performance", "catalog", "medium", "proposed"),
    ("unique_omits_tenant", "M9", "warn", "4", "both", "catalog", "medium", "proposed"),
    ("pii_unprotected", "M10", "warn", "3", "design", "directional", "medium", "advisory"),
    ("plaintext_secret", "M10", "fail", "5", "design", "catalog", "high", "advisory"),
]
RULES = {row[0]: dict(zip(RULE_COLUMNS, row, strict=True)) for row in RULE_ROWS}


@dataclass(frozen=True)
class Catalog:
    columns: DataFrame
    fks: DataFrame
    indexes: DataFrame
    confidence: str = "established"

    def tables(self) -> DataFrame:
        return self.columns.select("store", "table_name").distinct()

    def primary_keys(self) -> DataFrame:
        """(store, table_name, pk): ordered key columns of tables that have any."""
        return (
            self.columns.where("pk")
            .groupBy("store", "table_name")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))), lambda c: c["column_name"]).alias("pk"))
        )

    def fk_columns(self) -> DataFrame:
        return self.fks.select("store", "table_name", F.explode("columns").alias("column_name")).distinct()

    def stored(self) -> Catalog:
        """The same catalog read back from the shared folder, for running many rules on it."""
        return replace(
            self,
            columns=cut_lineage(self.columns, "columns"),
            fks=cut_lineage(self.fks, "fks"),
            indexes=cut_lineage(self.indexes, "indexes"),
        )

    def with_confidence(self, confidence: str) -> Catalog:
        return replace(self, confidence=confidence)


def findings(hits: DataFrame, confidence: str = "established") -> DataFrame:
    """Finding rows for hits ``(store, rule, object)``.  Ids name the object in lower case, so
    they always fit the id pattern."""

    def part(name: str) -> Column:
        return lookup({rule: row[name] for rule, row in RULES.items()}, F.col("rule"))

    obj = F.lower(F.regexp_replace("object", "[^A-Za-z0-9_.-]", "-"))
    joint = F.when(F.contains(F.col("object"), F.lit(".")), "_").otherwise(".")
    given = part("confidence")
    return hits.select(
        "store",
        F.concat(part("module"), F.lit("."), obj, joint, F.col("rule")).alias("id"),
        part("module").alias("module"),
        part("status").alias("status"),
        part("severity").cast("int").alias("severity"),
        part("axis").alias("axis"),
        F.when(given == "catalog", F.lit(confidence)).otherwise(given).alias("confidence"),
        part("magnitude").alias("magnitude"),
        part("fixable").alias("fixable"),
        "object",
    )


def _hits(df: DataFrame, obj: Column, rules: dict[str, Column]) -> DataFrame:
    """(store, rule, object) of every rule whose condition holds, from one pass over ``df``."""
    fired = F.array_compact(F.array(*[F.when(when, F.lit(rule)) for rule, when in rules.items()]))
    return df.select("store", F.explode(fired).alias("rule"), obj.alias("object"))


def _column() -> Column:
    return F.concat_ws(".", F.col("table_name"), F.col("column_name"))


def _is(column: str, pattern: str) -> Column:
    return F.col(column).rlike(jvm(pattern))


def confidence_downgrade(rows: DataFrame, model_confidence: str) -> DataFrame:
    """Findings of a heuristically parsed model are unproven: needs_api and speculative."""
    if model_confidence != "directional":
        return rows
    return rows.withColumn("status", F.lit("needs_api")).withColumn("confidence", F.lit("speculative"))


# --- rules on single columns --------------------------------------------------------------------


def tokens(name: str) -> Column:
    """Words of an identifier, at underscores and capitals, in lower case."""
    parted = F.regexp_replace(F.regexp_replace(F.col(name), "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+", "_")
    return F.split(F.lower(parted), "_")


def _names(pattern: str, token_bounded: bool) -> Column:
    """Does a column's name hold a hint, anywhere or as a word of its own (``fee`` but not ``coffee``)?"""
    if not token_bounded:
        return _is("column_name", pattern)
    words = re.search(r"\(([a-z|]+)\)", pattern).group(1).split("|")
    return F.arrays_overlap(tokens("column_name"), F.array(*[F.lit(w + s) for w in words for s in ("", "s")]))


def column_conditions(token_bounded: bool = False) -> dict[str, Column]:
    """Rule -> condition over one row of ``columns``; ``token_bounded`` takes hints as whole words."""
    name, kind = F.lower("column_name"), F.lower("type")
    default = F.trim(F.coalesce(F.col("default_expr"), F.lit("")))
    text, boolean = _is("type", TEXT_TYPE), kind.startswith("bool")
    return {
        "money_as_float": _names(MONEY_HINT, token_bounded) & _is("type", FLOAT_TYPE),
        "csv_in_column": _names(CSV_HINT, token_bounded) & text,
        "int4_pk": F.col("pk") & kind.isin("int", "int4", "integer", "serial"),
        "uuidv4_clustered_pk": F.col("pk") & (kind == "uuid") & default.rlike("(?i)(gen_random_uuid|uuid_generate_v4)"),
        "natural_key_pk": F.col("pk") & name.rlike(NATURAL_KEY),
        "naive_timestamp": kind.isin("timestamp", "timestamp without time zone", "timestamp_ntz", "datetime"),
        "free_text_status": kind.startswith("enum") | (name.rlike("^(status|state|kind|role)$") & text & ~F.col("has_check")),
        "json_catch_all": kind.isin("json", "jsonb"),
        "nullable": name.rlike("(_id$|^status$|^created_at$|^email$)") & ~F.col("not_null"),
        "no_check": name.rlike("(quantity|price|amount|^status$|^valid_|_count$)") & ~F.col("has_check"),
        "no_default": name.rlike("_at$") & (name != "deleted_at") & (default == ""),
        "app_maintained": name.rlike(DERIVED_HINT),
        "default_empty_string": default == "''",
        "serial_not_identity": kind.isin("serial", "bigserial"),
        "boolean_no_default": boolean & (default == ""),
        "reserved_word": is_reserved(F.col("column_name")),
        "boolean_unprefixed": boolean & ~name.rlike("^(is|has|can)_"),
        "opaque_name": name.rlike(OPAQUE) | (kind.startswith("timestamp") & ~name.rlike(DATE_LIKE)),
        "pii_unprotected": name.rlike(PII_HINT),
        "plaintext_secret": name.rlike(SECRET_COLUMN) & ~name.rlike("hash") & text,
    }


def column_rules(cat: Catalog, only: list[str] | None = None, token_bounded: bool = False) -> DataFrame:
    rules = {r: c for r, c in column_conditions(token_bounded).items() if only is None or r in only}
    return _hits(cat.columns, _column(), rules)


# --- rules on single tables ---------------------------------------------------------------------


def table_conditions(boolean_flags: int = 3) -> dict[str, Column]:
    """Rule -> condition over one row of ``table_profile``."""
    return {
        "eav": F.col("attr") & F.col("val") & (F.col("n") <= 6),
        "no_primary_key": ~F.col("has_pk"),
        "pii_no_retention_or_erasure": F.col("pii") & ~F.col("kept"),
        "boolean_soup": F.col("flags") >= boolean_flags,
        "reserved_word": is_reserved(F.col("table_name")),
    }


def table_profile(cat: Catalog) -> DataFrame:
    """Everything the table rules look at, from one aggregation over the columns."""
    name = F.lower("column_name")
    flag = F.lower("type").startswith("bool") & name.rlike("^(is|has|can)_")
    return cat.columns.groupBy("store", "table_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or("pk").alias("has_pk"),
        F.bool_or(name.rlike(EAV_ATTRIBUTE)).alias("attr"),
        F.bool_or(name.rlike(EAV_VALUE)).alias("val"),
        F.bool_or(name.rlike(PII_HINT)).alias("pii"),
        F.bool_or(name.rlike(RETENTION_HINT)).alias("kept"),
        F.count_if(flag).alias("flags"),
    )


def table_rules(cat: Catalog, only: list[str] | None = None) -> DataFrame:
    rules = {r: c for r, c in table_conditions().items() if only is None or r in only}
    return _hits(table_profile(cat), F.col("table_name"), rules)


# --- rules on single foreign keys ---------------------------------------------------------------


def fk_conditions() -> dict[str, Column]:
    """Rule -> condition over one row of ``fks``."""
    cascade = (F.col("on_delete") == "CASCADE") & F.lower("table_name").rlike(FINANCIAL_TABLE)
    named = F.concat(F.regexp_replace(F.lower("ref_table"), "s$", ""), F.lit("_id"))
    return {
        "fk_cascades_financial": cascade,
        "fk_no_action": F.coalesce(F.col("on_delete"), F.lit("")) == "",
        "not_validated": ~F.col("validated"),
        "fk_naming": (F.size("columns") == 1) & (F.lower(F.element_at("columns", 1)) != named),
    }


def _fk_object() -> Column:
    return F.concat_ws(".", F.col("table_name"), F.array_join("columns", "_"))


def fk_rules(cat: Catalog, only: list[str] | None = None) -> DataFrame:
    rules = {r: c for r, c in fk_conditions().items() if only is None or r in only}
    return _hits(cat.fks, _fk_object(), rules)


# --- rules that relate frames -------------------------------------------------------------------


def _named(df: DataFrame, rule: str, obj: Column) -> DataFrame:
    return df.select("store", F.lit(rule).alias("rule"), obj.alias("object"))


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that no size estimate turns into a broadcast.  Names and types repeat, so the files of a catalog are many
    times smaller than its rows, and ``run_rules`` would build the relations of all its rules on the driver at once."""
    return left.join(right.hint("merge"), on, how)


def polymorphic_fk(cat: Catalog, keep_keys: bool = False) -> DataFrame:
    """``x_type`` next to ``x_id`` without a key.  A ``x_id`` that is the table's own key is an
    event or row id, not a reference; ``keep_keys`` reports it all the same."""
    base = cat.columns.where(F.lower("column_name").rlike("_type$") & _is("type", TEXT_OR_ENUM)).select(
        "store", "table_name", F.regexp_replace(F.lower("column_name"), "_type$", "").alias("base")
    )
    ids = cat.columns.where(F.lower("column_name").rlike("_id$"))
    if not keep_keys:
        ids = ids.where("NOT pk")
    ids = ids.select("store", "table_name", F.regexp_replace(F.lower("column_name"), "_id$", "").alias("base"))
    declared = cat.fk_columns().select("store", "table_name", F.regexp_replace(F.lower("column_name"), "_id$", "").alias("base"))
    on = ["store", "table_name", "base"]
    hits = _join(_join(base, ids, on, "left_semi"), declared, on, "left_anti")
    return _named(hits, "polymorphic_fk", F.concat_ws(".", "table_name", "base"))


def _prefixes(columns: str) -> Column:
    """Every leading part of an ordered column list, as folded comma strings."""
    return F.transform(
        F.sequence(F.lit(1), F.size(columns)), lambda n: F.lower(F.array_join(F.slice(F.col(columns), F.lit(1), n), ","))
    )


def fk_unindexed(cat: Catalog) -> DataFrame:
    lists = (
        cat.indexes.select("store", "table_name", "columns")
        .unionByName(cat.primary_keys().withColumnRenamed("pk", "columns"))
        .unionByName(cat.columns.where("is_unique").select("store", "table_name", F.array("column_name").alias("columns")))
    )
    covered = lists.select("store", "table_name", F.explode(_prefixes("columns")).alias("fk")).distinct()
    keys = cat.fks.withColumn("fk", F.lower(F.array_join("columns", ",")))
    hits = _join(keys, covered, ["store", "table_name", "fk"], "left_anti").dropDuplicates(["store", "table_name", "fk"])
    return _named(hits, "fk_unindexed", _fk_object())


def repeating_groups(cat: Catalog) -> DataFrame:
    numbered = cat.columns.where(F.col("column_name").rlike("[0-9]+$"))
    stems = numbered.groupBy("store", "table_name", F.regexp_replace("column_name", "_?[0-9]+$", "").alias("stem")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return _named(stems.where("n >= 2"), "repeating_group", F.concat_ws(".", "table_name", "stem"))


def denormalized_label(cat: Catalog) -> DataFrame:
    """``user_name`` next to ``user_id`` where ``users`` is a table of its own."""
    labels = cat.columns.where(F.col("column_name").rlike("_(name|label)$")).select(
        "store", "table_name", "column_name", F.regexp_replace("column_name", "_(name|label)$", "").alias("stem")
    )
    ids = cat.columns.where(F.col("column_name").rlike("_id$")).select(
        "store", "table_name", F.regexp_replace("column_name", "_id$", "").alias("stem")
    )
    entities = cat.tables().select("store", F.regexp_replace("table_name", "s$", "").alias("stem"), F.col("table_name").alias("entity"))
    linked = _join(labels, ids, ["store", "table_name", "stem"], "left_semi")
    hits = _join(linked, entities, ["store", "stem"]).where("entity <> table_name").dropDuplicates(["store", "table_name", "column_name"])
    return _named(hits, "denormalized_label", _column())


def uuid_v4_key(cat: Catalog, versions: DataFrame) -> DataFrame:
    """Random uuid keys, with the native alternative where ``(store, major_version)`` has one."""
    rows = findings(column_rules(cat, ["uuidv4_clustered_pk"]), cat.confidence)
    native = F.coalesce(F.col("major_version"), F.lit(0)) >= 18
    return rows.join(versions, "store", "left").withColumn(
        "recommendation", F.when(native, "uuidv7()").otherwise("time-ordered id from the application")
    ).drop("major_version")


def composite_pk_order(cat: Catalog, leading: str = "tenant_id") -> DataFrame:
    """Composite keys of tables with a dominant access column that do not lead with it."""
    scoped = cat.columns.where(F.col("column_name") == leading).select("store", "table_name")
    composite = cat.primary_keys().where((F.size("pk") > 1) & (F.element_at("pk", 1) != leading))
    hits = _join(composite, scoped, ["store", "table_name"], "left_semi")
    return _named(hits, "composite_pk_order", F.col("table_name"))


def missing_fk(cat: Catalog) -> DataFrame:
    """``x_id`` columns that match a keyed table ``x`` or ``xs`` but are not declared."""
    ids = cat.columns.where(F.col("column_name").rlike("_id$") & ~F.col("pk")).select(
        "store", "table_name", "column_name", F.regexp_replace("column_name", "_id$", "").alias("stem")
    )
    keyed = cat.columns.where("pk").select("store", F.regexp_replace("table_name", "s$", "").alias("stem")).distinct()
    hits = _join(_join(ids, keyed, ["store", "stem"], "left_semi"), cat.fk_columns(), ["store", "table_name", "column_name"], "left_anti")
    serious = F.lower("table_name").rlike(FINANCIAL_TABLE)
    ruled = hits.withColumn("rule", F.when(serious, "no_fk_financial").otherwise("no_fk"))
    return ruled.select("store", "rule", _column().alias("object"))


def composite_fk_mismatch(cat: Catalog) -> DataFrame:
    """Multi-column keys whose referenced columns are not, in order, a key of the target."""
    targets = (
        cat.primary_keys()
        .select("store", "table_name", F.array_join("pk", ",").alias("cols"))
        .unionByName(cat.indexes.where("is_unique").select("store", "table_name", F.array_join("columns", ",").alias("cols")))
        .distinct()
    )
    refs = cat.fks.where(F.size("columns") > 1).select("store", "table_name", "columns", "ref_table", F.array_join("ref_columns", ",").alias("cols"))
    hits = _join(refs, targets.withColumnRenamed("table_name", "ref_table"), ["store", "ref_table", "cols"], "left_anti")
    return _named(hits, "composite_fk_mismatch", _fk_object())


def constraint_inventory(cat: Catalog) -> DataFrame:
    """Every column with each kind of constraint on it (blank when none)."""
    kinds = F.array_compact(
        F.array(
            F.when(F.col("pk"), F.lit("PRIMARY KEY")), F.when(F.col("is_unique"), F.lit("UNIQUE")), F.when(F.col("has_check"), F.lit("CHECK"))
        )
    )
    own = cat.columns.select("store", "table_name", "column_name", F.explode(kinds).alias("constraint_type"))
    fk = cat.fk_columns().withColumn("constraint_type", F.lit("FOREIGN KEY"))
    usage = own.unionByName(fk).distinct()
    base = cat.columns.select("store", "table_name", "column_name", (~F.col("not_null")).alias("is_nullable"))
    return base.join(usage, ["store", "table_name", "column_name"], "left").na.fill("", ["constraint_type"])


def missing_unique(cat: Catalog) -> DataFrame:
    natural = F.lower("column_name").rlike(NATURAL_KEY)
    single = cat.indexes.where("is_unique AND size(columns) = 1").select("store", "table_name", F.element_at("columns", 1).alias("column_name"))
    hits = _join(cat.columns.where(natural & ~F.col("is_unique") & ~F.col("pk")), single, ["store", "table_name", "column_name"], "left_anti")
    return _named(hits, "no_unique", _column())


def _index_object() -> Column:
    return F.concat_ws(".", F.col("table_name"), F.col("index_name"))


def over_nullable_unique(cat: Catalog) -> DataFrame:
    """Unique indexes with a nullable member: each NULL counts as different."""
    members = cat.indexes.where("is_unique").select("store", "table_name", "index_name", F.explode("columns").alias("column_name"))
    nullable = cat.columns.where("NOT not_null").select("store", "table_name", "column_name")
    hits = _join(members, nullable, ["store", "table_name", "column_name"], "left_semi").select("store", "table_name", "index_name").distinct()
    return _named(hits, "over_nullable_unique", _index_object())


def naming_casing(cat: Catalog) -> DataFrame:
    """Casing and plurality tally per store; more than one style is a finding."""
    name = F.col("column_name")
    styles = cat.columns.groupBy("store").agg(
        F.count_if(name.rlike("^[a-z0-9_]+$")).alias("snake"),
        F.count_if(name.rlike("^[a-z]+[A-Z]")).alias("camel"),
        F.count_if(name.rlike("^[A-Z][a-z]")).alias("pascal"),
    )
    table = F.col("table_name")
    tables = cat.tables().groupBy("store").agg(
        F.count_if(table.rlike("s$")).alias("plural"),
        F.count_if(~table.rlike("s$")).alias("singular"),
        F.count_if(table.rlike("[A-Z]")).alias("cased_tables"),
    )
    mixed = ((F.col("snake") > 0) & (F.col("camel") + F.col("pascal") + F.col("cased_tables") > 0)) | (
        (F.col("plural") > 0) & (F.col("singular") > 0)
    )
    return styles.join(tables, "store").withColumn("status", F.when(mixed, "warn").otherwise("pass"))


def soft_delete_consistency(cat: Catalog) -> DataFrame:
    """Stores where some tables soft-delete and others do not."""
    per_table = cat.columns.groupBy("store", "table_name").agg(F.bool_or(F.lower("column_name").isin(SOFT_DELETE)).alias("soft"))
    per_store = per_table.groupBy("store").agg(F.count_if("soft").alias("soft_tables"), F.count(F.lit(1)).alias("tables"))
    hits = per_store.where("soft_tables > 0 AND soft_tables < tables")
    return _named(hits, "soft_delete_inconsistent", F.col("store"))


def no_audit_companion(cat: Catalog) -> DataFrame:
    """Sensitive tables without ``<table>_history``, ``_audit`` or ``_log``."""
    companion = "_(history|audit|log)$"
    tables = cat.tables().withColumn("lowered", F.lower("table_name"))
    covered = tables.where(F.col("lowered").rlike(companion)).select("store", F.regexp_replace("lowered", companion, "").alias("lowered"))
    sensitive = tables.where(F.col("lowered").rlike(SENSITIVE_TABLE) & ~F.col("lowered").rlike(companion))
    return _named(_join(sensitive, covered, ["store", "lowered"], "left_anti"), "no_audit_trail", F.col("table_name"))


def tenant_columns(cat: Catalog) -> DataFrame:
    """``store, table_name, tenants``: the columns that scope a table to a tenant, if it has any."""
    named = cat.columns.where(F.lower("column_name").isin(TENANT_COLUMNS))
    return named.groupBy("store", "table_name").agg(F.collect_set(F.lower("column_name")).alias("tenants"))


def tenant_missing(cat: Catalog) -> DataFrame:
    """Tables of a multi-tenant store with no tenant column, or none that must be set."""
    is_tenant = F.lower("column_name").isin(TENANT_COLUMNS)
    per_table = cat.columns.groupBy("store", "table_name").agg(F.bool_or(is_tenant & F.col("not_null")).alias("scoped"))
    shared = cat.columns.where(is_tenant).select("store").distinct()
    hits = _join(per_table.where("NOT scoped"), shared, ["store"], "left_semi")
    return _named(hits, "no_tenant_scope", F.col("table_name"))


def tenant_indexes(cat: Catalog, only: list[str] | None = None) -> DataFrame:
    """Indexes and composite primary keys of tenant tables that do not lead with a tenant column;
    unique indexes, and foreign keys between tenant tables, that leave it out."""
    tenants = tenant_columns(cat)

    def lowered(columns: str) -> Column:
        return F.transform(columns, F.lower)

    leads = F.array_contains("tenants", F.element_at(lowered("columns"), 1))
    holds = F.arrays_overlap("tenants", lowered("columns"))
    rules = {"index_not_tenant_leading": ~leads, "unique_omits_tenant": F.col("is_unique") & ~holds}
    chosen = {r: c for r, c in rules.items() if only is None or r in only}
    out = _hits(_join(cat.indexes, tenants, ["store", "table_name"]), _index_object(), chosen)
    if "index_not_tenant_leading" in chosen:
        keys = _join(cat.primary_keys().where(F.size("pk") > 1).withColumnRenamed("pk", "columns"), tenants, ["store", "table_name"])
        out = out.unionByName(_named(keys.where(~leads), "index_not_tenant_leading", F.concat("table_name", F.lit(".pk"))))
    if "unique_omits_tenant" in chosen:
        parents = tenants.select("store", F.col("table_name").alias("ref_table"))
        linked = _join(_join(cat.fks, tenants, ["store", "table_name"]), parents, ["store", "ref_table"], "left_semi")
        named = F.concat("table_name", F.lit("."), F.array_join("columns", "_"))
        out = out.unionByName(_named(linked.where(~holds), "unique_omits_tenant", named))
    return out


def index_duplicate(cat: Catalog) -> DataFrame:
    """Indexes with the same ordered column list; the first name is the one to keep."""
    groups = cat.indexes.groupBy("store", "table_name", F.lower(F.array_join("columns", ",")).alias("cols")).agg(
        F.count(F.lit(1)).alias("copies"), F.min("index_name").alias("keep")
    )
    return groups.where("copies > 1")


def index_redundant_prefix(cat: Catalog) -> DataFrame:
    """Non-unique indexes that a longer index of the table starts with."""
    longer = cat.indexes.where(F.size("columns") > 1).select(
        "store", "table_name", F.explode(F.slice(_prefixes("columns"), F.lit(1), F.size("columns") - 1)).alias("cols")
    )
    shorter = cat.indexes.where("NOT is_unique").withColumn("cols", F.lower(F.array_join("columns", ",")))
    hits = _join(shorter, longer.distinct(), ["store", "table_name", "cols"], "left_semi")
    return _named(hits, "redundant_prefix", _index_object())


def index_esr(cat: Catalog, predicates: DataFrame) -> DataFrame:
    """Composite indexes whose columns are not ordered equality, sort, range as used."""
    role = F.when(F.col("role") == "equality", 1).when(F.col("role") == "sort", 2).otherwise(3)
    used = predicates.groupBy("store", "table_name", "column_name").agg(F.min(role).alias("rank"))
    members = cat.indexes.where(F.size("columns") > 1).select(
        "store", "table_name", "index_name", F.posexplode("columns").alias("pos", "column_name")
    )
    ranked = members.join(used, ["store", "table_name", "column_name"])
    ordered = ranked.groupBy("store", "table_name", "index_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "rank"))), lambda x: x["rank"]).alias("ranks")
    )
    return _named(ordered.where(F.col("ranks") != F.array_sort("ranks")), "esr_order", _index_object())


def index_type_fit(cat: Catalog, predicates: DataFrame) -> DataFrame:
    """Containment predicates on json or text columns that no fitting index serves: an ordinary one
    does not.  ``method`` of the indexes, where known, says which fit."""
    special = cat.columns.where(F.lower("type").isin("json", "jsonb") | _is("type", TEXT_TYPE)).select("store", "table_name", "column_name")
    hits = predicates.where("role = 'containment'").join(special, ["store", "table_name", "column_name"], "left_semi")
    if "method" in cat.indexes.columns:
        fitting = cat.indexes.where(F.lower("method").isin(CONTAINMENT_METHODS))
        served = fitting.select("store", "table_name", F.explode("columns").alias("column_name"))
        hits = hits.join(served, ["store", "table_name", "column_name"], "left_anti")
    return _named(hits, "index_type", _column())


# --- shape --------------------------------------------------------------------------------------


def god_table(cat: Catalog, columns: int = 30, nullable_bp: int = 2500) -> DataFrame:
    """Tables with very many columns, a good part of them nullable."""
    sizes = cat.columns.groupBy("store", "table_name").agg(
        F.count(F.lit(1)).alias("n_columns"), F.count_if(~F.col("not_null")).alias("nullable")
    )
    return sizes.where((F.col("n_columns") >= columns) & (F.col("nullable") * 10000 >= F.col("n_columns") * nullable_bp)).orderBy(
        F.desc("n_columns"), "store", "table_name"
    )


def json_depth(column: Column) -> Column:
    """Nesting depth of a JSON text: brackets outside strings, counted up and down."""
    brackets = F.regexp_replace(F.regexp_replace(column, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    steps = F.filter(F.split(brackets, ""), lambda c: c != "")
    zero = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(acc: Column, c: Column) -> Column:
        d = acc["d"] + F.when(c.isin("{", "["), 1).otherwise(-1)
        return F.struct(d.alias("d"), F.greatest(acc["m"], d).alias("m"))

    return F.aggregate(steps, zero, step)["m"]


def deep_nesting(documents: DataFrame, group: str, column: str, limit: int) -> DataFrame:
    """Deepest document per group and how many exceed the limit."""
    sized = documents.select(group, json_depth(F.col(column)).alias("depth"))
    return sized.groupBy(group).agg(
        F.count(F.lit(1)).alias("documents"), F.max("depth").alias("max_depth"), F.count_if(F.col("depth") > limit).alias("too_deep")
    )


RELATING_RULES = [
    polymorphic_fk,
    fk_unindexed,
    repeating_groups,
    denormalized_label,
    composite_pk_order,
    missing_fk,
    composite_fk_mismatch,
    missing_unique,
    over_nullable_unique,
    soft_delete_consistency,
    no_audit_companion,
    tenant_missing,
    tenant_indexes,
    index_redundant_prefix,
]
ALL_RULES: list[Callable[[Catalog], DataFrame]] = [column_rules, table_rules, fk_rules, *RELATING_RULES]


def run_rules(cat: Catalog, rules: list[Callable[[Catalog], DataFrame]] | None = None) -> DataFrame:
    """All rules (or those given) as one findings frame."""
    hits = reduce(DataFrame.unionByName, [rule(cat) for rule in rules or ALL_RULES])
    return confidence_downgrade(findings(hits, cat.confidence), cat.confidence)
