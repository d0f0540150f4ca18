"""Catalog rules, diffs, inventories and sources bound to an estate catalog derived from
``orders``, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import catalog_rules as cr
from plumbline.operators import diff, graph, scoring, seed
from plumbline.operators import state_rules as sr
from plumbline.plans.registry import query
from plumbline.plans.scoring_plans import BASE
from plumbline.session import TABLES, scratch_path
from plumbline.sources import catalog as sc
from plumbline.sources import files as sf


def estate(i) -> cr.Catalog:
    return cr.Catalog(i.estate_columns, i.estate_fks, i.estate_indexes)


SHOWN = ["store", "id", "status", "severity", "axis", "confidence", "object"]


RULE_SQL: list[str] = []
GROUPS = {
    "fk_action": ["fk_cascades_financial", "fk_no_action"],
    "default": ["no_default", "app_maintained", "default_empty_string", "serial_not_identity", "boolean_no_default"],
}


def single(rule):
    """The pass that evaluates a rule (or group of rules), limited to it."""
    names = GROUPS.get(rule, [rule])
    if names[0] in cr.column_conditions():
        return lambda cat: cr.column_rules(cat, names)
    if names[0] in cr.table_conditions():
        return lambda cat: cr.table_rules(cat, names)
    return lambda cat: cr.fk_rules(cat, names)


def reserved_words(cat):
    return cr.column_rules(cat, ["reserved_word"]).unionByName(cr.table_rules(cat, ["reserved_word"]))


def rule_query(name, rule, hits, module, suffix, status="'warn'", severity="3", axis="design", confidence="established"):
    """Register a rule; ``hits`` is SQL yielding (store, object [, status, severity])."""
    suffix = suffix if suffix.startswith("(") else f"'{suffix}'"
    confidence = confidence if confidence.startswith("(") else f"'{confidence}'"
    sql = f"""SELECT store, '{module}.' || lower(regexp_replace(object, '[^A-Za-z0-9_.-]', '-', 'g')) || CASE WHEN contains(object, '.') THEN '_' ELSE '.' END || {suffix} AS id, {status} AS status,
              CAST({severity} AS INT) AS severity, '{axis}' AS axis, {confidence} AS confidence, object FROM ({hits}) h"""

    RULE_SQL.append(sql)

    @query(name, sql)
    def _(i):
        run = rule if callable(rule) else single(rule)
        cat = estate(i)
        return cr.findings(run(cat), cat.confidence).select(*SHOWN)


C = "{estate_columns}"
COL = "store, table_name || '.' || column_name AS object"
TEXTY = "regexp_matches(lower(type), '\\b(text|varchar|char|string)\\b')"
BOOL = "type LIKE 'boolean%'"
TENANT = "(SELECT DISTINCT store, table_name FROM {estate_columns} WHERE column_name = 'tenant_id')"
TENANTS = "(SELECT store, table_name, list(DISTINCT column_name) AS tenants FROM {estate_columns} WHERE column_name IN ('tenant_id', 'org_id', 'account_id') GROUP BY 1, 2)"
FKC = "(SELECT DISTINCT store, table_name, unnest(columns) AS column_name FROM {estate_fks})"
PKS = "(SELECT store, table_name, list(column_name ORDER BY ordinal) AS pk FROM {estate_columns} WHERE pk GROUP BY 1, 2)"

rule_query(
    "rule_float_money",
    "money_as_float",
    f"SELECT {COL} FROM {C} WHERE regexp_matches(lower(column_name), 'price|amount|cost|total|balance|fee|salary|revenue|payment|wage|tax|discount|subtotal|charge|refund|money|currency') AND type IN ('double precision', 'real', 'float')",
    "M19", "money_as_float", "'fail'", "5",
)
rule_query(
    "rule_csv_column",
    "csv_in_column",
    f"SELECT {COL} FROM {C} WHERE regexp_matches(lower(column_name), 'tags|ids|categories|roles|emails|skus|list|csv|values|items') AND {TEXTY}",
    "M19", "csv_in_column", "'needs_api'", "3", "design", "speculative",
)
rule_query(
    "rule_eav",
    "eav",
    f"""SELECT store, table_name AS object FROM {C} GROUP BY 1, 2 HAVING bool_or(lower(column_name) IN ('attribute', 'attr', 'key', 'name', 'prop', 'property', 'field', 'meta_key'))
        AND bool_or(lower(column_name) IN ('value', 'val', 'meta_value', 'data')) AND count(*) <= 6""",
    "M19", "eav", "'needs_api'", "3", "both", "speculative",
)
rule_query(
    "rule_no_primary_key",
    "no_primary_key",
    f"SELECT store, table_name AS object FROM {C} GROUP BY 1, 2 HAVING NOT bool_or(pk)",
    "M19", "no_primary_key", "'fail'", "5", "both",
)
rule_query(
    "rule_polymorphic_fk",
    cr.polymorphic_fk,
    f"""SELECT t.store, t.table_name || '.' || replace(t.column_name, '_type', '') AS object FROM {C} t JOIN {C} d ON t.store = d.store AND t.table_name = d.table_name
        AND d.column_name = replace(t.column_name, '_type', '') || '_id' AND NOT d.pk WHERE t.column_name LIKE '%\\_type' ESCAPE '\\' AND {TEXTY.replace('type', 't.type')}
        AND NOT EXISTS (SELECT 1 FROM {FKC} f WHERE f.store = d.store AND f.table_name = d.table_name AND f.column_name = d.column_name)""",
    "M19", "polymorphic_fk", "'warn'", "3", "both",
)
rule_query(
    "rule_fk_unindexed",
    cr.fk_unindexed,
    f"""SELECT DISTINCT f.store, f.table_name || '.' || array_to_string(f.columns, '_') AS object FROM {{estate_fks}} f WHERE NOT EXISTS (
          SELECT 1 FROM (SELECT store, table_name, columns FROM {{estate_indexes}} UNION ALL SELECT store, table_name, pk FROM {PKS} p
                         UNION ALL SELECT store, table_name, [column_name] FROM {C} WHERE is_unique) x
          WHERE x.store = f.store AND x.table_name = f.table_name AND list_transform(x.columns[1:len(f.columns)], lambda c: lower(c)) = list_transform(f.columns, lambda c: lower(c)))""",
    "M11", "fk_unindexed", "'warn'", "3", "performance",
)
rule_query(
    "rule_repeating_groups",
    cr.repeating_groups,
    f"""SELECT store, table_name || '.' || regexp_replace(column_name, '_?[0-9]+$', '') AS object FROM {C} WHERE regexp_matches(column_name, '[0-9]+$')
        GROUP BY store, table_name, regexp_replace(column_name, '_?[0-9]+$', '') HAVING count(*) >= 2""",
    "M1", "repeating_group", confidence="directional",
)
rule_query(
    "rule_denormalized_label",
    cr.denormalized_label,
    f"""SELECT DISTINCT l.store, l.table_name || '.' || l.column_name AS object FROM {C} l JOIN {C} d ON l.store = d.store AND l.table_name = d.table_name
        AND d.column_name = regexp_replace(l.column_name, '_(name|label)$', '_id') JOIN (SELECT DISTINCT store, table_name FROM {C}) e
        ON e.store = l.store AND regexp_replace(e.table_name, 's$', '') = regexp_replace(l.column_name, '_(name|label)$', '') AND e.table_name <> l.table_name
        WHERE regexp_matches(l.column_name, '_(name|label)$')""",
    "M1", "denormalized_label", confidence="directional",
)
rule_query("rule_int4_key", "int4_pk", f"SELECT {COL} FROM {C} WHERE pk AND type IN ('int', 'int4', 'integer', 'serial')", "M2", "int4_pk", "'warn'", "4", "both", "directional")
rule_query("rule_natural_key_pk", "natural_key_pk", f"SELECT {COL} FROM {C} WHERE pk AND column_name IN ('email', 'username', 'slug', 'external_id', 'ssn', 'phone')", "M2", "natural_key_pk", confidence="directional")
rule_query(
    "rule_composite_pk_order",
    cr.composite_pk_order,
    f"SELECT p.store, p.table_name AS object FROM {PKS} p JOIN {TENANT} t USING (store, table_name) WHERE len(pk) > 1 AND pk[1] <> 'tenant_id'",
    "M2", "composite_pk_order", axis="performance", confidence="directional",
)


@query(
    "rule_uuid_v4_key",
    f"""SELECT c.store, 'M2.' || lower(table_name || '.' || column_name) || '_uuidv4_clustered_pk' AS id,
        CASE WHEN major_version >= 18 THEN 'uuidv7()' ELSE 'time-ordered id from the application' END AS recommendation
        FROM {C} c JOIN {{estate_stores}} s ON s.store = c.store WHERE pk AND type = 'uuid' AND default_expr = 'gen_random_uuid()'""",
)
def _(i):
    return cr.uuid_v4_key(estate(i), i.estate_stores.select("store", "major_version")).select("store", "id", "recommendation")


FINANCIAL = "regexp_matches(lower(table_name), 'payment|invoice|transaction|account|order')"
rule_query(
    "rule_missing_fk",
    cr.missing_fk,
    f"""SELECT c.store, c.table_name, c.table_name || '.' || c.column_name AS object FROM {C} c WHERE c.column_name LIKE '%\\_id' ESCAPE '\\' AND NOT c.pk
        AND EXISTS (SELECT 1 FROM {PKS} p WHERE p.store = c.store AND regexp_replace(p.table_name, 's$', '') = regexp_replace(c.column_name, '_id$', ''))
        AND NOT EXISTS (SELECT 1 FROM {FKC} f WHERE f.store = c.store AND f.table_name = c.table_name AND f.column_name = c.column_name)""",
    "M3", f"(CASE WHEN {FINANCIAL} THEN 'no_fk_financial' ELSE 'no_fk' END)", f"CASE WHEN {FINANCIAL} THEN 'fail' ELSE 'warn' END", f"CASE WHEN {FINANCIAL} THEN 5 ELSE 3 END", "both",
)
rule_query(
    "rule_fk_action",
    "fk_action",
    f"""SELECT store, table_name || '.' || array_to_string(columns, '_') AS object, on_delete = 'CASCADE' AND {FINANCIAL} AS casc FROM {{estate_fks}}
        WHERE (on_delete = 'CASCADE' AND {FINANCIAL}) OR on_delete = ''""",
    "M3", "(CASE WHEN casc THEN 'fk_cascades_financial' ELSE 'fk_no_action' END)", "'warn'", "CASE WHEN casc THEN 4 ELSE 3 END",
)
rule_query(
    "rule_composite_fk_mismatch",
    cr.composite_fk_mismatch,
    f"""SELECT store, table_name || '.' || array_to_string(columns, '_') AS object FROM {{estate_fks}} f WHERE len(columns) > 1 AND NOT EXISTS (
        SELECT 1 FROM (SELECT store, table_name, pk AS cols FROM {PKS} p UNION ALL SELECT store, table_name, columns FROM {{estate_indexes}} WHERE is_unique) k
        WHERE k.store = f.store AND k.table_name = f.ref_table AND k.cols = f.ref_columns)""",
    "M3", "composite_fk_mismatch",
)
rule_query("rule_naive_timestamp", "naive_timestamp", f"SELECT {COL} FROM {C} WHERE type = 'timestamp'", "M4", "naive_timestamp", "'warn'", "4")
rule_query("rule_enum_lookup", "free_text_status", f"SELECT {COL} FROM {C} WHERE column_name = 'status' AND {TEXTY} AND NOT has_check", "M4", "free_text_status", "'warn'", "2", confidence="directional")
rule_query("rule_json_catch_all", "json_catch_all", f"SELECT {COL} FROM {C} WHERE type IN ('json', 'jsonb')", "M4", "json_catch_all", confidence="directional")


@query(
    "rule_constraint_inventory",
    f"""WITH u AS (SELECT store, table_name, column_name, 'PRIMARY KEY' AS constraint_type FROM {C} WHERE pk UNION SELECT store, table_name, column_name, 'UNIQUE' FROM {C} WHERE is_unique
          UNION SELECT store, table_name, column_name, 'CHECK' FROM {C} WHERE has_check UNION SELECT store, table_name, column_name, 'FOREIGN KEY' FROM {FKC} f)
        SELECT c.store, c.table_name, c.column_name, NOT c.not_null AS is_nullable, coalesce(u.constraint_type, '') AS constraint_type FROM {C} c LEFT JOIN u USING (store, table_name, column_name)""",
)
def _(i):
    return cr.constraint_inventory(estate(i))


rule_query("rule_missing_not_null", "nullable", f"SELECT {COL} FROM {C} WHERE NOT not_null AND regexp_matches(lower(column_name), '_id$|^status$|^created_at$|^email$')", "M5", "nullable")
rule_query("rule_missing_check", "no_check", f"SELECT {COL} FROM {C} WHERE NOT has_check AND regexp_matches(lower(column_name), 'quantity|price|amount|^status$|^valid_|_count$')", "M5", "no_check")
rule_query(
    "rule_missing_unique",
    cr.missing_unique,
    f"""SELECT {COL} FROM {C} c WHERE column_name IN ('email', 'slug', 'ssn', 'phone') AND NOT is_unique AND NOT pk AND NOT EXISTS
        (SELECT 1 FROM {{estate_indexes}} x WHERE x.store = c.store AND x.table_name = c.table_name AND x.is_unique AND x.columns = [c.column_name])""",
    "M5", "no_unique", "'warn'", "4", confidence="directional",
)
rule_query(
    "rule_over_nullable_unique",
    cr.over_nullable_unique,
    f"""SELECT DISTINCT x.store, x.table_name || '.' || x.index_name AS object FROM {{estate_indexes}} x JOIN {C} c ON c.store = x.store AND c.table_name = x.table_name
        AND list_contains(x.columns, c.column_name) WHERE x.is_unique AND NOT c.not_null""",
    "M5", "over_nullable_unique", "'warn'", "4",
)
rule_query("rule_unvalidated_constraint", "not_validated", "SELECT store, table_name || '.' || array_to_string(columns, '_') AS object FROM {estate_fks} WHERE NOT validated", "M5", "not_validated")
rule_query(
    "rule_default_inventory",
    "default",
    f"""SELECT store, table_name || '.' || column_name AS object, p FROM (
        SELECT *, 'no_default' AS p FROM {C} WHERE column_name IN ('created_at', 'updated_at') AND default_expr = ''
        UNION ALL SELECT *, 'app_maintained' FROM {C} WHERE column_name IN ('total_amount', 'full_name', 'item_count')
        UNION ALL SELECT *, 'default_empty_string' FROM {C} WHERE default_expr = ''''''
        UNION ALL SELECT *, 'serial_not_identity' FROM {C} WHERE type = 'serial'
        UNION ALL SELECT *, 'boolean_no_default' FROM {C} WHERE type = 'boolean' AND default_expr = '') t""",
    "M6", "(p)", "'warn'", "CASE WHEN p = 'app_maintained' THEN 3 ELSE 2 END", confidence="(CASE WHEN p = 'app_maintained' THEN 'directional' ELSE 'established' END)",
)


@query(
    "rule_naming_casing",
    f"""WITH s AS (SELECT store, count(*) FILTER (regexp_full_match(column_name, '[a-z0-9_]+')) AS snake, count(*) FILTER (regexp_matches(column_name, '^[a-z]+[A-Z]')) AS camel,
          count(*) FILTER (regexp_matches(column_name, '^[A-Z][a-z]')) AS pascal FROM {C} GROUP BY 1),
        t AS (SELECT store, count(*) FILTER (table_name LIKE '%s') AS plural, count(*) FILTER (table_name NOT LIKE '%s') AS singular, count(*) FILTER (regexp_matches(table_name, '[A-Z]')) AS cased_tables
          FROM (SELECT DISTINCT store, table_name FROM {C}) d GROUP BY 1)
        SELECT s.*, t.* EXCLUDE (store), CASE WHEN (snake > 0 AND camel + pascal + cased_tables > 0) OR (plural > 0 AND singular > 0) THEN 'warn' ELSE 'pass' END AS status FROM s JOIN t USING (store)""",
)
def _(i):
    return cr.naming_casing(estate(i))


rule_query(
    "rule_reserved_word",
    reserved_words,
    f"SELECT DISTINCT store, table_name AS object FROM {C} WHERE table_name IN ('user', 'order') UNION ALL SELECT {COL} FROM {C} WHERE column_name IN ('order')",
    "M7", "reserved_word", "'warn'", "2", confidence="directional",
)
rule_query(
    "rule_fk_naming",
    "fk_naming",
    "SELECT store, table_name || '.' || columns[1] AS object FROM {estate_fks} WHERE len(columns) = 1 AND columns[1] <> regexp_replace(ref_table, 's$', '') || '_id'",
    "M7", "fk_naming", "'warn'", "1", confidence="directional",
)
rule_query("rule_boolean_prefix", "boolean_unprefixed", f"SELECT {COL} FROM {C} WHERE {BOOL} AND NOT regexp_matches(column_name, '^(is|has|can)_')", "M7", "boolean_unprefixed", "'warn'", "1", confidence="directional")
rule_query(
    "rule_opaque_name",
    "opaque_name",
    f"SELECT {COL} FROM {C} WHERE column_name IN ('data', 'value', 'tmp') OR (type LIKE 'timestamp%' AND NOT regexp_matches(column_name, '_at$|^valid_'))",
    "M7", "opaque_name", "'warn'", "1", confidence="directional",
)
rule_query(
    "rule_soft_delete_consistency",
    cr.soft_delete_consistency,
    f"""SELECT store, store AS object FROM (SELECT store, table_name, bool_or(column_name IN ('deleted_at', 'is_deleted')) AS s FROM {C} GROUP BY 1, 2) t
        GROUP BY store HAVING bool_or(s) AND NOT bool_and(s)""",
    "M8", "soft_delete_inconsistent", confidence="directional",
)
rule_query(
    "rule_no_audit_companion",
    cr.no_audit_companion,
    f"""WITH t AS (SELECT DISTINCT store, table_name FROM {C}) SELECT store, table_name AS object FROM t WHERE regexp_matches(lower(table_name), 'payment|invoice|transaction|account|permission|order|user')
        AND NOT regexp_matches(lower(table_name), '_(history|audit|log)$') AND NOT EXISTS (SELECT 1 FROM t h WHERE h.store = t.store AND lower(h.table_name) IN (lower(t.table_name) || '_history', lower(t.table_name) || '_audit', lower(t.table_name) || '_log'))""",
    "M8", "no_audit_trail", confidence="directional",
)
PII = "regexp_matches(lower(column_name), 'email|ssn|phone|birth|dob|address|addr|card|full_name')"
rule_query("rule_pii_columns", "pii_unprotected", f"SELECT {COL} FROM {C} WHERE {PII}", "M10", "pii_unprotected", confidence="directional")
rule_query(
    "rule_pii_no_retention",
    "pii_no_retention_or_erasure",
    f"SELECT store, table_name AS object FROM {C} GROUP BY 1, 2 HAVING bool_or({PII}) AND NOT bool_or(column_name LIKE '%retention%')",
    "M8", "pii_no_retention_or_erasure", "'warn'", "4", confidence="directional",
)
rule_query("rule_plaintext_secret_column", "plaintext_secret", f"SELECT {COL} FROM {C} WHERE column_name IN ('api_token', 'password') AND {TEXTY}", "M10", "plaintext_secret", "'fail'", "5")
rule_query(
    "rule_tenant_missing",
    cr.tenant_missing,
    f"""WITH t AS (SELECT store, table_name, bool_or(column_name IN ('tenant_id', 'org_id', 'account_id')) AS s, bool_or(column_name IN ('tenant_id', 'org_id', 'account_id') AND not_null) AS n FROM {C} GROUP BY 1, 2)
        SELECT store, table_name AS object FROM t WHERE NOT n AND store IN (SELECT store FROM t WHERE s)""",
    "M9", "no_tenant_scope", "'warn'", "4", "both",
)
rule_query(
    "rule_tenant_not_leading",
    lambda c: cr.tenant_indexes(c, ["index_not_tenant_leading"]),
    f"""SELECT x.store, x.table_name || '.' || index_name AS object FROM {{estate_indexes}} x JOIN {TENANTS} t USING (store, table_name) WHERE NOT list_contains(tenants, x.columns[1])
        UNION ALL SELECT p.store, p.table_name || '.pk' FROM {PKS} p JOIN {TENANTS} t USING (store, table_name) WHERE len(pk) > 1 AND NOT list_contains(tenants, pk[1])""",
    "M9", "index_not_tenant_leading", axis="performance",
)
rule_query(
    "rule_tenant_unique",
    lambda c: cr.tenant_indexes(c, ["unique_omits_tenant"]),
    f"""SELECT x.store, x.table_name || '.' || index_name AS object FROM {{estate_indexes}} x JOIN {TENANTS} t USING (store, table_name) WHERE is_unique AND NOT list_has_any(x.columns, tenants)
        UNION ALL SELECT f.store, f.table_name || '.' || array_to_string(f.columns, '_') FROM {{estate_fks}} f JOIN {TENANTS} t USING (store, table_name)
        JOIN {TENANTS} r ON r.store = f.store AND r.table_name = f.ref_table WHERE NOT list_has_any(f.columns, t.tenants)""",
    "M9", "unique_omits_tenant", "'warn'", "4", "both",
)


@query(
    "rule_index_duplicate",
    "SELECT store, table_name, lower(array_to_string(columns, ',')) AS cols, CAST(count(*) AS BIGINT) AS copies, min(index_name) AS keep FROM {estate_indexes} GROUP BY 1, 2, 3 HAVING count(*) > 1",
)
def _(i):
    return cr.index_duplicate(estate(i))


rule_query(
    "rule_index_redundant_prefix",
    cr.index_redundant_prefix,
    """SELECT store, table_name || '.' || index_name AS object FROM {estate_indexes} a WHERE NOT is_unique AND EXISTS (SELECT 1 FROM {estate_indexes} b
       WHERE b.store = a.store AND b.table_name = a.table_name AND len(b.columns) > len(a.columns) AND b.columns[1:len(a.columns)] = a.columns)""",
    "M12", "redundant_prefix", axis="performance",
)


@query(
    "rule_index_esr",
    """WITH u AS (SELECT store, table_name, column_name, min(CASE role WHEN 'equality' THEN 1 WHEN 'sort' THEN 2 ELSE 3 END) AS r FROM {estate_predicates} GROUP BY 1, 2, 3),
       m AS (SELECT store, table_name, index_name, unnest(columns) AS column_name, generate_subscripts(columns, 1) AS pos FROM {estate_indexes} WHERE len(columns) > 1),
       o AS (SELECT store, table_name, index_name, list(r ORDER BY pos) AS rs FROM m JOIN u USING (store, table_name, column_name) GROUP BY ALL)
       SELECT store, 'M11.' || lower(table_name || '.' || index_name) || '_esr_order' AS id FROM o WHERE rs <> list_sort(rs)""",
)
def _(i):
    return cr.findings(cr.index_esr(estate(i), i.estate_predicates)).select("store", "id")


@query(
    "rule_index_type_fit",
    f"""SELECT p.store, 'M11.' || lower(p.table_name || '.' || p.column_name) || '_index_type' AS id FROM {{estate_predicates}} p JOIN {C} c USING (store, table_name, column_name)
        WHERE role = 'containment' AND (c.type IN ('json', 'jsonb') OR {TEXTY.replace('type', 'c.type')})""",
)
def _(i):
    return cr.findings(cr.index_type_fit(estate(i), i.estate_predicates)).select("store", "id")


@query(
    "rule_god_table",
    f"SELECT store, table_name, CAST(count(*) AS BIGINT) AS n_columns, CAST(count(*) FILTER (NOT not_null) AS BIGINT) AS nullable FROM {C} GROUP BY 1, 2 HAVING count(*) >= 30 AND count(*) FILTER (NOT not_null) * 10000 >= count(*) * 2500",
)
def _(i):
    return cr.god_table(estate(i))


rule_query(
    "rule_boolean_soup",
    "boolean_soup",
    f"SELECT store, table_name AS object FROM {C} WHERE {BOOL} AND regexp_matches(column_name, '^(is|has|can)_') GROUP BY 1, 2 HAVING count(*) >= 3",
    "M19", "boolean_soup", confidence="directional",
)


@query(
    "rule_deep_nesting",
    "SELECT template_no, CAST(count(*) AS BIGINT) AS documents, CAST(3 AS INT) AS max_depth, CAST(count(*) AS BIGINT) AS too_deep FROM {statements_fx} GROUP BY 1",
)
def _(i):
    docs = i.payloads_fx.withColumn("template_no", F.col("event_id") % 24)
    return cr.deep_nesting(docs, "template_no", "payload", 2)


@query(
    "rule_confidence_downgrade",
    f"SELECT store, 'M19.' || lower(table_name) || '.no_primary_key' AS id, 'needs_api' AS status, 'speculative' AS confidence FROM {C} GROUP BY store, table_name HAVING NOT bool_or(pk)",
)
def _(i):
    model = estate(i).with_confidence("directional")
    return cr.run_rules(model, [lambda c: cr.table_rules(c, ["no_primary_key"])]).select("store", "id", "status", "confidence")


UUID_SQL = f"SELECT store, 'M2.' || table_name AS id, 'warn' AS status, CAST(3 AS INT) AS severity, '' AS axis, '' AS confidence, '' AS object FROM {C} WHERE pk AND type = 'uuid' AND default_expr = 'gen_random_uuid()'"


@query(
    "catalog_rules_all",
    f"""SELECT split_part(id, '.', 1) AS module, status, severity, CAST(count(*) AS BIGINT) AS findings FROM ({' UNION ALL '.join([*RULE_SQL, UUID_SQL])}) r GROUP BY 1, 2, 3""",
)
def _(i):
    return cr.run_rules(estate(i).stored()).groupBy("module", "status", "severity").agg(F.count(F.lit(1)).alias("findings"))


# --- diff ---------------------------------------------------------------------------------------

SIDES = """k AS (SELECT store, table_name, column_name, a.column_name IS NOT NULL AS ina, b.column_name IS NOT NULL AS inb, a.type AS a_t, b.type AS b_t, a.not_null AS a_n, b.not_null AS b_n,
     a.default_expr AS a_d, b.default_expr AS b_d, a.pk AS a_p, b.pk AS b_p, a.is_identity AS a_i, b.is_identity AS b_i, a.ordinal AS a_o, b.ordinal AS b_o
   FROM {estate_columns} a FULL JOIN {estate_next_columns} b USING (store, table_name, column_name)),
 t AS (SELECT store, table_name, bool_or(ina) AS ta, bool_or(inb) AS tb FROM k GROUP BY 1, 2),
 kt AS (SELECT * FROM k JOIN t USING (store, table_name)),
 ch AS (SELECT *, 'add_column' AS kind FROM kt WHERE ta AND tb AND NOT ina UNION ALL SELECT *, 'drop_column' FROM kt WHERE ta AND tb AND NOT inb
   UNION ALL SELECT *, 'alter_type' FROM kt WHERE ina AND inb AND a_t <> b_t UNION ALL SELECT *, 'set_not_null' FROM kt WHERE ina AND inb AND a_t = b_t AND NOT a_n AND b_n
   UNION ALL SELECT *, 'set_default' FROM kt WHERE ina AND inb AND a_t = b_t AND a_d <> b_d)"""
CHANGES = """rows_out AS (SELECT store, kind, table_name || '.' || column_name AS object, coalesce(a_t, '') AS from_type, coalesce(b_t, '') AS to_type, kind = 'drop_column' AS destructive,
     CASE WHEN kind = 'add_column' AND b_n AND b_d = '' THEN 'backfill before enforcing NOT NULL' WHEN kind = 'alter_type' THEN 'check that the type is not narrower'
          WHEN kind = 'set_not_null' THEN 'backfill NULLs first' ELSE '' END AS note FROM ch
   UNION ALL SELECT store, CASE WHEN ta THEN 'drop_table' ELSE 'add_table' END, table_name, '', '', ta, '' FROM t WHERE ta <> tb)"""


@query("schema_diff_changes", f"WITH {SIDES}, {CHANGES} SELECT * FROM rows_out")
def _(i):
    return diff.schema_diff_changes(i.estate_columns, i.estate_next_columns)


RW = ", ".join(f"'{w}'" for w in tx.RESERVED_WORDS)


def qi(name: str) -> str:
    return f"""CASE WHEN regexp_full_match({name}, '[a-z_][a-z0-9_]*') AND lower({name}) NOT IN ({RW}) THEN {name} ELSE '"' || {name} || '"' END"""


def mt(t: str) -> str:
    return f"CASE {t} WHEN 'int' THEN 'integer' WHEN 'json' THEN 'jsonb' WHEN 'boolean' THEN 'boolean' ELSE {t} END"


def ddl(s: str) -> str:
    return f"""{qi('column_name')} || ' ' || {mt(s + '_t')} || CASE WHEN {s}_n THEN ' NOT NULL' ELSE '' END
      || CASE WHEN {s}_d <> '' AND NOT {s}_i THEN ' DEFAULT ' || {s}_d ELSE '' END || CASE WHEN {s}_p THEN ' PRIMARY KEY' ELSE '' END"""


@query(
    "schema_diff_sql",
    f"""WITH {SIDES}, q AS (SELECT *, 'ALTER TABLE ' || {qi('table_name')} AS alt, {qi('column_name')} AS c FROM ch),
        tabs AS (SELECT store, table_name, ta, string_agg(CASE WHEN ta THEN {ddl('a')} ELSE {ddl('b')} END, ',' || chr(10) || '  ' ORDER BY coalesce(b_o, a_o)) AS body FROM kt WHERE ta <> tb GROUP BY 1, 2, 3),
        mk AS (SELECT *, 'CREATE TABLE ' || {qi('table_name')} || ' (' || chr(10) || '  ' || body || chr(10) || ');' AS cr, 'DROP TABLE ' || {qi('table_name')} || ';' AS dr FROM tabs)
        SELECT store, kind, table_name || '.' || column_name AS object,
          CASE kind WHEN 'add_column' THEN alt || ' ADD COLUMN ' || {ddl('b')} || ';' WHEN 'drop_column' THEN '-- DESTRUCTIVE' || chr(10) || alt || ' DROP COLUMN ' || c || ';'
            WHEN 'alter_type' THEN alt || ' ALTER COLUMN ' || c || ' TYPE ' || {mt('b_t')} || ';' WHEN 'set_not_null' THEN alt || ' ALTER COLUMN ' || c || ' SET NOT NULL;'
            ELSE alt || ' ALTER COLUMN ' || c || CASE WHEN b_d = '' THEN ' DROP DEFAULT;' ELSE ' SET DEFAULT ' || b_d || ';' END END AS up_sql,
          CASE kind WHEN 'add_column' THEN alt || ' DROP COLUMN ' || c || ';' WHEN 'drop_column' THEN alt || ' ADD COLUMN ' || {ddl('a')} || ';'
            WHEN 'alter_type' THEN alt || ' ALTER COLUMN ' || c || ' TYPE ' || {mt('a_t')} || ';' WHEN 'set_not_null' THEN alt || ' ALTER COLUMN ' || c || ' DROP NOT NULL;'
            ELSE alt || ' ALTER COLUMN ' || c || CASE WHEN a_d = '' THEN ' DROP DEFAULT;' ELSE ' SET DEFAULT ' || a_d || ';' END END AS down_sql FROM q
        UNION ALL SELECT store, CASE WHEN ta THEN 'drop_table' ELSE 'add_table' END, table_name, CASE WHEN ta THEN '-- DESTRUCTIVE' || chr(10) || dr ELSE cr END,
          CASE WHEN ta THEN '-- structure only' || chr(10) || cr ELSE dr END FROM mk""",
)
def _(i):
    return diff.schema_diff(i.estate_columns, i.estate_next_columns).select("store", "kind", "object", "up_sql", "down_sql")


@query(
    "schema_diff_summary",
    f"""WITH {SIDES}, {CHANGES}, s AS (SELECT store, CAST(count(*) AS BIGINT) AS changes, bool_or(destructive) AS destructive, CAST(count(*) FILTER (note <> '') AS BIGINT) AS notes FROM rows_out GROUP BY 1),
        g AS (SELECT store, bool_or(type IN ('int', 'bigint', 'boolean', 'date', 'json', 'uuid')) AS g FROM (SELECT store, type FROM {{estate_columns}} UNION ALL SELECT store, type FROM {{estate_next_columns}}) u GROUP BY 1)
        SELECT s.*, destructive OR notes > 0 AS requires_review, CASE WHEN g THEN 'directional' ELSE 'established' END AS confidence FROM s JOIN g USING (store)""",
)
def _(i):
    return diff.schema_diff_summary(i.estate_columns, i.estate_next_columns)


def _keys_sql(name: str, columns: str, indexes: str, fks: str) -> str:
    return f"""{name} AS (SELECT store, 'index' AS what, table_name || '(' || CASE WHEN is_unique THEN 'unique ' ELSE '' END || array_to_string(columns, ',') || ')' AS object FROM {indexes}
      UNION SELECT store, 'fk', table_name || '(' || array_to_string(columns, ',') || ' -> ' || ref_table || '.' || array_to_string(ref_columns, ',') || ')' FROM {fks}
      UNION SELECT store, 'not_null', table_name || '(' || column_name || ')' FROM {columns} WHERE not_null)"""


@query(
    "schema_diff_keys",
    f"""WITH {_keys_sql('a', '{estate_next_columns}', '{estate_indexes}', '{estate_fks}')}, {_keys_sql('b', '{estate_columns}', '{estate_next_indexes}', '{estate_next_fks}')},
        g AS (SELECT * FROM a EXCEPT SELECT * FROM b), n AS (SELECT * FROM b EXCEPT SELECT * FROM a)
        SELECT store, object, 'drop_' || what AS kind FROM g WHERE what <> 'not_null' OR (store, object) IN (SELECT (store, table_name || '(' || column_name || ')') FROM {{estate_columns}})
        UNION ALL SELECT store, object, 'add_' || what FROM n WHERE what <> 'not_null'""",
)
def _(i):
    before = {"columns": i.estate_next_columns, "indexes": i.estate_indexes, "fks": i.estate_fks}
    after = {"columns": i.estate_columns, "indexes": i.estate_next_indexes, "fks": i.estate_next_fks}
    return diff.key_changes(before, after)


DRIFT_KEY = ["store", "table_name", "column_name", "type"]


@query(
    "schema_drift",
    """SELECT *, 'artifact_only' AS drift FROM (SELECT store, table_name, column_name, type FROM {estate_columns} EXCEPT ALL SELECT store, table_name, column_name, type FROM {estate_next_columns}) a
       UNION ALL SELECT *, 'history_only' FROM (SELECT store, table_name, column_name, type FROM {estate_next_columns} EXCEPT ALL SELECT store, table_name, column_name, type FROM {estate_columns}) b""",
)
def _(i):
    return diff.schema_drift(i.estate_columns, i.estate_next_columns, DRIFT_KEY)


@query(
    "catalog_union",
    """SELECT store, CAST(count(*) AS BIGINT) AS columns, CAST(count(DISTINCT table_name) AS BIGINT) AS tables FROM
       (SELECT store, table_name FROM {estate_columns} UNION ALL SELECT store || '_next', table_name FROM {estate_next_columns}) u GROUP BY 1""",
)
def _(i):
    other = i.estate_next_columns.withColumn("store", F.concat("store", F.lit("_next")))
    merged = diff.catalog_union([i.estate_columns, other]).groupBy("store", "table_name").agg(F.count(F.lit(1)).alias("n"))
    return merged.groupBy("store").agg(F.sum("n").alias("columns"), F.count(F.lit(1)).alias("tables"))


@query("catalog_intersect", "SELECT store, table_name FROM {estate_columns} INTERSECT SELECT store, table_name FROM {estate_next_columns}")
def _(i):
    return diff.shared_tables(i.estate_columns, i.estate_next_columns)


@query(
    "data_diff",
    """SELECT o_orderkey, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
       CASE WHEN a.o_custkey IS NULL OR b.o_custkey IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END,
         CASE WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'o_totalprice' END], lambda x: x IS NOT NULL), ',') END AS columns
       FROM orders a FULL JOIN {orders_next_fx} b USING (o_orderkey)
       WHERE a.o_custkey IS NULL OR b.o_custkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_totalprice IS DISTINCT FROM b.o_totalprice""",
)
def _(i):
    return diff.data_diff(i.orders, i.orders_next_fx, "o_orderkey", ["o_custkey", "o_orderstatus", "o_totalprice"])


# --- state rules --------------------------------------------------------------------------------


def _metric_values() -> str:
    return ", ".join(f"('{r}', '{m}', '{c}', {t}, {d}, '{mod}', '{s}', {sev})" for r, m, c, t, d, mod, s, sev in sr.METRIC_RULES)


@query(
    "metric_rules",
    f"""WITH r(rule, metric, cmp, threshold, days, module, rs, severity) AS (VALUES {_metric_values()}),
        l AS (SELECT store, object, metric, arg_max(value, ts) AS value, epoch_us(max(ts)) - epoch_us(min(ts)) AS w FROM {{metrics_fx}} GROUP BY 1, 2, 3),
        g AS (SELECT * FROM (SELECT DISTINCT store, object FROM l) o, r)
        SELECT g.store, g.module || '.' || g.object || '.' || rule AS id, g.module, CASE WHEN value IS NULL THEN 'needs_api'
          WHEN (cmp = '<=' AND value <= threshold) OR (cmp = '>' AND value > threshold) OR (cmp = '>=' AND value >= threshold) THEN rs ELSE 'pass' END AS status, g.severity, 'performance' AS axis,
          CASE WHEN value IS NULL THEN 'speculative' WHEN w < days * 86400000000 THEN 'directional' ELSE 'established' END AS confidence, g.object
        FROM g LEFT JOIN l ON l.store = g.store AND l.object = g.object AND l.metric = g.metric""",
)
def _(i):
    return sr.metric_rules(i.metrics_fx)


@query(
    "top_dead_tuples",
    """SELECT store, object, value AS dead_ratio, CAST(row_number() OVER (PARTITION BY store ORDER BY value DESC, object) AS INT) AS rank
       FROM (SELECT store, object, arg_max(value, ts) AS value FROM {metrics_fx} WHERE metric = 'dead_ratio' GROUP BY 1, 2) l QUALIFY rank <= 20""",
)
def _(i):
    return sr.top_dead_tuples(i.metrics_fx)


POOLS = """SELECT 's' || CAST(s_nationkey AS STRING) AS store, 'p' || CAST(s_suppkey AS STRING) AS object, DATE '2024-01-01' AS ts,
  split_part('pool_size|instances|max_connections|cores', '|', CAST(m AS INT)) AS metric, CAST(CASE m WHEN 1 THEN 2 + s_suppkey % 20 WHEN 2 THEN 1 + s_suppkey % 7 WHEN 3 THEN 100 ELSE 4 * (1 + s_suppkey % 5) END AS DOUBLE) AS value
  FROM supplier CROSS JOIN (VALUES (1), (2), (3), (4)) v(m) WHERE m <> 1 + s_suppkey % 9"""


@query(
    "pool_capacity",
    f"""WITH h AS ({POOLS}), w AS (SELECT store, object, max(value) FILTER (metric = 'pool_size') * max(value) FILTER (metric = 'instances') AS connections,
         max(value) FILTER (metric = 'max_connections') - 3 AS room, max(value) FILTER (metric = 'cores') AS cores FROM h GROUP BY 1, 2)
       SELECT store, object, connections, room, CASE WHEN connections IS NULL OR room IS NULL THEN 'needs_api' WHEN connections > room THEN 'fail' WHEN connections > 2 * cores + 1 THEN 'warn' ELSE 'pass' END AS status FROM w""",
)
def _(i):
    values = F.array(
        (2 + F.col("s_suppkey") % 20).cast("double"), (1 + F.col("s_suppkey") % 7).cast("double"), F.lit(100.0), (4 * (1 + F.col("s_suppkey") % 5)).cast("double")
    )
    names = F.array(*[F.lit(m) for m in ("pool_size", "instances", "max_connections", "cores")])
    history = i.supplier.select(
        F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("store"), F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("object"),
        F.lit("2024-01-01").cast("date").alias("ts"), F.posexplode(F.arrays_zip(names.alias("metric"), values.alias("value"))).alias("m", "x"), "s_suppkey",
    ).where(F.col("m") != F.col("s_suppkey") % 9)
    return sr.pool_capacity(history.select("store", "object", "ts", F.col("x.metric").alias("metric"), F.col("x.value").alias("value")))


@query(
    "metric_trend",
    """WITH s AS (SELECT store, object, CAST(count(*) AS BIGINT) AS samples, arg_min(value, ts) AS first_value, arg_max(value, ts) AS last_value, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us
         FROM {metrics_fx} WHERE metric = 'xid_age_pct' GROUP BY 1, 2)
       SELECT *, CASE WHEN last_value <= first_value OR span_us = 0 THEN -1 WHEN last_value >= 100 THEN 0
         ELSE CAST(floor(((100.0::DOUBLE - last_value) / (last_value - first_value)) * (span_us / 86400000000)) AS BIGINT) END AS days_to_ceiling FROM s""",
)
def _(i):
    return sr.metric_trend(i.metrics_fx, "xid_age_pct", 100.0)


URL_REDACTED = "regexp_replace(url, ':pw[0-9]+@', ':****@')"


@query(
    "config_rules",
    f"""WITH m AS (SELECT store, max(value) FILTER (key = 'url') AS url, max(value) FILTER (key = 'runtime') AS runtime, max(value) FILTER (key = 'charset') AS charset,
          max(value) FILTER (key = 'validator') AS validator, max(value) FILTER (key = 'appendonly') AS appendonly, max(value) FILTER (key = 'ttl_policy') AS ttl, max(value) FILTER (key = 'retention_policy') AS ret,
          max(value) FILTER (key = 'compression_policy') AS comp, max(value) FILTER (key = 'rollup_policy') AS roll, max(value) FILTER (key = 'lookup_index') AS look, max(value) FILTER (key = 'model_version') AS mv,
          max(value) FILTER (key = 'ann_index') AS ann, max(value) FILTER (key = 'matview_refresh') AS mat, max(value) FILTER (key = 'autovacuum') AS av FROM {{config_fx}} GROUP BY 1),
        h AS (SELECT store, 'conn_insecure' AS rule, 'M10' AS module, 4 AS severity, {URL_REDACTED} AS observed FROM m WHERE url LIKE '%sslmode=disable%'
          UNION ALL SELECT store, 'pooler_session_features', 'M15', 4, {URL_REDACTED} FROM m WHERE url LIKE '%:6543/%' AND url LIKE '%prepared_statements=true%'
          UNION ALL SELECT store, 'serverless_direct', 'M15', 4, {URL_REDACTED} FROM m WHERE url LIKE '%:5432/%' AND runtime IN ('vercel', 'lambda')
          UNION ALL SELECT store, 'charset', 'M4', 3, charset FROM m WHERE charset IN ('utf8', 'utf8mb3')
          UNION ALL SELECT store, 'doc_validator_off', 'M5', 3, validator FROM m WHERE validator = 'none'
          UNION ALL SELECT store, 'doc_validator_missing', 'M5', 3, '(missing)' FROM m WHERE validator IS NULL
          UNION ALL SELECT store, 'kv_not_durable', 'M12', 4, appendonly FROM m WHERE appendonly = 'no'
          UNION ALL SELECT store, 'kv_no_ttl', 'M8', 3, '(missing)' FROM m WHERE ttl IS NULL
          UNION ALL SELECT store, 'timeseries_no_retention', 'M8', 3, '(missing)' FROM m WHERE ret IS NULL
          UNION ALL SELECT store, 'timeseries_no_compression', 'M18', 3, '(missing)' FROM m WHERE comp IS NULL
          UNION ALL SELECT store, 'timeseries_no_rollup', 'M17', 3, '(missing)' FROM m WHERE roll IS NULL
          UNION ALL SELECT store, 'matview_no_refresh', 'M17', 2, '(missing)' FROM m WHERE mat IS NULL
          UNION ALL SELECT store, 'matview_blocks_readers', 'M17', 2, mat FROM m WHERE mat = 'blocking'
          UNION ALL SELECT store, 'autovacuum_disabled', 'M18', 3, av FROM m WHERE av = 'off'
          UNION ALL SELECT store, 'graph_lookup_unindexed', 'M11', 3, '(missing)' FROM m WHERE look IS NULL
          UNION ALL SELECT store, 'vector_model_unversioned', 'M19', 3, '(missing)' FROM m WHERE mv IS NULL
          UNION ALL SELECT store, 'vector_no_index', 'M11', 4, '(missing)' FROM m WHERE ann IS NULL)
        SELECT store, module || '.' || store || '.' || rule AS id, module, 'warn' AS status, CAST(severity AS INT) AS severity, observed FROM h""",
)
def _(i):
    return sr.config_rules(i.config_fx)


@query(
    "platform_capability",
    """SELECT s.store, platform, CAST(count(*) AS BIGINT) AS declared_fks, CASE WHEN platform = 'd1' THEN 'needs_api' ELSE 'fail' END AS status, CAST(CASE WHEN platform = 'd1' THEN 3 ELSE 4 END AS INT) AS severity
       FROM {estate_stores} s JOIN {estate_fks} f ON f.store = s.store WHERE platform IN ('planetscale', 'dynamodb', 'mongodb', 'd1') GROUP BY 1, 2""",
)
def _(i):
    return sr.platform_capability(i.estate_stores, i.estate_fks).select("store", "platform", "declared_fks", "status", "severity")


@query(
    "platform_versions",
    "SELECT store, platform, major_version FROM {estate_stores} WHERE (platform = 'postgres' AND major_version < 14) OR (platform = 'mysql' AND major_version < 8)",
)
def _(i):
    return sr.old_engine_versions(i.estate_stores, {"postgres": 14, "mysql": 8})


@query(
    "rls_state",
    f"""SELECT p.store, p.table_name, CASE WHEN NOT rls_enabled THEN 'fail' WHEN policy_count = 0 THEN 'warn' ELSE 'pass' END AS status,
        CAST(CASE WHEN NOT rls_enabled THEN 5 WHEN policy_count = 0 THEN 3 ELSE 1 END AS INT) AS severity FROM {{estate_policies}} p JOIN {TENANT} t USING (store, table_name)""",
)
def _(i):
    tenants = i.estate_columns.where("column_name = 'tenant_id'").select("store", "table_name").distinct()
    return sr.rls_state(i.estate_policies, tenants)


@query(
    "derived_as_source",
    "SELECT object_id, CAST(count(*) AS BIGINT) AS writes FROM {access_fx} WHERE action = 'write' AND object_id % 5 = 0 GROUP BY 1",
)
def _(i):
    roles = i.access_fx.select("object_id").distinct().withColumn("role", F.when(F.col("object_id") % 5 == 0, "derived").otherwise("source"))
    return sr.derived_as_source(roles, i.access_fx.where("action = 'write'"))


@query(
    "largest_tables",
    "SELECT * FROM {estate_sizes} ORDER BY size_bytes DESC, store, table_name LIMIT 20",
)
def _(i):
    return sr.largest_tables(i.estate_sizes)


@query(
    "partition_inventory",
    "SELECT store, CAST(count(*) FILTER (partitioned) AS BIGINT) AS partitioned, CAST(count(*) FILTER (NOT partitioned AND size_bytes > 50000000000) AS BIGINT) AS large_unpartitioned, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM {estate_sizes} GROUP BY 1",
)
def _(i):
    return i.estate_sizes.groupBy("store").agg(
        F.count_if("partitioned").alias("partitioned"),
        F.count_if(~F.col("partitioned") & (F.col("size_bytes") > 50_000_000_000)).alias("large_unpartitioned"),
        F.sum("size_bytes").alias("bytes"),
    )


@query(
    "premature_sharding",
    """SELECT * FROM (SELECT store, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, CAST(1 + max(est_rows) % 4 AS BIGINT) AS shards FROM {estate_sizes} GROUP BY 1) s WHERE shards > 1 AND size_bytes < 1000000000000""",
)
def _(i):
    per_store = i.estate_sizes.groupBy("store").agg(F.sum("size_bytes").alias("size_bytes"), (F.max("est_rows") % 4 + 1).alias("shards"))
    return sr.premature_sharding(per_store, 1_000_000_000_000)


@query(
    "tier_inputs",
    "SELECT DISTINCT store, r.m || '.' || store || '.' || r.rule AS id, r.m AS module, 'needs_api' AS status, CAST(r.s AS INT) AS severity, CAST(1 AS INT) AS tier FROM {estate_columns}, (VALUES ('index_unused', 'M12', 3), ('vacuum_wraparound', 'M18', 5), ('hot_statements', 'M13', 3)) r(rule, m, s)",
)
def _(i):
    frames = {"catalog": i.estate_columns, "data": i.orders, "metrics": None, "log": None}
    needs = {
        "index_unused": ("metrics", "M12", 3),
        "vacuum_wraparound": ("metrics", "M18", 5),
        "hot_statements": ("log", "M13", 3),
        "orphans": ("data", "M3", 5),
    }
    return sr.stamp_missing(i.spark, i.estate_columns.select("store"), frames, needs)


# --- graph of the catalog, seed -----------------------------------------------------------------

EDGES = """e AS (SELECT DISTINCT f.store, f.table_name AS child, f.ref_table AS parent FROM {estate_fks} f JOIN (SELECT DISTINCT store, table_name FROM {estate_columns}) n ON n.store = f.store AND n.table_name = f.ref_table WHERE f.table_name <> f.ref_table),
  reach AS (SELECT store, child, parent FROM e UNION SELECT r.store, r.child, e.parent FROM reach r JOIN e ON e.store = r.store AND e.child = r.parent)"""


@query(
    "fk_cycles",
    f"""WITH RECURSIVE {EDGES}, c AS (SELECT store, child AS table_name FROM reach WHERE child = parent),
        sz AS (SELECT a.store, a.table_name, 1 + (SELECT count(*) FROM reach x JOIN reach y ON x.store = y.store AND x.child = y.parent AND x.parent = y.child WHERE x.store = a.store AND x.child = a.table_name AND x.parent <> a.table_name) AS n FROM c a)
        SELECT store, table_name, CAST(n AS BIGINT) AS cycle_tables, CAST(4 AS INT) AS severity FROM sz""",
)
def _(i):
    return graph.fk_cycles(i.estate_columns, i.estate_fks)


@query(
    "load_order",
    f"""WITH RECURSIVE {EDGES}, bad AS (SELECT DISTINCT store, child AS table_name FROM reach r WHERE child = parent OR EXISTS (SELECT 1 FROM reach c WHERE c.store = r.store AND c.child = r.parent AND c.parent = r.parent)),
        n AS (SELECT DISTINCT store, table_name FROM {{estate_columns}}),
        lv AS (SELECT store, table_name, 0 AS l FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.store = n.store AND e.child = n.table_name)
          UNION SELECT e.store, e.child, lv.l + 1 FROM lv JOIN e ON e.store = lv.store AND e.parent = lv.table_name WHERE lv.l < 25)
        SELECT n.store, n.table_name, CAST(CASE WHEN b.table_name IS NOT NULL THEN -1 ELSE max(lv.l) END AS INT) AS level
        FROM n LEFT JOIN bad b USING (store, table_name) LEFT JOIN lv USING (store, table_name) GROUP BY n.store, n.table_name, b.table_name""",
)
def _(i):
    return graph.load_order(i.estate_columns, i.estate_fks)


def seed_sql(name: str, t: str, pk: str, allowed: str) -> str:
    n = "CAST(i + 1 AS VARCHAR)"
    return f"""CASE WHEN {allowed} THEN split_part('new,done', ',', CAST(i % 2 + 1 AS INT)) WHEN {t} = 'uuid' THEN '00000000-0000-0000-0000-' || lpad({n}, 12, '0')
      WHEN {pk} OR {t} IN ('serial', 'bigint', 'int', 'integer') THEN {n} WHEN {t} = 'boolean' THEN CASE WHEN i % 2 = 0 THEN 'true' ELSE 'false' END
      WHEN regexp_matches({t}, 'timestamp|date') THEN '2026-01-0' || CAST(i % 9 + 1 AS VARCHAR) || 'T12:00:00Z' WHEN regexp_matches({t}, 'numeric|double|real') THEN CAST(i + 10 AS VARCHAR) || '.00'
      WHEN {name} = 'email' THEN 'user' || {n} || '@example.com' WHEN {t} LIKE 'json%' THEN chr(123) || chr(125) ELSE {name} || '_' || {n} END"""


@query(
    "seed_rows",
    f"""WITH l AS (SELECT store, table_name, unnest(columns) AS column_name, ref_table, unnest(ref_columns) AS ref_column FROM {{estate_fks}}),
        l1 AS (SELECT store, table_name, column_name, min((ref_table, ref_column)) AS r FROM l GROUP BY 1, 2, 3),
        w AS (SELECT c.*, l1.r IS NOT NULL AS linked, p.type AS ptype FROM {C} c LEFT JOIN l1 USING (store, table_name, column_name)
              LEFT JOIN {C} p ON p.store = c.store AND p.table_name = l1.r[1] AND p.column_name = l1.r[2] WHERE NOT c.is_identity AND c.default_expr = '')
        SELECT store, table_name, CAST(i AS INT) AS row_no, column_name, CASE WHEN linked THEN CASE WHEN ptype = 'uuid' THEN '00000000-0000-0000-0000-' || lpad(CAST(i + 1 AS VARCHAR), 12, '0') ELSE CAST(i + 1 AS VARCHAR) END
          ELSE {seed_sql('column_name', 'type', 'pk', "column_name = 'status'")} END AS value FROM w, (SELECT unnest(range(5)) AS i) n""",
)
def _(i):
    allowed = F.when(F.col("column_name") == "status", F.array(F.lit("new"), F.lit("done"))).otherwise(F.array().cast("array<string>"))
    return seed.seed_rows(i.estate_columns.withColumn("allowed", allowed), i.estate_fks, 5)


# --- sources and sinks --------------------------------------------------------------------------

KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "events": ["event_id"],
    "documents": ["doc_id"],
    "embeddings": ["vec_id"],
    "pages": ["page_id"],
    "benchmark": ["item_id"],
    "conversations": ["conv_id", "turn"],
}


def warehouse_columns(i):
    return sc.catalog_from_frames(i.spark, {t: getattr(i, t) for t in TABLES}, KEYS)


def _stats_sql(table: str, columns: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, '{t}' AS type, {str(c in KEYS.get(table, [])).lower()} AS pk, (SELECT count(*) FROM {table}) AS rows, (SELECT count({c}) FROM {table}) AS filled"
        for c, t in columns
    )


WAREHOUSE = {
    "region": "r_regionkey int|r_name text",
    "nation": "n_nationkey int|n_name text|n_regionkey int",
    "customer": "c_custkey bigint|c_name text|c_nationkey int|c_acctbal double precision|c_mktsegment text",
    "supplier": "s_suppkey bigint|s_name text|s_nationkey int|s_acctbal double precision",
    "part": "p_partkey bigint|p_name text|p_brand text|p_type text|p_size int|p_retailprice double precision",
    "orders": "o_orderkey bigint|o_custkey bigint|o_orderstatus text|o_totalprice double precision|o_orderdate timestamp|o_orderpriority text",
    "lineitem": "l_orderkey bigint|l_partkey bigint|l_suppkey bigint|l_linenumber int|l_quantity double precision|l_extendedprice double precision|l_discount double precision|l_tax double precision|l_returnflag text|l_linestatus text|l_shipdate timestamp",
    "events": "event_id bigint|ts timestamp|user_id bigint|event_type text|value double precision|props text",
    "documents": "doc_id bigint|text text|lang text|source text|n_chars bigint",
    "embeddings": "vec_id bigint|embedding array<float>|label int",
    "pages": "page_id bigint|url text|html text",
    "benchmark": "item_id bigint|text text",
    "labels": "doc_id bigint|quality int|toxic int",
    "conversations": "conv_id bigint|turn bigint|role text|text text",
}


@query("catalog_from_frames", " UNION ALL ".join(_stats_sql(t, [tuple(c.split(" ", 1)) for c in cols.split("|")]) for t, cols in WAREHOUSE.items()))
def _(i):
    stats = sc.table_statistics({t: getattr(i, t) for t in TABLES})
    return warehouse_columns(i).join(stats, ["table_name", "column_name"]).select("table_name", "column_name", "type", "pk", "rows", "filled")


def snapshot_documents(i):
    """One JSON snapshot per store, built from the estate catalog."""
    c = i.estate_columns
    entry = F.struct(
        F.col("column_name").alias("name"), "type", F.col("not_null").alias("notNull"), F.col("pk").alias("primaryKey"), F.col("default_expr").alias("default"), F.col("is_identity").alias("identity")
    )
    keyed = F.map_from_entries(F.collect_list(F.struct(F.col("column_name").alias("k"), entry.alias("v"))))
    idx = i.estate_indexes.groupBy("store", "table_name").agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.col("index_name").alias("k"), F.struct(F.col("index_name").alias("name"), "columns", F.col("is_unique").alias("isUnique")).alias("v")))
        ).alias("indexes")
    )
    tables = c.groupBy("store", "table_name").agg(keyed.alias("columns")).join(idx, ["store", "table_name"], "left")
    body = F.struct(F.col("table_name").alias("name"), "columns", "indexes")
    per_store = tables.groupBy("store").agg(F.map_from_entries(F.collect_list(F.struct(F.col("table_name").alias("k"), body.alias("v")))).alias("tables"))
    return per_store.select(F.to_json(F.struct("store", F.lit("postgresql").alias("dialect"), "tables")).alias("value"))


@query(
    "catalog_from_snapshot_json",
    "SELECT store, table_name, column_name, type, not_null, pk, default_expr, is_identity OR type = 'serial' AS is_identity FROM {estate_columns}",
)
def _(i):
    path = scratch_path(i.spark, "snapshots")
    snapshot_documents(i).write.text(path)
    tables = sc.parse_snapshots(i.spark.read.text(path))
    return sc.snapshot_columns(tables).drop("is_unique")


@query(
    "catalog_from_snapshot_indexes",
    "SELECT DISTINCT store, table_name, index_name, array_to_string(columns, ',') AS cols, is_unique FROM {estate_indexes}",
)
def _(i):
    path = scratch_path(i.spark, "snapshots")
    snapshot_documents(i).write.text(path)
    tables = sc.parse_snapshots(i.spark.read.text(path))
    return sc.snapshot_indexes(tables).select("store", "table_name", "index_name", F.array_join("columns", ",").alias("cols"), "is_unique")


def ddl_corpus(i):
    """One .sql text per table of the estate, with its indexes."""
    c = F.col
    default = F.when(c("default_expr") != "", F.concat(F.lit(" DEFAULT "), c("default_expr"))).otherwise("")
    line = F.concat(
        F.lit('"'), c("column_name"), F.lit('" '), c("type"), default, F.when(c("not_null"), " NOT NULL").otherwise(""), F.when(c("is_unique"), " UNIQUE").otherwise(""),
        F.when(c("is_identity"), " GENERATED ALWAYS AS IDENTITY").otherwise(""),
        F.when(c("has_check"), F.concat(F.lit(" CHECK ("), c("column_name"), F.lit(" IN ('a', 'b'))"))).otherwise(""),
        F.when(c("column_name") == "user_id", ' REFERENCES "users" (id)').otherwise(""),
    )
    tables = i.estate_columns.withColumn("line", line).groupBy("store", "table_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), ",\n  ").alias("body"),
        F.array_join(F.array_sort(F.collect_list(F.when(c("pk"), F.col("column_name")))), ", ").alias("keys"),
    )
    pk = F.when(c("keys") != "", F.concat(F.lit(",\n  PRIMARY KEY ("), c("keys"), F.lit(")"))).otherwise("")
    text = F.concat(
        F.lit("CREATE TABLE IF NOT EXISTS public."), c("table_name"), F.lit(" (\n  "), c("body"), pk, F.lit("\n);\nCREATE UNIQUE INDEX ix_"), c("table_name"),
        F.lit(" ON public."), c("table_name"), F.lit(" (a, b);"),
    )
    return tables.select("store", text.alias("value"))


@query(
    "catalog_from_ddl_corpus",
    """SELECT store, table_name, column_name, ordinal, type, not_null, pk, is_unique, default_expr, is_identity OR type = 'serial' AS is_identity, has_check,
       CASE WHEN has_check THEN 'a|b' ELSE '' END AS allowed FROM {estate_columns}""",
)
def _(i):
    out = sc.catalog_from_ddl_corpus(ddl_corpus(i))["columns"]
    return out.withColumn("allowed", F.coalesce(F.array_join("allowed", "|"), F.lit("")))


@query(
    "catalog_from_ddl_keys",
    """SELECT DISTINCT store, table_name, 'index' AS kind, 'a,b' AS cols, '' AS target FROM {estate_columns}
       UNION ALL SELECT store, table_name, 'fk', 'user_id', 'users(id)' FROM {estate_columns} WHERE column_name = 'user_id'""",
)
def _(i):
    made = sc.catalog_from_ddl_corpus(ddl_corpus(i))
    cols = F.array_join("columns", ",").alias("cols")
    idx = made["indexes"].select("store", "table_name", F.lit("index").alias("kind"), cols, F.lit("").alias("target"))
    target = F.concat("ref_table", F.lit("("), F.array_join("ref_columns", ","), F.lit(")"))
    return idx.unionByName(made["fks"].select("store", "table_name", F.lit("fk").alias("kind"), cols, target.alias("target")))


# One text per customer, written as people write DDL: comments, storage options, quoted defaults, dollar-quoted bodies.
DDL_SHAPES = r"""-- customer {k}: CREATE TABLE nothing (x int
CREATE TEMP TABLE scratch_{k} (a int) ENGINE=MEMORY COMMENT='t; (x';
CREATE FUNCTION f() RETURNS int AS $$ CREATE TABLE no (x int); $$ LANGUAGE sql;
CREATE TABLE `shop`.`t {k}` (
  id bigint NOT NULL AUTO_INCREMENT, -- the key, of course (really
  `full name` varchar(40) DEFAULT '{n}, b (c; it''s' NOT NULL, /* one, two; */ note text DEFAULT 'not null, unique' COMMENT 'check (x',
  PRIMARY KEY (`id`), KEY ix (`full name` DESC)
) ENGINE=InnoDB COMMENT='{n}; (y int';
DROP TABLE IF EXISTS scratch_{k}, `shop`.`old, {k}`"""


def ddl_shapes(i):
    text = F.replace(F.replace(F.lit(DDL_SHAPES), F.lit("{k}"), F.col("c_custkey").cast("string")), F.lit("{n}"), F.col("c_name"))
    return i.customer.select("c_custkey", F.col("c_mktsegment").alias("store"), text.alias("value"))


@query(
    "catalog_from_ddl_shapes",
    """SELECT c_mktsegment AS store, 'scratch_' || c_custkey AS table_name, 'a' AS column_name, CAST(0 AS INT) AS ordinal, 'int' AS type, false AS not_null, false AS pk, '' AS default_expr, false AS is_identity FROM customer
       UNION ALL SELECT c_mktsegment, 't ' || c_custkey, 'id', 0, 'bigint', true, true, '', true FROM customer
       UNION ALL SELECT c_mktsegment, 't ' || c_custkey, 'full name', 1, 'varchar(40)', true, false, chr(39) || c_name || ', b (c; it' || chr(39) || chr(39) || 's' || chr(39), false FROM customer
       UNION ALL SELECT c_mktsegment, 't ' || c_custkey, 'note', 2, 'text', false, false, chr(39) || 'not null, unique' || chr(39), false FROM customer""",
)
def _(i):
    made = sc.catalog_from_ddl_corpus(ddl_shapes(i))["columns"]
    return made.select("store", "table_name", "column_name", "ordinal", "type", "not_null", "pk", "default_expr", "is_identity")


@query(
    "statement_targets",
    """SELECT c_custkey, pos, unnest(tables) AS table_name FROM (
         SELECT c_custkey, CAST(0 AS INT) AS pos, ['scratch_' || c_custkey] AS tables FROM customer UNION ALL SELECT c_custkey, 1, [''] FROM customer
         UNION ALL SELECT c_custkey, 2, ['t ' || c_custkey] FROM customer UNION ALL SELECT c_custkey, 3, ['scratch_' || c_custkey, 'old, ' || c_custkey] FROM customer) x""",
)
def _(i):
    from plumbline.operators.statements import split_statements, target_tables

    split = split_statements(ddl_shapes(i), "c_custkey", "value")
    return split.select("c_custkey", F.col("pos").cast("int").alias("pos"), F.explode(target_tables(F.col("statement"))).alias("table_name"))


@query(
    "load_findings",
    """SELECT store, module, status, axis, confidence, CAST(count(*) AS BIGINT) AS findings, CAST(sum(severity) AS BIGINT) AS severity FROM {findings_fx} GROUP BY ALL""",
)
def _(i):
    path = scratch_path(i.spark, "findings")
    nested = i.findings_fx.select(
        "store", "paradigm", "id", "module", "status", "severity", "fixable", F.struct("axis", "confidence", "magnitude").alias("expected_impact")
    )
    nested.write.json(path)
    loaded = sf.load_findings(i.spark, path)
    return loaded.groupBy("store", "module", "status", "axis", "confidence").agg(F.count(F.lit(1)).alias("findings"), F.sum("severity").alias("severity"))


@query(
    "load_findings_arrays",
    """SELECT store, module, status, axis, confidence, CAST(count(*) AS BIGINT) AS findings, CAST(sum(severity) AS BIGINT) AS severity FROM {findings_fx} GROUP BY ALL""",
)
def _(i):
    # reports as they are written by hand-made tools: per store and module one indented array, {"findings": [...]}, or lines
    path = scratch_path(i.spark, "findings")
    one = F.struct("store", "paradigm", "id", "module", "status", "severity", "fixable", F.struct("axis", "confidence", "magnitude").alias("expected_impact"))
    here = Window.partitionBy("part", "store", "module").orderBy("store")  # in any order
    placed = i.findings_fx.select("store", "module", F.concat_ws("-", "store", "module").alias("part"), one.alias("f")).withColumns(
        {"n": F.row_number().over(here), "last": F.lead(F.lit(False), 1, True).over(here)}
    )
    shape = F.pmod(F.xxhash64("store", "module"), F.lit(3))
    listed = F.to_json(F.array("f"), {"pretty": "true"})
    pretty = F.substring(listed, F.lit(3), F.length(listed) - 4)  # without the brackets
    head = F.when(F.col("n") > 1, "").when(shape == 0, "[ ").otherwise('{\n "version": 1, "findings": [ ')
    tail = F.when(~F.col("last"), ",").when(shape == 0, " ]").otherwise(" ]}\n")
    body = F.when(shape == 2, F.to_json("f")).otherwise(F.concat(head, pretty, tail))
    # a file is written by one task, line by line; the writer keeps the order of rows that are sorted by their file
    placed.sortWithinPartitions("part", "store", "module", "n").select(body.alias("value"), "part").write.partitionBy("part").text(path)
    loaded = sf.load_findings(i.spark, f"{path}/*")
    return loaded.groupBy("store", "module", "status", "axis", "confidence").agg(F.count(F.lit(1)).alias("findings"), F.sum("severity").alias("severity"))


@query(
    "load_migration_corpus",
    """WITH b AS (SELECT split_part(path, '/', 2) AS folder, body FROM {migration_files_fx}) SELECT folder, CAST(count(*) * 3 + count(*) FILTER (body LIKE '%-- down%') AS BIGINT) AS statements FROM b GROUP BY 1""",
)
def _(i):
    from plumbline.operators.statements import split_statements

    path = scratch_path(i.spark, "migrations")
    bodies = i.migration_files_fx.select(F.split("path", "/")[1].alias("folder"), F.col("body").alias("value"))
    bodies.hint("rebalance", "folder").write.partitionBy("folder").text(path)
    corpus = sf.load_migration_corpus(i.spark, path, "*.txt")
    named = corpus.withColumn("folder", F.regexp_extract("path", "folder=([^/]+)/", 1))
    return split_statements(named, "folder", "body").groupBy("folder").agg(F.count(F.lit(1)).alias("statements"))


@query(
    "load_file_inventory",
    """SELECT split_part(path, '/', 2) AS folder, CAST(sum(strlen(body) + 1) AS BIGINT) AS bytes FROM {migration_files_fx} GROUP BY 1""",
)
def _(i):
    path = scratch_path(i.spark, "inventory")
    bodies = i.migration_files_fx.select(F.split("path", "/")[1].alias("folder"), F.col("body").alias("value"))
    bodies.hint("rebalance", "folder").write.partitionBy("folder").text(path)
    listed = sf.load_file_inventory(i.spark, path, glob="*.txt")
    return listed.groupBy(F.regexp_replace("repo", "folder=", "").alias("folder")).agg(F.sum("bytes").alias("bytes"))


@query(
    "write_report",
    f"""{BASE}, w AS (SELECT store, max(value) FILTER (axis = 'design') AS design, max(value) FILTER (axis = 'performance') AS performance FROM scores GROUP BY 1)
       SELECT store, CAST(1 AS INT) AS tier, 'engine of ' || store AS engine, axis, value, band, capped, (SELECT count(*) FROM d WHERE d.store = scores.store) AS findings,
       (SELECT count(DISTINCT category) FROM s WHERE s.store = scores.store AND s.axis = scores.axis) AS categories,
       (SELECT string_agg(category, ',' ORDER BY category) FROM (SELECT DISTINCT store, axis, category FROM s) c WHERE c.store = scores.store AND c.axis = scores.axis) AS names,
       CASE WHEN design >= 70 AND performance >= 70 THEN 'solid and ready to scale' WHEN design >= 70 AND performance < 60 THEN 'clean model, will not carry load yet'
       WHEN design < 60 AND performance >= 70 THEN 'fast today, the model is decaying' WHEN design < 60 AND performance < 60 THEN 'foundation problems, fix the caps first'
       ELSE 'mixed, follow the prioritized actions' END AS interpretation FROM scores JOIN w USING (store)""",
)
def _(i):
    findings = scoring.dedupe_findings(i.findings_fx)
    path = scratch_path(i.spark, "report")
    engines = i.findings_fx.select("store", F.concat(F.lit("engine of "), "store").alias("engine")).distinct()
    sf.write_report(findings, path, "2026-01-01T00:00:00Z", 1, engines)
    reports = sf.read_reports(i.spark, path).select(F.col("target").alias("store"), "tier", "engine", F.explode("scores").alias("s"))
    stored = i.spark.read.parquet(f"{path}/findings").groupBy("store").agg(F.count(F.lit(1)).alias("findings"))
    shown = reports.select(
        "store", "tier", "engine", "s.axis", "s.value", "s.band", "s.capped", "s.interpretation",
        F.size("s.categories").cast("long").alias("categories"), F.array_join("s.categories.name", ",").alias("names"),
    )
    return shown.join(stored, "store")
