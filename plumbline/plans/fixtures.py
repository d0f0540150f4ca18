"""Frames derived from the supplied tables, as SQL that Spark and the oracle both run.

Each one is a projection (or a union of projections) of a supplied table, so its size grows
with the data.  They plant defects that the clean tables lack and lay out the estate catalog,
findings, statement log, metric history and configuration rows the operators work on.
"""

from __future__ import annotations


def words(items: str, index: str) -> str:
    """SQL picking the ``index``-th (0-based) of ``|``-separated words."""
    return f"split_part('{items}', '|', CAST(1 + ({index}) AS INT))"


PARADIGMS = "relational|document|key-value|wide-column|vector|time-series|graph"

# One statement per operation class, then statements no class claims.  #ID# is the event id.
STATEMENT_TEMPLATES = [
    "ALTER TABLE orders DROP COLUMN legacy_#ID#",
    "ALTER TABLE orders ADD COLUMN archived_#ID# boolean NOT NULL DEFAULT false",
    "DROP TABLE audit_log_#ID#",
    "UPDATE orders SET status = 'archived_#ID#'",
    "ALTER TABLE customers ADD CONSTRAINT customers_email_#ID# UNIQUE (email)",
    "DROP INDEX idx_orders_#ID#",
    "ALTER TABLE orders ALTER COLUMN code_#ID# TYPE varchar(10)",
    "CREATE INDEX idx_#ID# ON orders (customer_id)",
    "ALTER TABLE orders ADD CONSTRAINT fk_#ID# FOREIGN KEY (customer_id) REFERENCES customers (id)",
    "ALTER TABLE orders ALTER COLUMN note_#ID# SET NOT NULL",
    "DELETE FROM sessions WHERE id = #ID#",
    "ALTER TYPE mood DROP VALUE 'v#ID#'",
    "ALTER TYPE mood ADD VALUE 'v#ID#'",
    "CREATE TABLE t_#ID# (id bigint PRIMARY KEY)",
    "ALTER TABLE orders RENAME TO orders_#ID#",
    "TRUNCATE staging_#ID#",
    "SELECT * FROM orders WHERE id = #ID#",
    "SELECT id FROM orders ORDER BY id LIMIT 20 OFFSET #ID#",
    "SELECT id FROM users WHERE name LIKE '%x#ID#'",
    "SELECT id FROM users WHERE lower(email) = 'u#ID#@x.com'",
    "SELECT id FROM jobs WHERE state = 'new' LIMIT 1 FOR UPDATE",
    "GRANT SELECT ON orders TO role_#ID#",
    "FLUSHALL",
    "COPY t_#ID# TO PROGRAM 'sh'",
]


def _templates() -> str:
    return "~".join(STATEMENT_TEMPLATES).replace("'", "''")


def _statement(index: str) -> str:
    return f"replace(split_part('{_templates()}', '~', CAST(1 + ({index}) % 24 AS INT)), '#ID#', CAST(event_id AS STRING))"


ESTATE_TABLES = (
    "users|orders|payments|invoices|products|items|accounts|sessions|user|order|"
    "OrderItem|audit_log|users_history|events|permissions|tenants|customers|transactions|tags|documents"
)
ESTATE_COLUMNS = (
    "price|total_amount|tags|user_id|order_id|account_id|created_at|updated_at|status|is_active|has_paid|active|"
    "email|phone|api_token|password|attribute|value|commentable_type|commentable_id|addr1|addr2|addr3|payload|"
    "data|full_name|item_count|tenant_id|deleted_at|quantity|firstName|user_name|order|birthday|embedding|role_ids|"
    "is_admin|is_deleted|valid_from|valid_to|slug|product_id|ssn|notes|can_edit|tmp|retention_until|coffee_grade"
)
ESTATE_TYPES = (
    "double precision|numeric(12,2)|text|bigint|bigint|int|timestamp|timestamptz|varchar(20)|boolean|boolean|boolean|"
    "text|text|text|varchar(64)|text|text|varchar(40)|bigint|text|text|text|jsonb|"
    "json|text|int|bigint|timestamp|int|text|text|int|date|vector(64)|text|"
    "boolean|boolean|date|date|text|uuid|text|text|boolean|text|date|real"
)

FIXTURES: dict[str, str] = {}

FIXTURES["findings_fx"] = f"""
SELECT store, paradigm, module, module || '.' || object AS id, object, status,
       CASE WHEN status = 'not_applicable' THEN 0 ELSE sev END AS severity,
       axis, confidence, magnitude, fixable
FROM (
  SELECT 'store_' || CAST(l_suppkey % 8 AS STRING) AS store,
         {words(PARADIGMS, 'l_suppkey % 8 % 7')} AS paradigm,
         'M' || CAST(1 + l_partkey % 22 AS STRING)
             || CASE WHEN l_partkey % 22 = 19 THEN {words('a|b|c|d', 'l_linenumber % 4')} ELSE '' END AS module,
         't' || CAST(l_orderkey % 50 AS STRING) || '.c' || CAST(l_linenumber AS STRING) AS object,
         {words('pass|pass|pass|pass|pass|warn|warn|fail|needs_api|not_applicable', '(l_orderkey + l_linenumber) % 10')} AS status,
         CAST(1 + l_orderkey % 5 AS INT) AS sev,
         {words('design|performance|both', '(l_orderkey + l_partkey) % 3')} AS axis,
         {words('established|directional|speculative', 'CAST(l_quantity AS INT) % 3')} AS confidence,
         {words('high|medium|low', 'l_linenumber % 3')} AS magnitude,
         {words('auto|proposed|advisory', 'l_partkey % 3')} AS fixable
  FROM {{lineitem}}) f
"""

FIXTURES["findings_raw_fx"] = f"""
SELECT CASE WHEN l_orderkey % 41 = 0 THEN 'X9.bad id' WHEN l_orderkey % 43 = 0 THEN CAST(NULL AS STRING)
            ELSE 'M' || CAST(1 + l_partkey % 22 AS STRING) || '.t' || CAST(l_orderkey AS STRING) || '.c' || CAST(l_linenumber AS STRING) END AS id,
       CASE WHEN l_orderkey % 37 = 0 THEN 'M23' ELSE 'M' || CAST(1 + l_partkey % 22 AS STRING) END AS module,
       CASE WHEN l_orderkey % 31 = 0 THEN 'ok' ELSE {words('pass|warn|fail|needs_api', 'l_orderkey % 4')} END AS status,
       CAST(CASE WHEN l_orderkey % 29 = 0 THEN 6 ELSE 1 + l_orderkey % 5 END AS INT) AS severity,
       CASE WHEN l_orderkey % 23 = 0 THEN 'cost' ELSE {words('design|performance|both', 'l_partkey % 3')} END AS axis,
       {words('established|directional|speculative', 'l_partkey % 3')} AS confidence,
       {words('high|medium|low', 'l_linenumber % 3')} AS magnitude,
       CASE WHEN l_orderkey % 19 = 0 THEN 'never' ELSE {words('auto|proposed|advisory', 'l_partkey % 3')} END AS fixable,
       CASE WHEN l_orderkey % 17 = 0 THEN 'row' ELSE {words('column|table|index|schema|database|cluster|query|collection|keyspace', 'l_partkey % 9')} END AS scope,
       {words('ddl_parse|migration_lint|schema_introspect|index_check|explain_plan|constraint_check|query_stat|dry_run_migration|connection_introspect|manual_review', 'l_partkey % 10')} AS method,
       CASE WHEN l_orderkey % 13 = 0 THEN 'x' ELSE 'Finding ' || CAST(l_orderkey AS STRING) END AS title,
       'observed' AS observed, 'expected' AS expected, 'recommendation' AS recommendation,
       'assertion' AS assertion, 'reproduce' AS reproduce, 'rationale' AS rationale
FROM {{lineitem}}
"""

FIXTURES["statements_fx"] = f"""
SELECT event_id, user_id AS session_id, ts, value AS elapsed_ms, event_id % 24 AS template_no,
       {_statement('event_id')} AS statement
FROM {{events}}
"""

FIXTURES["migration_files_fx"] = f"""
SELECT 'migrations/' || CAST(user_id AS STRING) || '/' || CAST(event_id AS STRING) || '.sql' AS path, event_id,
       '-- header; not a statement' || chr(10) || {_statement('event_id')}
       || '; INSERT INTO notes VALUES (''a;b -- c'', "c;d");' || chr(10) || '/* block; comment */ '
       || {_statement('event_id + 7')} || ';'
       || CASE WHEN event_id % 3 = 0 THEN chr(10) || '-- down' || chr(10) || 'SELECT 1;' ELSE '' END AS body
FROM {{events}}
"""

FIXTURES["file_statements_fx"] = f"""
SELECT path, CAST(0 AS INT) AS pos, stmt1 AS statement FROM (
  SELECT 'migrations/' || CAST(user_id AS STRING) || '/' || CAST(event_id AS STRING) || '.sql' AS path, {_statement('event_id')} AS stmt1 FROM {{events}}) a
UNION ALL SELECT 'migrations/' || CAST(user_id AS STRING) || '/' || CAST(event_id AS STRING) || '.sql', 1, 'INSERT INTO notes VALUES (''a;b -- c'', "c;d")' FROM {{events}}
UNION ALL SELECT 'migrations/' || CAST(user_id AS STRING) || '/' || CAST(event_id AS STRING) || '.sql', 2, {_statement('event_id + 7')} FROM {{events}}
UNION ALL SELECT 'migrations/' || CAST(user_id AS STRING) || '/' || CAST(event_id AS STRING) || '.sql', 3, 'SELECT 1' FROM {{events}} WHERE event_id % 3 = 0
"""

# Orders told with their customer, as an unnormalised table would hold them.
FIXTURES["orders_wide_fx"] = """
SELECT o_orderkey, o_custkey, c_nationkey, c_mktsegment, o_orderpriority, 'EUR' AS currency,
       CASE WHEN c_nationkey % 4 = 1 THEN NULL ELSE c_mktsegment || '-' || CAST(c_nationkey AS STRING) END AS area
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

# Nested documents: keys that come and go, one of changing kind, arrays in arrays, null and malformed rows.
# Braces are chr(123) and chr(125), since templates fill names in braces.
FIXTURES["docs_fx"] = """
SELECT event_id, CASE WHEN event_id % 89 = 7 THEN CAST(NULL AS STRING) ELSE
       chr(123) || '"id": ' || CAST(event_id AS STRING) || ', "user": ' || chr(123) || '"no": ' || CAST(user_id AS STRING)
       || ', "seen": ' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '"' || event_type || '"' END
       || CASE WHEN event_id % 25 = 0 THEN '' ELSE ', "lang": "en"' END || chr(125) || ', "props": ' || props
       || ', "amount": ' || CASE WHEN event_id % 7 = 0 THEN '"n/a"' ELSE CAST(event_id % 100 AS STRING) || '.5' END
       || CASE WHEN event_id % 5 = 0 THEN ', "tags": ["' || event_type || '", ' || chr(123) || '"first seen": true, "deep": [[' || CAST(user_id AS STRING) || '], []]' || chr(125) || ']' ELSE '' END
       || CASE WHEN event_id % 97 = 11 THEN '' ELSE chr(125) END END AS doc
FROM {events}
"""

# Object access log: reads and writes of an entity by a session.
FIXTURES["access_fx"] = """
SELECT event_id, user_id % 40 AS session_id, event_id % 25 AS object_id, ts,
       CASE WHEN event_type IN ('purchase', 'signup') THEN 'write' ELSE 'read' END AS action
FROM {events}
"""

# --- planted defects over orders / lineitem / customer -----------------------------------
FIXTURES["orders_fx"] = """
SELECT o_orderkey, 
       CASE WHEN o_orderkey % 97 = 0 THEN o_custkey + 1000000
            WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
       CASE WHEN o_orderkey % 71 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 11 = 0 THEN o_orderpriority || ',' || o_orderstatus ELSE o_orderpriority END AS o_orderpriority,
       CASE WHEN o_orderkey % 59 = 0 THEN '' ELSE o_orderstatus || '-note' END AS o_note,
       CASE WHEN o_orderkey % 101 = 0 THEN 0 - o_totalprice ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_custkey % 16 AS tenant_id
FROM {orders}
"""

FIXTURES["orders_dup_fx"] = """
SELECT o_orderkey, o_custkey, o_orderdate FROM {orders}
UNION ALL SELECT o_orderkey, o_custkey, o_orderdate FROM {orders} WHERE o_orderkey % 53 = 0
"""

FIXTURES["customer_fx"] = """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'User' ELSE 'user' END || CAST(c_custkey % 70 AS STRING) || '@x.com' AS email,
       CASE WHEN c_custkey % 13 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS deleted_at,
       c_custkey % 16 AS tenant_id
FROM {customer}
"""

FIXTURES["line_tenant_fx"] = """
SELECT l.l_orderkey, l.l_linenumber,
       CASE WHEN l.l_orderkey % 61 = 0 THEN NULL ELSE o.o_custkey % 16 + CASE WHEN l.l_orderkey % 83 = 0 THEN 1 ELSE 0 END END AS tenant_id
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
"""

FIXTURES["validity_fx"] = """
SELECT o_custkey AS entity_id, o_orderkey AS version_id, o_orderdate AS valid_from,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 400 DAY ELSE o_orderdate + INTERVAL 30 DAY END AS valid_to
FROM {orders}
"""

FIXTURES["orders_next_fx"] = """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 31 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
FROM {orders} WHERE o_orderkey % 19 <> 0
UNION ALL
SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice FROM {orders} WHERE o_orderkey % 23 = 0
"""

FIXTURES["orders_backfill_fx"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 67 = 0 THEN NULL WHEN o_orderkey % 47 = 0 THEN o_totalprice + 0.5 ELSE o_totalprice END AS total_new
FROM {orders}
"""

# A stored hourly rollup that misses late rows of some hours and whole hours.
FIXTURES["stored_rollup_fx"] = """
SELECT date_trunc('hour', ts) AS bucket, CAST(count(*) AS BIGINT) AS n
FROM {events} WHERE event_id % 50 <> 0 AND extract(hour FROM ts) <> 3 GROUP BY date_trunc('hour', ts)
"""

# --- estate catalog ------------------------------------------------------------------------
# Every order is one column of one table; 160 orders make one store of 20 tables of 8 columns
# (or, in every tenth store, 4 tables of 40 columns).
FIXTURES["estate_columns"] = f"""
SELECT store, store_no, table_no, table_name, column_name, ordinal, type, not_null, pk, is_unique, default_expr, is_identity, has_check
FROM (
  SELECT 'store_' || CAST(store_no AS STRING) AS store, store_no, table_no, ordinal,
         {words(ESTATE_TABLES, 'table_no % 20')} AS table_name,
         CASE WHEN ordinal = 0 AND table_no % 5 <> 3 THEN 'id'
              ELSE {words(ESTATE_COLUMNS, '(ordinal + table_no * 11) % 48')} END AS column_name,
         CASE WHEN ordinal = 0 AND table_no % 5 <> 3 THEN {words('bigint|int|uuid|serial', 'table_no % 4')}
              WHEN r % 11 = 0 THEN 'text'
              ELSE {words(ESTATE_TYPES, '(ordinal + table_no * 11) % 48')} END AS type,
         r % 3 <> 0 OR ordinal = 0 AS not_null,
         (ordinal = 0 OR (ordinal = 1 AND table_no % 9 = 4)) AND table_no % 7 <> 0 AS pk,
         r % 9 = 0 AND ordinal > 0 AS is_unique,
         CASE WHEN ordinal = 0 AND table_no % 4 = 2 THEN 'gen_random_uuid()'
              WHEN ordinal = 0 THEN ''
              WHEN r % 6 = 1 THEN 'now()' WHEN r % 6 = 2 THEN '''''' WHEN r % 6 = 3 THEN '0' ELSE '' END AS default_expr,
         ordinal = 0 AND table_no % 4 = 0 AS is_identity,
         r % 4 = 1 AND ordinal > 0 AS has_check
  FROM (
    SELECT o_custkey AS r, CAST(floor(o_orderkey / 160) AS BIGINT) AS store_no,
           CASE WHEN CAST(floor(o_orderkey / 160) AS BIGINT) % 10 = 3 THEN CAST(floor(o_orderkey / 40) AS BIGINT) * 5
                ELSE CAST(floor(o_orderkey / 8) AS BIGINT) END AS table_no,
           CAST(CASE WHEN CAST(floor(o_orderkey / 160) AS BIGINT) % 10 = 3 THEN o_orderkey % 40 ELSE o_orderkey % 8 END AS INT) AS ordinal
    FROM {{orders}}) o) c
WHERE NOT (table_no % 8 = 5 AND ordinal >= 6)
"""

FIXTURES["estate_fks"] = f"""
SELECT store, table_name, split(column_name, ',') AS columns, ref_table, split('id', ',') AS ref_columns,
       {words('CASCADE|RESTRICT|SET NULL|', '(table_no + ordinal) % 4')} AS on_delete,
       table_no % 5 <> 2 AS validated
FROM (
  SELECT *, CASE column_name WHEN 'user_id' THEN 'users' WHEN 'order_id' THEN 'orders' WHEN 'account_id' THEN 'accounts'
                             WHEN 'product_id' THEN 'products' WHEN 'tenant_id' THEN 'tenants'
                             WHEN 'commentable_id' THEN 'documents' END AS ref_table
  FROM {{estate_columns}}) e
WHERE ref_table IS NOT NULL AND (table_no * 3 + ordinal) % 4 <> 0 AND NOT (column_name = 'commentable_id' AND table_no % 3 = 0)
UNION ALL
SELECT store, table_name, split('tenant_id,user_id', ','), 'users', split('tenant_id,id', ','), 'CASCADE', true
FROM {{estate_columns}} WHERE column_name = 'created_at' AND table_no % 3 = 0
"""

FIXTURES["estate_indexes"] = """
SELECT store, table_name, 'ix_' || table_name || '_' || column_name AS index_name, split(column_name, ',') AS columns, is_unique
FROM {estate_columns} WHERE (table_no + ordinal) % 3 = 1 AND ordinal > 0
UNION ALL
SELECT store, table_name, 'ix2_' || table_name || '_' || column_name, split(column_name, ','), false
FROM {estate_columns} WHERE (table_no + ordinal) % 12 = 1 AND ordinal > 0
UNION ALL
SELECT store, table_name, 'ixc_' || table_name || '_' || column_name, split(column_name || ',id', ','), ordinal % 3 = 0
FROM {estate_columns} WHERE (table_no + ordinal) % 5 = 1 AND ordinal > 0
UNION ALL
SELECT store, table_name, 'ixt_' || table_name || '_' || column_name, split('tenant_id,' || column_name, ','), ordinal % 2 = 0
FROM {estate_columns} WHERE (table_no + ordinal) % 11 = 2 AND ordinal > 0 AND column_name <> 'tenant_id'
"""

# What queries do with a column: equality, sort or range.
FIXTURES["estate_predicates"] = f"""
SELECT store, table_name, column_name, {words('equality|sort|range|containment', '(table_no + ordinal * 3) % 4')} AS role
FROM {{estate_columns}} WHERE ordinal % 2 = 1 OR column_name IN ('tenant_id', 'id')
"""

FIXTURES["estate_next_columns"] = f"""
SELECT store, store_no, table_no, table_name, column_name, ordinal,
       CASE WHEN (table_no + ordinal) % 13 = 5 AND type = 'int' THEN 'bigint'
            WHEN (table_no + ordinal) % 13 = 6 AND type = 'text' THEN 'varchar(20)' ELSE type END AS type,
       not_null OR (table_no + ordinal) % 17 = 3 AS not_null, pk, is_unique,
       CASE WHEN (table_no + ordinal) % 19 = 4 THEN '1' WHEN (table_no + ordinal) % 19 = 8 THEN '' ELSE default_expr END AS default_expr,
       is_identity, has_check
FROM {{estate_columns}} WHERE table_no % 23 <> 7 AND ((table_no + ordinal) % 29 <> 9 OR ordinal = 0)
UNION ALL
SELECT store, store_no, table_no, table_name, 'added_' || column_name, ordinal + 100, 'boolean', ordinal % 2 = 1, false, false,
       CASE WHEN ordinal % 4 = 1 THEN 'false' ELSE '' END, false, false
FROM {{estate_columns}} WHERE (table_no + ordinal) % 31 = 11 AND table_no % 23 <> 7
UNION ALL
SELECT store, store_no, table_no + 1000000000, table_name || '_new', column_name, ordinal, type, not_null, pk, is_unique, default_expr, is_identity, has_check
FROM {{estate_columns}} WHERE table_no % 37 = 12
"""

FIXTURES["estate_next_indexes"] = """
SELECT store, table_name, index_name, columns, is_unique OR length(table_name) % 4 = 1 AS is_unique FROM {estate_indexes} WHERE length(index_name) % 5 <> 2
"""

FIXTURES["estate_next_fks"] = """
SELECT store, table_name, columns, ref_table, ref_columns, on_delete, validated FROM {estate_fks} WHERE length(table_name) % 3 <> 1
"""

FIXTURES["estate_stores"] = f"""
SELECT DISTINCT store, store_no, {words('postgres|mysql|planetscale|supabase|d1|mongodb|cockroachdb|dynamodb', 'store_no % 8')} AS platform,
       store_no % 20 AS major_version
FROM {{estate_columns}}
"""

FIXTURES["estate_policies"] = """
SELECT store, table_name, table_no % 3 = 0 AS rls_enabled, CAST(table_no % 4 AS INT) AS policy_count
FROM {estate_columns} WHERE ordinal = 0
"""

FIXTURES["estate_sizes"] = """
SELECT store, table_name, (table_no * 7919) % 100000 * 1048576 AS size_bytes, (table_no * 104729) % 5000000 AS est_rows,
       table_no % 6 = 0 AS partitioned
FROM {estate_columns} WHERE ordinal = 0 AND table_no % 9 <> 4
"""

# --- metric history and configuration -----------------------------------------------------
FIXTURES["metrics_fx"] = f"""
SELECT 'store_' || CAST(user_id % 8 AS STRING) AS store, 'obj_' || CAST(user_id AS STRING) AS object,
       {words('idx_scan|dead_ratio|xid_age_pct|open_conn_pct|replay_lag_bytes|size_bytes', 'event_id % 6')} AS metric, ts,
       CASE event_id % 6 WHEN 0 THEN floor(value / 100) WHEN 1 THEN value / 500 WHEN 2 THEN value / 5 WHEN 3 THEN value / 5
            WHEN 4 THEN floor(value * 1000000) ELSE floor(value * 10000000) END AS value
FROM {{events}} WHERE user_id % 5 <> 0 OR ts < TIMESTAMP '2024-01-05 00:00:00'
"""

FIXTURES["config_fx"] = f"""
SELECT store, key, CASE key
    WHEN 'url' THEN 'postgres://app:pw' || CAST(n AS STRING) || '@db:' || {words('5432|6543', 'g % 2')} || '/main?sslmode='
                    || {words('disable|require|verify-full', 'g % 3')} || CASE WHEN g % 4 = 1 THEN '&prepared_statements=true' ELSE '' END
    WHEN 'runtime' THEN {words('vercel|container|lambda|vm', 'g % 4')}
    WHEN 'validator' THEN {words('strict|none', 'g % 2')}
    WHEN 'charset' THEN {words('utf8|utf8mb4|latin1|utf8mb3', 'g % 4')}
    WHEN 'appendonly' THEN {words('yes|no', 'g % 2')}
    WHEN 'matview_refresh' THEN {words('concurrent|blocking', 'g % 2')}
    WHEN 'autovacuum' THEN {words('on|off', 'g % 2')}
    ELSE 'set' END AS value
FROM (
  SELECT c_custkey AS n, CAST(floor(c_custkey / 14) AS BIGINT) AS g, 'store_' || CAST(CAST(floor(c_custkey / 14) AS BIGINT) AS STRING) AS store,
         {words('url|runtime|validator|charset|appendonly|retention_policy|compression_policy|ttl_policy|lookup_index|model_version|ann_index|rollup_policy|matview_refresh|autovacuum', 'c_custkey % 14')} AS key
  FROM {{customer}} WHERE (c_custkey * 7) % 5 <> 0) c
"""

FIXTURES["files_fx"] = """
SELECT 'repo_' || CAST(CAST(floor(c_custkey / 6) AS BIGINT) AS STRING) AS repo,
       split_part('prisma/schema.prisma|package.json|docker-compose.yml|.env|db/schema.rb|src/models/user.js', '|', CAST(1 + c_custkey % 6 AS INT)) AS path,
       CASE c_custkey % 6
         WHEN 0 THEN 'datasource db ' || chr(10) || ' provider = "' || split_part('postgresql|mysql|sqlite|mongodb', '|', CAST(1 + floor(c_custkey / 6) % 4 AS INT)) || '"'
         WHEN 1 THEN chr(123) || '"name": "app", "dependencies": ' || chr(123) || '"react": "18", "' || split_part('pg|mongoose|ioredis|neo4j-driver', '|', CAST(1 + floor(c_custkey / 6) % 4 AS INT)) || '": "1.0"' || chr(125) || chr(125)
         WHEN 2 THEN 'image: ' || split_part('postgres:16|redis:7|cassandra:4|nginx:1', '|', CAST(1 + floor(c_custkey / 6) % 4 AS INT))
         WHEN 3 THEN 'DATABASE_URL=' || split_part('postgres|mysql|mongodb+srv|rediss', '|', CAST(1 + floor(c_custkey / 6) % 4 AS INT)) || '://u:p' || CAST(c_custkey AS STRING) || '@h/db'
         WHEN 4 THEN 'ActiveRecord::Schema.define do'
         ELSE 'const mongoose = require(''mongoose'')' END AS content
FROM {customer}
WHERE (c_custkey % 6 <> 0 OR floor(c_custkey / 6) % 3 = 0) AND (c_custkey % 6 <> 4 OR floor(c_custkey / 6) % 5 = 0)
  AND (c_custkey % 6 <> 5 OR floor(c_custkey / 6) % 7 = 0) AND floor(c_custkey / 6) % 11 <> 10
"""

# Purchases of parts by customers, as an undirected graph.
FIXTURES["edges_fx"] = """
SELECT 'c' || CAST(o.o_custkey AS STRING) AS src, 'p' || CAST(l.l_partkey AS STRING) AS dst
FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey
"""


FIXTURES["payloads_fx"] = """
SELECT event_id, chr(123) || '"tool": "sql", "input": ' || chr(123) || '"command": "' || statement || '", "options": ["a:b", "'
       || CAST(session_id AS STRING) || '"]' || chr(125) || chr(125) AS payload
FROM {statements_fx}
"""

FIXTURES["source_lines_fx"] = """
SELECT event_id, CASE event_id % 5
  WHEN 0 THEN 'db.query("SELECT * FROM users WHERE id = " + id' || CAST(event_id AS STRING) || ')'
  WHEN 1 THEN 'db.query(`SELECT * FROM users WHERE id = $' || chr(123) || 'id' || chr(125) || '`)'
  WHEN 2 THEN 'cur.execute(f"DELETE FROM t WHERE id = ' || chr(123) || 'x' || chr(125) || '")'
  WHEN 3 THEN 'db.query("SELECT * FROM users WHERE id = $1", [id])'
  ELSE 'const total = a + b' END AS line
FROM {events}
"""

FIXTURES["paths_fx"] = """
SELECT event_id, split_part('.git/config|src/app.ts|.env.local|deploy/id_rsa|certs/server.pem|yarn.lock|home/.ssh/known|.aws/config|.pgpass|cfg/secrets.yml|credentials|README.md', '|', CAST(1 + event_id % 12 AS INT)) AS path
FROM {events}
"""

FIXTURES["sources_fx"] = """
SELECT 'store_' || CAST(CAST(floor(c_custkey / 5) AS BIGINT) AS STRING) AS store, 'source_' || CAST(c_custkey AS STRING) AS source,
       split_part('orm|migration|declarative|live', '|', CAST(1 + (c_custkey * 7 + floor(c_custkey / 5)) % 4 AS INT)) AS kind
FROM {customer}
"""
