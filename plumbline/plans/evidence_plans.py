"""Evidence operators bound to the supplied tables, with their SQL oracles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from plumbline.operators import dependencies, documents
from plumbline.operators import integrity as ri
from plumbline.operators import profile as pf
from plumbline.operators import timeseries as tm
from plumbline.operators.ordered import id_bucket
from plumbline.plans.registry import query

STAMP = "yyyy-MM-dd HH:mm:ss"
SQL_STAMP = "%Y-%m-%d %H:%M:%S"


def stamp(column: str):
    return F.date_format(column, STAMP)


# --- referential ----------------------------------------------------------------------------


@query(
    "orphan_rows",
    """SELECT o_custkey AS fk_value, CAST(count(*) AS BIGINT) AS orphans, min(o_orderkey) AS sample_id
       FROM {orders_fx} o WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)
       GROUP BY o_custkey""",
)
def _(i):
    return ri.orphan_rows(i.orders_fx, "o_custkey", i.customer, "c_custkey", "o_orderkey")


def _orphan_sql(name: str, child: str, fk: str, parent: str, pk: str) -> str:
    return f"""SELECT '{name}' AS fk_name, CAST(count(*) AS BIGINT) AS child_rows,
        CAST(count(*) FILTER (c.{fk} IS NULL) AS BIGINT) AS null_keys,
        CAST(count(*) FILTER (c.{fk} IS NOT NULL AND p.{pk} IS NULL) AS BIGINT) AS orphans
        FROM {child} c LEFT JOIN {parent} p ON c.{fk} = p.{pk}"""


DECLARED = [
    ("nation.n_regionkey", "nation", "n_regionkey", "region", "r_regionkey"),
    ("customer.c_nationkey", "customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier.s_nationkey", "supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders.o_custkey", "orders", "o_custkey", "customer", "c_custkey"),
    ("orders_fx.o_custkey", "orders_fx", "o_custkey", "customer", "c_custkey"),
    ("lineitem.l_orderkey", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem.l_partkey", "lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem.l_suppkey", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels.doc_id", "labels", "doc_id", "documents", "doc_id"),
]


@query("orphan_matrix", " UNION ALL ".join(_orphan_sql(n, "{orders_fx}" if c == "orders_fx" else c, f, p, k) for n, c, f, p, k in DECLARED))
def _(i):
    return ri.orphan_matrix([(n, getattr(i, c), f, getattr(i, p), k) for n, c, f, p, k in DECLARED])


@query(
    "childless_parents",
    "SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)",
)
def _(i):
    return ri.childless_parents(i.orders.select("o_orderkey", "o_custkey"), "o_orderkey", i.lineitem, "l_orderkey")


@query(
    "matched_children",
    """SELECT CAST(count(*) AS BIGINT) AS matched_rows, CAST(count(DISTINCT o_custkey) AS BIGINT) AS matched_keys
       FROM {orders_fx} o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)""",
)
def _(i):
    return ri.matched_children(i.orders_fx, "o_custkey", i.customer, "c_custkey")


def _card_sql(name: str, parent: str, pk: str, child: str, fk: str) -> str:
    return f"""SELECT '{name}' AS relationship, CAST(count(*) AS BIGINT) AS parents, CAST(min(n) AS BIGINT) AS min_children,
        CAST(max(n) AS BIGINT) AS max_children,
        '1:' || CASE WHEN min(n) = 0 THEN '0..' ELSE '' END || CASE WHEN max(n) > 1 THEN 'N' ELSE '1' END AS shape
        FROM (SELECT p.{pk}, count(c.{fk}) AS n FROM {parent} p LEFT JOIN {child} c ON c.{fk} = p.{pk} GROUP BY p.{pk}) t"""


RELATIONSHIPS = [
    ("customer-orders", "customer", "c_custkey", "orders", "o_custkey"),
    ("orders-lineitem", "orders", "o_orderkey", "lineitem", "l_orderkey"),
    ("documents-labels", "documents", "doc_id", "labels", "doc_id"),
    ("region-nation", "region", "r_regionkey", "nation", "n_regionkey"),
]


@query("relationship_cardinality", " UNION ALL ".join(_card_sql(*r) for r in RELATIONSHIPS))
def _(i):
    return ri.relationship_cardinality([(n, getattr(i, c), fk, getattr(i, p), pk) for n, p, pk, c, fk in RELATIONSHIPS])


@query(
    "cross_tenant_reference",
    """SELECT l.tenant_id AS child_tenant, o.tenant_id AS parent_tenant, CAST(count(*) AS BIGINT) AS rows
       FROM {line_tenant_fx} l JOIN {orders_fx} o ON l.l_orderkey = o.o_orderkey WHERE l.tenant_id <> o.tenant_id GROUP BY 1, 2""",
)
def _(i):
    return ri.cross_tenant_references(i.line_tenant_fx, "l_orderkey", i.orders_fx, "o_orderkey")


CANDIDATES = [
    ("orders_fx.o_custkey~customer", "orders_fx", "o_custkey", "customer", "c_custkey"),
    ("lineitem.l_suppkey~supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("lineitem.l_partkey~customer", "lineitem", "l_partkey", "customer", "c_custkey"),
    ("events.user_id~supplier", "events", "user_id", "supplier", "s_suppkey"),
]


@query(
    "fk_candidate_containment",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS candidate, CAST(count(DISTINCT c.{f}) AS BIGINT) AS distinct_values,
        CAST(count(DISTINCT p.{k}) AS BIGINT) AS contained,
        CAST(10000 * count(DISTINCT p.{k}) // count(DISTINCT c.{f}) AS BIGINT) AS contained_bp
        FROM {'{orders_fx}' if c == 'orders_fx' else c} c LEFT JOIN {p} p ON c.{f} = p.{k}"""
        for n, c, f, p, k in CANDIDATES
    ),
)
def _(i):
    return ri.containment([(n, getattr(i, c), f, getattr(i, p), k) for n, c, f, p, k in CANDIDATES])


KEYLIKE = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"],
    "part": ["p_partkey", "p_size"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "events": ["event_id", "user_id"],
}


@query(
    "fk_inclusion_discovery",
    "WITH v AS ("
    + " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, CAST({c} AS BIGINT) AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 3" for t, cs in KEYLIKE.items() for c in cs)
    + """), d AS (SELECT t, c, count(*) AS distinct_values, max(n) = 1 AS is_key FROM v GROUP BY ALL),
         p AS (SELECT a.t AS child, a.c AS child_column, b.t AS parent, b.c AS parent_column, count(*) AS contained FROM v a JOIN v b ON a.v = b.v AND (a.t, a.c) <> (b.t, b.c) GROUP BY ALL)
       SELECT child, child_column, parent, parent_column, x.distinct_values, contained, CAST(10000 * contained // x.distinct_values AS BIGINT) AS contained_bp
       FROM p JOIN d x ON child = x.t AND child_column = x.c JOIN d y ON parent = y.t AND parent_column = y.c AND y.is_key WHERE 10000 * contained // x.distinct_values >= 9500""",
)
def _(i):
    return ri.inclusion_dependencies({t: getattr(i, t) for t in KEYLIKE}, [(t, c) for t, cs in KEYLIKE.items() for c in cs], 9_500)


@query(
    "read_your_writes",
    """SELECT r.session_id, r.object_id, w.event_id AS write_event, r.event_id AS read_event,
              epoch_us(r.ts) - epoch_us(w.ts) AS age_us
       FROM {access_fx} r JOIN {access_fx} w ON r.session_id = w.session_id AND r.object_id = w.object_id
        AND w.action = 'write' AND (w.ts < r.ts OR (w.ts = r.ts AND w.event_id < r.event_id)) AND w.ts >= r.ts - INTERVAL 86400 SECOND
       WHERE r.action = 'read' QUALIFY row_number() OVER (PARTITION BY r.event_id ORDER BY w.ts DESC, w.event_id DESC) = 1""",
)
def _(i):
    return ri.read_your_writes(i.access_fx, "session_id", "object_id", "ts", "action", "event_id", 86400, 6 * 3600)


@query(
    "lost_update",
    """WITH a AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS o FROM {access_fx}),
       own AS (SELECT *, lag(action) OVER s AS mine_action, lag(event_id) OVER s AS mine_event, lag(o) OVER s AS mine_o
               FROM a WINDOW s AS (PARTITION BY object_id, session_id ORDER BY o))
       SELECT w.object_id, w.session_id, w.mine_event AS read_event, p.event_id AS overtaking_event, w.event_id AS write_event
       FROM own w JOIN a p ON p.object_id = w.object_id AND p.action = 'write'
        AND p.o = (SELECT max(x.o) FROM a x WHERE x.object_id = w.object_id AND x.action = 'write' AND x.o < w.o)
       WHERE w.action = 'write' AND w.mine_action = 'read' AND p.session_id <> w.session_id AND p.o > w.mine_o""",
)
def _(i):
    return ri.lost_updates(i.access_fx, "session_id", "object_id", "ts", "action", "event_id", 6 * 3600)


@query(
    "backfill_verify",
    """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (o.o_totalprice IS NOT DISTINCT FROM b.total_new) AS BIGINT) AS equal_rows,
       CAST(count(*) FILTER (b.total_new IS NULL AND o.o_totalprice IS NOT NULL) AS BIGINT) AS not_filled,
       CAST(count(*) FILTER (b.total_new <> o.o_totalprice) AS BIGINT) AS different
       FROM orders o LEFT JOIN {orders_backfill_fx} b ON o.o_orderkey = b.o_orderkey""",
)
def _(i):
    return ri.backfill_verify(i.orders, i.orders_backfill_fx, "o_orderkey", "o_totalprice", "total_new")


@query(
    "temporal_bound_violation",
    """SELECT CAST(year(o_orderdate) AS INT) AS parent_year, CAST(count(*) AS BIGINT) AS rows,
       CAST(count(*) FILTER (l_shipdate < o_orderdate) AS BIGINT) AS violations
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _(i):
    return ri.temporal_bound_violations(i.lineitem, "l_orderkey", "l_shipdate", i.orders, "o_orderkey", "o_orderdate")


@query(
    "golden_vs_derived",
    """WITH d AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 - l_discount AS DECIMAL(6,2))) AS derived FROM lineitem GROUP BY 1),
       j AS (SELECT CAST(o_totalprice AS DECIMAL(18,4)) AS stored, derived FROM orders LEFT JOIN d ON l_orderkey = o_orderkey)
       SELECT CAST(count(*) AS BIGINT) AS parents, CAST(count(*) FILTER (derived IS NULL) AS BIGINT) AS without_children,
       CAST(count(*) FILTER (abs(stored - derived) > 100000) AS BIGINT) AS drifted,
       CAST(count(*) FILTER (abs(stored - derived) <= 100000) AS BIGINT) AS agreeing FROM j""",
)
def _(i):
    return ri.golden_vs_derived(
        i.orders,
        "o_orderkey",
        "o_totalprice",
        i.lineitem,
        "l_orderkey",
        "CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 - l_discount AS DECIMAL(6,2))",
        "100000",
    )


# --- single tables --------------------------------------------------------------------------


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(i):
    return pf.duplicate_keys(i.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "duplicate_keys_orders",
    "SELECT o_orderkey, CAST(count(*) AS BIGINT) AS copies FROM {orders_dup_fx} GROUP BY 1 HAVING count(*) > 1",
)
def _(i):
    return pf.duplicate_keys(i.orders_dup_fx, ["o_orderkey"])


@query(
    "duplicate_keys_ci",
    """SELECT lower(email) AS folded, CAST(count(*) AS BIGINT) AS copies, CAST(count(DISTINCT email) AS BIGINT) AS spellings
       FROM {customer_fx} GROUP BY 1 HAVING count(*) > 1""",
)
def _(i):
    return pf.duplicate_keys_ci(i.customer_fx, "email")


@query(
    "duplicate_live_rows",
    "SELECT email, CAST(count(*) AS BIGINT) AS copies FROM {customer_fx} WHERE deleted_at IS NULL GROUP BY 1 HAVING count(*) > 1",
)
def _(i):
    return pf.duplicate_live_rows(i.customer_fx, ["email"], "deleted_at")


@query(
    "soft_delete_resurrection",
    """SELECT email, CAST(count(*) FILTER (deleted_at IS NULL) AS BIGINT) AS live_rows, CAST(count(deleted_at) AS BIGINT) AS deleted_rows
       FROM {customer_fx} GROUP BY 1 HAVING count(deleted_at) > 0 AND count(*) > count(deleted_at)""",
)
def _(i):
    return pf.soft_delete_resurrection(i.customer_fx, ["email"], "deleted_at")


KEY_SETS = [["l_orderkey"], ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]]


@query(
    "candidate_key_profile",
    " UNION ALL ".join(
        f"""SELECT '{','.join(k)}' AS candidate, CAST(sum(n) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS distinct_values,
        CAST(0 AS BIGINT) AS null_rows, sum(n) = count(*) AS is_key FROM (SELECT count(*) AS n FROM lineitem GROUP BY {','.join(k)}) t"""
        for k in KEY_SETS
    )
    + """ UNION ALL SELECT 'o_custkey', (SELECT count(*) FROM {orders_fx}), (SELECT count(DISTINCT o_custkey) FROM {orders_fx}),
          (SELECT count(*) FROM {orders_fx} WHERE o_custkey IS NULL), false""",
)
def _(i):
    return pf.candidate_key_profile(i.lineitem, KEY_SETS).unionByName(pf.candidate_key_profile(i.orders_fx, [["o_custkey"]]))


KEYS = [("orders", "o_orderkey"), ("customer", "c_custkey"), ("events", "event_id"), ("orders_fx", "o_custkey")]


@query(
    "key_headroom",
    " UNION ALL ".join(
        f"""SELECT '{t}.{k}' AS key_name, CAST(max({k}) AS BIGINT) AS max_id, CAST(10000 * max({k}) // 2147483647 AS BIGINT) AS used_bp
        FROM {'{orders_fx}' if t == 'orders_fx' else t}"""
        for t, k in KEYS
    ),
)
def _(i):
    return pf.key_headroom([(f"{t}.{k}", getattr(i, t), k) for t, k in KEYS])


PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_note", "o_totalprice"]


@query(
    "null_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count({c}) AS BIGINT) AS nulls,
        CAST(count(*) FILTER (CAST({c} AS VARCHAR) = '') AS BIGINT) AS empties FROM {{orders_fx}}"""
        for c in PROFILED
    ),
)
def _(i):
    return pf.null_profile(i.orders_fx, PROFILED)


RULES = {
    "price_not_negative": "o_totalprice >= 0",
    "status_in_domain": "o_orderstatus IN ('P', 'O', 'F')",
    "priority_is_scalar": "instr(o_orderpriority, ',') = 0",
    "note_not_blank": "o_note <> ''",
    "customer_known": "o_custkey < 1000000",
}


@query(
    "check_violations",
    " UNION ALL ".join(
        f"SELECT '{n}' AS rule, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (NOT ({r})) AS BIGINT) AS violations FROM {{orders_fx}}"
        for n, r in RULES.items()
    ),
)
def _(i):
    return pf.check_violations(i.orders_fx, RULES)


FDS = [("part", "p_brand", "p_type"), ("part", "p_name", "p_type"), ("nation", "n_nationkey", "n_regionkey"), ("orders", "o_custkey", "o_orderpriority")]


@query(
    "fd_check",
    " UNION ALL ".join(
        f"""SELECT '{x}->{y}' AS fd, CAST(count(*) AS BIGINT) AS determinants, CAST(count(*) FILTER (ys = 1) AS BIGINT) AS determined,
        CAST(max(ys) AS BIGINT) AS max_dependents, max(ys) <= 1 AS holds FROM (SELECT {x}, count(DISTINCT {y}) AS ys FROM {t} GROUP BY 1) t"""
        for t, x, y in FDS
    ),
)
def _(i):
    parts = [pf.fd_check(getattr(i, t), x, y) for t, x, y in FDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


FD_COLUMNS = ["p_name", "p_brand", "p_type", "p_size"]


@query(
    "fd_discovery",
    " UNION ALL ".join(
        f"""SELECT '{x}' AS x, '{y}' AS y, CAST(count(DISTINCT {x}) AS BIGINT) AS distinct_x, CAST(count(DISTINCT ({x}, {y})) AS BIGINT) AS distinct_xy,
        count(DISTINCT {x}) = count(DISTINCT ({x}, {y})) AS holds FROM part"""
        for x in FD_COLUMNS
        for y in FD_COLUMNS
        if x != y
    ),
)
def _(i):
    return pf.fd_discovery(i.part, FD_COLUMNS)


LATTICE_COLUMNS = ["o_orderkey", "o_custkey", "c_nationkey", "c_mktsegment", "o_orderpriority", "currency", "area"]


def _lattice_sql(table: str, columns: list[str], most: int) -> str:
    """Every set of columns grouped on its own, then what holds without a smaller set that does."""
    sets = [s for n in range(most + 1) for s in combinations(columns, n)]
    held, arms = [], []
    for k, s in enumerate(sets):
        answers = [*[f"max(d_{y}) <= 1 AS h_{y}" for y in columns if y not in s], "max(n) <= 1 AS h_key"]
        counted = ", ".join(f"count(DISTINCT {y}) + max(CASE WHEN {y} IS NULL THEN 1 ELSE 0 END) AS d_{y}" for y in columns if y not in s)
        held.append(f"s{k} AS MATERIALIZED (SELECT {', '.join(answers)} FROM (SELECT {counted}, count(*) AS n FROM {table} {'GROUP BY ' + ', '.join(s) if s else ''}) t)")
        parts = [j for j, p in enumerate(sets) if set(p) < set(s)]
        for y in [*[c for c in columns if c not in s], "key"]:
            rest = " AND ".join(["TRUE", *[f"NOT (SELECT h_{y} FROM s{j})" for j in parts], *[f"NOT (SELECT h_key FROM s{j})" for j in parts]])
            arms.append(f"SELECT '{','.join(s)}' AS determinant, '{'*' if y == 'key' else y}' AS dependent, {len(s)} AS \"columns\" FROM s{k} WHERE h_{y} AND {rest}")
    return f"WITH {', '.join(held)} {' UNION ALL '.join(arms)}"


@query("minimal_dependencies", _lattice_sql("{orders_wide_fx}", LATTICE_COLUMNS, 2))
def _(i):
    return dependencies.minimal_dependencies(i.orders_wide_fx, LATTICE_COLUMNS, 2)


DEPENDENTS = ["l_shipdate", "l_returnflag"]


@query(
    "partial_dependency",
    " UNION ALL ".join(
        f"""SELECT '{s}' AS key_part, '{c}' AS column_name, CAST(max(n) AS BIGINT) AS max_values, max(n) <= 1 AS partial
        FROM (SELECT {s}, count(DISTINCT {c}) AS n FROM lineitem GROUP BY 1) t"""
        for s in ("l_orderkey", "l_linenumber")
        for c in DEPENDENTS
    ),
)
def _(i):
    return pf.partial_dependency(i.lineitem, ["l_orderkey", "l_linenumber"], DEPENDENTS)


@query(
    "csv_evidence",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, CAST(count(*) AS BIGINT) AS rows,
        CAST(count(*) FILTER (instr({c}, ',') > 0) AS BIGINT) AS rows_with_delimiter FROM {{orders_fx}}"""
        for c in ("o_orderpriority", "o_orderstatus", "o_note")
    ),
)
def _(i):
    return pf.csv_evidence(i.orders_fx, ["o_orderpriority", "o_orderstatus", "o_note"])


DRIFT = "CAST(l_extendedprice AS DECIMAL(18,2))", "CAST(l_quantity AS DECIMAL(9,2)) * CAST(p_retailprice AS DECIMAL(9,2))"


@query(
    "derived_drift",
    f"""SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER ({DRIFT[0]} IS DISTINCT FROM {DRIFT[1]}) AS BIGINT) AS drifted
       FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def _(i):
    joined = i.lineitem.join(i.part, F.col("l_partkey") == F.col("p_partkey"))
    return pf.derived_drift(joined, *DRIFT)


MONEY = ["l_extendedprice", "l_discount", "l_tax", "l_quantity"]


@query(
    "money_scale_violations",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, CAST(count(*) AS BIGINT) AS rows,
        CAST(count(*) FILTER (CAST({c} AS DECIMAL(28,8)) <> round(CAST({c} AS DECIMAL(28,8)), 2)) AS BIGINT) AS violations,
        CAST(sum(CAST({c} AS DECIMAL(18,2))) * 100 AS BIGINT) AS total_minor FROM {{t}}""".replace("{t}", "(SELECT l_extendedprice, l_discount / 8 AS l_discount, l_tax, l_quantity FROM lineitem) x")
        for c in MONEY
    ),
)
def _(i):
    rows = i.lineitem.selectExpr("l_extendedprice", "l_discount / 8 AS l_discount", "l_tax", "l_quantity")
    return pf.money_scale_violations(rows, MONEY)


DOMAINS = ["o_orderstatus", "o_orderpriority", "o_note"]


@query(
    "low_card_domain",
    """WITH l AS ("""
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS domain_value FROM {{orders_fx}}" for c in DOMAINS)
    + """), c AS (SELECT column_name, domain_value, CAST(count(*) AS BIGINT) AS rows FROM l GROUP BY 1, 2),
       s AS (SELECT column_name, CAST(count(*) AS BIGINT) AS "values" FROM c GROUP BY 1)
       SELECT * FROM c JOIN s USING (column_name) WHERE "values" <= 10""",
)
def _(i):
    return pf.low_card_domain(i.orders_fx, DOMAINS, max_values=10)


@query(
    "narrowing_loss",
    """SELECT 'o_orderpriority' AS column_name, 'varchar(8)' AS target_type, CAST(count(*) AS BIGINT) AS rows,
       CAST(count(*) FILTER (length(o_orderpriority) > 8) AS BIGINT) AS lost FROM {orders_fx}
       UNION ALL SELECT 'o_custkey', 'smallint', count(*), count(*) FILTER (o_custkey IS NOT NULL AND TRY_CAST(o_custkey AS SMALLINT) IS NULL) FROM {orders_fx}
       UNION ALL SELECT 'o_totalprice', 'int', count(*), count(*) FILTER (CAST(o_totalprice AS DECIMAL(38,6)) <> trunc(CAST(o_totalprice AS DECIMAL(38,6)))) FROM {orders_fx}""",
)
def _(i):
    return pf.narrowing_loss(i.orders_fx, [("o_orderpriority", "varchar(8)"), ("o_custkey", "smallint"), ("o_totalprice", "int")])


@query(
    "json_key_profile",
    """WITH k AS (SELECT unnest(json_keys(props)) AS json_key FROM events)
       SELECT json_key, CAST(count(*) AS BIGINT) AS rows, (SELECT count(*) FROM events) AS documents,
       CAST(10000 * count(*) // (SELECT count(*) FROM events) AS BIGINT) AS share_bp, 10000 * count(*) // (SELECT count(*) FROM events) >= 9500 AS stable
       FROM k GROUP BY 1""",
)
def _(i):
    return pf.json_key_profile(i.events, "props")


@query(
    "json_path_profile",
    r"""WITH d AS (SELECT event_id, CASE WHEN json_valid(doc) THEN CAST(doc AS JSON) END AS j FROM {docs_fx}),
       m AS (SELECT fullkey, path AS above, CASE WHEN type IN ('OBJECT', 'ARRAY', 'BOOLEAN', 'NULL') THEN lower(type) WHEN type = 'VARCHAR' THEN 'string' ELSE 'number' END AS kind,
                    regexp_full_match(fullkey, '.*\[[0-9]+\]') AS place FROM (SELECT t.* FROM d, json_tree(d.j) t) x),
       n AS (SELECT regexp_replace(regexp_replace(fullkey, '\[[0-9]+\]', '[*]', 'g'), '\."([^"]*)"', '[''\1'']', 'g') AS path,
                    regexp_replace(regexp_replace(above, '\[[0-9]+\]', '[*]', 'g'), '\."([^"]*)"', '[''\1'']', 'g') AS above, kind, place FROM m),
       v AS (SELECT path, above, place, CAST(count(*) AS BIGINT) AS "values", string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(DISTINCT nullif(kind, 'null')) > 1 AS mixed FROM n GROUP BY 1, 2, 3),
       h AS (SELECT path AS above, kind = 'array' AS place, CAST(count(*) AS BIGINT) AS parents FROM n WHERE kind IN ('object', 'array') GROUP BY 1, 2)
       SELECT path, parents, "values", CASE WHEN NOT place THEN CAST(10000 * "values" // parents AS BIGINT) END AS share_bp, kinds, mixed,
              NOT place AND 10000 * "values" // parents >= 9500 AS stable FROM v JOIN h USING (above, place) WHERE path <> '$'
       UNION ALL SELECT '$', (SELECT count(*) FROM d), "values", CAST(10000 * "values" // (SELECT count(*) FROM d) AS BIGINT), kinds, mixed, FALSE FROM v WHERE path = '$'""",
)
def _(i):
    return documents.json_path_profile(i.docs_fx, "doc")


@query(
    "json_key_explosion",
    """WITH k AS (SELECT DISTINCT unnest(json_keys(json_object('k' || CAST(user_id AS VARCHAR), event_id))) AS json_key FROM events)
       SELECT CAST(count(*) AS BIGINT) AS distinct_keys, count(*) > 100 AS exploded FROM k""",
)
def _(i):
    docs = i.events.select(F.to_json(F.create_map(F.concat(F.lit("k"), F.col("user_id")), F.col("event_id"))).alias("doc"))
    return pf.json_key_explosion(docs, "doc", 100)


@query(
    "array_growth",
    """SELECT label, CAST(count(*) AS BIGINT) AS documents, CAST(max(len(embedding)) AS BIGINT) AS max_items,
       CAST(1000 * sum(len(embedding)) // count(*) AS BIGINT) AS avg_items_milli, CAST(count(*) FILTER (len(embedding) * 10 >= 63 * 9) AS BIGINT) AS near_cap
       FROM embeddings GROUP BY 1""",
)
def _(i):
    return pf.array_growth(i.embeddings, "label", F.size("embedding"), 63)


@query(
    "array_growth_children",
    """SELECT 'all' AS scope, CAST(count(*) AS BIGINT) AS documents, CAST(max(n) AS BIGINT) AS max_items,
       CAST(1000 * sum(n) // count(*) AS BIGINT) AS avg_items_milli, CAST(count(*) FILTER (n * 10 >= 8 * 9) AS BIGINT) AS near_cap
       FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) t""",
)
def _(i):
    return pf.child_growth(i.conversations, "conv_id", 8)


@query(
    "doc_size_profile",
    """SELECT lang, CAST(count(*) AS BIGINT) AS documents, CAST(max(strlen(text)) AS BIGINT) AS max_bytes, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes,
       CAST(count(*) FILTER (strlen(text) * 10 >= 16384 * 9) AS BIGINT) AS near_cap FROM documents GROUP BY 1""",
)
def _(i):
    return pf.doc_size_profile(i.documents, "text", "lang", cap=16384)


@query(
    "key_skew",
    """WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
       SELECT CAST(count(*) AS BIGINT) AS keys, CAST(sum(n) AS BIGINT) AS rows, CAST(max(n) AS BIGINT) AS max_rows,
       (SELECT user_id FROM c ORDER BY n DESC, user_id LIMIT 1) AS top_key, CAST(10000 * max(n) // sum(n) AS BIGINT) AS top_share_bp,
       CAST(10000 * max(n) * count(*) // sum(n) AS BIGINT) AS max_over_mean_bp FROM c""",
)
def _(i):
    return pf.key_skew(i.events, "user_id")


@query(
    "top_key_share",
    """WITH c AS (SELECT l_suppkey, CAST(count(*) AS BIGINT) AS rows FROM lineitem GROUP BY 1),
       t AS (SELECT * FROM c ORDER BY rows DESC, l_suppkey LIMIT 20),
       w AS (SELECT *, CAST(row_number() OVER o AS INT) AS rank, CAST(sum(rows) OVER o AS BIGINT) AS cumulative FROM t WINDOW o AS (ORDER BY rows DESC, l_suppkey))
       SELECT *, CAST(10000 * cumulative // (SELECT sum(rows) FROM c) AS BIGINT) AS cumulative_bp FROM w""",
)
def _(i):
    return pf.top_key_share(i.lineitem, "l_suppkey", 20)


@query(
    "partition_bound",
    f"""SELECT user_id, strftime(date_trunc('day', ts), '{SQL_STAMP}') AS bucket, CAST(count(*) AS BIGINT) AS rows FROM events GROUP BY 1, 2 HAVING count(*) > 4""",
)
def _(i):
    return pf.partition_bound(i.events, "user_id", F.date_format(tm.trunc("day", "ts"), STAMP), 4)


@query(
    "key_cardinality",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_values, CAST(count({c}) AS BIGINT) AS rows FROM events"
        for c in ("user_id", "event_type", "event_id")
    ),
)
def _(i):
    return pf.key_cardinality(i.events, ["user_id", "event_type", "event_id"])


@query("key_cardinality_approx")
def _(i):
    return pf.key_cardinality_approx(i.events, ["user_id", "event_type", "event_id"])


@query(
    "tag_cardinality",
    """SELECT 'user_id,event_type' AS tags, CAST(count(*) AS BIGINT) AS series, CAST(max(n) AS BIGINT) AS max_points
       FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type) t""",
)
def _(i):
    return pf.tag_cardinality(i.events, ["user_id", "event_type"])


@query(
    "monotonic_key",
    """WITH e AS (SELECT 'events' AS t, ts < lag(ts) OVER (ORDER BY event_id) AS inv FROM events),
       o AS (SELECT 'orders' AS t, o_orderdate < lag(o_orderdate) OVER (ORDER BY o_orderkey) AS inv FROM orders)
       SELECT t AS table_name, CAST(count(inv) AS BIGINT) AS steps, CAST(count(*) FILTER (inv) AS BIGINT) AS inversions, count(*) FILTER (inv) = 0 AS monotonic
       FROM (SELECT * FROM e UNION ALL SELECT * FROM o) x GROUP BY 1""",
)
def _(i):
    events = pf.monotonic_key(i.events, "event_id", "ts", id_bucket("event_id", 100_000)).withColumn("table_name", F.lit("events"))
    orders = pf.monotonic_key(i.orders, "o_orderkey", "o_orderdate", id_bucket("o_orderkey", 100_000))
    return events.unionByName(orders.withColumn("table_name", F.lit("orders")))


@query(
    "null_tenant_rows",
    """SELECT 'line_tenant' AS table_name, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count(tenant_id) AS BIGINT) AS unscoped_rows FROM {line_tenant_fx}""",
)
def _(i):
    return pf.null_tenant_rows(i.line_tenant_fx, "tenant_id", "line_tenant")


@query(
    "idempotency_duplicates",
    """SELECT user_id, event_type, CAST(floor(value) AS BIGINT) AS amount, CAST(count(*) AS BIGINT) AS applied,
       epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us FROM events GROUP BY 1, 2, 3 HAVING count(*) > 1""",
)
def _(i):
    ops = i.events.withColumn("amount", F.floor("value").cast("long"))
    return pf.idempotency_duplicates(ops, ["user_id", "event_type", "amount"], "ts")


WAITS = """event_id, CASE WHEN event_id % 3 = 0 THEN 'idle' ELSE 'active' END AS state,
           CASE WHEN user_id % 2 = 0 THEN 'Lock' ELSE 'IO' END AS wait_event_type, event_type AS wait_event"""


@query(
    "wait_event_summary",
    f"""SELECT wait_event_type, wait_event, CAST(count(*) AS BIGINT) AS sessions FROM (SELECT {WAITS} FROM events) w
        WHERE state = 'active' GROUP BY 1, 2""",
)
def _(i):
    frame = i.events.selectExpr(
        "event_id",
        "CASE WHEN event_id % 3 = 0 THEN 'idle' ELSE 'active' END AS state",
        "CASE WHEN user_id % 2 = 0 THEN 'Lock' ELSE 'IO' END AS wait_event_type",
        "event_type AS wait_event",
    )
    return pf.wait_event_summary(frame, "state", "wait_event_type", "wait_event")


# --- time -----------------------------------------------------------------------------------


@query(
    "chunk_sizing",
    """WITH c AS (SELECT date_trunc('hour', ts) AS b, count(*) AS n FROM events GROUP BY 1),
       g AS (SELECT unnest(generate_series((SELECT min(b) FROM c), (SELECT max(b) FROM c), INTERVAL 1 HOUR)) AS b)
       SELECT 'hour' AS chunk, CAST(count(*) AS BIGINT) AS chunks, CAST(min(coalesce(n, 0)) AS BIGINT) AS min_rows,
       CAST(max(coalesce(n, 0)) AS BIGINT) AS max_rows, CAST(count(*) FILTER (n IS NULL) AS BIGINT) AS empty_chunks FROM g LEFT JOIN c USING (b)""",
)
def _(i):
    return tm.chunk_sizing(i.events, "ts", "hour")


@query(
    "time_gap_fill",
    f"""WITH p AS (SELECT ts FROM events), c AS (SELECT date_trunc('hour', ts) AS b, count(*) AS n FROM p GROUP BY 1),
       g AS (SELECT unnest(generate_series((SELECT min(b) FROM c), (SELECT max(b) FROM c), INTERVAL 1 HOUR)) AS b)
       SELECT strftime(b, '{SQL_STAMP}') AS bucket, CAST(coalesce(n, 0) AS BIGINT) AS rows FROM g LEFT JOIN c USING (b)""",
)
def _(i):
    filled = tm.gap_fill(i.events, "ts", "hour")
    return filled.select(stamp("bucket").alias("bucket"), "rows")


@query(
    "rollup_hourly",
    f"""SELECT strftime(date_trunc('hour', ts), '{SQL_STAMP}') AS bucket, event_type, CAST(count(*) AS BIGINT) AS n,
        CAST(sum(CAST(value AS DECIMAL(18,2))) * 100 AS BIGINT) AS total_minor FROM events GROUP BY 1, 2""",
)
def _(i):
    out = tm.rollup_hourly(i.events, "ts", ["event_type"], "value")
    return out.withColumn("bucket", stamp("bucket"))


@query(
    "rollup_grains",
    """WITH e AS (SELECT strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day, event_type FROM events)
       SELECT CASE WHEN grouping(month) = 1 THEN '*' ELSE month END AS month, CASE WHEN grouping(day) = 1 THEN '*' ELSE day END AS day,
       CASE WHEN grouping(event_type) = 1 THEN '*' ELSE event_type END AS event_type, CAST(count(*) AS BIGINT) AS n
       FROM e GROUP BY ROLLUP (month, day, event_type)""",
)
def _(i):
    days = i.events.select(F.date_format("ts", "yyyy-MM").alias("month"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    return tm.rollup_grains(days, ["month", "day", "event_type"])


@query(
    "rollup_cube",
    """SELECT CASE WHEN grouping(l_returnflag) = 1 THEN '*' ELSE l_returnflag END AS l_returnflag,
       CASE WHEN grouping(l_linestatus) = 1 THEN '*' ELSE l_linestatus END AS l_linestatus,
       CASE WHEN grouping(l_linenumber) = 1 THEN '*' ELSE CAST(l_linenumber AS VARCHAR) END AS l_linenumber,
       CAST(grouping(l_returnflag) * 4 + grouping(l_linestatus) * 2 + grouping(l_linenumber) AS INT) AS "grouping", CAST(count(*) AS BIGINT) AS n
       FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)""",
)
def _(i):
    return tm.cube_grains(i.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"])


@query(
    "rollup_staleness",
    f"""WITH f AS (SELECT date_trunc('hour', ts) AS bucket, CAST(count(*) AS BIGINT) AS fresh_n FROM events GROUP BY 1)
       SELECT strftime(coalesce(f.bucket, s.bucket), '{SQL_STAMP}') AS bucket, coalesce(s.n, 0) AS stored_n, coalesce(fresh_n, 0) AS fresh_n,
       CASE WHEN s.n IS NULL THEN 'missing' WHEN fresh_n IS NULL THEN 'extra' ELSE 'stale' END AS state
       FROM f FULL JOIN {{stored_rollup_fx}} s ON f.bucket = s.bucket WHERE fresh_n IS DISTINCT FROM s.n""",
)
def _(i):
    return tm.rollup_staleness(i.events, "ts", "hour", i.stored_rollup_fx).withColumn("bucket", stamp("bucket"))


@query(
    "retention_report",
    """SELECT strftime(l_shipdate, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS rows,
       CAST(count(*) FILTER (l_shipdate < TIMESTAMP '1998-01-15 00:00:00') AS BIGINT) AS expired FROM lineitem GROUP BY 1""",
)
def _(i):
    return tm.retention_report(i.lineitem, "l_shipdate", "1998-01-15 00:00:00")
