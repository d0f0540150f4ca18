"""Scoring operators bound to findings derived from ``lineitem``, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import grading as gr
from plumbline.operators import profiles, scoring
from plumbline.plans.registry import query

# --- building blocks of the oracles -----------------------------------------------------------

PROFILE_VALUES = ", ".join(
    f"('{p}', '{a}', '{c}', {w}, '{m}')" for p, a, c, w, mods in profiles.profile_rows() for m in mods
)
RANK = "CASE {c} WHEN 'fail' THEN 0 WHEN 'warn' THEN 1 WHEN 'needs_api' THEN 2 WHEN 'pass' THEN 3 WHEN 'not_applicable' THEN 4 ELSE 5 END"
CONF = "CASE confidence WHEN 'established' THEN 0 WHEN 'directional' THEN 1 ELSE 2 END"
MAG = "CASE magnitude WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
FIX = "CASE fixable WHEN 'auto' THEN 0 WHEN 'proposed' THEN 1 ELSE 2 END"


def dedupe_sql(source: str) -> str:
    return f"""SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY store, id
        ORDER BY {RANK.format(c='status')}, severity DESC, {CONF}, paradigm, module, object, status, severity, axis, confidence, magnitude, fixable) = 1"""


PROF = f"prof(paradigm, axis, category, weight, module) AS (VALUES {PROFILE_VALUES})"
DEDUPED = f"d AS ({dedupe_sql('{findings_fx}')})"
SCORED = """x AS (SELECT d.* EXCLUDE (axis), a.axis FROM d JOIN (VALUES ('design'), ('performance')) a(axis) ON d.axis = a.axis OR d.axis = 'both'),
  s AS (SELECT x.*, p.category, p.weight FROM x JOIN prof p ON p.paradigm = x.paradigm AND p.axis = x.axis AND p.module = regexp_replace(x.module, '[a-z]$', ''))"""
OK = "status IN ('pass', 'warn', 'fail') AND severity > 0"
CATS = f"""cats AS (SELECT store, paradigm, axis, category, weight,
    CAST(coalesce(sum(CASE status WHEN 'pass' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END * severity) FILTER ({OK}), 0) AS BIGINT) AS pts,
    CAST(coalesce(sum(severity) FILTER ({OK}), 0) AS BIGINT) AS den,
    count(*) FILTER ({OK}) > 0 AS active, count(*) FILTER (status = 'needs_api') AS na,
    count(*) FILTER (severity = 5 AND status = 'fail' AND confidence = 'established') AS gating FROM s GROUP BY ALL),
  vals AS (SELECT *, CASE WHEN den > 0 THEN (1000 * pts + den) // (2 * den) ELSE 0 END AS t FROM cats)"""
BAND = "CASE WHEN {v} >= 90 THEN 'A' WHEN {v} >= 80 THEN 'B' WHEN {v} >= 70 THEN 'C' WHEN {v} >= 60 THEN 'D' ELSE 'F' END"
AXES = f"""grid AS (SELECT * FROM (SELECT DISTINCT store, paradigm FROM d) g, (VALUES ('design'), ('performance')) a(axis)),
  sums AS (SELECT store, paradigm, axis, coalesce(sum(t * weight) FILTER (active), 0) AS num, coalesce(sum(weight) FILTER (active), 0) AS den,
     coalesce(sum(na), 0) AS na, coalesce(sum(gating), 0) AS gating FROM grid LEFT JOIN vals USING (store, paradigm, axis) GROUP BY ALL),
  comp AS (SELECT *, CAST(CASE WHEN den > 0 THEN (2 * num + den) // (2 * den) ELSE 0 END AS BIGINT) AS t FROM sums),
  ax AS (SELECT store, paradigm, axis, CASE WHEN gating > 0 THEN least(t, 590) ELSE t END / 10 AS value, t / 10 AS computed, gating > 0 AS capped,
     CAST(den AS BIGINT) AS active_weight, CAST(na AS BIGINT) AS needs_api_count FROM comp),
  scores AS (SELECT *, {BAND.format(v='value')} AS band FROM ax)"""
BASE = f"WITH {PROF}, {DEDUPED}, {SCORED}, {CATS}, {AXES}"


def findings(i):
    return scoring.dedupe_findings(i.findings_fx)


# --- queries ------------------------------------------------------------------------------------


@query(
    "validate_findings",
    r"""SELECT id, status, severity, array_to_string(list_sort(list_filter([
        CASE WHEN id IS NULL THEN 'id: missing' WHEN NOT regexp_matches(id, '^M([0-9]|1[0-9]|2[0-2])[a-z]?\.[a-z0-9_.-]+$') THEN 'id: bad pattern' END,
        CASE WHEN NOT regexp_matches(module, '^M([0-9]|1[0-9]|2[0-2])[a-z]?$') THEN 'module: bad pattern' END,
        CASE WHEN severity < 0 OR severity > 5 THEN 'severity: out of range' END,
        CASE WHEN length(title) < 3 THEN 'title: bad length' END,
        CASE WHEN status = 'ok' THEN 'status: unknown value' END,
        CASE WHEN axis = 'cost' THEN 'axis: unknown value' END,
        CASE WHEN fixable = 'never' THEN 'fixable: unknown value' END,
        CASE WHEN scope = 'row' THEN 'scope: unknown value' END], lambda x: x IS NOT NULL)), '; ') AS errors
       FROM {findings_raw_fx}""",
)
def _(i):
    checked = scoring.validate_findings(i.findings_raw_fx)
    return checked.select("id", "status", "severity", F.array_join("errors", "; ").alias("errors"))


@query("dedupe_findings", dedupe_sql("{findings_fx}"))
def _(i):
    return findings(i)


@query(
    "paradigm_profiles",
    f"""WITH {PROF}, n AS (SELECT regexp_replace(module, '[a-z]$', '') AS module, paradigm, CAST(count(*) AS BIGINT) AS findings FROM {{findings_fx}} GROUP BY 1, 2)
       SELECT p.paradigm, p.axis, p.category, p.weight, p.module, coalesce(n.findings, 0) AS findings FROM prof p LEFT JOIN n USING (paradigm, module)""",
)
def _(i):
    counts = i.findings_fx.groupBy(gr.parent_module(F.col("module")).alias("module"), "paradigm").agg(F.count(F.lit(1)).alias("findings"))
    return profiles.profile_modules(i.spark).join(counts, ["paradigm", "module"], "left").na.fill(0, ["findings"])


@query(
    "profile_check",
    f"""WITH {PROF}, w AS (SELECT DISTINCT paradigm, axis, category, weight FROM prof),
       t AS (SELECT paradigm, axis, CAST(sum(weight) AS BIGINT) AS total_weight, CAST(count(*) AS BIGINT) AS categories FROM w GROUP BY 1, 2),
       u AS (SELECT DISTINCT paradigm FROM {{findings_fx}})
       SELECT *, CAST(0 AS BIGINT) AS repeated_modules, total_weight = 100 AS balanced FROM t WHERE paradigm IN (FROM u)""",
)
def _(i):
    used = i.findings_fx.select("paradigm").distinct()
    return profiles.profile_check(profiles.paradigm_profiles(i.spark)).join(used, "paradigm", "left_semi")


@query(
    "category_scores",
    f"{BASE} SELECT store, paradigm, axis, category, weight, active, CAST(na AS BIGINT) AS needs_api_count, t / 10 AS value FROM vals",
)
def _(i):
    return scoring.category_scores(findings(i))


@query("axis_scores", f"{BASE} SELECT * FROM scores")
def _(i):
    return scoring.axis_scores(findings(i))


@query("severity_gate", f"{BASE} SELECT store, axis, id, module, category FROM s WHERE severity = 5 AND status = 'fail' AND confidence = 'established'")
def _(i):
    return scoring.severity_gate(findings(i))


@query("needs_api_count", f"{BASE} SELECT store, axis, needs_api_count FROM scores")
def _(i):
    return scoring.axis_scores(findings(i)).select("store", "axis", "needs_api_count")


@query(
    "score_interpretation",
    f"""{BASE}, w AS (SELECT store, max(value) FILTER (axis = 'design') AS design, max(value) FILTER (axis = 'performance') AS performance FROM scores GROUP BY 1)
       SELECT *, CASE WHEN design >= 70 AND performance >= 70 THEN 'solid and ready to scale' WHEN design >= 70 AND performance < 60 THEN 'clean model, will not carry load yet'
       WHEN design < 60 AND performance >= 70 THEN 'fast today, the model is decaying' WHEN design < 60 AND performance < 60 THEN 'foundation problems, fix the caps first'
       ELSE 'mixed, follow the prioritized actions' END AS interpretation FROM w""",
)
def _(i):
    return scoring.score_interpretation(scoring.axis_scores(findings(i)))


@query(
    "multi_store_rollup",
    f"""{BASE} SELECT axis, value, store AS floored_by, CAST(n AS BIGINT) AS stores, band FROM
       (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY value, store) AS rn, count(*) OVER (PARTITION BY axis) AS n FROM scores) t WHERE rn = 1""",
)
def _(i):
    return scoring.multi_store_rollup(scoring.axis_scores(findings(i)))


@query(
    "rescore_paradigm",
    f"""WITH {PROF}, d0 AS ({dedupe_sql('{findings_fx}')}), d AS (SELECT d0.* EXCLUDE (paradigm), p.paradigm FROM d0, (SELECT DISTINCT paradigm FROM prof) p), {SCORED}, {CATS}, {AXES}
       SELECT * FROM scores""",
)
def _(i):
    return scoring.rescore_paradigm(findings(i))


@query(
    "score_delta",
    f"""WITH {PROF}, d AS ({dedupe_sql('{findings_fx}')}), {SCORED}, {CATS}, {AXES},
       old AS MATERIALIZED (SELECT * FROM scores),
       d2 AS (SELECT * REPLACE (CASE WHEN status = 'fail' AND fixable = 'auto' THEN 'pass' ELSE status END AS status) FROM d),
       {SCORED.replace('x AS', 'x2 AS').replace('FROM d JOIN', 'FROM d2 JOIN').replace('SELECT d.*', 'SELECT d2.*').replace('ON d.axis = a.axis OR d.axis', 'ON d2.axis = a.axis OR d2.axis').replace('s AS (SELECT x.*', 's2 AS (SELECT x2.*').replace('FROM x JOIN', 'FROM x2 JOIN').replace('= x.', '= x2.').replace('(x.module', '(x2.module')},
       {CATS.replace('cats AS', 'cats2 AS').replace('FROM s GROUP', 'FROM s2 GROUP').replace('vals AS', 'vals2 AS').replace('FROM cats)', 'FROM cats2)')},
       {AXES.replace('grid AS', 'grid2 AS').replace('FROM d)', 'FROM d2)').replace('sums AS', 'sums2 AS').replace('FROM grid LEFT JOIN vals', 'FROM grid2 LEFT JOIN vals2').replace('comp AS', 'comp2 AS').replace('FROM sums)', 'FROM sums2)').replace('ax AS', 'ax2 AS').replace('FROM comp)', 'FROM comp2)').replace('scores AS', 'scores2 AS').replace('FROM ax)', 'FROM ax2)')}
       SELECT o.store, o.axis, o.value AS old_value, o.band AS old_band, n.value AS new_value, n.band AS new_band,
       CAST(CAST(n.value - o.value AS DECIMAL(9,1)) AS DOUBLE) AS delta FROM old o JOIN scores2 n USING (store, axis)""",
)
def _(i):
    before = findings(i)
    fixed = F.when((F.col("status") == "fail") & (F.col("fixable") == "auto"), "pass").otherwise(F.col("status"))
    after = before.withColumn("status", fixed)
    return scoring.score_delta(scoring.axis_scores(before), scoring.axis_scores(after))


EVIDENCE = "SELECT store, id, CAST(length(object) % 3 AS BIGINT) AS violations FROM {f} WHERE status IN ('needs_api', 'warn') AND severity >= 3"


@query(
    "tier_upgrade",
    f"""WITH {DEDUPED}, e AS ({EVIDENCE.format(f='d')}),
       j AS (SELECT d.*, e.violations AS v, d.status IN ('needs_api', 'warn', 'fail') AS o FROM d LEFT JOIN e USING (store, id))
       SELECT store, id, module, severity, CASE WHEN o AND v > 0 AND severity >= 4 THEN 'fail' WHEN o AND v > 0 THEN 'warn' WHEN o AND v = 0 THEN 'pass' ELSE status END AS status,
       CASE WHEN o AND v >= 0 THEN 'established' ELSE confidence END AS confidence FROM j""",
)
def _(i):
    base = findings(i)
    evidence = base.where("status IN ('needs_api', 'warn') AND severity >= 3").selectExpr(
        "store", "id", "CAST(length(object) % 3 AS BIGINT) AS violations"
    )
    return scoring.tier_upgrade(base, evidence).select("store", "id", "module", "severity", "status", "confidence")


OPEN = "status IN ('fail', 'warn', 'needs_api')"


@query(
    "next_actions",
    f"""{BASE}, t AS (SELECT store, id, module, min(CASE WHEN severity = 5 AND status = 'fail' AND confidence = 'established' THEN 0 ELSE 1 END) AS gate_rank,
         max(severity * weight) AS impact, min({FIX}) AS fix_rank, min(CASE WHEN status = 'needs_api' THEN 2 WHEN confidence = 'established' THEN 1 ELSE 0 END) AS cost_rank
         FROM s WHERE {OPEN} GROUP BY 1, 2, 3)
       SELECT *, CAST(dense_rank() OVER (PARTITION BY store ORDER BY gate_rank, impact DESC, fix_rank, cost_rank) AS INT) AS priority FROM t""",
)
def _(i):
    return scoring.next_actions(findings(i))


@query(
    "prioritized_actions",
    f"""WITH {DEDUPED}, p AS (SELECT store, id, CAST(floor(severity * (3 - {MAG}) * 1000 / (1 + {FIX})) AS BIGINT) AS score_milli FROM d WHERE {OPEN})
       SELECT store, id, score_milli, CAST(row_number() OVER (PARTITION BY store ORDER BY score_milli DESC, id) AS INT) AS rank FROM p QUALIFY rank <= 25""",
)
def _(i):
    return scoring.prioritized_actions(findings(i), 25)


@query(
    "top_issues_per_axis",
    f"""WITH {DEDUPED}, x AS (SELECT d.* EXCLUDE (axis), a.axis FROM d JOIN (VALUES ('design'), ('performance')) a(axis) ON d.axis = a.axis OR d.axis = 'both')
       SELECT store, axis, id, status, severity, CAST(row_number() OVER (PARTITION BY store, axis ORDER BY CASE WHEN severity = 5 AND status = 'fail' THEN 0 ELSE 1 END,
       {RANK.format(c='status')}, severity DESC, {MAG}, id) AS INT) AS rank FROM x WHERE {OPEN} QUALIFY rank <= 10""",
)
def _(i):
    return scoring.top_issues_per_axis(findings(i), 10)


@query(
    "findings_by_module",
    f"""WITH {DEDUPED} SELECT regexp_replace(module, '[a-z]$', '') AS module, severity, """
    + ", ".join(f"CAST(count(*) FILTER (status = '{s}') AS BIGINT) AS {s}" for s in scoring.STATUSES)
    + " FROM d GROUP BY 1, 2",
)
def _(i):
    return scoring.findings_by_module(findings(i))


@query(
    "fix_plan",
    f"""{BASE} SELECT store, axis, category, fixable, CAST(count(*) AS BIGINT) AS fixes, max(severity) AS max_severity FROM s
       WHERE {OPEN} AND fixable IN ('auto', 'proposed') AND NOT (module = 'M22' AND severity = 5) GROUP BY 1, 2, 3, 4""",
)
def _(i):
    return scoring.fix_plan(findings(i))


CHECK_VALUES = ", ".join(
    f"({n + 1}, '{name}', {str(name in scoring.RELATIONAL_ONLY).lower()}, '{' '.join(mods)}')" for n, (name, mods) in enumerate(scoring.CHECKLIST)
)
CHECKLIST_SQL = f"""WITH {DEDUPED}, chk(check_no, "check", rel, mods) AS (VALUES {CHECK_VALUES}),
  g AS (SELECT s.store, s.paradigm, chk.* FROM (SELECT DISTINCT store, paradigm FROM d) s, chk),
  m AS (SELECT d.*, chk.check_no FROM d JOIN chk ON list_contains(string_split(mods, ' '), regexp_replace(d.module, '[a-z]$', ''))),
  c AS (SELECT store, check_no, count(*) FILTER (status = 'fail' AND severity >= 4) AS fails, count(*) FILTER (status IN ('warn', 'fail')) AS warns,
     count(*) FILTER (status = 'needs_api') AS unk, count(*) FILTER (status = 'pass') AS passes, count(*) FILTER ({OPEN}) AS driving FROM m GROUP BY 1, 2),
  grid_out AS (SELECT g.store, g.check_no, g."check", CASE WHEN rel AND paradigm <> 'relational' THEN 'N-A' WHEN fails > 0 THEN 'FAIL' WHEN warns > 0 THEN 'WARN'
     WHEN unk > 0 THEN 'NEEDS-LIVE' WHEN passes > 0 THEN 'PASS' ELSE 'NEEDS-LIVE' END AS result, CAST(coalesce(driving, 0) AS BIGINT) AS driving
     FROM g LEFT JOIN c USING (store, check_no))"""


@query("readiness_checklist", f"{CHECKLIST_SQL} SELECT * FROM grid_out")
def _(i):
    return scoring.readiness_checklist(findings(i))


@query("readiness_drivers", f"{CHECKLIST_SQL} SELECT DISTINCT store, check_no, id, status FROM m WHERE {OPEN}")
def _(i):
    return scoring.readiness_drivers(findings(i))


@query(
    "readiness_verdict",
    f"""{CHECKLIST_SQL}, v AS (SELECT store, CAST(count(*) FILTER (result = 'FAIL') AS BIGINT) AS fails, CAST(count(*) FILTER (result IN ('WARN', 'NEEDS-LIVE')) AS BIGINT) AS caveats FROM grid_out GROUP BY 1)
       SELECT *, CASE WHEN fails > 0 THEN 'NO-GO' WHEN caveats > 0 THEN 'GO WITH CAVEATS' ELSE 'GO' END AS verdict FROM v""",
)
def _(i):
    return scoring.readiness_verdict(scoring.readiness_checklist(findings(i)))


# --- scalar functions on findings -----------------------------------------------------------------


@query(
    "parent_module",
    "SELECT module, regexp_replace(module, '[a-z]$', '') AS parent, CAST(count(*) AS BIGINT) AS findings FROM {findings_fx} GROUP BY 1",
)
def _(i):
    return (
        i.findings_fx.groupBy("module")
        .agg(F.count(F.lit(1)).alias("findings"))
        .withColumn("parent", gr.parent_module(F.col("module")))
    )


@query("band", f"SELECT event_id, value, {BAND.format(v='value / 5')} AS band FROM events")
def _(i):
    return i.events.select("event_id", "value", gr.band(F.col("value") / 5).alias("band"))


DIALECT = "split_part('MongoDB 7|DynamoDB|Apache Cassandra|Redis|Neo4j|pgvector|TimescaleDB|time series|PostgreSQL 16|', '|', CAST(1 + c_custkey % 10 AS INT))"


@query(
    "infer_paradigm",
    f"""SELECT c_custkey, CASE WHEN regexp_matches(x, 'mongo|document|firestore') THEN 'document' WHEN x LIKE '%dynamo%' THEN 'key-value'
       WHEN regexp_matches(x, 'cassandra|scylla|wide') THEN 'wide-column' WHEN x LIKE '%redis%' THEN 'key-value' WHEN regexp_matches(x, 'neo4j|graph') THEN 'graph'
       WHEN regexp_matches(x, 'pgvector|vector|qdrant|pinecone|weaviate') THEN 'vector' WHEN regexp_matches(x, 'timescale|influx|clickhouse|time-?series') THEN 'time-series'
       ELSE 'relational' END AS paradigm FROM (SELECT c_custkey, lower({DIALECT}) AS x FROM customer) t""",
)
def _(i):
    return i.customer.select("c_custkey", gr.infer_paradigm(F.expr(DIALECT)).alias("paradigm"))


ENGINE = "split_part('postgres|mysql|mongodb|redis|cassandra|pgvector|clickhouse|neo4j|oracle', '|', CAST(1 + c_custkey % 9 AS INT))"
URL = "split_part('postgres|postgresql|mongodb+srv|rediss|libsql|ftp', '|', CAST(1 + c_custkey % 6 AS INT)) || '://h' || CAST(c_custkey AS STRING)"


@query(
    "engine_paradigm",
    f"""SELECT c_custkey, {ENGINE} AS engine, split_part('relational|relational|document|key-value|wide-column|vector|time-series|graph|relational', '|', CAST(1 + c_custkey % 9 AS INT)) AS paradigm,
       split_part('postgres|postgres|mongodb|redis|turso|unknown', '|', CAST(1 + c_custkey % 6 AS INT)) AS url_engine FROM customer""",
)
def _(i):
    return i.customer.select(
        "c_custkey",
        F.expr(ENGINE).alias("engine"),
        gr.engine_paradigm(F.expr(ENGINE)).alias("paradigm"),
        F.coalesce(gr.scheme_engine(F.expr(URL)), F.lit("unknown")).alias("url_engine"),
    )


# --- the whole audit ------------------------------------------------------------------------------


@query("warehouse_findings")
def _(i):
    from plumbline.plans.flagship import warehouse_audit

    return warehouse_audit(i.spark, i.sf_dir).findings()


@query("warehouse_next_actions")
def _(i):
    from plumbline.plans.flagship import warehouse_actions

    return warehouse_actions(i.spark, i.sf_dir)
