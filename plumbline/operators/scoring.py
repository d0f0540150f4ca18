"""Findings to scores: validation, dedupe, two independent 0-100 axes, rollups and rankings.

A findings frame has one row per finding: ``store, paradigm, id, module, status, severity,
axis, confidence, magnitude, fixable`` (plus anything else, which is carried along).
Sums run over ``2 * factor * severity`` as integers, so scores do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import constant_frame
from plumbline.functions.grading import PARADIGMS, band, parent_module, tenths
from plumbline.operators.ordered import top_n
from plumbline.operators.profiles import profile_modules

# The finding vocabulary.
STATUSES = ["fail", "warn", "needs_api", "pass", "not_applicable"]  # most severe first
AXES = ["design", "performance", "both"]
CONFIDENCES = ["established", "directional", "speculative"]
MAGNITUDES = ["high", "medium", "low"]
FIXABLES = ["auto", "proposed", "advisory"]
SCOPES = ["column", "table", "index", "schema", "database", "cluster", "query", "collection", "keyspace"]
METHODS = [
    "ddl_parse",
    "migration_lint",
    "schema_introspect",
    "index_check",
    "explain_plan",
    "constraint_check",
    "query_stat",
    "dry_run_migration",
    "connection_introspect",
    "manual_review",
]
MODULE_PATTERN = "^M([0-9]|1[0-9]|2[0-2])[a-z]?$"
ID_PATTERN = r"^M([0-9]|1[0-9]|2[0-2])[a-z]?\.[a-z0-9_.-]+$"
REQUIRED = [
    "id",
    "module",
    "title",
    "status",
    "severity",
    "scope",
    "observed",
    "expected",
    "recommendation",
    "fixable",
    "method",
    "assertion",
    "reproduce",
    "axis",
    "confidence",
    "magnitude",
    "rationale",
]
GATE_CEILING = 59


def rank_in(column: str, ordered: list[str]) -> Column:
    """Position of a value in an ordered vocabulary (0 first, unknown last)."""
    position = F.array_position(F.array(*[F.lit(v) for v in ordered]), F.col(column)).cast("int")
    return F.when(F.coalesce(position, F.lit(0)) == 0, len(ordered)).otherwise(position - 1)


def validate_findings(findings: DataFrame) -> DataFrame:
    """Adds ``errors``; rows with any go to quarantine rather than being dropped."""

    def missing(c: str) -> Column:
        return F.when(F.col(c).isNull(), f"{c}: missing")

    def outside(c: str, allowed: list[str]) -> Column:
        return F.when(F.col(c).isNotNull() & ~F.col(c).isin(allowed), f"{c}: unknown value")

    checks = [missing(c) for c in REQUIRED if c in findings.columns]
    checks += [
        F.when(~F.col("id").rlike(ID_PATTERN), "id: bad pattern"),
        F.when(~F.col("module").rlike(MODULE_PATTERN), "module: bad pattern"),
        F.when((F.col("severity") < 0) | (F.col("severity") > 5), "severity: out of range"),
        F.when((F.char_length("title") < 3) | (F.char_length("title") > 160), "title: bad length"),
        outside("status", STATUSES),
        outside("axis", AXES),
        outside("confidence", CONFIDENCES),
        outside("magnitude", MAGNITUDES),
        outside("fixable", FIXABLES),
        outside("scope", SCOPES),
        outside("method", METHODS),
    ]
    return findings.withColumn("errors", F.array_sort(F.array_compact(F.array(*checks))))


def quarantine(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = validate_findings(findings)
    return checked.where(F.size("errors") == 0), checked.where(F.size("errors") > 0)


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """One finding per (store, id): the most severe status, then severity, then the firmest
    confidence, then the least values.

    The three ranks are one number, whose minimum per id is a hash aggregation of narrow rows
    combined map-side; only the findings that reach it are compared by their other columns.
    """
    keys = [k for k in ("store", "id") if k in findings.columns]
    rest = [c for c in findings.columns if c not in keys]
    # no severity is a severity of its own, before all others
    grade = (rank_in("status", STATUSES) * 10_000 + F.coalesce(1_000 - F.col("severity"), F.lit(0))) * 10 + rank_in("confidence", CONFIDENCES)
    graded = findings.withColumn("__grade", grade.cast("long"))
    best = graded.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min("__grade").alias("__best"))
    same = F.col("__grade") == F.col("__best")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    equal = graded.join(best, same).groupBy(*keys).agg(F.min(F.struct(*rest)).alias("f"))
    return equal.select(*keys, *[F.col(f"f.{c}") for c in rest])


def by_axis(findings: DataFrame) -> DataFrame:
    """Repeat each finding for every axis it feeds."""
    axes = F.when(F.col("axis") == "both", F.array(F.lit("design"), F.lit("performance"))).otherwise(F.array("axis"))
    return findings.withColumn("axis", F.explode(axes))


def in_profile(findings: DataFrame) -> DataFrame:
    """Findings per axis with category and weight; modules outside the paradigm drop out.
    The profile is a constant of fewer than 200 rows, hence broadcast."""
    modules = F.broadcast(profile_modules(findings.sparkSession))
    scored = by_axis(findings).withColumn("parent", parent_module(F.col("module")))
    return scored.join(modules.withColumnRenamed("module", "parent"), ["paradigm", "axis", "parent"])


def tally(findings: DataFrame) -> DataFrame:
    """Findings counted per everything a score depends on: a bounded number of rows per store."""
    return findings.groupBy("store", "paradigm", "module", "status", "severity", "axis", "confidence").agg(
        F.count(F.lit(1)).alias("n")
    )


def category_sums(tallied: DataFrame) -> DataFrame:
    """Per store, axis and category: everything any score needs, from one aggregation.

    Every finding is laid against both axes, so a store keeps a row (with NULL category) on an
    axis that none of its findings feed.
    """
    axes = F.explode(F.array(F.lit("design"), F.lit("performance")))
    laid = tallied.withColumnRenamed("axis", "fed").withColumn("axis", axes)
    feeds = (F.col("fed") == F.col("axis")) | (F.col("fed") == "both")
    laid = laid.withColumn("parent", F.when(feeds, parent_module(F.col("module"))))
    modules = F.broadcast(profile_modules(tallied.sparkSession).withColumnRenamed("module", "parent"))
    placed = F.col("category").isNotNull()
    counted = placed & F.col("status").isin("pass", "warn", "fail") & (F.col("severity") > 0)
    factor = F.when(F.col("status") == "pass", 2).when(F.col("status") == "warn", 1).otherwise(0)
    gate = placed & (F.col("severity") == 5) & (F.col("status") == "fail") & (F.col("confidence") == "established")

    def total(condition: Column, value: Column) -> Column:
        return F.sum(F.when(condition, F.col("n") * value).otherwise(0)).cast("long")

    return (
        laid.join(modules, ["paradigm", "axis", "parent"], "left")
        .groupBy("store", "paradigm", "axis", "category", "weight")
        .agg(
            total(counted, factor * F.col("severity")).alias("points"),
            total(counted, F.col("severity")).alias("severity_sum"),
            total(counted, F.lit(1)).alias("scored"),
            total(placed & (F.col("status") == "needs_api"), F.lit(1)).alias("needs_api_count"),
            total(gate, F.lit(1)).alias("gating"),
        )
    )


def _category_values(sums: DataFrame) -> DataFrame:
    value = F.when(F.col("severity_sum") > 0, tenths("50 * points", "greatest(severity_sum, 1)")).otherwise(0)
    return sums.withColumn("value_tenths", value).withColumn("active", F.col("scored") > 0)


def category_scores(findings: DataFrame) -> DataFrame:
    """Value 0-100 of each category that has any finding; needs_api counts never score."""
    sums = category_sums(tally(findings)).where("category IS NOT NULL")
    return _category_values(sums).select(
        "store",
        "paradigm",
        "axis",
        "category",
        "weight",
        "active",
        "needs_api_count",
        (F.col("value_tenths") / 10).alias("value"),
    )


def axis_scores(findings: DataFrame) -> DataFrame:
    """Weighted mean over active categories, capped below 60 by an established severity-5 failure.
    ``active_weight`` 0 tells a store with nothing to score from a store that scored 0."""
    return _axis_scores(tally(findings))


def _axis_scores(tallied: DataFrame) -> DataFrame:
    cats = _category_values(category_sums(tallied))
    weight = F.when(F.col("active"), F.col("weight")).otherwise(0)
    sums = cats.groupBy("store", "paradigm", "axis").agg(
        F.sum(weight * F.col("value_tenths")).alias("weighted"),
        F.sum(weight).alias("active_weight"),
        F.sum("needs_api_count").alias("needs_api_count"),
        F.sum("gating").alias("gating"),
    )
    # value_tenths carries the factor 10 already, so divide by 10 inside the rounding.
    computed = F.when(
        F.col("active_weight") > 0,
        F.expr("CAST((2 * weighted + greatest(active_weight, 1)) div (2 * greatest(active_weight, 1)) AS BIGINT)"),
    ).otherwise(0)
    capped = F.col("gating") > 0
    value = F.when(capped, F.least("computed_tenths", F.lit(GATE_CEILING * 10).cast("long"))).otherwise(F.col("computed_tenths"))
    return (
        sums.withColumn("computed_tenths", computed)
        .withColumn("value", value / 10)
        .select(
            "store",
            "paradigm",
            "axis",
            "value",
            (F.col("computed_tenths") / 10).alias("computed"),
            band(F.col("value")).alias("band"),
            capped.alias("capped"),
            "active_weight",
            "needs_api_count",
        )
    )


def severity_gate(findings: DataFrame) -> DataFrame:
    """The findings that cap a score: established severity-5 failures inside the profile."""
    return in_profile(findings).where("severity = 5 AND status = 'fail' AND confidence = 'established'").select(
        "store", "axis", "id", "module", "category"
    )


def score_interpretation(scores: DataFrame) -> DataFrame:
    """Both axes of a store side by side and the class of message they call for."""
    paired = scores.groupBy("store").agg(
        F.coalesce(F.max(F.when(F.col("axis") == "design", F.col("value"))), F.lit(0.0)).alias("design"),
        F.coalesce(F.max(F.when(F.col("axis") == "performance", F.col("value"))), F.lit(0.0)).alias("performance"),
    )
    ok_d, ok_p = F.col("design") >= 70, F.col("performance") >= 70
    bad_d, bad_p = F.col("design") < 60, F.col("performance") < 60
    return paired.withColumn(
        "interpretation",
        F.when(ok_d & ok_p, "solid and ready to scale")
        .when(ok_d & bad_p, "clean model, will not carry load yet")
        .when(bad_d & ok_p, "fast today, the model is decaying")
        .when(bad_d & bad_p, "foundation problems, fix the caps first")
        .otherwise("mixed, follow the prioritized actions"),
    )


def multi_store_rollup(scores: DataFrame) -> DataFrame:
    """Worst store per axis; ties go to the first store name."""
    return scores.groupBy("axis").agg(
        F.min("value").alias("value"),
        F.min_by("store", F.struct("value", "store")).alias("floored_by"),
        F.count(F.lit(1)).alias("stores"),
    ).withColumn("band", band(F.col("value")))


def rescore_paradigm(findings: DataFrame) -> DataFrame:
    """The same findings scored under every profile."""
    every = F.explode(F.array(*[F.lit(p) for p in PARADIGMS]))
    counted = tally(findings.drop("paradigm").withColumn("paradigm", F.lit("")))
    return _axis_scores(counted.withColumn("paradigm", every))


def score_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of each (store, axis) between two audits."""
    b = before.select("store", "axis", F.col("value").alias("old_value"), F.col("band").alias("old_band"))
    a = after.select("store", "axis", F.col("value").alias("new_value"), F.col("band").alias("new_band"))
    out = b.join(a, ["store", "axis"], "full_outer")
    delta = F.round((F.col("new_value") - F.col("old_value")).cast("decimal(9,1)"), 1).cast("double")
    return out.withColumn("delta", delta)


def tier_upgrade(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Live evidence ``(store, id, violations)`` decides findings that files could not settle.

    A confirmed finding becomes an established failure (or keeps a firmer status), a refuted
    one an established pass; findings without evidence stay as they were.
    """
    e = evidence.groupBy("store", "id").agg(F.max("violations").alias("violations"))
    joined = findings.join(e, ["store", "id"], "left")
    open_status = F.col("status").isin("needs_api", "warn", "fail")
    confirmed = open_status & (F.col("violations") > 0)
    refuted = open_status & (F.col("violations") == 0)
    return (
        joined.withColumn(
            "new_status",
            F.when(confirmed & (F.col("severity") >= 4), "fail").when(confirmed, "warn").when(refuted, "pass").otherwise(F.col("status")),
        )
        .withColumn("new_confidence", F.when(confirmed | refuted, "established").otherwise(F.col("confidence")))
        .drop("status", "confidence", "violations")
        .withColumnsRenamed({"new_status": "status", "new_confidence": "confidence"})
    )


# --- rankings -------------------------------------------------------------------------------


def _open_findings(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("status").isin("fail", "warn", "needs_api"))


def next_actions(findings: DataFrame) -> DataFrame:
    """What to do next, per store: gates first, then severity x weight, then how safely it can be
    fixed, then how cheaply it can be confirmed.

    ``priority`` numbers the distinct ranking tuples of a store (a few hundred at most, whatever
    the number of findings), so no store's findings are sorted in one task.
    """
    scored = in_profile(_open_findings(findings))
    cost = F.when(F.col("status") == "needs_api", 2).when(F.col("confidence") == "established", 1).otherwise(0)
    gate = (F.col("severity") == 5) & (F.col("status") == "fail") & (F.col("confidence") == "established")
    tuples = scored.groupBy("store", "id", "module").agg(
        F.min(F.when(gate, 0).otherwise(1)).alias("gate_rank"),
        F.max(F.col("severity") * F.col("weight")).alias("impact"),
        F.min(rank_in("fixable", FIXABLES)).alias("fix_rank"),
        F.min(cost).alias("cost_rank"),
    )
    classes = ["store", "gate_rank", "impact", "fix_rank", "cost_rank"]
    w = Window.partitionBy("store").orderBy("gate_rank", F.desc("impact"), "fix_rank", "cost_rank")
    ranked = tuples.select(*classes).distinct().withColumn("priority", F.row_number().over(w))
    return tuples.join(ranked, classes).select("store", "id", "module", "priority", "gate_rank", "impact", "fix_rank", "cost_rank")


def prioritized_actions(findings: DataFrame, n: int) -> DataFrame:
    """Top ``n`` per store by severity x magnitude / effort (each banded 3/2/1)."""
    magnitude = 3 - rank_in("magnitude", MAGNITUDES)
    effort = 1 + rank_in("fixable", FIXABLES)
    scored = _open_findings(findings).withColumn(
        "score_milli", F.floor((F.col("severity") * magnitude * 1000) / effort).cast("long")
    )
    ranked = top_n(scored, ["store"], [F.desc("score_milli"), F.asc("id")], n)
    return ranked.select("store", "rank", "id", "score_milli")


def top_issues_per_axis(findings: DataFrame, n: int) -> DataFrame:
    """Top ``n`` issues per store and axis; severity-5 failures sort first."""
    issues = by_axis(_open_findings(findings))
    order = [
        F.when((F.col("severity") == 5) & (F.col("status") == "fail"), 0).otherwise(1),
        rank_in("status", STATUSES),
        F.desc("severity"),
        rank_in("magnitude", MAGNITUDES),
        F.asc("id"),
    ]
    return top_n(issues, ["store", "axis"], order, n).select("store", "axis", "rank", "id", "status", "severity")


def findings_by_module(findings: DataFrame) -> DataFrame:
    """Status by severity matrix per module."""
    module = parent_module(F.col("module")).alias("module")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return findings.groupBy(module, "severity").agg(*counts)


def fix_plan(findings: DataFrame) -> DataFrame:
    """Fixable open findings per store, class and category; destructive migrations are excluded."""
    destructive = (F.col("module") == "M22") & (F.col("severity") == 5)
    fixable = _open_findings(findings).where(F.col("fixable").isin("auto", "proposed") & ~destructive)
    return in_profile(fixable).groupBy("store", "axis", "category", "fixable").agg(
        F.count(F.lit(1)).alias("fixes"), F.max("severity").alias("max_severity")
    )


# Readiness checks and the modules that answer each.
CHECKLIST = [
    ("PITR / backups", []),
    ("RLS on tenant tables", ["M9", "M10"]),
    ("FK indexes", ["M11"]),
    ("Money as numeric", ["M19"]),
    ("timestamptz / UTC", ["M4"]),
    ("Connection pooling sized", ["M15"]),
    ("Migration reversibility", ["M22"]),
    ("Secrets not in schema", ["M10"]),
    ("charset / utf8mb4", ["M4"]),
]
RELATIONAL_ONLY = ["RLS on tenant tables", "FK indexes", "charset / utf8mb4"]


def readiness_checklist(findings: DataFrame) -> DataFrame:
    """Fixed launch checklist per store: PASS, WARN, FAIL, NEEDS-LIVE or N-A, and how many findings
    drive each status (``readiness_drivers`` names them).  The findings are read once, and counted
    per module before they meet the checks."""
    checks = F.array(
        *[
            F.struct(
                F.lit(n + 1).alias("check_no"), F.lit(name).alias("check"), F.lit(name in RELATIONAL_ONLY).alias("relational_only"),
                F.array(*[F.lit(m) for m in mods]).cast("array<string>").alias("modules"),
            )
            for n, (name, mods) in enumerate(CHECKLIST)
        ]
    )
    per_module = findings.groupBy("store", "paradigm", parent_module(F.col("module")).alias("parent")).agg(
        F.count_if((F.col("status") == "fail") & (F.col("severity") >= 4)).alias("fails"),
        F.count_if(F.col("status").isin("warn", "fail")).alias("warns"),
        F.count_if(F.col("status") == "needs_api").alias("unknowns"),
        F.count_if(F.col("status") == "pass").alias("passes"),
        F.count_if(F.col("status").isin("fail", "warn", "needs_api")).alias("driving"),
    )
    laid = per_module.select("*", F.explode(checks).alias("c"))
    answers = F.array_contains("c.modules", F.col("parent"))
    counts = ["fails", "warns", "unknowns", "passes", "driving"]
    out = laid.groupBy("store", "paradigm", "c.check_no", "c.check", "c.relational_only").agg(
        *[F.coalesce(F.sum(F.when(answers, F.col(c))), F.lit(0)).alias(c) for c in counts]
    )
    status = (
        F.when(F.col("relational_only") & (F.col("paradigm") != "relational"), "N-A")
        .when(F.col("fails") > 0, "FAIL")
        .when(F.col("warns") > 0, "WARN")
        .when(F.col("unknowns") > 0, "NEEDS-LIVE")
        .when(F.col("passes") > 0, "PASS")
        .otherwise("NEEDS-LIVE")
    )
    return out.select("store", "check_no", "check", status.alias("result"), "driving")


def readiness_drivers(findings: DataFrame) -> DataFrame:
    """``store, check_no, id, status``: every open finding behind a readiness check, with its worst status."""
    answered = constant_frame(
        findings.sparkSession, [(n + 1, m) for n, (_, mods) in enumerate(CHECKLIST) for m in mods], "check_no int, parent string"
    )
    open_ = findings.where(F.col("status").isin("fail", "warn", "needs_api")).withColumn("parent", parent_module(F.col("module")))
    worst = open_.join(F.broadcast(answered), "parent").groupBy("store", "check_no", "id").agg(F.min(rank_in("status", STATUSES)).alias("s"))
    return worst.select("store", "check_no", "id", F.array(*[F.lit(v) for v in STATUSES])[F.col("s")].alias("status"))


def readiness_verdict(checklist: DataFrame) -> DataFrame:
    out = checklist.groupBy("store").agg(
        F.count_if(F.col("result") == "FAIL").alias("fails"),
        F.count_if(F.col("result").isin("WARN", "NEEDS-LIVE")).alias("caveats"),
    )
    return out.withColumn("verdict", F.when(F.col("fails") > 0, "NO-GO").when(F.col("caveats") > 0, "GO WITH CAVEATS").otherwise("GO"))
