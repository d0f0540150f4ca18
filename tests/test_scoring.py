"""Scores, gates, rollups and the checklist on hand-made findings."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions.grading import band, engine_paradigm, infer_paradigm, parent_module
from plumbline.operators import profiles, scoring

COLUMNS = "store string, paradigm string, id string, module string, status string, severity int, axis string, confidence string, magnitude string, fixable string"


def make(spark, rows):
    full = []
    for n, r in enumerate(rows):
        row = {
            "store": "s",
            "paradigm": "relational",
            "id": f"{r.get('module', 'M1')}.t.c{n}",
            "module": "M1",
            "status": "pass",
            "severity": 3,
            "axis": "design",
            "confidence": "established",
            "magnitude": "high",
            "fixable": "auto",
        }
        row.update(r)
        full.append(tuple(row.values()))
    return spark.createDataFrame(full, COLUMNS)


def score(spark, rows, axis="design"):
    out = scoring.axis_scores(make(spark, rows)).where(F.col("axis") == axis).collect()
    assert len(out) == 1
    return out[0]


def test_band_boundaries(spark):
    values = [(90.0, "A"), (89.9, "B"), (80.0, "B"), (70.0, "C"), (60.0, "D"), (59.9, "F")]
    df = spark.createDataFrame(values, "v double, want string").withColumn("got", band(F.col("v")))
    assert df.where("got <> want").count() == 0


def test_profiles_are_balanced(spark):
    checked = profiles.profile_check(profiles.paradigm_profiles(spark)).collect()
    assert len(checked) == 14
    assert all(r["balanced"] for r in checked)


def test_worked_document_example(spark):
    """Category values 70/90/60/40/80/100/75 give 70.2, band C."""
    parts = {"M19": 70, "M2": 90, "M4": 60, "M5": 40, "M9": 80, "M7": 100, "M8": 75}
    rows = []
    for module, value in parts.items():
        for n in range(20):
            status = "pass" if n * 5 < value else "fail"
            rows.append({"module": module, "status": status, "severity": 1, "paradigm": "document"})
    got = score(spark, rows)
    assert (got["value"], got["band"], got["capped"], got["active_weight"]) == (70.2, "C", False, 100)


def test_warn_counts_half_and_needs_api_is_excluded(spark):
    rows = [{"status": "pass"}, {"status": "warn"}, {"status": "needs_api", "severity": 5}, {"status": "not_applicable", "severity": 0}]
    got = score(spark, rows)
    assert got["value"] == 75.0
    assert got["needs_api_count"] == 1


@pytest.mark.parametrize("confidence,capped", [("established", True), ("directional", False), ("speculative", False)])
def test_only_established_failures_gate(spark, confidence, capped):
    rows = [{"status": "pass", "severity": 5}] * 30 + [{"module": "M3", "status": "fail", "severity": 5, "confidence": confidence}]
    rows += [{"module": "M3", "status": "pass", "severity": 5}] * 30
    got = score(spark, rows)
    assert got["capped"] is capped
    assert got["value"] == (59.0 if capped else got["computed"])


def test_foreign_key_findings_do_not_touch_a_document_store(spark):
    rows = [{"module": "M3", "status": "fail", "severity": 5, "paradigm": "document"}, {"module": "M2", "paradigm": "document"}]
    got = score(spark, rows)
    assert (got["capped"], got["value"]) == (False, 100.0)


def test_migration_findings_gate_every_paradigm(spark):
    rows = [{"module": "M22", "status": "fail", "severity": 5, "axis": "performance", "paradigm": "document"}]
    assert score(spark, rows, "performance")["capped"] is True


def test_nothing_scored_is_zero_with_no_active_weight(spark):
    got = score(spark, [{"status": "needs_api"}], "performance")
    assert (got["value"], got["band"], got["active_weight"]) == (0.0, "F", 0)


def test_dedupe_keeps_the_most_severe_and_is_idempotent(spark):
    rows = [{"id": "M1.t.c", "status": s, "severity": v} for s, v in [("pass", 1), ("warn", 4), ("fail", 2), ("fail", 3), ("needs_api", 5)]]
    once = scoring.dedupe_findings(make(spark, rows))
    assert [(r["status"], r["severity"]) for r in once.collect()] == [("fail", 3)]
    assert scoring.dedupe_findings(once).collect() == once.collect()


def test_scores_do_not_depend_on_row_order(spark):
    rows = [{"module": f"M{1 + n % 9}", "status": ["pass", "warn", "fail"][n % 3], "severity": 1 + n % 5} for n in range(200)]
    assert scoring.axis_scores(make(spark, rows)).collect() == scoring.axis_scores(make(spark, rows[::-1])).collect()


def test_rollup_names_the_first_of_equal_floors(spark):
    rows = [{"store": s, "status": "fail", "severity": 1} for s in ("b", "a")] + [{"store": "c"}]
    out = {r["axis"]: r for r in scoring.multi_store_rollup(scoring.axis_scores(make(spark, rows))).collect()}
    assert (out["design"]["value"], out["design"]["floored_by"], out["design"]["stores"]) == (0.0, "a", 3)


def test_readiness_never_passes_unknowns(spark):
    rows = [{"module": "M11", "status": "fail", "severity": 4, "axis": "performance"}, {"module": "M15", "axis": "performance"}]
    grid = {r["check"]: r["result"] for r in scoring.readiness_checklist(make(spark, rows)).collect()}
    assert grid["PITR / backups"] == "NEEDS-LIVE"
    assert grid["FK indexes"] == "FAIL"
    assert grid["Connection pooling sized"] == "PASS"
    verdict = scoring.readiness_verdict(scoring.readiness_checklist(make(spark, rows))).first()["verdict"]
    assert verdict == "NO-GO"


def test_checklist_marks_relational_rows_not_applicable(spark):
    grid = {r["check"]: r["result"] for r in scoring.readiness_checklist(make(spark, [{"paradigm": "document"}])).collect()}
    assert grid["RLS on tenant tables"] == "N-A"


def test_quarantine_keeps_every_row(spark):
    base = {c: "x" for c in ("title", "scope", "observed", "expected", "recommendation", "method", "assertion", "reproduce", "rationale")}
    df = make(spark, [{}, {"status": "maybe"}])
    for c, v in base.items():
        df = df.withColumn(c, F.lit({"scope": "table", "method": "ddl_parse", "title": "long enough"}.get(c, v)))
    good, bad = scoring.quarantine(df)
    assert good.count() == 1
    assert bad.first()["errors"] == ["status: unknown value"]


def test_next_actions_put_gates_first(spark):
    rows = [
        {"id": "M1.a", "status": "warn", "severity": 4},
        {"id": "M7.b", "module": "M7", "status": "fail", "severity": 5},
        {"id": "M1.c", "status": "warn", "severity": 4, "fixable": "advisory"},
        {"id": "M1.d", "status": "pass", "severity": 5},
    ]
    ranked = [r["id"] for r in scoring.next_actions(make(spark, rows)).orderBy("priority", "id").collect()]
    assert ranked == ["M7.b", "M1.a", "M1.c"]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("M20a", "MongoDB", "neo4j"), ("M7", None, "unheard-of")], "m string, d string, e string")
    got = df.select(parent_module(F.col("m")).alias("p"), infer_paradigm(F.col("d")).alias("i"), engine_paradigm(F.col("e")).alias("g")).collect()
    assert [tuple(r) for r in got] == [("M20", "document", "graph"), ("M7", "relational", "relational")]
