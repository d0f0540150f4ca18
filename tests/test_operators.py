"""Operators against brute force on small frames, including badly skewed ones."""

import datetime as dt
import itertools
import json
import pathlib
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import catalog_rules as cr
from plumbline.operators import dependencies, diff, documents, graph, history, integrity, inventory, privacy, profile, seed, state_rules, statements, vectors
from plumbline.operators.ordered import Ordered, id_bucket, top_n
from plumbline.plans import registry
from plumbline.session import shared_dir
from plumbline.sources import catalog as sc
from plumbline.sources import files as sf
from plumbline.sources.cutter import Cutter
from plumbline.streaming import jobs

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


# --- ordered windows ------------------------------------------------------------------------------


@FEW
@given(hs.lists(hs.tuples(hs.sampled_from(["hot", "hot", "cold"]), hs.integers(0, 60), hs.integers(0, 5)), min_size=1, max_size=60))
def test_bucketed_windows_equal_plain_ones(spark, rows):
    df = spark.createDataFrame([(k, t, n, v) for n, (k, t, v) in enumerate(rows)], "k string, t int, n int, v int")
    made = Ordered(df, ["k"], ["t", "n"], id_bucket("t", 7))
    w = Window.partitionBy("k").orderBy("t", "n")
    plain = (
        df.withColumn("p", F.lag("n").over(w))
        .withColumn("s", F.sum("v").over(w))
        .withColumn("l", F.last(F.when(F.col("v") > 3, F.col("n")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    )
    want = {r["n"]: (r["p"], r["s"], r["l"]) for r in plain.collect()}
    prev = {r["n"]: r["q"]["n"] if r["q"] else None for r in made.previous(["n"], "q").collect()}
    sums = {r["n"]: r["s"] for r in made.running_sum("v", "s").collect()}
    last = {r["n"]: r["q"]["n"] if r["q"] else None for r in made.latest(F.col("v") > 3, ["n"], "q").collect()}
    assert {n: (prev[n], sums[n], last[n]) for n in want} == want


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1, 1), (None, 20, 2)], "k string, t int, n int")
    got = Ordered(df, ["k"], ["t", "n"], id_bucket("t", 7)).previous(["n"], "q").collect()
    assert {r["n"]: r["q"]["n"] if r["q"] else None for r in got} == {1: None, 2: 1}


def test_top_n_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    top = top_n(df, ["k"], [F.desc("id")], 2)
    assert sorted((r["k"], r["id"]) for r in top.collect()) == [(0, 996), (0, 999), (1, 994), (1, 997), (2, 995), (2, 998)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


# --- evidence -------------------------------------------------------------------------------------


def test_lost_updates_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(int(n), int(rng.integers(0, 4)), int(rng.integers(0, 3)), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(n * 17)), ["read", "write"][int(rng.integers(0, 2))]) for n in range(150)]
    df = spark.createDataFrame(rows, "event_id int, s int, o int, ts timestamp_ntz, action string")
    want = set()
    for i, (e, s, o, _, a) in enumerate(rows):
        mine = [r for r in rows[:i] if r[1] == s and r[2] == o]
        writes = [r for r in rows[:i] if r[2] == o and r[4] == "write"]
        if a == "write" and mine and mine[-1][4] == "read" and writes and writes[-1][1] != s and writes[-1][0] > mine[-1][0]:
            want.add((o, s, mine[-1][0], writes[-1][0], e))
    got = {tuple(r) for r in integrity.lost_updates(df, "s", "o", "ts", "action", "event_id", 3600).collect()}
    assert want and got == want


@FEW
@given(hs.lists(hs.tuples(hs.sampled_from([1, 1, 2]), hs.integers(0, 20000)), min_size=1, max_size=80))
def test_bursts_against_brute_force(spark, rows):
    """Gaps around one hour, buckets of one hour: runs cross any number of bucket edges."""
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s) for _, s in rows]
    df = spark.createDataFrame([(n, k, at[n], "SELECT 1") for n, (k, _) in enumerate(rows)], "e int, s int, ts timestamp_ntz, statement string")
    want = []
    for key in {k for k, _ in rows}:
        run = []
        for t, n in sorted((at[n], n) for n, (k, _) in enumerate(rows) if k == key):
            if run and (t - run[-1][0]).total_seconds() > 900:
                want.append((key, len(run), min(x[1] for x in run)))
                run = []
            run.append((t, n))
        want.append((key, len(run), min(x[1] for x in run)))
    got = statements.n_plus_one_bursts(df, "s", "ts", "e", 900, 0).collect()
    assert sorted((r["s"], r["repeats"], r["first_event"]) for r in got) == sorted(want)


def test_orphans_with_a_hot_missing_parent(spark):
    child = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, 99).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 5).alias("fk"))
    parent = spark.range(5).withColumnRenamed("id", "pk")
    out = integrity.orphan_rows(child, "fk", parent, "pk", "id").collect()
    assert [tuple(r) for r in out] == [(99, 300, 0)]
    row = integrity.orphan_matrix([("c.fk", child, "fk", parent, "pk")]).first()
    nulls = child.where("fk IS NULL").count()
    assert (row["child_rows"], row["null_keys"], row["orphans"]) == (900, nulls, 300)


def test_orphan_matrix_of_empty_child(spark):
    child = spark.createDataFrame([], "fk long")
    row = integrity.orphan_matrix([("c", child, "fk", spark.range(3), "id")]).first()
    assert (row["child_rows"], row["null_keys"], row["orphans"]) == (0, 0, 0)


def test_keys_of_unlike_types_compare_as_the_engine_does(spark):
    def orphans(child, parent):
        a, b = (spark.sql(f"SELECT * FROM VALUES {v} AS t(k)") for v in (child, parent))
        return integrity.orphan_matrix([("x", a, "k", b, "k")]).first()["orphans"]

    assert orphans("(9007199254740993L)", "(9007199254740992BD)") == 1
    assert orphans("(9007199254740993L), (2L)", "(9007199254740993BD), (2.00BD)") == 0
    assert orphans("(date'2024-01-02')", "(timestamp'2024-01-02 00:00:00')") == 0
    assert orphans("(date'2024-01-02')", "(timestamp_ntz'2024-01-02 00:00:00'), (timestamp_ntz'2024-01-02 00:00:01')") == 0
    assert orphans("(timestamp_ntz'1960-01-02 03:04:05.000001')", "(timestamp_ntz'1960-01-02 03:04:05.000002')") == 1
    assert orphans("(timestamp'1960-01-02 03:04:05.000001')", "(timestamp_ntz'1960-01-02 03:04:05.000001')") == 0
    assert orphans("(0.0D), (1.5D)", "(-0.0D), (1.5BD)") == 0
    assert orphans("(1), (2)", "(1L)") == 1 and orphans("('1')", "('1 ')") == 1 and orphans("(X'01')", "(X'01')") == 0
    with pytest.raises(ValueError):
        orphans("('1')", "(1)")


def test_microseconds_part_keys(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01 00:00:00.000001', 1, 'x'), (timestamp'2024-01-01 00:00:00.000002', 1, 'y'), (NULL, 2, NULL) AS t(ts, k, v)")
    got = {r["candidate"]: r for r in profile.candidate_key_profile(df, [["ts"], ["k", "v"], ["v", "k"], ["k"]]).collect()}
    assert (got["ts"]["distinct_values"], got["ts"]["null_rows"], got["ts"]["is_key"]) == (2, 1, False)
    assert [(got[c]["rows"], got[c]["distinct_values"], got[c]["null_rows"]) for c in ("k,v", "v,k", "k")] == [(3, 2, 1), (3, 2, 1), (3, 2, 0)]
    part = {(r["key_part"], r["column_name"]): r["max_values"] for r in profile.partial_dependency(df, ["ts", "k"], ["v"]).collect()}
    assert part == {("ts", "v"): 1, ("k", "v"): 2}
    assert [tuple(r) for r in profile.candidate_key_profile(df.limit(0), [["ts"]]).collect()] == [("ts", 0, 0, 0, True)]


def test_inclusion_dependencies_by_brute_force(spark):
    draw = random.Random(3)
    tables = {
        "p": [(k, f"n{k}", k % 4) for k in range(30)],
        "c": [(draw.choice([None, *range(30)]), f"n{draw.randrange(31)}", k) for k in range(80)],
        "e": [(None, None, None)],
    }
    frames = {t: spark.createDataFrame(rows, f"{t}1 {'long' if t == 'p' else 'int'}, {t}2 string, {t}3 int") for t, rows in tables.items()}
    values = {(t, f"{t}{k + 1}"): [r[k] for r in rows if r[k] is not None] for t, rows in tables.items() for k in range(3)}
    for least in (10_000, 9_000, 1):
        want = {
            (*a, *b, len(set(x)), len(set(x) & set(y)))
            for a, x in values.items() for b, y in values.items()
            if a != b and len(set(y)) == len(y) and set(x) & set(y) and 10_000 * len(set(x) & set(y)) // len(set(x)) >= least
        }
        assert {tuple(r)[:6] for r in integrity.inclusion_dependencies(frames, least_bp=least).collect()} == want


@pytest.mark.parametrize("width", [3, 1_000])
def test_versions_are_held_against_all_that_is_open(spark, width):
    draw = random.Random(width)
    rows = [("a", 1, 1, 100), ("a", 2, 2, 3), ("a", 3, 5, 6), ("b", 4, 1, None), ("b", 5, 2, None), ("c", 6, 1, 2), ("c", 7, 2, 3), ("c", 8, 9, 10), ("c", 9, None, 1)]
    rows += [("d", 100 + k, draw.randrange(60), draw.choice([None, *range(60)])) for k in range(60)] + [("f", 200 + k, 3 * k, 3 * k + draw.choice([1, 3, 9])) for k in range(40)]
    df = spark.createDataFrame(rows, "e string, v int, s int, t int")
    want = set()
    for e, v, s, t in rows:
        before = [(t2 is None, t2 or 0, v2) for e2, v2, s2, t2 in rows if e2 == e and (s2 is not None, s2 or 0, v2) < (s is not None, s or 0, v)]
        if before:
            is_open, end, name = max(before)
            problem = "overlap" if is_open or s is None or s < end else "gap" if s > end else None
            want |= {(e, name, v, problem)} if problem else set()
    got = history.validity_overlap(df, "e", "s", "t", "v", F.floor(F.col("s") / width).cast("long"))
    assert {tuple(r) for r in got.collect()} == want and ("a", 1, 3, "overlap") in want and ("b", 4, 5, "overlap") in want


def test_functional_dependencies(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "b", "x"), (2, "b", "x"), (None, "c", "x")], "k int, d string, e string")
    assert profile.fd_check(df, "k", "d").first()["holds"] is True
    assert profile.fd_check(df, "k", "e").first()["holds"] is False
    found = {(r["x"], r["y"]): r["holds"] for r in profile.fd_discovery(df.where("k IS NOT NULL"), ["k", "d", "e"]).collect()}
    assert found == {("k", "d"): True, ("d", "k"): True, ("k", "e"): False, ("e", "k"): False, ("d", "e"): False, ("e", "d"): False}


@pytest.mark.parametrize("sample_rows", [40, 100_000])
def test_minimal_dependencies_by_brute_force(spark, sample_rows):
    draw = random.Random(5)
    rows = []
    for k in range(300):
        a, b = draw.choice([None, 1, 2, 3]), draw.choice(["x", "y", None])
        rows.append((a, b, None if a is None else a * 2.0, f"{a}{b}", k // 2, 7, k % 2))
    columns = ["a", "b", "c", "d", "e f", "g", "h"]
    held = {}
    for s in (s for n in range(4) for s in itertools.combinations(range(7), n)):
        for y in [y for y in [*range(7), "*"] if y not in s]:
            groups = {}
            for n, r in enumerate(rows):
                groups.setdefault(tuple(r[c] for c in s), set()).add(n if y == "*" else r[y])
            held[s, y] = all(len(v) == 1 for v in groups.values())
    want = set()
    for (s, y), ok in held.items():
        parts = [p for n in range(len(s)) for p in itertools.combinations(s, n)]
        if ok and not any(held[p, y] or held[p, "*"] for p in parts):
            want.add((",".join(columns[c] for c in s), y if y == "*" else columns[y], len(s)))
    df = spark.createDataFrame(rows, "a int, b string, c double, d string, `e f` int, g int, h int")
    got = [tuple(r) for r in dependencies.minimal_dependencies(df, columns, 3, sample_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want and ("e f,h", "*", 2) in want and ("a,b", "d", 2) in want
    # rows that repeat leave no key; in an empty table the empty set is one
    assert "*" not in {r["dependent"] for r in dependencies.minimal_dependencies(df.union(df), columns, 2, sample_rows).collect()}
    assert {tuple(r) for r in dependencies.minimal_dependencies(df.limit(0), ["a"], 1).collect()} == {("", "a", 0), ("", "*", 0)}
    with pytest.raises(ValueError):
        dependencies.minimal_dependencies(df, ["a", "a"])


def test_json_paths_by_brute_force(spark):
    texts = ['{"a":[1,{"b":null}],"c d":"x","f":1.5}', '{"a":{"b":2},"f":"t","it\'s":[]}', None, '{"x":', "5", '[[true,"s"],[]]', '{"a":1,"a":2}', "{}", '{"f":{"":1}}', "", "null"]
    texts += ['{"deep":' * 8 + "1" + "}" * 8] * 3
    want, holders = {}, {}

    def meet(value, path, above):
        kind = {bool: "boolean", str: "string", dict: "object", list: "array", type(None): "null"}.get(type(value), "number")
        want.setdefault((path, above), []).append(kind)
        holders[path, kind] = holders.get((path, kind), 0) + 1
        if kind == "object":
            for k, v in value.items():
                meet(v, path + (f".{k}" if k.isidentifier() else "['" + k.replace("'", "\\'") + "']"), (path, "object"))
        for v in value if kind == "array" else []:
            meet(v, path + "[*]", (path, "array"))

    for t in texts:
        if t and t.count('"a"') < 2 and t != '{"x":':
            meet(json.loads(t), "$", None)
    expected = {}
    for (path, above), kinds in want.items():
        parents = holders[above] if above else len(texts)
        share = None if above and above[1] == "array" else 10_000 * len(kinds) // parents
        met = set(kinds)
        expected[path] = (parents, len(kinds), share, ",".join(sorted(met)), len(met - {"null"}) > 1, bool(above) and share is not None and share >= 9500)
    df = spark.createDataFrame([(t, 1) for t in texts], "j string, value int")
    got = {r["path"]: tuple(r)[1:] for r in documents.json_path_profile(df, "j").collect()}
    assert got == expected and len([p for p in got if p.endswith(".deep")]) == 8
    assert documents.json_path_profile(df.limit(0), "j").collect() == []
    assert [tuple(r) for r in documents.json_path_profile(df.where("j IS NULL"), "j").collect()] == [("$", 1, 0, 0, "", False, False)]


def test_narrowing(spark):
    df = spark.createDataFrame([("abc", 1.5, 70000), ("abcdef", 2.0, 5), (None, None, None)], "s string, d double, i int")
    out = {r["column_name"]: r["lost"] for r in profile.narrowing_loss(df, [("s", "varchar(4)"), ("d", "int"), ("i", "smallint")]).collect()}
    assert out == {"s": 1, "d": 1, "i": 1}


def test_erasure_follows_links(spark):
    tables = {
        "c": spark.createDataFrame([(1,), (2,)], "ck int"),
        "o": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "ok int, ck int"),
        "l": spark.createDataFrame([(10, "x"), (11, "y"), (12, "z")], "ok int, v string"),
    }
    links = [("o", "ck", "c", "ck"), ("l", "ok", "o", "ok")]
    after = privacy.erase_subjects(tables, links, "c", "ck", spark.createDataFrame([(1,)], "ck int"))
    assert {r["v"] for r in after["l"].collect()} == {"y", "z"}
    counts = {r["table_name"]: (r["rows_before"], r["rows_after"]) for r in privacy.erasure_counts(tables, after).collect()}
    assert counts == {"c": (2, 1), "o": (3, 2), "l": (3, 2)}


# --- catalog rules, diff, seed ---------------------------------------------------------------------


def columns(spark, rows):
    """Rows of (table, column, type[, overrides])."""
    out = []
    seen = {}
    for table, name, kind, *rest in rows:
        extra = {"not_null": True, "pk": False, "is_unique": False, "default_expr": "", "is_identity": False, "has_check": False}
        extra.update(rest[0] if rest else {})
        n = seen.setdefault(table, 0)
        seen[table] += 1
        out.append(("s", table, name, n, kind, *extra.values()))
    return spark.createDataFrame(out, sc.COLUMN_SCHEMA)


FK_SCHEMA = "store string, table_name string, columns array<string>, ref_table string, ref_columns array<string>, on_delete string, validated boolean"
IX_SCHEMA = "store string, table_name string, index_name string, columns array<string>, is_unique boolean"


def catalog(spark, cols, fks=(), indexes=()):
    return cr.Catalog(
        columns(spark, cols),
        spark.createDataFrame([("s", *f) for f in fks], FK_SCHEMA),
        spark.createDataFrame([("s", *x) for x in indexes], IX_SCHEMA),
    )


def test_event_id_is_not_a_polymorphic_reference(spark):
    cat = catalog(spark, [("events", "event_id", "bigint", {"pk": True}), ("events", "event_type", "text"), ("notes", "target_id", "bigint"), ("notes", "target_type", "text")])
    assert {r["object"] for r in cr.polymorphic_fk(cat).collect()} == {"notes.target"}
    assert {r["object"] for r in cr.polymorphic_fk(cat, keep_keys=True).collect()} == {"notes.target", "events.event"}


def test_index_prefix_covers_in_order_only(spark):
    cat = catalog(
        spark,
        [("t", "a", "int", {"pk": True}), ("t", "b", "int"), ("t", "c", "int"), ("t", "d", "int")],
        [("t", ["b"], "x", ["id"], "", True), ("t", ["C"], "x", ["id"], "", True), ("t", ["a"], "x", ["id"], "", True), ("t", ["b", "c"], "y", ["i", "j"], "", True), ("t", ["d"], "x", ["id"], "", True)],
        [("t", "i1", ["b", "c"], False), ("t", "i2", ["d", "c"], False)],
    )
    assert {r["object"] for r in cr.fk_unindexed(cat).collect()} == {"t.C"}


def test_finding_ids_fit_the_pattern(spark):
    cat = catalog(spark, [("Order Items", "Total Price", "double precision")])
    ids = [r["id"] for r in cr.run_rules(cat).collect()]
    from plumbline.operators.scoring import ID_PATTERN

    assert ids
    assert spark.createDataFrame([(i,) for i in ids], "i string").where(~F.col("i").rlike(ID_PATTERN)).count() == 0


def test_rules_that_relate_frames_broadcast_nothing(spark):
    cat = catalog(
        spark,
        [("users", "id", "int", {"pk": True}), ("users", "email", "text"), ("orders", "user_id", "int", {"not_null": False}), ("orders", "user_name", "text"), ("orders", "tenant_id", "int")],
        [("orders", ["tenant_id"], "users", ["id"], "", True)],
        [("orders", "ix", ["user_id"], True), ("orders", "ix2", ["user_id", "tenant_id"], False)],
    )
    found = cr.run_rules(cat)
    got = {(r["object"], r["id"].rpartition(".")[2]) for r in found.collect()}
    assert {("orders.user_id", "user_id_no_fk_financial"), ("orders.user_name", "user_name_denormalized_label"), ("orders.ix", "ix_over_nullable_unique"), ("users", "no_tenant_scope")} <= got
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_directional_models_never_gate(spark):
    cat = catalog(spark, [("t", "price", "float")]).with_confidence("directional")
    assert {(r["status"], r["confidence"]) for r in cr.run_rules(cat).collect()} == {("needs_api", "speculative")}


def test_diff_of_a_catalog_with_itself_is_empty_and_counts_mirror(spark):
    a = columns(spark, [("t", "id", "int", {"pk": True}), ("t", "x", "text"), ("old", "y", "int")])
    b = columns(spark, [("t", "id", "bigint", {"pk": True}), ("t", "z", "text", {"not_null": False}), ("new", "y", "int")])
    assert diff.schema_diff(a, a).count() == 0
    forward = {r["kind"]: r["object"] for r in diff.schema_diff_changes(a, b).collect()}
    assert forward == {"alter_type": "t.id", "add_column": "t.z", "drop_column": "t.x", "add_table": "new", "drop_table": "old"}
    back = {r["kind"]: r["object"] for r in diff.schema_diff_changes(b, a).collect()}
    assert (back["add_column"], back["drop_column"], back["add_table"]) == ("t.x", "t.z", "old")


def test_diff_sql(spark):
    a = columns(spark, [("order", "id", "int", {"pk": True})])
    b = columns(spark, [("order", "id", "int", {"pk": True}), ("order", "when", "datetime", {"default_expr": "now()"})])
    row = diff.schema_diff(a, b).first()
    assert row["up_sql"] == 'ALTER TABLE "order" ADD COLUMN "when" timestamptz NOT NULL DEFAULT now();'
    assert row["down_sql"] == 'ALTER TABLE "order" DROP COLUMN "when";'


def test_seed_rows_follow_types_checks_and_parents(spark):
    cols = columns(
        spark,
        [("p", "id", "uuid", {"pk": True}), ("c", "id", "bigint", {"pk": True, "is_identity": True}), ("c", "p_id", "uuid"), ("c", "status", "text"), ("c", "at", "timestamptz", {"default_expr": "now()"}), ("c", "on_day", "date"), ("c", "email", "text"), ("c", "cost", "numeric(9,2)")],
    )
    allowed = F.when(F.col("column_name") == "status", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    fks = spark.createDataFrame([("s", "c", ["p_id"], "p", ["id"], "", True)], FK_SCHEMA)
    rows = seed.seed_rows(cols.withColumn("allowed", allowed), fks, 3).collect()
    got = {(r["table_name"], r["column_name"], r["row_no"]): r["value"] for r in rows}
    assert got[("p", "id", 2)] == got[("c", "p_id", 2)] == "00000000-0000-0000-0000-000000000003"
    assert [got[("c", "status", n)] for n in range(3)] == ["a", "b", "a"]
    assert got[("c", "on_day", 1)] == "2026-01-02T12:00:00Z"
    assert got[("c", "email", 0)] == "user1@example.com"
    assert got[("c", "cost", 1)] == "11.00"
    assert not any(c in ("at",) or (t, c) == ("c", "id") for t, c, _ in got)


# --- graphs ---------------------------------------------------------------------------------------


def test_cycles_and_levels(spark):
    nodes = spark.createDataFrame([("s", t) for t in "abcdefgh"], "store string, table_name string")
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "f"), ("g", "f"), ("h", "a")]
    fks = spark.createDataFrame([("s", x, [y], y, ["id"], "", True) for x, y in edges], FK_SCHEMA)
    got = {r["table_name"]: r["cycle_tables"] for r in graph.fk_cycles(nodes, fks).collect()}
    assert got == {"a": 3, "b": 3, "c": 3, "d": 2, "e": 2}
    levels = {r["table_name"]: r["level"] for r in graph.load_order(nodes, fks).collect()}
    assert levels == {"a": -1, "b": -1, "c": -1, "d": -1, "e": -1, "h": -1, "f": 0, "g": 1}


@pytest.mark.parametrize("together", [0, 12, 1_000])
def test_cycles_and_levels_of_stores_of_any_size(spark, together):
    draw = random.Random(5)
    fks = [(s, f"t{draw.randrange(12)}", f"t{draw.randrange(14)}") for s, n in (("a", 9), ("b", 14), ("c", 22)) for _ in range(n)]
    fks += [("d", f"t{k}", f"t{k - 1}") for k in range(1, 9)]
    names = [(s, f"t{k}") for s in "abcd" for k in range(13)]
    edges = {(s, c, p) for s, c, p in fks if c != p and p != "t13"}
    reach = set(edges)
    while more := {(s, a, c) for s, a, b in reach for s2, b2, c in edges if s == s2 and b == b2} - reach:
        reach |= more
    on_cycle = {(s, a) for s, a, b in reach if a == b}
    cycles = {(s, a, sum((s, a, b) in reach and (s, b, a) in reach for _, b in names[:13])) for s, a in on_cycle}
    bad = on_cycle | {(s, a) for s, a, b in reach if (s, b) in on_cycle}

    def level(s, n):
        return -1 if (s, n) in bad else max((1 + level(s, p) for s2, c, p in edges if (s2, c) == (s, n)), default=0)

    nodes, keys = spark.createDataFrame(names, "store string, table_name string"), spark.createDataFrame(fks, "store string, table_name string, ref_table string")
    got = graph.fk_cycles(nodes, keys, together).collect()
    assert {(r["store"], r["table_name"], r["cycle_tables"]) for r in got} == cycles and len(cycles) == len(got)
    assert {tuple(r) for r in graph.load_order(nodes, keys, together).collect()} == {(s, n, level(s, n)) for s, n in names}


def test_acyclic_catalog_has_no_cycles(spark):
    nodes = spark.createDataFrame([("s", "a"), ("s", "b")], "store string, table_name string")
    fks = spark.createDataFrame([("s", "a", ["b_id"], "b", ["id"], "", True)], FK_SCHEMA)
    assert graph.fk_cycles(nodes, fks).count() == 0


def test_k_hop_reports_shortest_distance(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    got = {r["node"]: r["hop"] for r in graph.k_hop(edges, seeds, 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2}


# --- vectors --------------------------------------------------------------------------------------


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_nearest_neighbours_over_several_query_blocks(spark, monkeypatch, metric):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(1)
    data, asked = rng.normal(size=(60, 5)), rng.normal(size=(7, 5))
    df = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(data)], "i long, v array<double>").repartition(5)
    queries = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(asked)], "query_id long, query_vec array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in vectors.knn_exact(df, "i", "v", queries, 4, metric).collect()}
    d = np.round(vectors._distances(data, asked, metric), 9)
    want = {(q, k + 1): int(i) for q in range(7) for k, i in enumerate(np.lexsort((np.arange(60), d[:, q]))[:4])}
    assert got == want


def test_vectors_of_other_dimensions_do_not_compete(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [])], "i long, v array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query_vec array<double>")
    assert [r["id"] for r in vectors.knn_exact(df, "i", "v", queries, 5).collect()] == [1]
    assert {r["dim"]: r["matches"] for r in vectors.dim_check(df, "v", 2).collect()} == {2: True, 1: False, 0: False}


# --- state rules and inventory ----------------------------------------------------------------------


def test_missing_metrics_are_needs_api_and_short_windows_directional(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("s", "o", "idx_scan", t0, 0.0), ("s", "o", "idx_scan", t0 + dt.timedelta(days=2), 0.0)]
    out = {r["id"].split(".")[-1]: (r["status"], r["confidence"]) for r in state_rules.metric_rules(spark.createDataFrame(rows, "store string, object string, metric string, ts timestamp_ntz, value double")).collect()}
    assert out["index_unused"] == ("warn", "directional")
    assert out["dead_tuples"] == ("needs_api", "speculative")


def test_config_evidence_is_redacted(spark):
    df = spark.createDataFrame([("s", "url", "postgres://u:hunter2@h:5432/d?sslmode=disable")], "store string, key string, value string")
    rows = {r["id"]: r["observed"] for r in state_rules.config_rules(df).collect()}
    assert rows["M10.s.conn_insecure"] == "postgres://u:****@h:5432/d?sslmode=disable"
    assert rows["M8.s.kv_no_ttl"] == "(missing)"


def test_inventory_fills_gaps_only(spark):
    files = [
        ("r", "prisma/schema.prisma", 'generator x { provider = "prisma-client" }\ndatasource d { provider = "mysql" }'),
        ("r", "package.json", '{"dependencies": {"mysql2": "1", "ioredis": "1"}}'),
        ("r", "node_modules/x/package.json", '{"dependencies": {"mongoose": "1"}}'),
        ("r", "docker-compose.yml", "image: redis:7\nimage: postgres:16"),
        ("r", "db/x.sql", "select 1"),
        ("q", "a.sql", "select 1"),
        ("e", "README.md", "nothing"),
    ]
    out = inventory.stack_inventory(spark.createDataFrame(files, "repo string, path string, content string")).collect()
    got = {(r["repo"], r["engine"], r["orm"]) for r in out}
    assert got == {("r", "mysql", "prisma"), ("r", "redis", "unknown"), ("r", "postgres", "docker-compose"), ("q", "postgres", "raw-sql")}


def test_every_signal_of_a_stack(spark):
    files = [
        ("a", "web/drizzle/meta/0001_snapshot.json", '{"dialect": "mysql"}'), ("a", "supabase/config.toml", ""), ("a", "db/structure.sql", "x"),
        ("b", "app/models.py", "x"), ("b", "app/migrations/0002_more.py", ""), ("b", "app/migrations/0001_initial.py", ""),
        ("c", "app/models.py", "import django"),
        ("d", "alembic/versions/1.py", ""), ("e", "001.sql", "select"), ("e", "wrangler.toml", "[[ d1_databases ]]"),
        ("f", "api/package.json", '{"dependencies": {"drizzle-orm": "1", "mongoose": "1", "mongodb": "1"}, "devDependencies": {"@aws-sdk/client-dynamodb": "3"}}'),
        ("g", "node_modules/x/package.json", '{"dependencies": {"pg": "1"}}'), ("h", "drizzle.config.ts", ""),
    ]
    out = inventory.stack_inventory(spark.createDataFrame(files, "repo string, path string, content string")).collect()
    assert {(r["repo"], r["engine"], r["orm"], r["platform"], r["confidence"], r["source_of_truth"]) for r in out} == {
        ("a", "mysql", "drizzle", None, "established", "web/drizzle/meta/0001_snapshot.json"),
        ("a", "postgres", "activerecord", "supabase", "established", "db/structure.sql"),
        ("b", "postgres", "django", None, "directional", "app/migrations/0001_initial.py"),
        ("d", "postgres", "alembic", None, "directional", "alembic/versions/1.py"),
        ("e", "postgres", "raw-sql", None, "established", "001.sql"),
        ("e", "d1", "raw-sql", "cloudflare-d1", "directional", "wrangler.toml"),
        ("f", "mongodb", "mongoose", None, "directional", "api/package.json"),
        ("f", "dynamodb", "unknown", None, "directional", "api/package.json"),
        ("h", "postgres", "drizzle", None, "directional", "drizzle.config.ts"),
    }


# --- sources ----------------------------------------------------------------------------------------


def test_findings_in_any_layout(spark, tmp_path):
    found = [{"id": f"f{k}", "store": "s", "severity": k, "evidence": {"observed": "a\nb"}, "axis": "design"} for k in range(5)]
    files = {
        "indented.json": json.dumps(found, indent=2), "one line.json": json.dumps(found), "lines.json": "\n".join(map(json.dumps, found)) + "\n",
        "report.json": json.dumps({"version": 1, "findings": found}, indent=4), "report line.json": json.dumps({"findings": found}),
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows = sf.load_findings(spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["store"], r["severity"], r["observed"], r["axis"]) for r in rows) == sorted([(f["id"], "s", f["severity"], "a\nb", "design") for f in found] * 5)
    for name in ("indented.json", "report.json"):
        assert len(sf.load_findings(spark, str(tmp_path / name)).collect()) == len(sf.load_findings(spark, str(tmp_path / name), multi_line=True).collect()) == 5
        with pytest.raises(Exception, match="FAILFAST|[Mm]alformed"):
            sf.load_findings(spark, str(tmp_path / name), multi_line=False).collect()
    (tmp_path / "broken.json").write_text('[{"id": "x"},')
    with pytest.raises(Exception, match="FAILFAST|[Mm]alformed"):
        sf.load_findings(spark, str(tmp_path)).collect()


def cut(text, lines):
    cutter, out, most = Cutter("findings"), [], 0
    every = text.split("\n")
    for k in range(0, len(every), lines):
        cutter.feed(("\n".join(every[k : k + lines]) + "\n").encode())
        out += [(json.loads(t), inner) for texts, inner in cutter.given() for t in texts.to_pylist()]
        most = max(most, sum(map(len, cutter.held)))
    cutter.end()
    return out, most


def test_elements_are_cut_out_of_a_stream():
    odd = {"findings]": [{"findings": ["},{", "a\\", '\\"[', "é\n", None]}, [[], {}]], 'x"findings': [1, [2]], "n": -1.5}
    report = {"version": [1, {"findings": 2}], "findings": [odd, None, "x", [3, odd]], "after": [[odd], "]"]}
    for lines in (1, 2, 7, 1000):
        for indent in (None, 0, 3):
            assert cut(json.dumps([odd, [odd], 5, "a,b", None], indent=indent), lines)[0] == [(x, False) for x in (odd, [odd], 5, "a,b", None)]
            shell = {**report, "findings": []}
            assert cut("\n" + json.dumps(report, indent=indent, ensure_ascii=False) + "\n\n", lines)[0] == [*((x, True) for x in report["findings"]), (shell, False)]
            for one in ({}, odd, {"findings": None}, {"findings": {"findings": [1]}}):
                assert cut(json.dumps(one, indent=indent), lines)[0] == [(one, False)]
        assert cut("[ ]", lines)[0] == cut("\n", lines)[0] == []
        assert cut('{"a": 1}\n[2,\n3]\n{"findings": [\n]}', lines)[0] == [({"a": 1}, False), (2, False), (3, False), ({"findings": []}, False)]
        for bad in ('[{"id": "x"},', "[1]]", '{"a": [1}', "[1}", "1", '{"a": 1},\n{"b": 2}', '"x"\n[1]', '{"findings": [1, 2}', "}"):
            with pytest.raises(ValueError, match="Malformed"):
                cut(bad, lines)
    for many in ([odd] * 500, {"findings": [odd] * 500}):
        got, most = cut(json.dumps(many, indent=1), 3)
        assert len([x for x, _ in got if x == odd]) == 500 and most < 2 * len(json.dumps(odd, indent=1))


def test_findings_over_many_lines_are_read_one_by_one(spark, tmp_path):
    found = [{"id": f"f{k}", "severity": k, "evidence": {"observed": 'a,]\\"{'}} for k in range(4)]
    shapes = [found, {"findings": found[:3], "id": "no finding"}, found[0], {**found[1], "findings": None}, [found[2], {"findings": found}], {"findings": []}]
    for k, shape in enumerate(shapes):
        (tmp_path / f"a+b {{{k}}} [x]*.json").write_text(json.dumps(shape, indent=1).replace("\n", "\r\n" if k % 2 else "\n"))
    (tmp_path / "two values.json").write_text("\n".join(json.dumps(f, indent=2) for f in found[2:]))
    (tmp_path / "empty.json").write_text("")
    for multi_line in (None, True):
        read = sf.load_findings(spark, str(tmp_path), multi_line)
        assert sorted(r["id"] for r in read.collect()) == sorted(["f0", "f1", "f2", "f3", "f0", "f1", "f2", "f0", "f1", "f2", "f0", "f1", "f2", "f3", "f2", "f3"])
        assert {r["observed"] for r in read.collect()} == {'a,]\\"{'}
        assert "json" not in read._jdf.queryExecution().executedPlan().toString().lower().replace("from_json", "")
    (tmp_path / "lines of +%41.json").write_text("\n\n".join(map(json.dumps, found)))
    assert sf.load_findings(spark, str(tmp_path)).count() == 20
    (tmp_path / "wide.json").write_text(json.dumps(found, indent=1), encoding="utf-16")
    assert sf.load_findings(spark, str(tmp_path)).count() == 24
    for bad in ("[{},\n,{}]", '{"findings": [{},\n,{}]}', '[\n{"severity": "x"}]', '[\n{"severity" 1}]', "[\n1]", "nonsense"):
        (tmp_path / "bad").mkdir(exist_ok=True)
        (tmp_path / "bad" / "bad.json").write_text(bad)
        with pytest.raises(Exception, match="FAILFAST|[Mm]alformed"):
            sf.load_findings(spark, str(tmp_path / "bad")).collect()


def test_reports_of_each_shape_are_json(spark, tmp_path):
    rows = [(o, p, s, n, 1.0) for o in range(9) for p in (1, 2, None) for s in (3, 4, 5, None) for n in (1, 2)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    shared = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.glob("findings-*"))
    read = registry.queries()["load_findings_arrays"](spark, str(tmp_path))
    (made,) = set(shared.glob("findings-*")) - before
    shapes = set()
    for file in made.glob("*/*.txt"):
        text = file.read_text()
        lines = not text.startswith(("[", "{\n"))
        found = [json.loads(x) for x in text.splitlines()] if lines else json.loads(text)
        shapes.add("lines" if lines else type(found).__name__)
        assert len(found["findings"] if isinstance(found, dict) else found) == 18
    assert shapes == {"lines", "list", "dict"} and len(list(made.glob("*/*.txt"))) == 12
    assert sum(r["findings"] for r in read.collect()) == len(rows)


def test_ddl_corpus(spark):
    ddl = """
    CREATE TABLE customers (id bigint GENERATED ALWAYS AS IDENTITY PRIMARY KEY, email text NOT NULL UNIQUE, created_at timestamp with time zone DEFAULT now());
    create table if not exists "public.orders" (
      id bigint, customer_id bigint not null references customers (id), amount numeric(12,2), kind text default 'x' check (kind in ('x', 'y')),
      primary key (id, customer_id), constraint u unique (amount, kind), foreign key (id, kind) references k.other (a, b)
    );
    CREATE INDEX CONCURRENTLY ix ON orders (customer_id, id);
    """
    made = sc.catalog_from_ddl_corpus(spark.createDataFrame([("s", ddl)], "store string, value string"))
    cols = {(r["table_name"], r["column_name"]): r for r in made["columns"].collect()}
    assert set(cols) == {("customers", "id"), ("customers", "email"), ("customers", "created_at"), ("orders", "id"), ("orders", "customer_id"), ("orders", "amount"), ("orders", "kind")}
    assert cols[("orders", "amount")]["type"] == "numeric(12,2)"
    assert cols[("customers", "created_at")]["type"] == "timestamp with time zone"
    assert cols[("customers", "created_at")]["default_expr"] == "now()"
    assert cols[("orders", "kind")]["allowed"] == ["x", "y"]
    assert [k for k, r in cols.items() if r["pk"]] and {k for k, r in cols.items() if r["pk"]} == {("customers", "id"), ("orders", "id"), ("orders", "customer_id")}
    assert cols[("customers", "id")]["is_identity"] is True
    fks = {(tuple(r["columns"]), r["ref_table"], tuple(r["ref_columns"])) for r in made["fks"].collect()}
    assert fks == {(("customer_id",), "customers", ("id",)), (("id", "kind"), "other", ("a", "b"))}
    idx = {(r["index_name"], tuple(r["columns"]), r["is_unique"]) for r in made["indexes"].collect()}
    assert idx == {("", ("amount", "kind"), True), ("ix", ("customer_id", "id"), False)}


def test_ddl_as_people_write_it(spark):
    ddl = r"""
    -- CREATE TABLE nothing (x int);
    CREATE TABLE `a` (
      id int unsigned NOT NULL AUTO_INCREMENT, -- the key, of course (really
      `na me` varchar(20) DEFAULT 'a,b (c' NOT NULL, /* one, two; */ note text DEFAULT 'not null unique, it''s; primary key' COMMENT 'check (x',
      kind enum('x','y, z') default 'y, z', price decimal(10,2) default (coalesce(1, (2 + 3))) check (price in (1, 2)), state text check (state in ('on, off', 'it''s')),
      PRIMARY KEY (`id`), UNIQUE KEY uq (`na me`, kind), KEY ix (price DESC, note(10)), CONSTRAINT fk FOREIGN KEY (id) REFERENCES b
    ) ENGINE=InnoDB COMMENT='t; (x int';
    CREATE TABLE b (x int);
    CREATE TEMP TABLE "S""q".[c d] ("from" timestamp without time zone default now() at time zone 'utc' not null, tags text[] default '{}', v character varying(9) null);
    CREATE FUNCTION f() RETURNS int AS $$ CREATE TABLE no (x int); $$ LANGUAGE sql;
    ALTER TABLE ONLY public.b ADD CONSTRAINT b_pk PRIMARY KEY (x), ADD CONSTRAINT b_fk FOREIGN KEY (x) REFERENCES s.a (id) ON DELETE CASCADE;
    CREATE INDEX ON b USING gin (lower(x), (x || ','), "q, r" DESC NULLS LAST);
    CREATE TABLE copied AS SELECT 1; CREATE TABLE open_end (y int, z text default 'x'
    """
    made = sc.catalog_from_ddl_corpus(spark.createDataFrame([("s", ddl)], "store string, value string"))
    cols = {(r["table_name"], r["column_name"]): r for r in made["columns"].collect()}
    assert set(cols) == {
        *((("a", c)) for c in ("id", "na me", "note", "kind", "price", "state")), ("b", "x"), *((("c d", c)) for c in ("from", "tags", "v")), ("open_end", "y"), ("open_end", "z"),
    }
    got = {k: (r["type"], r["not_null"], r["pk"], r["is_unique"], r["default_expr"], r["is_identity"], r["allowed"]) for k, r in cols.items()}
    assert got[("a", "id")] == ("int unsigned", True, True, False, "", True, None)
    assert got[("a", "na me")] == ("varchar(20)", True, False, False, "'a,b (c'", False, None)
    assert got[("a", "note")] == ("text", False, False, False, "'not null unique, it''s; primary key'", False, None)
    assert got[("a", "kind")] == ("enum('x','y, z')", False, False, False, "'y, z'", False, None)
    assert got[("a", "price")] == ("decimal(10,2)", False, False, False, "(coalesce(1, (2 + 3)))", False, ["1", "2"])
    assert got[("a", "state")] == ("text", False, False, False, "", False, ["on, off", "it's"])
    assert got[("b", "x")] == ("int", False, True, False, "", False, None)
    assert got[("c d", "from")] == ("timestamp without time zone", True, False, False, "now() at time zone 'utc'", False, None)
    assert got[("c d", "tags")][:5] == ("text[]", False, False, False, "'{}'") and got[("c d", "v")][0] == "character varying(9)"
    fks = {(r["table_name"], tuple(r["columns"]), r["ref_table"], tuple(r["ref_columns"])) for r in made["fks"].collect()}
    assert fks == {("a", ("id",), "b", ("id",)), ("b", ("x",), "a", ("id",))}
    idx = {(r["table_name"], r["index_name"], tuple(r["columns"]), r["is_unique"]) for r in made["indexes"].collect()}
    assert idx == {("a", "uq", ("na me", "kind"), True), ("a", "ix", ("price", "note"), False), ("b", "", ("lower(x)", "(x || ',')", "q, r"), False)}


def test_snapshot_with_composite_keys(spark, tmp_path):
    doc = {
        "store": "s",
        "dialect": "postgresql",
        "tables": {
            "public.t": {
                "name": "t",
                "columns": {"a": {"name": "a", "type": "Serial", "notNull": True, "primaryKey": False}, "b": {"name": "b", "type": "text"}},
                "indexes": {"i": {"name": "i", "columns": ["b", "a"], "isUnique": True}},
                "foreignKeys": {"f": {"columnsFrom": ["a"], "tableTo": "u", "columnsTo": ["id"]}},
                "compositePrimaryKeys": {"pk": {"columns": ["a", "b"]}},
                "uniqueConstraints": {"q": {"columns": ["b"]}},
            }
        },
    }
    (tmp_path / "s.json").write_text(json.dumps(doc, indent=2))
    made = sc.catalog_from_snapshot_json(spark, str(tmp_path))
    cols = {r["column_name"]: (r["type"], r["pk"], r["is_unique"], r["is_identity"], r["not_null"]) for r in made["columns"].collect()}
    assert cols == {"a": ("serial", True, False, True, True), "b": ("text", True, True, False, False)}
    assert made["indexes"].first()["columns"] == ["b", "a"]
    assert made["fks"].first()["ref_table"] == "u"


def test_findings_from_array_and_object(spark, tmp_path):
    one = {"id": "M1.t.x", "module": "M1", "status": "fail", "severity": 4, "expected_impact": {"axis": "design", "confidence": "established", "magnitude": "high", "rationale": "r"}, "evidence": {"observed": "o"}}
    (tmp_path / "a.json").write_text(json.dumps([one, {**one, "id": "M1.t.y"}], indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"findings": [{**one, "id": "M1.t.z"}]}))
    rows = {r["id"]: (r["axis"], r["observed"]) for r in sf.load_findings(spark, str(tmp_path), multi_line=True).collect()}
    assert rows == {f"M1.t.{c}": ("design", "o") for c in "xyz"}


def test_corpus_and_inventory_walks(spark, tmp_path):
    for path, text in {
        "repo/001.sql": "a;",
        "repo/deep/er/002.sql": "b;\nc;",
        "repo/notes.txt": "no",
        "repo/node_modules/x.sql": "d;",
        "repo/1/2/3/4/5/6/far.sql": "e;",
    }.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    corpus = sf.load_migration_corpus(spark, str(tmp_path))
    assert corpus.count() == 4
    everything = sf.load_file_inventory(spark, str(tmp_path))
    assert {r["path"] for r in everything.collect()} == {"001.sql", "deep/er/002.sql", "notes.txt", "1/2/3/4/5/6/far.sql"}
    assert sf.load_file_inventory(spark, str(tmp_path), max_depth=5).count() == 3
    assert [tuple(r) for r in sf.files_below(everything, 5).collect()] == [("repo", 1, 2)]


def test_nested_fields(spark):
    schema = spark.createDataFrame([], "a int, b struct<c:int, d:array<struct<e:int>>>").schema
    paths = sc.nested_fields(schema, "t")
    assert ("t", "b", 1, False) in paths
    assert ("t", "b.d", 2, True) in paths


# --- streams ----------------------------------------------------------------------------------------


def test_findings_stream_over_two_arrivals(spark, tmp_path):
    schema = "store string, paradigm string, id string, module string, status string, severity int, axis string, confidence string, magnitude string, fixable string, object string"
    base, incoming = str(tmp_path / "state"), str(tmp_path / "in")

    def arrive(status):
        spark.createDataFrame([("s", "relational", "M1.a", "M1", status, 3, "design", "established", "high", "auto", "o")], schema).write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(schema).parquet(incoming)
        return [r["status"] for r in jobs.findings_latest(stream, base).collect()]

    assert arrive("warn") == ["warn"]
    assert arrive("pass") == ["warn"]
    assert arrive("fail") == ["fail"]


def test_late_rows_are_kept_and_marked(spark, tmp_path):
    base, incoming = str(tmp_path / "state"), str(tmp_path / "in")

    def arrive(*minutes):
        rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), m) for m in minutes]
        spark.createDataFrame(rows, "ts timestamp, m int").write.mode("append").parquet(incoming)
        stream = spark.readStream.schema("ts timestamp, m int").parquet(incoming)
        return {r["m"]: r["late"] for r in jobs.split_late(stream, "ts", 600, base).collect()}

    assert arrive(0, 60) == {0: False, 60: False}
    assert arrive(49, 50, 61) == {0: False, 60: False, 49: True, 50: False, 61: False}


# --- the whole audit --------------------------------------------------------------------------------


def test_warehouse_audit(spark, sf_dir):
    from plumbline.plans.flagship import warehouse_audit

    audit = warehouse_audit(spark, sf_dir)
    rows = {r["id"]: r for r in audit.findings().collect()}
    money = {i for i in rows if i.endswith("_money_as_float")}
    assert {i.split(".")[2].removesuffix("_money_as_float") for i in money} == {"o_totalprice", "l_extendedprice", "l_discount", "l_tax", "p_retailprice"}
    naive = {i.split(".")[2] for i in rows if i.endswith("_naive_timestamp")}
    assert naive == {"o_orderdate_naive_timestamp", "l_shipdate_naive_timestamp", "ts_naive_timestamp"}
    assert {r["status"] for i, r in rows.items() if i.endswith("_orphans")} == {"pass"}
    assert rows["M2.lineitem.l_orderkey_l_linenumber_duplicate_keys"]["status"] == "fail"
    assert rows["M18.warehouse.vacuum_wraparound"]["status"] == "needs_api"
    assert "M3.warehouse.orphan_rows" not in rows
    scores = {r["axis"]: r for r in audit.scores().collect()}
    assert scores["design"]["capped"] and scores["performance"]["capped"]


def test_metrics_and_config_join_the_audit(spark):
    from plumbline import Audit

    frame = spark.createDataFrame([(1, 2.5)], "id int, price double")
    history = spark.createDataFrame([("w", "i", "idx_scan", dt.datetime(2024, 1, 1), 0.0)], "store string, object string, metric string, ts timestamp_ntz, value double")
    config = spark.createDataFrame([("w", "url", "postgres://u:p@h/d?sslmode=disable")], "store string, key string, value string")
    audit = Audit(spark, "w").catalog({"t": frame}, {"t": ["id"]}).rules().metrics(history).config(config)
    rows = {r["id"]: r["status"] for r in audit.findings().collect()}
    assert rows["M19.t.price_money_as_float"] == "fail"
    assert rows["M12.i.index_unused"] == "warn"
    assert rows["M10.w.conn_insecure"] == "warn"
    assert rows["M3.w.orphan_rows"] == "needs_api"


def test_ordered_buckets_in_runs(spark, monkeypatch):
    from plumbline.operators import ordered

    monkeypatch.setattr(ordered, "FAN", 2)
    rows = [(None if k % 5 == 0 else k % 3, k * k % 101, k, k % 4 == 0) for k in range(150)]
    df = spark.createDataFrame(rows, "k int, o int, id int, flag boolean")
    for keys in (["k"], []):
        window = Window.partitionBy(*keys).orderBy("o", "id")
        before = window.rowsBetween(Window.unboundedPreceding, -1)
        want = df.select(
            "id",
            F.lag("id").over(window).alias("p"),
            F.last(F.when(F.col("flag"), F.col("id")), ignorenulls=True).over(before).alias("l"),
            F.sum("id").over(window.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
        )
        by = ordered.Ordered(df, keys, ["o", "id"], ordered.id_bucket("o", 5))
        got = by.previous(["id"], "p").select("id", F.col("p.id").alias("p"))
        got = got.join(by.latest(F.col("flag"), ["id"], "l").select("id", F.col("l.id").alias("l")), "id").join(by.running_sum("id", "s").select("id", "s"), "id")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_nearest_neighbours_tell_what_they_leave_out(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [float("nan"), 1.0]), (6, [0.5, 0.5])] + [(k, [1.0, k / 10]) for k in range(10, 200)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    status = {r["status"]: r["vectors"] for r in vectors.comparable_vectors(df, "v", 2).collect()}
    assert status == {"ok": 192, "zero": 1, "dimension": 1, "null": 1, "not_finite": 1}
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "query_id int, query_vec array<double>")
    got = {(r["query_id"], r["id"]) for r in vectors.knn_exact(df, "id", "v", asked, 2).collect()}
    assert got == {(7, 1), (7, 6), (8, 199), (8, 198)}
    assert vectors.knn_exact(df, "id", "v", asked.limit(0), 2).collect() == []
    for bad in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, [0.0, 0.0])]):
        with pytest.raises(ValueError):
            vectors.knn_exact(df, "id", "v", spark.createDataFrame(bad, "query_id int, query_vec array<double>"), 2)


def test_names_as_whole_words(spark):
    columns = [("s", "t", c, 1, "real", False, True, "", False) for c in ("coffee_grade", "fee", "serviceFee", "total_fees", "price")]
    schema = "store string, table_name string, column_name string, ordinal int, type string, pk boolean, not_null boolean, default_expr string, has_check boolean"
    cat = cr.Catalog(spark.createDataFrame(columns, schema), None, None)
    for bounded, missed in ((False, set()), (True, {"t.coffee_grade"})):
        hits = {r["object"] for r in cr.column_rules(cat, ["money_as_float"], bounded).collect()}
        assert hits == {f"t.{c[2]}" for c in columns} - missed


def test_fitting_indexes_serve_containment(spark):
    columns = spark.createDataFrame([("s", "t", c, "jsonb") for c in "ab"], "store string, table_name string, column_name string, type string")
    indexes = spark.createDataFrame([("s", "t", "i", ["a"], False, "GIN"), ("s", "t", "j", ["b"], False, "btree")], "store string, table_name string, index_name string, columns array<string>, is_unique boolean, method string")
    asked = spark.createDataFrame([("s", "t", c, "containment") for c in "ab"], "store string, table_name string, column_name string, role string")
    assert [r["object"] for r in cr.index_type_fit(cr.Catalog(columns, None, indexes), asked).collect()] == ["t.b"]


def test_constraint_indexes_are_never_unused(spark):
    rows = [("s", o, m, dt.datetime(2024, 1, d), v) for d in (1, 20) for o, m, v in (("i", "idx_scan", 0.0), ("j", "idx_scan", 0.0), ("j", "enforces_constraint", 1.0))]
    history = spark.createDataFrame(rows, "store string, object string, metric string, ts timestamp, value double")
    got = {r["object"]: r["status"] for r in state_rules.metric_rules(history).collect() if r["id"].endswith("index_unused")}
    assert got == {"i": "warn", "j": "pass"}


@pytest.mark.parametrize(("name", "most"), [("candidate_key_profile", 2), ("partial_dependency", 1), ("key_cardinality", 1), ("relationship_cardinality", 7), ("fk_candidate_containment", 5), ("orphan_matrix", 10), ("readiness_checklist", 2)])
def test_tables_are_scanned_once(spark, sf_dir, name, most):
    from plumbline.plans import registry

    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= most, plan


def test_array_columns_are_seeded_empty(spark):
    types = spark.createDataFrame([("text[]",), ("int[3]",), ("array<int>",), ("text",)], "t string")
    got = types.select("t", seed.seed_value(F.lit(0), F.lit("c"), F.col("t"), F.lit(False), F.array().cast("array<string>")).alias("v"))
    assert {r["t"]: r["v"] for r in got.collect()} == {"text[]": "{}", "int[3]": "{}", "array<int>": "{}", "text": "c_1"}
