"""Evidence read off single tables: duplicates, nulls, domains, dependencies, skew, growth.

Per-column checks compile to one aggregate over one scan and are unpivoted afterwards.
Ratios are integers in basis points so that results do not depend on summation order.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ordered import Ordered, with_totals
from plumbline.session import constant_frame

INT4_MAX = 2147483647


def _stack(df: DataFrame, rows: list[list[str]], names: list[str]) -> DataFrame:
    """Unpivot a one-row aggregate: each entry of ``rows`` lists SQL expressions for ``names``."""
    flat = ", ".join(expr for row in rows for expr in row)
    return df.selectExpr(f"stack({len(rows)}, {flat}) AS ({', '.join(names)})")


def bp(part: str, whole: str) -> Column:
    """Basis points of ``whole``, rounded down; 0 when there is nothing to divide by."""
    return F.expr(f"CASE WHEN {whole} = 0 THEN CAST(0 AS BIGINT) ELSE CAST((10000 * {part}) div {whole} AS BIGINT) END")


# --- keys and duplicates -------------------------------------------------------------------


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def duplicate_keys_ci(df: DataFrame, column: str) -> DataFrame:
    """Duplicates after case folding, with the number of spellings."""
    spelled = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return (
        spelled.groupBy(F.lower(column).alias("folded"))
        .agg(F.sum("n").alias("copies"), F.count(F.lit(1)).alias("spellings"))
        .where("copies > 1")
    )


def duplicate_live_rows(df: DataFrame, key: list[str], deleted: str) -> DataFrame:
    """Duplicates among live rows; a UNIQUE over (key, deleted) would let them in."""
    return duplicate_keys(df.where(F.col(deleted).isNull()), key)


def soft_delete_resurrection(df: DataFrame, key: list[str], deleted: str) -> DataFrame:
    """Natural keys held by deleted and live rows at once."""
    live = F.count_if(F.col(deleted).isNull())
    dead = F.count_if(F.col(deleted).isNotNull())
    return df.groupBy(*key).agg(live.alias("live_rows"), dead.alias("deleted_rows")).where("live_rows > 0 AND deleted_rows > 0")


def _spread(df: DataFrame, rows: list[Column]) -> DataFrame:
    """Each row repeated for several purposes (structs of one type), from one scan."""
    return df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _for_each(names: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """A row for every name, also where the table has none; ``names`` are constants."""
    return names.join(counted, keys, "left").na.fill(0)


def _grouped(df: DataFrame, sets: list[list[str]]) -> tuple[DataFrame, list[str], dict[tuple[str, ...], int]]:
    """Counts ``n`` of the distinct values of several sets of columns, from one scan and typed: ``g`` numbers the
    set, columns outside it are null.  Also all columns, and the number of each set."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    numbers = {tuple(s): sum(1 << len(every) - 1 - k for k, c in enumerate(every) if c not in s) for s in sets}
    distinct = list({n: list(s) for s, n in numbers.items()}.values())
    return df.groupingSets(distinct, *every).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n")), every, numbers


def candidate_key_profile(df: DataFrame, candidates: list[list[str]]) -> DataFrame:
    """Rows, distinct values and rows with nulls of each candidate, and whether it is a key."""
    groups, every, numbers = _grouped(df, candidates)
    missing = F.lit(False)
    for c in every:
        within = [n for s, n in numbers.items() if c in s]
        missing = missing | (F.col("g").isin(within) & F.col(c).isNull())
    groups = groups.select("g", "n", missing.alias("missing"))
    counted = groups.groupBy("g").agg(
        F.sum("n").alias("rows"), F.count_if(~F.col("missing")).alias("distinct_values"), F.sum(F.when(F.col("missing"), F.col("n")).otherwise(0)).alias("null_rows")
    )
    names = constant_frame(df.sparkSession, [(",".join(c), numbers[tuple(c)]) for c in candidates], "candidate string, g long")
    return _for_each(names, counted, ["g"]).drop("g").withColumn("is_key", F.expr("rows = distinct_values AND null_rows = 0"))


def key_headroom(tables: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Largest key against the 4-byte ceiling, in basis points."""
    one = [df.agg(F.lit(name).alias("key_name"), F.max(F.col(c).cast("long")).alias("max_id")) for name, df, c in tables]
    return reduce(DataFrame.unionByName, one).withColumn("used_bp", bp("max_id", f"CAST({INT4_MAX} AS BIGINT)"))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and empty strings per column from one scan."""
    strings = {c for c, t in df.dtypes if t == "string"}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"n{i}"))
        aggs.append((F.count_if(F.col(c) == "") if c in strings else F.lit(0).cast("long")).alias(f"e{i}"))
    rows = [[f"'{c}'", "rows", f"n{i}", f"e{i}"] for i, c in enumerate(columns)]
    return _stack(df.agg(*aggs), rows, ["column_name", "rows", "nulls", "empties"])


def check_violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows failing each rule (a SQL predicate; unknown counts as satisfied, as in CHECK)."""
    aggs = [F.count_if(~F.expr(rule)).alias(f"v{i}") for i, rule in enumerate(rules.values())]
    rows = [[f"'{name}'", "rows", f"v{i}"] for i, name in enumerate(rules)]
    return _stack(df.agg(F.count(F.lit(1)).alias("rows"), *aggs), rows, ["rule", "rows", "violations"])


# --- dependencies --------------------------------------------------------------------------


def fd_check(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """Does ``determinant`` fix ``dependent``?  Pairs are made distinct first, so no value's
    rows meet in one task."""
    pairs = df.select(F.col(determinant).alias("x"), F.col(dependent).alias("y")).where("x IS NOT NULL").distinct()
    per = pairs.groupBy("x").agg(F.count("y").alias("ys"))
    return per.agg(
        F.lit(f"{determinant}->{dependent}").alias("fd"),
        F.count(F.lit(1)).alias("determinants"),
        F.count_if(F.col("ys") == 1).alias("determined"),
        F.max("ys").alias("max_dependents"),
    ).withColumn("holds", F.expr("coalesce(max_dependents, 0) <= 1"))


def fd_discovery(df: DataFrame, columns: list[str]) -> DataFrame:
    """All single-column dependencies X -> Y: holds iff distinct(X) = distinct(X, Y).

    The table shrinks to its distinct combinations before the distinct sets are expanded.
    """
    combos = df.select(*columns).distinct()
    sets = [(c,) for c in columns] + list(combinations(columns, 2))
    counted = combos.agg(*[F.count_distinct(F.struct(*s)).alias("__".join(s)) for s in sets])
    rows = []
    for x, y in combinations(columns, 2):
        rows.append([f"'{x}'", f"'{y}'", f"`{x}`", f"`{x}__{y}`"])
        rows.append([f"'{y}'", f"'{x}'", f"`{y}`", f"`{x}__{y}`"])
    out = _stack(counted, rows, ["x", "y", "distinct_x", "distinct_xy"])
    return out.withColumn("holds", F.expr("distinct_x = distinct_xy"))


def partial_dependency(df: DataFrame, key: list[str], non_key: list[str]) -> DataFrame:
    """Non-key columns fixed by a strict subset of a composite key."""
    subsets = [list(s) for n in range(1, len(key)) for s in combinations(key, n)]
    pairs, _, numbers = _grouped(df, [[*s, c] for s in subsets for c in non_key])
    counted = pairs.groupBy("g", *key).agg(F.count(F.lit(1)).alias("ys")).groupBy("g").agg(F.max("ys").alias("max_values"))
    cases = [(",".join(s), c, numbers[(*s, c)]) for s in subsets for c in non_key]
    names = constant_frame(df.sparkSession, cases, "key_part string, column_name string, g long")
    return _for_each(names, counted, ["g"]).drop("g").withColumn("partial", F.col("max_values") <= 1)


# --- values ---------------------------------------------------------------------------------


def csv_evidence(df: DataFrame, columns: list[str], delimiter: str = ",") -> DataFrame:
    aggs = [F.count_if(F.instr(F.col(c), delimiter) > 0).alias(f"d{i}") for i, c in enumerate(columns)]
    rows = [[f"'{c}'", "rows", f"d{i}"] for i, c in enumerate(columns)]
    return _stack(df.agg(F.count(F.lit(1)).alias("rows"), *aggs), rows, ["column_name", "rows", "rows_with_delimiter"])


def derived_drift(df: DataFrame, stored: str, expression: str) -> DataFrame:
    """Stored derived column against its inputs; both sides exact decimal expressions."""
    off = F.expr(f"NOT ({stored} <=> {expression})")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(off).alias("drifted"))


def money_scale_violations(df: DataFrame, columns: list[str], scale: int = 2) -> DataFrame:
    """Values with more decimals than the currency has, and the exact total in minor units."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        exact = F.col(c).cast("decimal(28,8)")
        aggs.append(F.count_if(exact != F.round(exact, scale)).alias(f"v{i}"))
        aggs.append((F.sum(F.col(c).cast(f"decimal(18,{scale})")) * 10**scale).cast("long").alias(f"s{i}"))
    rows = [[f"'{c}'", "rows", f"v{i}", f"s{i}"] for i, c in enumerate(columns)]
    return _stack(df.agg(*aggs), rows, ["column_name", "rows", "violations", "total_minor"])


def low_card_domain(df: DataFrame, columns: list[str], max_values: int = 32) -> DataFrame:
    """Value counts of the columns that have at most ``max_values`` distinct values, counted exactly:
    one scan, combined map-side per column and value."""
    arms = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    long = df.selectExpr(f"stack({len(columns)}, {arms}) AS (column_name, domain_value)")
    counts = long.groupBy("column_name", "domain_value").agg(F.count(F.lit(1)).alias("rows"))
    # one row per column at most
    sizes = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("values")).where(F.col("values") <= max_values)
    return counts.join(F.broadcast(sizes), "column_name")


def narrowing_loss(df: DataFrame, targets: list[tuple[str, str]]) -> DataFrame:
    """Rows that would not survive a change to a narrower type ("varchar(n)" or a SQL type)."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, (column, target) in enumerate(targets):
        if target.startswith("varchar("):
            lost = F.char_length(F.col(column)) > int(target[8:-1])
        else:
            narrowed = F.col(column).try_cast(target)
            lost = F.col(column).isNotNull() & (
                narrowed.isNull() | (narrowed.cast("decimal(38,6)") != F.col(column).cast("decimal(38,6)"))
            )
        aggs.append(F.count_if(lost).alias(f"l{i}"))
    rows = [[f"'{c}'", f"'{t}'", "rows", f"l{i}"] for i, (c, t) in enumerate(targets)]
    return _stack(df.agg(*aggs), rows, ["column_name", "target_type", "rows", "lost"])


# --- documents ------------------------------------------------------------------------------


def json_key_profile(df: DataFrame, column: str, stable_bp: int = 9500) -> DataFrame:
    """How often each top-level key occurs; stable keys are column candidates."""
    keys = df.select(F.explode(F.json_object_keys(column)).alias("json_key"))
    counts = keys.groupBy("json_key").agg(F.count(F.lit(1)).alias("rows"))
    total = df.agg(F.count(F.lit(1)).alias("documents"))
    return with_totals(counts, total).withColumn("share_bp", bp("rows", "documents")).withColumn(
        "stable", F.col("share_bp") >= stable_bp
    )


def json_key_explosion(df: DataFrame, column: str, limit: int = 1000) -> DataFrame:
    """Distinct keys over the whole column against a mapping limit."""
    keys = df.select(F.explode(F.json_object_keys(column)).alias("k")).distinct()
    return keys.agg(F.count(F.lit(1)).alias("distinct_keys")).withColumn("exploded", F.col("distinct_keys") > limit)


def array_growth(df: DataFrame, group: str, size: Column, cap: int) -> DataFrame:
    """Largest and mean array (or child list) per group, and arrays within a tenth of the cap."""
    sized = df.withColumn("__n", size.cast("long"))
    return sized.groupBy(group).agg(
        F.count(F.lit(1)).alias("documents"),
        F.max("__n").alias("max_items"),
        F.expr("CAST((1000 * sum(__n)) div count(1) AS BIGINT)").alias("avg_items_milli"),
        F.count_if(F.col("__n") * 10 >= cap * 9).alias("near_cap"),
    )


def child_growth(df: DataFrame, key: str, cap: int) -> DataFrame:
    """Children per parent as the size of an embedded list would be."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return array_growth(sizes.withColumn("scope", F.lit("all")), "scope", F.col("__n"), cap)


def doc_size_profile(df: DataFrame, column: str, group: str, cap: int = 16 * 1024 * 1024) -> DataFrame:
    """Bytes per document against the document size cap."""
    size = F.octet_length(column).cast("long")
    return df.withColumn("__b", size).groupBy(group).agg(
        F.count(F.lit(1)).alias("documents"),
        F.max("__b").alias("max_bytes"),
        F.sum("__b").alias("total_bytes"),
        F.count_if(F.col("__b") * 10 >= F.lit(cap).cast("long") * 9).alias("near_cap"),
    )


# --- distribution ---------------------------------------------------------------------------


def key_skew(df: DataFrame, key: str) -> DataFrame:
    """Share of the hottest key and its ratio to the mean, from counts combined map-side."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    out = counts.agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum("n").alias("rows"),
        F.max("n").alias("max_rows"),
        F.expr(f"min_by({key}, struct(-n, {key}))").alias("top_key"),
    )
    return out.withColumn("top_share_bp", bp("max_rows", "rows")).withColumn(
        "max_over_mean_bp", bp("(max_rows * keys)", "rows")
    )


def top_key_share(df: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` hottest keys with cumulative share; only ``k`` rows reach the running sum."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    top = counts.orderBy(F.desc("rows"), F.asc(key)).limit(k)
    total = counts.agg(F.sum("rows").alias("total"))
    w = Window.orderBy(F.desc("rows"), F.asc(key))
    ranked = top.withColumn("rank", F.row_number().over(w)).withColumn(
        "cumulative", F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    return with_totals(ranked, total).withColumn("cumulative_bp", bp("cumulative", "total")).drop("total")


def partition_bound(df: DataFrame, key: str, bucket: Column, bound: int) -> DataFrame:
    """Wide-row partitions: rows per (key, time bucket) above a bound."""
    return (
        df.groupBy(F.col(key), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > bound)
    )


def read_fan_out(df: DataFrame, session: str, fingerprint: Column) -> DataFrame:
    """Statements and distinct statement shapes per session (application-side joins)."""
    shapes = df.groupBy(F.col(session), fingerprint.alias("__f")).agg(F.count(F.lit(1)).alias("n"))
    return shapes.groupBy(session).agg(F.sum("n").alias("statements"), F.count(F.lit(1)).alias("shapes"))


def key_cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact distinct values of each candidate partition key or tag, from one scan."""
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns]
    groups = _spread(df, rows).where("v IS NOT NULL").groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    counted = groups.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("rows"))
    names = constant_frame(df.sparkSession, [(c,) for c in columns], "column_name string")
    return _for_each(names, counted, ["column_name"])


def key_cardinality_approx(df: DataFrame, columns: list[str], rsd: float = 0.02) -> DataFrame:
    """Approximate distinct values of all candidates from one scan."""
    counted = df.agg(*[F.approx_count_distinct(c, rsd).alias(c) for c in columns])
    return _stack(counted, [[f"'{c}'", f"`{c}`"] for c in columns], ["column_name", "approx_distinct"])


def tag_cardinality(df: DataFrame, tags: list[str]) -> DataFrame:
    """Distinct series of a tag set."""
    series = df.groupBy(*tags).agg(F.count(F.lit(1)).alias("n"))
    return series.agg(
        F.lit(",".join(tags)).alias("tags"), F.count(F.lit(1)).alias("series"), F.max("n").alias("max_points")
    )


def monotonic_key(df: DataFrame, key: str, value: str, bucket: Column) -> DataFrame:
    """Inversions of ``value`` along ``key``: none means the key follows it exactly (a hot last
    partition, or a fit for a block-range index)."""
    stepped = Ordered(df.select(key, value), [], [key], bucket).previous([value], "before")
    return stepped.agg(
        F.count("before").alias("steps"),
        F.count_if(F.col(value) < F.col(f"before.{value}")).alias("inversions"),
    ).withColumn("monotonic", F.col("inversions") == 0)


def null_tenant_rows(df: DataFrame, tenant: str, name: str) -> DataFrame:
    return df.agg(
        F.lit(name).alias("table_name"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(tenant).isNull()).alias("unscoped_rows"),
    )


def idempotency_duplicates(df: DataFrame, op_key: list[str], ts: str) -> DataFrame:
    """Operation keys applied more than once, with the span between first and last."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return (
        df.groupBy(*op_key)
        .agg(F.count(F.lit(1)).alias("applied"), (F.max(micros) - F.min(micros)).alias("span_us"))
        .where("applied > 1")
    )


def wait_event_summary(df: DataFrame, state: str, kind: str, event: str) -> DataFrame:
    return (
        df.where(F.col(state) == "active")
        .groupBy(kind, event)
        .agg(F.count(F.lit(1)).alias("sessions"))
        .orderBy(F.desc("sessions"), kind, event)
    )
