"""Referential evidence: what the declared or suspected relationships look like in the data.

Every check first counts rows per key value (combined map-side), so a foreign key value held
by a large share of the rows is one row by the time it is joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType, BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegralType, LongType, NumericType, StringType, TimestampNTZType, TimestampType,
)

from plumbline.operators.ordered import Ordered, time_bucket


def key_counts(child: DataFrame, fk: str, sample: str | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    if sample:
        aggs.append(F.min(sample).alias("sample"))
    return child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("fk")).agg(*aggs)


def orphan_rows(child: DataFrame, fk: str, parent: DataFrame, pk: str, sample: str) -> DataFrame:
    """Key values without a parent: rows holding each and the smallest child id as a sample."""
    counts = key_counts(child, fk, sample)
    parents = parent.select(F.col(pk).alias("fk"))
    return counts.join(parents, "fk", "left_anti").select(
        F.col("fk").alias("fk_value"), F.col("n").alias("orphans"), F.col("sample").alias("sample_id")
    )


Relation = tuple[str, DataFrame, str, DataFrame, str]  # name, child, its column, parent, its key


def common_type(a: DataType, b: DataType) -> DataType:
    """Type in which the engine compares values of both; an error where it has none."""
    if a == b:
        return a
    if isinstance(a, NumericType) and isinstance(b, NumericType):
        if any(isinstance(t, (FloatType, DoubleType)) for t in (a, b)):
            return DoubleType()
        if isinstance(a, IntegralType) and isinstance(b, IntegralType):
            return LongType()
        return DecimalType(38, max(t.scale if isinstance(t, DecimalType) else 0 for t in (a, b)))
    times = (DateType, TimestampType, TimestampNTZType)
    if isinstance(a, times) and isinstance(b, times):
        return TimestampNTZType() if TimestampType() not in (a, b) else TimestampType()
    raise ValueError(f"no common type of {a.simpleString()} and {b.simpleString()}")


def key_value(value: Column, kind: DataType) -> Column:
    """A value as ``(l long, s string)``, equal for equal values of its type alone: numbers and times of whole
    units stay numbers, only what is none travels as text."""
    number, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    if isinstance(kind, (IntegralType, BooleanType)):
        number = value.cast("long")
    elif isinstance(kind, DateType):
        number = F.unix_date(value).cast("long")
    elif isinstance(kind, TimestampType):
        number = F.unix_micros(value)
    elif isinstance(kind, TimestampNTZType):
        # whole seconds by the calendar, whatever the session's zone, and the micros beyond them
        days = F.unix_date(value.cast("date")).cast("long")
        seconds = F.hour(value) * 3600 + F.minute(value) * 60 + F.floor(F.date_part(F.lit("seconds"), value)).cast("int")
        micros = F.pmod((F.date_part(F.lit("seconds"), value) * 1_000_000).cast("long"), F.lit(1_000_000))
        number = (days * 86_400 + seconds) * 1_000_000 + micros
    elif isinstance(kind, (FloatType, DoubleType)):
        text = (value.cast("double") + F.lit(0.0)).cast("string")  # one zero
    elif isinstance(kind, BinaryType):
        text = F.hex(value)
    elif isinstance(kind, (StringType, DecimalType)):
        text = value.cast("string")
    else:
        raise ValueError(f"values of type {kind.simpleString()} are no keys")
    return F.struct(number.alias("l"), text.alias("s"))


def _children_and_parents(relations: list[Relation]) -> DataFrame:
    """``name, held, n, parents`` of every key value of any side: whether it is a value, rows on the child's side (``n``)
    and on the parent's.

    Every frame is scanned once, whatever number of its columns are asked for; both sides are
    counted map-side and meet in one shuffle, by the number of the relation and the typed value.
    """
    frames: list[tuple[DataFrame, list[Column]]] = []

    def ask(frame: DataFrame, key: Column) -> None:
        for known, keys in frames:
            if known is frame:
                keys.append(key)
                return
        frames.append((frame, [key]))

    for at, (_, child, fk, parent, pk) in enumerate(relations):
        kind = common_type(child.schema[fk].dataType, parent.schema[pk].dataType)
        for frame, column, is_child in ((child, fk, True), (parent, pk, False)):
            ask(frame, F.struct(F.lit(at).alias("at"), F.lit(is_child).alias("child"), key_value(F.col(column).cast(kind), kind).alias("v")))
    spread = [frame.select(F.explode(F.array(*keys)).alias("k")).select("k.at", "k.child", "k.v.l", "k.v.s") for frame, keys in frames]
    met = reduce(DataFrame.unionByName, spread).groupBy("at", "l", "s").agg(F.count_if(F.col("child")).alias("n"), F.count_if(~F.col("child")).alias("parents"))
    name = F.element_at(F.array(*[F.lit(r[0]) for r in relations]), F.col("at") + 1)
    return met.select(name.alias("name"), (F.col("l").isNotNull() | F.col("s").isNotNull()).alias("held"), "n", "parents")


def _named(frame: DataFrame, names: list[str], label: str) -> DataFrame:
    """A row for each name, also where neither side has any row."""
    every = frame.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    return every.join(frame, "name", "left").na.fill(0).withColumnRenamed("name", label)


def orphan_matrix(fks: list[Relation]) -> DataFrame:
    """One row per declared key ``(name, child, fk, parent, pk)``: child rows, null keys, orphans."""
    met = _children_and_parents(fks)
    held, orphaned = F.col("held"), F.col("held") & (F.col("parents") == 0)
    counted = met.groupBy("name").agg(
        F.sum("n").alias("child_rows"),
        F.sum(F.when(~held, F.col("n")).otherwise(0)).alias("null_keys"),
        F.sum(F.when(orphaned, F.col("n")).otherwise(0)).alias("orphans"),
    )
    return _named(counted, [f[0] for f in fks], "fk_name")


def childless_parents(parent: DataFrame, pk: str, child: DataFrame, fk: str) -> DataFrame:
    children = child.where(F.col(fk).isNotNull()).select(F.col(fk).alias(pk)).distinct()
    return parent.join(children, pk, "left_anti")


def matched_children(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows and key values of the child side that do have a parent."""
    counts = key_counts(child, fk)
    return counts.join(parent.select(F.col(pk).alias("fk")), "fk", "left_semi").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("matched_rows"), F.count(F.lit(1)).alias("matched_keys")
    )


def relationship_cardinality(relations: list[Relation]) -> DataFrame:
    """Measured shape of each relationship: fewest and most children of any parent."""
    met = _children_and_parents(relations).where("held AND parents > 0")
    counted = met.groupBy("name").agg(F.sum("parents").alias("parents"), F.min("n").alias("min_children"), F.max("n").alias("max_children"))
    return _named(counted, [r[0] for r in relations], "relationship").withColumn(
        "shape",
        F.concat(
            F.lit("1:"),
            F.when(F.col("min_children") == 0, "0..").otherwise(""),
            F.when(F.col("max_children") > 1, "N").otherwise("1"),
        ),
    )


def cross_tenant_references(
    child: DataFrame, fk: str, parent: DataFrame, pk: str, tenant: str = "tenant_id"
) -> DataFrame:
    """Children scoped to another tenant than their parent, counted per tenant pair."""
    pairs = child.groupBy(F.col(fk).alias("fk"), F.col(tenant).alias("child_tenant")).agg(F.count(F.lit(1)).alias("n"))
    owners = parent.select(F.col(pk).alias("fk"), F.col(tenant).alias("parent_tenant"))
    return (
        pairs.join(owners, "fk")
        .where(F.col("child_tenant") != F.col("parent_tenant"))
        .groupBy("child_tenant", "parent_tenant")
        .agg(F.sum("n").alias("rows"))
    )


def containment(candidates: list[Relation]) -> DataFrame:
    """Undeclared key candidates: share (basis points) of distinct child values the parent holds."""
    met = _children_and_parents(candidates).where("held AND n > 0")
    counted = met.groupBy("name").agg(F.count(F.lit(1)).alias("distinct_values"), F.count_if(F.col("parents") > 0).alias("contained"))
    out = _named(counted, [c[0] for c in candidates], "candidate")
    return out.withColumn(
        "contained_bp", F.expr("CASE WHEN distinct_values = 0 THEN 0 ELSE (10000 * contained) div distinct_values END")
    )


def _family(kind: DataType) -> str | None:
    """Columns of one family are compared with each other; None for those that are no keys."""
    if isinstance(kind, IntegralType):
        return "number"
    return {StringType: "text", DateType: "date", TimestampType: "instant", TimestampNTZType: "time"}.get(type(kind))


def inclusion_dependencies(frames: dict[str, DataFrame], columns: list[tuple[str, str]] | None = None, least_bp: int = 10_000) -> DataFrame:
    """``child, child_column, parent, parent_column, distinct_values, contained, contained_bp``: every pair of columns
    where the parent's is unique and holds at least ``least_bp`` basis points of the child's distinct values.

    No candidates are needed: ``columns`` (``table, column``; all that can be keys, if not given) are read in one
    scan of each table and meet by value in one shuffle.  A value is then one row with the set of columns that hold
    it, equal sets are counted together, and only these few sets are taken apart into pairs.  Nulls refer to
    nothing; a column without values includes and is included nowhere.
    """
    asked = columns or [(t, f.name) for t, frame in frames.items() for f in frame.schema if _family(f.dataType)]
    kinds = [frames[t].schema[c].dataType for t, c in asked]
    spread = []
    for table in dict.fromkeys(t for t, _ in asked):
        mine = [k for k, (t, _) in enumerate(asked) if t == table]
        values = [F.struct(F.lit(k).alias("at"), F.lit(_family(kinds[k])).alias("family"), key_value(F.col(asked[k][1]), kinds[k]).alias("v")) for k in mine]
        spread.append(frames[table].select(F.explode(F.array(*values)).alias("k")).select("k.at", "k.family", "k.v.l", "k.v.s"))
    held = reduce(DataFrame.unionByName, spread).where("l IS NOT NULL OR s IS NOT NULL").groupBy("family", "l", "s", "at").agg(F.count(F.lit(1)).alias("n"))
    value = held.groupBy("family", "l", "s").agg(F.array_sort(F.collect_list(F.struct("at", (F.col("n") > 1).alias("twice")))).alias("holders"))
    sets = value.groupBy("holders").agg(F.count(F.lit(1)).alias("values"))
    each = sets.select("holders", "values", F.explode("holders").alias("c"))
    of_column = each.groupBy(F.col("c.at").alias("at")).agg(F.sum("values").alias("distinct_values"), F.max("c.twice").alias("twice"))
    pairs = each.select(F.col("c.at").alias("child_at"), "values", F.explode("holders").alias("p")).where("child_at <> p.at")
    pairs = pairs.groupBy("child_at", F.col("p.at").alias("parent_at")).agg(F.sum("values").alias("contained"))
    unique = of_column.where(~F.col("twice")).select(F.col("at").alias("parent_at"))
    found = pairs.join(unique, "parent_at").join(of_column.select(F.col("at").alias("child_at"), "distinct_values"), "child_at")
    found = found.withColumn("contained_bp", F.expr("CAST((10000 * contained) div distinct_values AS BIGINT)")).where(F.col("contained_bp") >= least_bp)
    tables, names = (F.array(*[F.lit(x[k]) for x in asked]) for k in (0, 1))
    return found.select(
        F.element_at(tables, F.col("child_at") + 1).alias("child"), F.element_at(names, F.col("child_at") + 1).alias("child_column"),
        F.element_at(tables, F.col("parent_at") + 1).alias("parent"), F.element_at(names, F.col("parent_at") + 1).alias("parent_column"),
        "distinct_values", "contained", "contained_bp",
    )


def read_your_writes(
    log: DataFrame, user: str, entity: str, ts: str, action: str, event: str, lag_seconds: int, bucket_seconds: int = 3600
) -> DataFrame:
    """Reads within ``lag_seconds`` after the latest write of the same entity by the same user.

    The latest earlier write is carried along the time order, so no read-write pairs are built.
    """
    ordered = Ordered(log, [user, entity], [ts, event], time_bucket(ts, bucket_seconds))
    seen = ordered.latest(F.col(action) == "write", [ts, event], "w")
    age = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(f"w.{ts}").cast("timestamp"))
    return (
        seen.where((F.col(action) == "read") & F.col("w").isNotNull())
        .withColumn("age_us", age)
        .where(F.col("age_us") <= lag_seconds * 1_000_000)
        .select(
            F.col(user), F.col(entity), F.col(f"w.{event}").alias("write_event"), F.col(event).alias("read_event"), "age_us"
        )
    )


def lost_updates(
    log: DataFrame, session: str, entity: str, ts: str, action: str, event: str, bucket_seconds: int = 3600
) -> DataFrame:
    """Writes based on a read that another session's write has overtaken.

    A write is reported when the session read the entity since its own last write, and the
    latest write of the entity came later than that read and from another session.
    """
    bucket = time_bucket(ts, bucket_seconds)
    writes = Ordered(log, [entity], [ts, event], bucket).latest(F.col(action) == "write", [ts, event, session], "w")
    own = Ordered(writes, [entity, session], [ts, event], bucket).latest(F.lit(True), [ts, event, action], "mine")
    # The session's own latest action on the entity must be the read this write builds on.
    return (
        own.where((F.col(action) == "write") & (F.col("mine.action") == "read") & F.col("w").isNotNull())
        .where(F.col(f"w.{session}") != F.col(session))
        .where(F.struct(F.col(f"w.{ts}"), F.col(f"w.{event}")) > F.struct(F.col(f"mine.{ts}"), F.col(f"mine.{event}")))
        .select(
            F.col(entity),
            F.col(session),
            F.col(f"mine.{event}").alias("read_event"),
            F.col(f"w.{event}").alias("overtaking_event"),
            F.col(event).alias("write_event"),
        )
    )


def backfill_verify(old: DataFrame, new: DataFrame, key: str, old_col: str, new_col: str) -> DataFrame:
    """Agreement of an old column and its backfilled replacement, row by row."""
    joined = old.select(key, F.col(old_col).alias("old_v")).join(new.select(key, F.col(new_col).alias("new_v")), key, "left")
    same = F.col("old_v").eqNullSafe(F.col("new_v"))
    return joined.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(same).alias("equal_rows"),
        F.count_if(F.col("new_v").isNull() & F.col("old_v").isNotNull()).alias("not_filled"),
        F.count_if(~same & F.col("new_v").isNotNull()).alias("different"),
    )


def temporal_bound_violations(
    child: DataFrame, fk: str, child_date: str, parent: DataFrame, pk: str, parent_date: str
) -> DataFrame:
    """Child rows dated before their parent, per year of the parent."""
    p = parent.select(F.col(pk).alias(fk), F.col(parent_date))
    # rows of a parent on one date are one row before the join, however many they are
    dated = child.groupBy(fk, child_date).agg(F.count(F.lit(1)).alias("n"))
    early = F.when(F.col(child_date) < F.col(parent_date), F.col("n")).otherwise(0)
    return dated.join(p, fk).groupBy(F.year(parent_date).alias("parent_year")).agg(
        F.sum("n").alias("rows"), F.sum(early).alias("violations")
    )


def golden_vs_derived(
    parent: DataFrame, pk: str, stored: str, child: DataFrame, fk: str, expression: str, tolerance: str
) -> DataFrame:
    """A stored total against the recomputed aggregate of its children, in exact decimals."""
    derived = child.groupBy(F.col(fk).alias(pk)).agg(F.expr(f"sum({expression})").alias("derived"))
    compared = parent.select(pk, F.expr(f"CAST({stored} AS DECIMAL(18,4))").alias("stored")).join(derived, pk, "left")
    off = F.abs(F.col("stored") - F.col("derived")) > F.lit(tolerance).cast("decimal(18,4)")
    return compared.agg(
        F.count(F.lit(1)).alias("parents"),
        F.count_if(F.col("derived").isNull()).alias("without_children"),
        F.count_if(off).alias("drifted"),
        F.count_if(~off).alias("agreeing"),
    )
