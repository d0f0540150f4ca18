"""Streaming jobs over the supplied tables, with batch-equivalent oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.plans.evidence_plans import SQL_STAMP, STAMP
from plumbline.plans.fixtures import FIXTURES
from plumbline.plans.log_plans import GUARD_VALUES
from plumbline.plans.registry import query
from plumbline.plans.scoring_plans import dedupe_sql
from plumbline.streaming import jobs


def stamp(c):
    return F.date_format(c, STAMP)


def events(i):
    return jobs.table_stream(i.spark, i.sf_dir, "events", "ts")


def on_stream(i, fixture, **streams):
    """A derived fixture over streams instead of tables."""
    return i.spark.sql(FIXTURES[fixture], **streams)


@query(
    "stream_guard",
    f"WITH g(template_no, label, lenient) AS (VALUES {GUARD_VALUES}) SELECT event_id, label, label <> '' AS blocked FROM {{statements_fx}} JOIN g USING (template_no)",
)
def _(i):
    commands = on_stream(i, "statements_fx", events=events(i))
    return jobs.run_to_table(jobs.guard(commands).select("event_id", "label", "blocked"), jobs.fresh_base(i.spark, "guard"))


@query(
    "stream_rollup",
    f"""SELECT strftime(b, '{SQL_STAMP}') AS start, strftime(b + INTERVAL 1 HOUR, '{SQL_STAMP}') AS "end", event_type, CAST(count(*) AS BIGINT) AS n
        FROM (SELECT date_trunc('hour', ts) AS b, event_type FROM events) e GROUP BY 1, 2, 3""",
)
def _(i):
    out = jobs.final_state(jobs.rollup(events(i), "ts", ["event_type"], "1 hour", "10 minutes"), jobs.fresh_base(i.spark, "rollup"))
    return out.select(stamp("start").alias("start"), stamp("end").alias("end"), "event_type", "n")


@query(
    "stream_hot_key",
    f"""WITH b AS (SELECT user_id, time_bucket(INTERVAL 30 MINUTE, ts) AS s FROM events), w AS (SELECT user_id, s FROM b UNION ALL SELECT user_id, s - INTERVAL 30 MINUTE FROM b)
        SELECT strftime(s, '{SQL_STAMP}') AS start, user_id, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def _(i):
    hot = jobs.hot_keys(events(i), "ts", "user_id", "1 hour", "30 minutes", "10 minutes", 2)
    return jobs.final_state(hot, jobs.fresh_base(i.spark, "hot")).withColumn("start", stamp("start"))


@query(
    "stream_sessions",
    f"""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        r AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g)
        SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 7200000000 AS end_us, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY user_id, run""",
)
def _(i):
    out = jobs.final_state(jobs.sessions(events(i), "ts", "user_id", "2 hours", "10 minutes"), jobs.fresh_base(i.spark, "sessions"))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("stream_idempotent", "SELECT event_id, user_id, event_type FROM events")
def _(i):
    delivered = events(i).withColumn("delivery", F.explode(F.sequence(F.lit(0).cast("long"), F.col("event_id") % 3)))
    once = jobs.idempotent(delivered, "ts", ["event_id"], "1 hour").select("event_id", "user_id", "event_type")
    return jobs.run_to_table(once, jobs.fresh_base(i.spark, "idempotent"))


@query(
    "stream_read_your_writes",
    """WITH a AS (SELECT *, max(CASE WHEN action = 'write' THEN struct_pack(t := ts, e := event_id) END) OVER (PARTITION BY session_id, object_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM {access_fx})
       SELECT session_id, object_id, w.e AS write_event, event_id AS read_event FROM a WHERE action = 'read' AND ts <= w.t + INTERVAL 12 HOUR""",
)
def _(i):
    log = on_stream(i, "access_fx", events=events(i))
    return jobs.read_your_writes(log, "ts", ["session_id", "object_id"], "event_id", "12 HOURS", jobs.fresh_base(i.spark, "ryw"))


@query(
    "stream_late_data",
    """WITH e AS (SELECT *, event_id % 5 = 0 AS second FROM events), m AS (SELECT max(ts) - INTERVAL 1 DAY AS edge FROM e WHERE NOT second)
       SELECT strftime(ts, '%Y-%m-%d') AS day, second AND ts < edge AS late, CAST(count(*) AS BIGINT) AS rows FROM e, m GROUP BY 1, 2""",
)
def _(i):
    base = jobs.fresh_base(i.spark, "late")
    incoming = f"{base}/incoming"
    source = i.events.withColumn("ts", F.col("ts").cast("timestamp"))
    for part in ("event_id % 5 <> 0", "event_id % 5 = 0"):  # the second arrival trails the first
        source.where(part).write.mode("append").parquet(incoming)
        stream = i.spark.readStream.schema(source.schema).parquet(incoming)
        rows = jobs.split_late(stream, "ts", 86400, base)
    return rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "late").agg(F.count(F.lit(1)).alias("rows"))


@query("stream_findings_latest", dedupe_sql("{findings_fx}"))
def _(i):
    lines = jobs.table_stream(i.spark, i.sf_dir, "lineitem")
    return jobs.findings_latest(on_stream(i, "findings_fx", lineitem=lines), jobs.fresh_base(i.spark, "findings"))
