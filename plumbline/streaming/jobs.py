"""The same checks on streams, as Structured Streaming queries.

Sinks are tables under the shared folder; every query keeps its checkpoint there, so a restarted
query goes on where it stopped.  In append mode behind a watermark a window is written once, when
no more rows for it are accepted; ``final_state`` gives all windows, those still open included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.ordered import Ordered, time_bucket
from plumbline.operators.scoring import dedupe_findings
from plumbline.operators.statements import guard_commands
from plumbline.session import delete_folder, folder_names, scratch_path


def table_stream(spark: SparkSession, folder: str, name: str, ts: str | None = None) -> DataFrame:
    """Files ``name*.parquet`` of a folder as a stream; ``ts`` becomes a zoned event time."""
    schema = spark.read.option("pathGlobFilter", f"{name}*.parquet").parquet(folder).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(folder)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")) if ts else stream


def run_to_table(stream: DataFrame, base: str) -> DataFrame:
    """Work off what is available in append mode and return the sink table."""
    out = f"{base}/out"
    q = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{base}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, base: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Work off what is available, handing every micro-batch to ``each``."""
    q = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", f"{base}/checkpoint")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def guard(commands: DataFrame, column: str = "statement") -> DataFrame:
    """Block or allow each command as it arrives, with the rule that decided."""
    return guard_commands(commands, column).na.fill("", ["label"]).withColumn("blocked", F.col("label") != "")


def rollup(events: DataFrame, ts: str, keys: list[str], width: str, delay: str) -> DataFrame:
    """Tumbling counts per key; rows later than ``delay`` are cut off."""
    counted = events.withWatermark(ts, delay).groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def hot_keys(events: DataFrame, ts: str, key: str, width: str, slide: str, delay: str, at_least: int) -> DataFrame:
    """Sliding write rate per key above a bound."""
    counted = events.withWatermark(ts, delay).groupBy(F.window(ts, width, slide), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= at_least).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, delay: str) -> DataFrame:
    """Bursts of activity per key, closed by ``gap`` of silence.  Sessions are merged inside each
    input partition first (when the session setting allows it), which keeps a hot key light."""
    counted = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def idempotent(deliveries: DataFrame, ts: str, op_key: list[str], delay: str) -> DataFrame:
    """Drop redeliveries of an operation that arrive within the watermark."""
    return deliveries.withWatermark(ts, delay).dropDuplicatesWithinWatermark(op_key)


def read_your_writes(log: DataFrame, ts: str, keys: list[str], event: str, lag: str, base: str) -> DataFrame:
    """Reads that follow the latest write of the same keys within ``lag``.

    Each batch is ordered together with the one latest write per key that earlier batches left,
    so a read is reported once and the carried table holds one row per key.  Rows arrive in the
    order of batches; within a batch they may come in any order.
    """
    spark = log.sparkSession
    place = F.struct(ts, event)
    schema = log.select(*keys, event, ts, "action").schema

    def each(batch: DataFrame, batch_id: int) -> None:
        before = [n for n in _versions(spark, base) if n < batch_id]
        rows = batch.select(*keys, event, ts, "action")
        if before:
            rows = rows.unionByName(spark.read.schema(schema).parquet(f"{base}/state/{before[-1]}"))
        rows = rows.withColumn("__at", F.col(ts))
        ordered = Ordered(rows, keys, [ts, event], time_bucket(ts, 86_400))
        judged = ordered.latest(F.col("action") == "write", [event, "__at"], "w")
        found = judged.where((F.col("action") == "read") & (F.col(ts) <= F.col("w.__at") + F.expr(f"INTERVAL {lag}")))
        found.select(*keys, F.col(f"w.{event}").alias("write_event"), F.col(event).alias("read_event")).write.mode("overwrite").parquet(f"{base}/out/batch-{batch_id}")
        writes = rows.where("action = 'write'").groupBy(*keys).agg(F.max(place).alias("m"))
        writes.select(*keys, f"m.{event}", f"m.{ts}", F.lit("write").alias("action")).write.mode("overwrite").parquet(f"{base}/state/{batch_id}")
        for n in before[:-1]:
            delete_folder(spark, f"{base}/state/{n}")

    run_batches(log, base, each)
    return spark.read.parquet(f"{base}/out/*")


def split_late(events: DataFrame, ts: str, delay_seconds: int, base: str) -> DataFrame:
    """Separate rows that arrive more than ``delay_seconds`` behind the newest row of earlier
    batches; late rows are kept and marked, not lost.  Replaying a batch rewrites its own output."""
    spark = events.sparkSession
    schema = "batch_max long, batch_id long"

    def each(batch: DataFrame, batch_id: int) -> None:
        micros = F.unix_micros(ts)
        seen = spark.read.schema(schema).parquet(f"{base}/seen/*") if batch_id > 0 else None
        edge = seen.where(F.col("batch_id") < batch_id).agg(F.max("batch_max")).first()[0] if seen is not None else None
        late = F.lit(False) if edge is None else micros < F.lit(edge - delay_seconds * 1_000_000)
        marked = batch.withColumn("late", late).withColumn("batch_id", F.lit(batch_id).cast("long"))
        marked.write.mode("overwrite").parquet(f"{base}/rows/batch-{batch_id}")
        newest = batch.agg(F.max(micros).alias("batch_max")).withColumn("batch_id", F.lit(batch_id).cast("long"))
        newest.write.mode("overwrite").parquet(f"{base}/seen/batch-{batch_id}")

    run_batches(events, base, each)
    return spark.read.parquet(f"{base}/rows/*")


def findings_latest(findings: DataFrame, base: str) -> DataFrame:
    """Running most-severe state per finding, as one table: each batch merges the table before it
    with its own findings.  Replaying a batch rewrites its own table; older ones are deleted, so
    neither state nor files grow with the number of batches."""
    spark = findings.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        before = [n for n in _versions(spark, base) if n < batch_id]
        merged = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{base}/state/{before[-1]}")) if before else batch
        dedupe_findings(merged).write.mode("overwrite").parquet(f"{base}/state/{batch_id}")
        for n in before[:-1]:
            delete_folder(spark, f"{base}/state/{n}")

    run_batches(findings, base, each)
    return _newest(findings, base)


def _versions(spark: SparkSession, base: str) -> list[int]:
    return sorted(map(int, folder_names(spark, f"{base}/state")))


def _newest(like: DataFrame, base: str) -> DataFrame:
    """The table of the last batch; no rows before the first."""
    spark, versions = like.sparkSession, _versions(like.sparkSession, base)
    return spark.read.schema(like.schema).parquet(f"{base}/state/{versions[-1]}") if versions else spark.createDataFrame([], like.schema)


def final_state(stream: DataFrame, base: str) -> DataFrame:
    """Work off what is available in complete mode: the state of every window, open ones included."""
    spark = stream.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/state/{batch_id}")
        for n in _versions(spark, base):
            if n < batch_id - 1:
                delete_folder(spark, f"{base}/state/{n}")

    run_batches(stream, base, each, mode="complete")
    return _newest(stream, base)


def fresh_base(spark: SparkSession, label: str) -> str:
    return scratch_path(spark, f"stream-{label}")
