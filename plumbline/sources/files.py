"""Findings, migration corpora and file listings in; reports out."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.once import compute_once
from plumbline.operators import scoring
from plumbline.operators.inventory import IGNORED_DIRS
from plumbline.sources.cutter import file_elements

FINDING_JSON = (
    "store string, paradigm string, id string, module string, title string, status string, severity int, scope string, "
    "evidence struct<observed:string,snippet:string>, expected string, recommendation string, fixable string, "
    "verification struct<method:string,assertion:string,reproduce:string>, "
    "expected_impact struct<axis:string,confidence:string,magnitude:string,rationale:string>, "
    "axis string, confidence string, magnitude string"
)


def load_findings(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Findings from JSON files: one finding, ``{"findings": [...]}`` or array per line, or such values over many lines.

    Files whose every line is a value are split within a file; the others are read whole, a task for each, which holds
    some lines and one finding at a time, and one that holds no JSON value fails the job.  ``multi_line`` says which kind
    all files are, where that is known; then nothing is read twice, and all have to be UTF-8.
    """
    schema = f"{FINDING_JSON}, findings array<struct<{_as_struct(FINDING_JSON)}>>"
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    if multi_line is None:
        kinds = _layouts(spark.read.text(path)).collect()  # names of files, which the driver lists to read them anyway
        lines, whole, wide = ([_literal(unquote(r["file"])) for r in kinds if r["layout"] == kind] for kind in ("lines", "whole", "wide"))
        parts = [reader.json(lines if whole or wide else path)] if lines or not kinds else []
        parts += [_elements(spark, whole, schema)] if whole else []
        parts += [reader.option("multiLine", True).json(wide)] if wide else []
        raw = reduce(DataFrame.unionByName, parts)
    else:
        raw = _elements(spark, path, schema) if multi_line else reader.json(path)
    plain = [c for c in raw.columns if c != "findings"]
    each = raw.select(F.explode(F.coalesce("findings", F.array(F.struct(*plain)))).alias("f")).select("f.*")
    impact = {c: F.coalesce(c, f"expected_impact.{c}") for c in ("axis", "confidence", "magnitude")}
    return each.withColumns(impact).withColumns(
        {
            "observed": F.col("evidence.observed"),
            "method": F.col("verification.method"),
            "assertion": F.col("verification.assertion"),
            "reproduce": F.col("verification.reproduce"),
            "rationale": F.col("expected_impact.rationale"),
        }
    ).drop("evidence", "verification", "expected_impact")


def _layouts(texts: DataFrame) -> DataFrame:
    """(file, layout): ``lines`` where every line is a value of its own, as its brackets show, else ``whole``; ``wide`` are
    UTF-16 and UTF-32, which only Spark's reader of whole files tells apart."""
    plain = F.regexp_replace(F.regexp_replace("value", r"\\.", ""), '"[^"]*+"', "")
    opened, closed = (F.length(F.regexp_replace(plain, others, "")) for others in (r"[^{\[]+", r"[^}\]]+"))
    broken = F.when(~F.col("value").rlike(r"^[\s\uFEFF]*[{\[]"), F.col("value").rlike(r"\S")).otherwise(opened != closed)
    seen = texts.select(F.col("_metadata.file_path").alias("file"), broken.alias("broken"), F.contains("value", F.lit("\0")).alias("wide"))
    layout = F.when(F.bool_or("wide"), "wide").when(F.bool_or("broken"), "whole").otherwise("lines")
    return seen.groupBy("file").agg(layout.alias("layout"))


def _literal(path: str) -> str:
    """A path whose characters stand for themselves where the readers take patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _elements(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Rows of files that are not of lines, read finding by finding."""
    found = file_elements(spark, paths, "findings")
    text = F.when(~F.col("text").rlike(r"\S"), "]").otherwise(F.col("text"))  # nothing between two commas is no value
    value = F.when(F.col("inner"), F.concat(F.lit('{"findings":['), text, F.lit("]}"))).otherwise(text)
    return compute_once(found, d=F.from_json(value, schema, {"mode": "FAILFAST"})).select("d.*")


def _as_struct(ddl: str) -> str:
    """``a int, b struct<..>`` in the colon form nested types need."""
    fields, current, depth = [], "", 0
    for ch in ddl:
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and depth == 0:
            fields.append(current.strip())
            current = ""
        else:
            current += ch
    fields.append(current.strip())
    return ",".join(f.replace(" ", ":", 1) for f in fields)


def load_migration_corpus(spark: SparkSession, root: str, glob: str = "*.sql") -> DataFrame:
    """(path, body) of every migration file under ``root``; one row per file."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    )


def load_file_inventory(spark: SparkSession, root: str, max_depth: int | None = None, glob: str = "*") -> DataFrame:
    """(repo, path, content, bytes) of the files below each repository folder of ``root``; dependency
    and build folders are left out.  A ``max_depth`` keeps the files that deep or less; what lies
    deeper is counted by ``files_below``."""
    raw = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.col("value").alias("content"))
    )
    below = F.regexp_replace(F.col("file"), "^.*?" + _quoted(root.rstrip("/")) + "/", "")
    split = raw.withColumn("below", below).withColumn("repo", F.regexp_extract("below", "^([^/]+)/", 1))
    inside = split.withColumn("path", F.regexp_replace("below", "^[^/]+/", ""))
    kept = inside.where(~F.col("path").rlike(IGNORED_DIRS)).select("repo", "path", "content", "bytes")
    return kept if max_depth is None else kept.where(_depth() <= max_depth)


def _depth() -> Column:
    return F.size(F.split("path", "/")) - 1


def files_below(inventory: DataFrame, max_depth: int) -> DataFrame:
    """Files and bytes per repository that a listing of this depth would leave out."""
    deeper = inventory.where(_depth() > max_depth)
    return deeper.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def report_rows(findings: DataFrame, generated_at: str, tier: int, engines: DataFrame | None = None) -> DataFrame:
    """One nested JSON report per store: both axes with their categories and what they mean
    together.  ``engines`` has the engine of each store; findings stay in their own table."""
    scores = scoring.axis_scores(findings)
    named = scoring.category_scores(findings).groupBy("store", "axis").agg(
        F.array_sort(F.collect_list(F.struct(F.col("category").alias("name"), "weight", "value", "active"))).alias("categories")
    )
    told = scoring.score_interpretation(scores).select("store", "interpretation")
    each = scores.join(named, ["store", "axis"], "left").join(told, "store")
    none = F.array().cast("array<struct<name:string,weight:int,value:double,active:boolean>>")
    each = each.withColumn("categories", F.coalesce("categories", none))
    per_store = each.groupBy("store", "paradigm").agg(
        F.array_sort(
            F.collect_list(F.struct("axis", "value", "computed", "band", "capped", "interpretation", "needs_api_count", "categories"))
        ).alias("scores")
    )
    per_store = per_store.join(engines.select("store", "engine"), "store", "left") if engines else per_store.withColumn("engine", F.lit(None).cast("string"))
    body = F.struct(
        F.col("store").alias("target"), F.lit(generated_at).alias("generated_at"), F.lit(tier).alias("tier"), "paradigm", "engine", "scores"
    )
    return per_store.select("store", F.to_json(body).alias("value"))


def write_report(findings: DataFrame, path: str, generated_at: str, tier: int, engines: DataFrame | None = None) -> None:
    """Findings as Parquet partitioned by store, and reports on what was stored as JSON lines."""
    # Rebalancing splits a store that holds much of the data and merges small ones.
    findings.hint("rebalance", "store").write.mode("error").partitionBy("store").parquet(f"{path}/findings")
    stored = findings.sparkSession.read.schema(findings.schema).parquet(f"{path}/findings")
    report_rows(stored, generated_at, tier, engines).select("value").write.mode("error").text(f"{path}/reports")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    categories = "array<struct<name:string,weight:int,value:double,active:boolean>>"
    schema = (
        "target string, generated_at string, tier int, paradigm string, engine string, scores array<struct<axis:string,value:double,"
        f"computed:double,band:string,capped:boolean,interpretation:string,needs_api_count:bigint,categories:{categories}>>"
    )
    return spark.read.schema(schema).json(f"{path}/reports")
