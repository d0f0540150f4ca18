"""Session helpers: test/bench sessions, table access and the shared scratch folder."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: str = "*", partitions: int = 8, app: str = "plumbline") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def constant_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal frame.  It is part of the plan itself, so filters and projections on it
    fold away and no task reads it."""
    types = spark.createDataFrame([], schema).schema
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
    table = pa.Table.from_arrays(
        [pa.array(list(values), t) for values, t in zip(columns, to_arrow_schema(types).types, strict=True)], names=types.names
    )
    return spark.createDataFrame(table, schema=types)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` as the cluster sets it, else the
    checkpoint folder that the program set on its context.  There is no other fallback."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Materialise ``df`` as a table in the shared folder, so that later jobs restart from it
    and a lost executor costs nothing but a re-read."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    stage = df.sparkSession.read.schema(df.schema).parquet(path)
    stage.stage_path = path
    return stage


def drop_stage(stage: DataFrame) -> None:
    """Delete the files of a table made by ``cut_lineage`` that nothing will read again."""
    delete_folder(stage.sparkSession, stage.stage_path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def folder_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of the shared store; none if it does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in store.listStatus(path)) if store.exists(path) else []
