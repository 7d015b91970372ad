"""Sources and sinks: JSON lines, CSV and Parquet with stated schemas, and the mapping of the shared test tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = "Index int, FunctionName string, Title string, Difficulty string, Prompt string, StarterCode string, IdealResponse string, TestCases string"
RESULTS = "Index int, TargetName string, AttemptIndex int, Visibility string, CaseIndex int, Status string, FailureType string, Expected string, Actual string"
JUDGMENTS = "Index int, Column string, Verdict string, Note string"


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """Rows of a table; malformed JSON lines come back as rows of nulls."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "jsonl":
        return reader.option("mode", "PERMISSIVE").json(path)
    if kind == "csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return reader.format(kind).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Replaces a table; nested columns become JSON text in CSV."""
    if kind == "csv":
        nested = [c for c, t in df.dtypes if t.startswith(("array", "struct", "map"))]
        df.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif kind == "jsonl":
        df.write.mode("overwrite").json(path)
    else:
        df.write.mode("overwrite").format(kind).save(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """A scan with fewer partitions than cores, dealt anew by ``key``: a small file of one row group is read by one task. Larger scans stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores, key) if rows.rdd.getNumPartitions() < cores else rows


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path under the folder that the cluster names for checkpoints; a temporary one in local mode where it names none."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="datagauge-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/datagauge/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Rows read back from a new folder of ``scratch``."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
