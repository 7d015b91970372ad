"""Incremental rollup of events: the same columns from a batch, from a stream, or merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def rollup(events: DataFrame) -> DataFrame:
    """Counts and values by hour and type; works on batches and streams."""
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def stream(spark: SparkSession, path: str, schema, late: str = "10 minutes") -> DataFrame:
    """The rollup of a folder that grows; rows later than ``late`` are left out by the watermark."""
    return rollup(spark.readStream.schema(schema).parquet(path).withWatermark("ts", late))


def merge(total: DataFrame, batch: DataFrame) -> DataFrame:
    """Adds a batch's rollup to a total: sums are additive, so batches may come in any order."""
    return combined(total.unionByName(batch))


def combined(parts: DataFrame) -> DataFrame:
    """One rollup of the rows of several."""
    return parts.groupBy("hour", "event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


def q_incremental_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    odd = F.pmod("event_id", F.lit(2)) == 1
    return merge(rollup(events.where(odd)), rollup(events.where(~odd)))


QUERIES = {"incremental_rollup": q_incremental_rollup}
ORACLE = {"incremental_rollup": "SELECT date_trunc('hour', ts) \"hour\", event_type, count(*) n, round(sum(\"value\"), 2) total FROM events GROUP BY 1, 2"}
