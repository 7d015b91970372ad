"""Batches that a stopped run takes up again: a stream over a folder's files, and a table kept as a log of versions.

``process`` is a Structured Streaming query with ``foreachBatch`` and ``Trigger.AvailableNow``: its checkpoint knows which files belong to which
batch before the batch runs, so a batch that was cut short runs again with the same files and replaces what it left. Nothing counts or sorts what is left to do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import CommitLog
from ..sources.tables import scratch, table
from .rollup import combined, rollup


def process(spark: SparkSession, folder: str, schema, root: str, step: Callable[[DataFrame], DataFrame], files: int = 1) -> DataFrame | None:
    """Applies ``step`` to every file of ``folder`` that no earlier run has done, ``files`` of them a batch; returns the rows of all batches with their number (``batch``), None without any.

    ``root`` holds the checkpoint and the rows of each batch. A batch is done once the checkpoint says so; until then its rows are written anew.
    """
    out = f"{root}/rows"

    def one(rows: DataFrame, batch: int) -> None:
        step(rows).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    query = source.writeStream.foreachBatch(one).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return finished(spark, root)


def _numbers(spark: SparkSession, folder: str, prefix: str = "") -> list[int]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())


def finished(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows of all batches that are done: those up to the last one in the checkpoint, which forgets older numbers."""
    last = max(_numbers(spark, f"{root}/checkpoint/commits"), default=-1)
    paths = [f"{root}/rows/batch={b}" for b in _numbers(spark, f"{root}/rows", "batch=") if b <= last]
    return spark.read.option("basePath", f"{root}/rows").parquet(*paths) if paths else None


def q_streamed_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of events by hour and type, streamed from files in batches of two and merged."""
    events, root = table(spark, sf_dir, "events"), scratch(spark, "streamed")
    events.repartition(6, "event_id").write.parquet(f"{root}/in")
    return combined(process(spark, f"{root}/in", events.schema, root, rollup, files=2))


def q_committed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type from a log of versions: a third of the events, the second third, users ending in 3 deleted, a compaction, the last third; the snapshots after the second change and after all."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.col("value"))
    log = CommitLog(spark, scratch(spark, "committed"), ["user_id", "event_type"])
    third = lambda i: events.where(F.pmod("event_id", F.lit(3)) == i)
    log.upsert(third(0), order="event_id")
    second = log.upsert(third(1), order="event_id")
    log.delete(events.where("user_id % 10 = 3"))
    log.compact()
    last = log.upsert(third(2), order="event_id")
    return log.read(second).withColumn("snapshot", F.lit("second")).unionByName(log.read(last).withColumn("snapshot", F.lit("last")))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
_LAST = 'SELECT user_id, event_type, {}, event_id, "value" FROM events WHERE {} QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY {}event_id DESC) = 1'
ORACLE = {
    "streamed_rollup": "SELECT date_trunc('hour', ts) \"hour\", event_type, count(*) n, round(sum(\"value\"), 2) total FROM events GROUP BY 1, 2",
    "committed_events": _LAST.format("'second' \"snapshot\"", "event_id % 3 IN (0, 1)", "event_id % 3 DESC, ")
    + " UNION ALL "
    + _LAST.format("'last' \"snapshot\"", "event_id % 3 = 2 OR user_id % 10 <> 3 OR user_id IS NULL", "event_id % 3 DESC, "),
}
