"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Shuffle files of a write are deleted when it ends: the table stands for them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset: a temporary one in local mode (tests), an error on a cluster."""
    set_by_cluster = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="datagauge-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/datagauge/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a written table: later jobs neither recompute them nor depend on executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if _scopes.get():
        _scopes.get()[-1].append(out)
    return out


#: Open scopes of the running thread, the innermost last.
_scopes: contextvars.ContextVar[tuple[list[DataFrame], ...]] = contextvars.ContextVar("scopes", default=())


@contextlib.contextmanager
def scope():
    """Deletes what is materialized inside when it ends, but for the tables given to the function that it yields."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    outer = _scopes.get()
    _scopes.set((*outer, made))
    try:
        yield lambda df: kept.append(df) or df
    finally:
        _scopes.set(outer)
        drop(*(df for df in made if not any(df is k for k in kept)))
        if outer:
            outer[-1].extend(kept)


def drop(*written: DataFrame) -> None:
    """Deletes tables of ``materialize`` that nothing reads any more."""
    for df in (x for x in written if hasattr(x, "_written_to")):
        fs, path = filesystem(df.sparkSession, df._written_to)
        fs.delete(path, True)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system and path objects for ``path``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's text, modulo ``parts``; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts, F.lit(0))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts of ``df`` and 16 for each row, counted: an estimate from file sizes knows neither compression nor widths."""
    return df.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 16)).first()[0] or 0


def parts_for(n_bytes: int, bytes_each: int, least: int = 64) -> int:
    """Partitions of about ``bytes_each`` bytes: grows with the input, without an upper end."""
    return max(least, -(-n_bytes // bytes_each))
