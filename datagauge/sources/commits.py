"""Tables as logs of numbered versions: upserts and deletes by key, snapshots of any kept version, compaction, retention.

A version is a manifest that lists folders of rows: a base and the changes since. A writer writes its rows to a folder of
its own, then puts the next manifest under its number only if no other writer has (a rename that fails where the name is taken: atomic on HDFS; a
store without such a rename needs one writer). The loser reads the newer manifest and tries the next number: its rows are written already,
changes of two writers never exclude each other, and of a key changed by both the later version holds. A writer that dies leaves an unlisted folder,
no lock; ``expire`` removes it. Readers keep the version that they opened. A manifest holds names only, as many as there are changes since the last compaction.

Null keys are equal. Rows of one change that repeat a key: the largest ``order`` holds, then the largest hash of the row. Columns that a later
change adds are null in earlier rows. An empty change is a version like any other. A log without a version reads as None.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import artifacts

GONE = "__gone"


class Taken(Exception):
    """Another writer has put this version."""


class CommitLog:
    """A table at ``root`` with the key columns ``keys``."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str]):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys

    def versions(self) -> list[int]:
        fs, at = artifacts._fs(self.spark, f"{self.root}/log")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(at) if x.getPath().getName().isdigit()) if fs.exists(at) else []

    def manifest(self, version: int | None = None) -> dict:
        """``version`` (the last one by default): its number, base folder or None, and folders of changes in order."""
        version = (self.versions() or [0])[-1] if version is None else version
        if version == 0:
            return {"version": 0, "base": None, "changes": []}
        fs, at = artifacts._fs(self.spark, f"{self.root}/log/{version:020d}")
        stream = fs.open(at)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {"version": version, **json.loads(text)}

    def _put(self, version: int, base: str | None, changes: list[str]) -> None:
        """The manifest under its number, whole or not at all; ``Taken`` where there is one."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        fs, draft = artifacts._fs(self.spark, f"{self.root}/log/.draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps({"base": base, "changes": changes}).encode()))
        stream.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{self.root}/log/{version:020d}"), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e):
                raise Taken(version) from None
            raise

    def _commit(self, base: str | None, changes: list[str], since: dict) -> int:
        """Adds ``changes``, or puts ``base`` in the place of all that ``since`` lists; whatever others added meanwhile stays."""
        while True:
            last = self.manifest()
            if base is None:
                found, rest = last["base"], last["changes"] + changes
            elif last["base"] != since["base"]:
                raise Taken("the base was replaced by another compaction")
            else:
                found, rest = base, last["changes"][len(since["changes"]) :]
            try:
                self._put(last["version"] + 1, found, rest)
            except Taken:
                continue
            return last["version"] + 1

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/data/{name}")
        return name

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Puts the rows in place of those of the same key; returns the version."""
        rest = [c for c in rows.columns if c not in self.keys]
        by = F.struct(*([F.col(order)] if order else []), F.xxhash64(*rest) if rest else F.lit(0))
        one = rows.groupBy(*self.keys).agg(F.max_by(F.struct(F.lit(False).alias(GONE), *rest), by).alias("__r")).select(*self.keys, "__r.*")
        return self._commit(None, [self._write(one)], {})

    def delete(self, rows: DataFrame) -> int:
        """Removes the keys that ``rows`` hold; returns the version."""
        return self._commit(None, [self._write(rows.select(*self.keys).distinct().withColumn(GONE, F.lit(True)))], {})

    def _changes(self, names: list[str]) -> DataFrame:
        """The last change of each key: an aggregate over the changes alone."""
        parts = [self.spark.read.parquet(f"{self.root}/data/{n}").withColumn("__at", F.lit(i)) for i, n in enumerate(names)]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part, allowMissingColumns=True)
        rest = [c for c in rows.columns if c not in (*self.keys, "__at")]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.col("__at")).alias("__r")).select(*self.keys, "__r.*")

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version. The base is not shuffled for changes that Spark finds small enough to broadcast."""
        at = self.manifest(version)
        base = self.spark.read.parquet(f"{self.root}/data/{at['base']}") if at["base"] else None
        if not at["changes"]:
            return base
        changed = self._changes(at["changes"])
        if base is None:
            return changed.where(~F.col(GONE)).drop(GONE)
        same = [F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}")) for k in self.keys]
        kept = base.alias("b").join(changed.select(*self.keys).alias("c"), same, "left_anti")
        return kept.unionByName(changed.where(~F.col(GONE)).drop(GONE), allowMissingColumns=True)

    def compact(self) -> int:
        """Writes the current rows as one base. Changes committed meanwhile stay; of two compactions at once the second raises ``Taken`` and changes nothing."""
        since = self.manifest()
        rows = self.read(since["version"])
        return self._commit(self._write(rows), [], since) if rows is not None else 0

    def expire(self, keep: int = 2) -> int:
        """Removes all but the last ``keep`` versions, and the folders that only those listed; returns how many folders went.

        Folders that no version lists are a dead writer's or a running one's: run this where no writer is at work.
        """
        versions = self.versions()
        held = [self.manifest(v) for v in versions[-max(keep, 1) :]]
        listed = {n for m in held for n in [m["base"], *m["changes"]] if n}
        for v in versions[: -max(keep, 1)]:
            fs, at = artifacts._fs(self.spark, f"{self.root}/log/{v:020d}")
            fs.delete(at, False)
        fs, at = artifacts._fs(self.spark, f"{self.root}/data")
        gone = [x.getPath() for x in fs.listStatus(at) if x.getPath().getName() not in listed] if fs.exists(at) else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)
