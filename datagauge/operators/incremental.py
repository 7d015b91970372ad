"""Pairs, clusters and neighbours of samples that arrive in batches, kept without comparing old samples with one another again.

A batch compares its samples with each other and with those held. Of each held sample the prefixes of its sets are kept, in an order of grams
that the first batch fixes (any order that all sets share is exact), so a held set is neither read whole nor sorted again until it meets a candidate.
Clusters are merged by their roots: new pairs are edges between stored roots, and only samples whose root changes get a row. Of neighbours, the new pairs'
best meets the stored one.

A batch is a folder with its samples, prefixes, pairs, and the roots and neighbours that it changes; a manifest of
``commits.CommitLog`` lists the folders that count. A batch that died is not listed and runs again under its name; one that is
listed already changes nothing. Of two batches at once the second raises ``commits.Taken`` and is to run again, as the two were not compared.

Samples: as ``pairs.score_pairs`` takes them. Of an id that comes again the sample held stays; null ids are left out; of rows that repeat an id one is taken (the least by
name and prompt). An empty batch is a batch like any other.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import CommitLog
from ..sources.tables import scratch, written
from . import pairs, similarity


class SampleStore:
    """Samples, labelled pairs, clusters and neighbours at ``root``, as of the last batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, self.root, ["id"])

    def batches(self) -> list[str]:
        """Names of the batches that count, in their order."""
        return [f.rsplit("-", 1)[0] for f in self.log.manifest()["changes"]]

    def _read(self, folders: list[str], name: str) -> DataFrame | None:
        """The rows that ``folders`` hold of a table, with the place of their batch (``__at``)."""
        parts = [self.spark.read.parquet(f"{self.root}/data/{f}/{name}").withColumn("__at", F.lit(i)) for i, f in enumerate(folders)]
        out = parts[0] if parts else None
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _last(self, folders: list[str], name: str) -> DataFrame | None:
        """Of each id the row of its last batch."""
        rows = self._read(folders, name)
        if rows is None:
            return None
        rest = [c for c in rows.columns if c not in ("id", "__at")]
        return rows.groupBy("id").agg(F.max_by(F.struct(*rest), "__at").alias("__r")).select("id", "__r.*")

    def pairs(self) -> DataFrame | None:
        """All labelled pairs; None before the first batch."""
        rows = self._read(self.log.manifest()["changes"], "pairs")
        return rows.drop("__at") if rows is not None else None

    def nearest(self) -> DataFrame | None:
        """As ``pairs.nearest`` over all pairs."""
        return self._last(self.log.manifest()["changes"], "nearest")

    def clusters(self) -> DataFrame | None:
        """As ``pairs.clusters``: every id with its cluster and the cluster's size."""
        roots = self._last(self.log.manifest()["changes"], "roots")
        if roots is None:
            return None
        rows = written(roots.select("id", F.col("root").alias("cluster_id")), "clusters")
        return rows.join(rows.groupBy("cluster_id").agg(F.count("*").alias("cluster_size")), "cluster_id").select("id", "cluster_id", "cluster_size")

    def _order(self, folders: list[str], folder: str, signal: str, new: DataFrame) -> np.ndarray:
        """The counters that order the grams of ``signal``: those of the first batch, kept beside it, 2^20 at any size."""
        if not folders:
            weight = similarity.counters(new)
            kept = np.flatnonzero(weight)
            rows = self.spark.createDataFrame(list(zip(kept.tolist(), weight[kept].tolist(), strict=True)), "k int, n long")
            rows.coalesce(1).write.parquet(f"{self.root}/data/{folder}/counters/signal={signal}")
            return weight
        found = self.spark.read.parquet(f"{self.root}/data/{folders[0]}/counters/signal={signal}").toArrow()
        weight = np.zeros(similarity.COUNTERS, np.int64)
        weight[found["k"].to_numpy()] = found["n"].to_numpy()
        return weight

    def _candidates(self, folders: list[str], folder: str, new: DataFrame, held: DataFrame | None) -> DataFrame:
        """(left, right) of every pair of a new sample with any other that may have a label."""
        at, old, made = f"{self.root}/data/{folder}", self._read(folders, "prefixes"), None
        for signal, least in pairs.SEARCHED.items():
            sets = pairs.hashed(new, signal)
            one = similarity.prefixes(sets, least - 1e-9, self._order(folders, folder, signal, sets), 0).withColumn("signal", F.lit(signal))
            made = one if made is None else made.unionByName(one)
        made.write.parquet(f"{at}/prefixes")
        fresh = self.spark.read.parquet(f"{at}/prefixes")
        out = pairs.near_vectors(new.select("id", "vector"), pairs.NEAR - 1e-9)
        if held is not None:
            out = out.unionByName(pairs.near_between(new, held, pairs.NEAR - 1e-9))
        for signal, least in pairs.SEARCHED.items():
            own = fresh.where(F.col("signal") == signal)
            theirs = old.where(F.col("signal") == signal) if old is not None else None
            everyone = own if theirs is None else own.unionByName(theirs.drop("__at"))
            out = out.unionByName(similarity.sharing(own, everyone, least - 1e-9))
            if theirs is not None:
                out = out.unionByName(similarity.sharing(theirs, own, least - 1e-9))
        return out.distinct()

    def _merge_roots(self, folders: list[str], new: DataFrame, found: DataFrame) -> DataFrame:
        """(id, root) of the new samples, and of the held ones whose root changes."""
        old = self._last(folders, "roots")
        own = new.select("id", F.col("id").alias("root"))
        every = written(own if old is None else own.unionByName(old), "roots")
        edges = found.where(F.col("combined") >= pairs.CLUSTER).select("left", "right")
        for end in ("left", "right"):
            edges = edges.join(every.select(F.col("id").alias(end), F.col("root").alias(f"{end}_root")), end)
        edges = edges.where("left_root <> right_root").select(F.col("left_root").alias("left"), F.col("right_root").alias("right"))
        moved = similarity.components(edges).select(F.col("node").alias("root"), F.col("root").alias("now"))
        rows = every.join(moved, "root", "left").join(own.select("id", F.lit(True).alias("fresh")), "id", "left")
        return rows.where("fresh OR now < root").select("id", F.coalesce("now", "root").alias("root"))

    def _merge_nearest(self, folders: list[str], found: DataFrame) -> DataFrame:
        """The closest other of every sample in a new pair, over all its pairs."""
        best, old = pairs.nearest(found), self._last(folders, "nearest")
        if old is None:
            return best
        rows = best.unionByName(old.join(best.select("id"), "id", "left_semi"))
        rest = [c for c in rows.columns if c != "id"]
        order = F.struct("combined", (-F.least("id", "closest")).alias("l"), (-F.greatest("id", "closest")).alias("r"))
        return rows.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("b")).select("id", "b.*")

    def add(self, name: str, samples: DataFrame) -> bool:
        """Takes a batch in; False if its name is listed already."""
        at = self.log.manifest()
        folders = at["changes"]
        if name in self.batches():
            return False
        folder = f"{name}-{uuid.uuid4().hex}"
        path = f"{self.root}/data/{folder}"
        held = self._read(folders, "samples")
        columns = [*pairs.SETS, "name", "vector"]
        new = samples.where("id IS NOT NULL").groupBy(F.col("id").cast("long").alias("id")).agg(F.min_by(F.struct(*columns), F.struct("name", "prompt")).alias("s")).select("id", "s.*")
        if held is not None:
            new = new.join(held.select("id"), "id", "left_anti")
        new.write.parquet(f"{path}/samples")
        new = self.spark.read.parquet(f"{path}/samples")
        every = new if held is None else new.unionByName(held.drop("__at"))
        found = pairs.score_pairs(written(self._candidates(folders, folder, new, held), "candidates"), every)
        found.write.parquet(f"{path}/pairs")
        found = self.spark.read.parquet(f"{path}/pairs")
        self._merge_roots(folders, new, found).write.parquet(f"{path}/roots")
        self._merge_nearest(folders, found).write.parquet(f"{path}/nearest")
        self.log._put(at["version"] + 1, None, [*folders, folder])
        return True


def q_incremental_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items taken in by three batches: every item's cluster and closest other."""
    samples, store = pairs._samples(spark, sf_dir), SampleStore(spark, scratch(spark, "samples"))
    for i in range(3):
        store.add(f"batch{i}", samples.where(F.pmod("id", F.lit(3)) == i))
    return pairs._rounded(store.clusters().join(store.nearest(), "id", "left")).select("id", "cluster_id", "cluster_size", "closest", "combined", "label")


QUERIES = {"incremental_samples": q_incremental_samples}
#: All samples at once.
ORACLE = {
    "incremental_samples": pairs.ORACLE["sample_clusters"].replace("SELECT id, cluster_id, count(*) OVER (PARTITION BY cluster_id) cluster_size FROM r", 'SELECT r.id, cluster_id, count(*) OVER (PARTITION BY cluster_id) cluster_size, closest, combined, "label" FROM r LEFT JOIN nb ON nb.id = r.id'),
}
