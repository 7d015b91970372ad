"""Delta-maintained token totals by source, language and tokenizer version.

A change is a signed row: +1 for an insert, -1 for a delete; a revised count is a -1 row with the old count
and a +1 row with the new one. A batch of changes is summed to one delta row per (source, lang, tokenizer) and
committed under its id by a rename; committing an id again changes nothing, so a retried batch counts once.
Totals are the sum of all committed deltas; ``compact`` folds them into one snapshot.

Tokens are those of the public tokenizers, without begin and end ids; a tokenizer's version is the name of its file.

Null keys form a group of their own; null counts add 0; null texts are empty; an empty batch commits an empty delta; extra columns
of the changes are ignored; repeated rows each count.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces, store, textkernel, wavelet

KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed(rows: DataFrame, sign: int, tokenizer: str, n_tokens: str) -> DataFrame:
    """Changes that insert (+1) or delete (-1) each of ``rows`` with the count in column ``n_tokens``."""
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).alias("sign"), F.coalesce(F.col(n_tokens), F.lit(0)).cast("long").alias("n_tokens"))


def revised(rows: DataFrame, tokenizer: str, old: str, new: str) -> DataFrame:
    """Changes that replace the count ``old`` by ``new``."""
    return signed(rows, -1, tokenizer, old).unionByName(signed(rows, 1, tokenizer, new))


class TokenRollup:
    """Totals kept under ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folders(self, kind: str) -> list[str]:
        fs, at = store.filesystem(self.spark, f"{self.root}/{kind}")
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def committed(self, batch_id: str) -> bool:
        """Whether a batch counts, by its delta or in the latest snapshot."""
        fs, at = store.filesystem(self.spark, f"{self.root}/delta/{batch_id}")
        covered = self._covered()
        return fs.exists(at) or (covered is not None and not covered.where(F.col("batch") == batch_id).isEmpty())

    def _covered(self, snapshots: list[str] | None = None) -> DataFrame | None:
        """Ids of the batches in the latest snapshot: as many as were ever committed, so they stay a table."""
        snapshots = self._folders("snapshot") if snapshots is None else snapshots
        return self.spark.read.schema("batch string").parquet(f"{self.root}/snapshot/{snapshots[-1]}/covered") if snapshots else None

    def _new(self, snapshots: list[str] | None = None, listed: list[str] | None = None) -> list[str]:
        """Ids of the deltas since the latest snapshot (and of a few before, until ``compact`` deletes them)."""
        folders, covered = self._folders("delta") if listed is None else listed, self._covered(snapshots)
        if covered is None or not folders:
            return folders
        names = self.spark.createDataFrame([(b,) for b in folders], "batch string")
        return sorted(r[0] for r in names.join(covered, "batch", "left_anti").collect())

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Sums and commits a batch; False, with nothing changed, if the id is committed already."""
        if not re.fullmatch(r"[\w-]+", batch_id):
            raise ValueError(f"batch id {batch_id!r} is not a word")
        if self.committed(batch_id):
            return False
        delta = (
            changes.groupBy(*KEYS)
            .agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.coalesce("n_tokens", F.lit(0))).cast("long").alias("n_tokens"))
            .where("n_docs <> 0 or n_tokens <> 0")
        )
        staged = f"{self.root}/staging/{uuid.uuid4().hex}"
        delta.write.parquet(staged)
        return self._publish(staged, "delta", batch_id)

    def _publish(self, staged: str, kind: str, name: str) -> bool:
        """Moves a staged folder to its name; False if another was there first."""
        fs, source = store.filesystem(self.spark, staged)
        _, target = store.filesystem(self.spark, f"{self.root}/{kind}/{name}")
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(source, target):
            fs.delete(source, True)
            return False
        # Some file systems move a folder into one that appeared meanwhile; nothing reads it there.
        _, inside = store.filesystem(self.spark, f"{self.root}/{kind}/{name}/{source.getName()}")
        if fs.exists(inside):
            fs.delete(inside, True)
            return False
        return True

    def totals(self) -> DataFrame:
        """n_docs and n_tokens of every (source, lang, tokenizer) that has any."""
        snapshots = self._folders("snapshot")
        return self._totals(snapshots, self._new(snapshots))

    def _totals(self, snapshots: list[str], new: list[str]) -> DataFrame:
        """The last of ``snapshots`` and the deltas ``new``, summed."""
        paths = [f"{self.root}/delta/{b}" for b in new] + [f"{self.root}/snapshot/{s}/totals" for s in snapshots[-1:]]
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Writes a snapshot of the totals with the ids it covers, and deletes the deltas that the snapshot before covered.

        Snapshots and deltas are listed once: a batch committed meanwhile is in neither the totals nor the ids and stays a delta, and of two
        that compact at once, the second finds its number taken and changes nothing.
        """
        snapshots = self._folders("snapshot")
        listed = self._folders("delta")
        new, covered, staged = self._new(snapshots, listed), self._covered(snapshots), f"{self.root}/staging/{uuid.uuid4().hex}"
        old = sorted(set(listed) - set(new))
        self._totals(snapshots, new).write.parquet(f"{staged}/totals")
        ids = self.spark.createDataFrame([(b,) for b in new], "batch string")
        (ids if covered is None else ids.unionByName(covered)).write.parquet(f"{staged}/covered")
        if self._publish(staged, "snapshot", f"{len(snapshots):08d}"):
            for b in old:
                fs, at = store.filesystem(self.spark, f"{self.root}/delta/{b}")
                fs.delete(at, True)


#: Tokenizer versions: the file, its codec's module, and the ids that the codec adds to a text.
TOKENIZERS = {wavelet.TOKENIZER: (wavelet.load, 1), pieces.MODEL: (pieces.load, 2)}


def counted(docs: DataFrame, tokenizers: list[str] | None = None) -> DataFrame:
    """Per document: doc_id, source, lang, a fingerprint of the text (null and empty texts alike), and its tokens by tokenizer (array)."""
    names = tokenizers or list(TOKENIZERS)
    schema = "doc_id long, source string, lang string, fingerprint string, tokens array<long>"

    def count(batches):
        codecs = [(TOKENIZERS[n][0](), TOKENIZERS[n][1]) for n in names]
        for batch, data, at in textkernel.ranges(batches):
            n = np.stack([np.diff(codec.encode(data, at)[1]) - added for codec, added in codecs], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * len(names), pa.int32()), pa.array(n.reshape(-1).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], lists], names=["doc_id", "source", "lang", "fingerprint", "tokens"])

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), "source", "lang", F.sha2(text.cast("binary"), 256).alias("fingerprint"), text.alias("text")).mapInArrow(count, schema)


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents pass through four batches: inserted under two tokenizer versions, exact copies deleted, the
    counts of one revised to hold an end token. Two of the batches are committed again, which changes nothing.
    """
    word, piece = TOKENIZERS
    rows = counted(store.table(spark, sf_dir, "documents"), [word, piece]).select("doc_id", "source", "lang", "fingerprint", F.col("tokens")[0].alias("n_word"), F.col("tokens")[1].alias("n_piece"))
    rows = store.materialize(rows, "op1-counts")
    least = F.min_by(F.struct("doc_id", "source", "lang", "n_word", "n_piece"), F.struct("doc_id", "source", "lang"))
    kept = store.materialize(rows.groupBy("fingerprint").agg(least.alias("k")).select("k.*"), "op1-kept")
    rollup = TokenRollup(spark, store.scratch(spark, "op1-rollup"))
    load = signed(rows, 1, word, "n_word")
    rollup.commit("load-word", load)
    rollup.commit("load-piece", signed(rows, 1, piece, "n_piece"))
    gone = [signed(x, s, t, n) for t, n in ((word, "n_word"), (piece, "n_piece")) for x, s in ((rows, -1), (kept, 1))]
    copies = gone[0].unionByName(gone[1]).unionByName(gone[2]).unionByName(gone[3])
    rollup.commit("drop-copies", copies)
    rollup.commit("drop-copies", copies)
    rollup.commit("end-token", revised(kept.withColumn("with_end", F.col("n_word") + 1), word, "n_word", "with_end"))
    rollup.compact()
    rollup.commit("load-word", load)
    store.drop(rows, kept)
    return rollup.totals()
