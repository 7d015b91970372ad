"""A commit within a compaction, two compactions at once, empty texts of a repeated source, scopes of two threads, repeated labelled ids, the order of numbered rows."""

import random
import threading

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from datagauge.llm import bloom_lm, mixing, quality, store, token_rollup, toxicity

CHANGES = "source string, lang string, tokenizer string, sign int, n_tokens long"


def totals(rollup):
    return [(r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()]


def test_commit_within_compaction(spark, tmp_path, monkeypatch):
    rollup = token_rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    batch = lambda n: spark.createDataFrame([("s", "en", "t", 1, n)], CHANGES)
    rollup.commit("a", batch(5))
    plain = token_rollup.TokenRollup._totals

    def late(self, snapshots, new):
        monkeypatch.setattr(token_rollup.TokenRollup, "_totals", plain)
        assert self.commit("b", batch(7))
        return plain(self, snapshots, new)

    monkeypatch.setattr(token_rollup.TokenRollup, "_totals", late)
    rollup.compact()
    assert totals(rollup) == [(2, 12)] and not rollup.commit("b", batch(7))
    rollup.compact()
    rollup.compact()
    assert totals(rollup) == [(2, 12)] and rollup.committed("a") and rollup.committed("b")


def test_two_compactions_at_once(spark, tmp_path, monkeypatch):
    rollup = token_rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    batch = lambda n: spark.createDataFrame([("s", "en", "t", 1, n)], CHANGES)
    rollup.commit("a", batch(5))
    plain = token_rollup.TokenRollup._totals

    def other(self, snapshots, new):
        monkeypatch.setattr(token_rollup.TokenRollup, "_totals", plain)
        self.compact()
        return plain(self, snapshots, new)

    monkeypatch.setattr(token_rollup.TokenRollup, "_totals", other)
    rollup.compact()
    assert totals(rollup) == [(1, 5)] and len(rollup._folders("snapshot")) == 1


def test_empty_texts_are_never_taken(spark):
    rows = [(i, "one two three", "a") for i in range(40)] + [(100 + i, "w " * 4, "b") for i in range(3)] + [(200, "", "b"), (201, None, "b"), (202, " \t", "b"), (203, "", "a")]
    mixed, held, wanted = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.array("source"))
    got = {r["doc_id"]: r["taken_copies"] for r in mixed.collect()}
    assert all(got[i] == 0 for i in (200, 201, 202, 203)) and sum(got[100 + i] for i in range(3)) > 3


def test_scopes_of_threads(spark):
    """A scope that ends in one thread leaves another thread's tables alone."""
    inside, ended, counts = threading.Event(), threading.Event(), []

    def one():
        with store.scope() as keep:
            df = store.materialize(spark.range(5), "scope-test")
            inside.set()
            ended.wait(60)
            counts.append(df.count())
            keep(df)

    t = threading.Thread(target=one)
    t.start()
    assert inside.wait(60)
    with store.scope():
        store.materialize(spark.range(3), "scope-test")
    ended.set()
    t.join()
    assert counts == [5]


def test_a_labelled_id_on_many_rows_is_fitted_once(spark):
    rows = [(i, f"vile rotten word{i}" if i % 2 else f"kind gentle word{i}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    once = toxicity.ToxicityModel.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    again = toxicity.ToxicityModel.fit(spark.createDataFrame(rows + [rows[3]] * 200 + [rows[4]] * 90 + [(None, "kind"), (77, "vile")], "doc_id long, text string"), labels)
    assert np.allclose(once.weights, again.weights) and abs(once.bias - again.bias) < 1e-9 and np.abs(once.weights).max() > 0


def test_numbered_rows_are_in_the_order_of_their_content():
    rows = [(1, True, "b"), (1, False, "b"), (None, None, None), (None, None, "a"), (2, True, ""), (2, True, ""), (1, True, None)]
    seen = set()
    for seed in range(6):
        random.Random(seed).shuffle(rows)
        table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "held_out": pa.array([r[1] for r in rows], pa.bool_()), "__text": pa.array([r[2] for r in rows], pa.string())})
        seen.add(repr(bloom_lm.in_order(table, ["doc_id", "held_out", "__text"]).to_pylist()))
    assert len(seen) == 1


def test_quality_learns_from_all_trusted_documents(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 60))) for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    few, all_ = (quality.QualityModel.fit(docs, labels, trusted=n) for n in (4, 1000))
    assert np.array_equal(few.ratio, all_.ratio) and few.threshold == all_.threshold
