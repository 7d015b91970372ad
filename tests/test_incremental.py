"""Samples in batches against all of them at once."""

import random

import pytest
from pyspark.sql import functions as F

from datagauge.operators import incremental, pairs
from datagauge.sources.commits import Taken
from datagauge.sources.tables import scratch, written

SCHEMA = "id long, prompt array<string>, template array<string>, tests array<string>, starter array<string>, title array<string>, function array<string>, name string, vector array<double>"


def rows(n, seed=3):
    """Samples of few kinds: copies, near copies, chains, empty sets, missing and zero vectors."""
    rng, out = random.Random(seed), []
    for i in range(n):
        kind = rng.randrange(6)
        grams = [f"k{kind}g{j}" for j in range(20) if rng.random() < 0.85] if kind else []
        vector = [None, [0.0, 0.0], [1.0, float(kind)], [float(rng.random()), 1.0]][rng.randrange(4)]
        out.append((i, grams, grams[:9], ["t"], grams[3:12], [f"w{kind}"], ["f"], f"n{kind}", vector))
    return out


@pytest.fixture(scope="module")
def samples(spark):
    return written(spark.createDataFrame(rows(36), SCHEMA), "samples")


def plain(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_batches_equal_all_at_once(spark, samples):
    store = incremental.SampleStore(spark, scratch(spark, "store"))
    assert store.pairs() is None and store.nearest() is None and store.clusters() is None and store.batches() == []
    # The last batch joins clusters of the earlier ones; one is empty; ids come again, null or twice.
    parts = {"a": samples.where("id % 2 = 0"), "b": samples.where("id % 4 = 1").unionByName(samples.where("id = 5")), "none": samples.where("false"), "c": samples.where("id % 4 = 3 OR id < 4").unionByName(samples.where("id = 7").withColumn("id", F.lit(None).cast("long")))}
    assert all([store.add(name, part) for name, part in parts.items()])
    assert store.batches() == list(parts)
    whole = written(pairs.labelled(samples), "whole")
    assert whole.count() > 50
    assert plain(store.pairs()) == plain(whole)
    assert plain(store.clusters()) == plain(pairs.clusters(samples, whole))
    assert plain(store.nearest()) == plain(pairs.nearest(whole))


def test_dead_and_repeated_batches(spark, samples, monkeypatch):
    store = incremental.SampleStore(spark, scratch(spark, "store"))
    store.add("a", samples.where("id < 8"))
    before = plain(store.clusters())
    assert not store.add("a", samples.where("id >= 8")) and plain(store.clusters()) == before

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_merge_nearest", dies)
        with pytest.raises(RuntimeError):
            store.add("b", samples.where("id >= 8 AND id < 16"))
    assert store.batches() == ["a"] and plain(store.clusters()) == before
    assert store.add("b", samples.where("id >= 8 AND id < 16"))
    part = samples.where("id < 16")
    assert plain(store.clusters()) == plain(pairs.clusters(part, written(pairs.labelled(part), "part")))


def test_two_batches_at_once(spark, samples):
    root = scratch(spark, "store")
    store, other = incremental.SampleStore(spark, root), incremental.SampleStore(spark, root)
    merged = store._merge_nearest

    def slow(*args):
        other.add("b", samples.where("id >= 4 AND id < 8"))
        return merged(*args)

    store._merge_nearest = slow
    with pytest.raises(Taken):
        store.add("a", samples.where("id < 4"))
    store._merge_nearest = merged
    assert store.add("a", samples.where("id < 4")) and store.batches() == ["b", "a"]
