"""A log of versions under two writers, snapshots, deletes, compaction and retention; a stream that is cut short and goes on."""

import pytest
from pyspark.sql import functions as F

from datagauge.sources.commits import CommitLog, Taken
from datagauge.streaming import resumable

ROWS = "k long, at long, v string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROWS)


def held(df):
    return sorted(((r["k"], r["v"]) for r in df.collect()), key=repr)


@pytest.fixture
def log(spark, tmp_path):
    return CommitLog(spark, f"file://{tmp_path}/log-table", ["k"])


def test_two_writers_lose_nothing(spark, log, monkeypatch):
    plain = CommitLog._put

    def late(self, *a):
        monkeypatch.setattr(CommitLog, "_put", plain)
        assert self.upsert(rows(spark, (2, 0, "other"), (3, 0, "other"))) == 1
        return plain(self, *a)

    monkeypatch.setattr(CommitLog, "_put", late)
    assert log.upsert(rows(spark, (1, 0, "mine"), (2, 0, "mine"))) == 2
    assert held(log.read()) == [(1, "mine"), (2, "mine"), (3, "other")]
    assert log.versions() == [1, 2]
    with pytest.raises(Taken):
        log._put(2, None, [])
    assert held(log.read()) == [(1, "mine"), (2, "mine"), (3, "other")]


def test_snapshots_deletes_and_null_keys(spark, log):
    assert log.read() is None and log.compact() == 0
    log.upsert(rows(spark, (1, 1, "a"), (1, 2, "b"), (None, 1, "n"), (4, 1, "d")), order="at")
    log.delete(rows(spark, (4, 0, ""), (9, 0, "")))
    log.upsert(rows(spark, (None, 2, "m"), (1, 0, "c")).withColumn("more", F.lit(5)))
    assert held(log.read(1)) == [(1, "b"), (4, "d"), (None, "n")]
    assert held(log.read(2)) == [(1, "b"), (None, "n")]
    assert held(log.read()) == [(1, "c"), (None, "m")]
    log.compact()
    assert len(log.manifest()["changes"]) == 0 and held(log.read()) == [(1, "c"), (None, "m")]
    log.upsert(rows(spark).limit(0))
    log.upsert(rows(spark, (4, 3, "back")))
    assert {r["k"]: r["more"] for r in log.read().collect()} == {1: 5, None: 5, 4: None}
    assert held(log.read(2)) == [(1, "b"), (None, "n")]


def test_a_change_within_a_compaction_stays(spark, log, monkeypatch):
    log.upsert(rows(spark, (1, 0, "a")))
    plain = CommitLog._write

    def late(self, df):
        monkeypatch.setattr(CommitLog, "_write", plain)
        name = plain(self, df)
        self.upsert(rows(spark, (2, 0, "b")))
        return name

    monkeypatch.setattr(CommitLog, "_write", late)
    log.compact()
    assert len(log.manifest()["changes"]) == 1 and held(log.read()) == [(1, "a"), (2, "b")]


def test_of_two_compactions_one_holds(spark, log, monkeypatch):
    log.upsert(rows(spark, (1, 0, "a")))
    plain = CommitLog._write

    def late(self, df):
        monkeypatch.setattr(CommitLog, "_write", plain)
        self.compact()
        return plain(self, df)

    monkeypatch.setattr(CommitLog, "_write", late)
    with pytest.raises(Taken):
        log.compact()
    assert log.versions() == [1, 2] and held(log.read()) == [(1, "a")]


def test_expire_keeps_what_versions_list(spark, log):
    for i in range(4):
        log.upsert(rows(spark, (i, 0, str(i))))
    log.compact()
    log.upsert(rows(spark, (9, 0, "9")))
    log._write(rows(spark, (7, 0, "left behind")).withColumn("__gone", F.lit(False)))
    assert log.expire(keep=2) == 5 and log.versions() == [5, 6]
    assert held(log.read()) == [(0, "0"), (1, "1"), (2, "2"), (3, "3"), (9, "9")] and len(held(log.read(5))) == 4


def test_a_stream_cut_short_goes_on(spark, tmp_path, request):
    spark.conf.set("spark.sql.streaming.minBatchesToRetain", "1")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.streaming.minBatchesToRetain"))
    base = f"file://{tmp_path}"
    spark.range(40).repartition(4, "id").write.parquet(f"{base}/in")
    schema, calls = "id long", []

    def step(df):
        calls.append(df.count())
        if len(calls) == 3:
            raise RuntimeError("stopped between batches")
        return df.select((F.col("id") * 2).alias("twice"))

    with pytest.raises(Exception, match="stopped between batches"):
        resumable.process(spark, f"{base}/in", schema, f"{base}/run", step)
    assert resumable.finished(spark, f"{base}/run").select("batch").distinct().count() == 2
    done = resumable.process(spark, f"{base}/in", schema, f"{base}/run", step)
    assert sorted(r["twice"] for r in done.collect()) == [2 * i for i in range(40)]
    assert len(calls) == 5 and sum(calls) == 40 + calls[2] and calls[2] == calls[3]
    again = resumable.process(spark, f"{base}/in", schema, f"{base}/run", step)
    assert again.count() == 40 and len(calls) == 5
    spark.range(100, 110).write.mode("append").parquet(f"{base}/in")
    assert resumable.process(spark, f"{base}/in", schema, f"{base}/run", step).count() == 50


def test_a_stream_over_nothing(spark, tmp_path):
    spark.range(0).write.parquet(f"file://{tmp_path}/in")
    got = resumable.process(spark, f"file://{tmp_path}/in", "id long", f"file://{tmp_path}/run", lambda df: df)
    assert got is None or got.count() == 0
