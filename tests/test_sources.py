"""Sources and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from datagauge.operators.checks import verdicts
from datagauge.sources import artifacts, samples


def line(i, **more):
    return json.dumps({"question_title": f"t{i}", "question_content": f"p{i}", "difficulty": "easy", "starter_code": "def f(x): pass", "ideal_response": "def f(x): return x", "metadata": json.dumps({"func_name": "f"}), "public_test_cases": json.dumps([{"input": "1", "output": "2", "testtype": "functional"}] * i), "private_test_cases": "[]"} | more)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("jsonl")
    (at / "a.jsonl").write_text("\n".join([line(0), "", line(1), "   ", line(2)]) + "\n")
    (at / "b.jsonl").write_text(line(3) + "\n\n")
    return str(at)


def test_samples_are_numbered_over_files(spark, folder):
    rows = samples.read_samples(spark, folder).orderBy("Index").collect()
    assert [(r["Index"], r["title"], len(r["public"]), r["function_name"]) for r in rows] == [(i, f"t{i}", i, "f") for i in range(4)]
    assert [r["Index"] for r in samples.read_samples(spark, folder, indices=[3, 1, 1]).orderBy("position").collect()] == [3, 1, 1]
    assert samples.read_samples(spark, folder, limit=2).count() == 2
    tests = samples.test_rows(samples.read_samples(spark, folder))
    assert sorted((r["Index"], r["case_index"]) for r in tests.collect()) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3)]


def test_samples_go_through_the_checks(spark, folder):
    rows = samples.read_samples(spark, folder).withColumns({"run_ok": F.lit(True), "run_passed": F.lit(1), "run_total": F.lit(1), "judgments": F.create_map().cast("map<string,string>")})
    assert {r["2.3_passes_internal_tests"] for r in verdicts(rows).collect()} == {"PASS"}


def test_lines_split_over_blocks_keep_their_order(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join(f"row {i}" for i in range(5000)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert all(r["value"] == f"row {r['Index']}" for r in samples.numbered_lines(spark, str(tmp_path / "x.jsonl")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_malformed_rows(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text(line(0) + "\n{oops\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        samples.read_samples(spark, str(tmp_path)).collect()
    assert [r["title"] for r in samples.read_samples(spark, str(tmp_path), strict=False).orderBy("Index").collect()] == ["t0", None]
    assert samples.parse_indices(" 3, 4\n5 ") == [3, 4, 5] and samples.parse_indices("") is None


def test_cache(spark):
    requests = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "request_id string, prompt string").withColumn("fingerprint", artifacts.fingerprint(F.col("prompt")))
    cache = requests.where("request_id = 'a'").select("request_id", "fingerprint", F.lit("note").alias("note"))
    hits, misses = artifacts.split_cached(requests, cache)
    assert [r["request_id"] for r in hits.collect()] == ["a"] and sorted(r["request_id"] for r in misses.collect()) == ["b", "c"]
    new = spark.createDataFrame([("a", "f", "newer"), (None, "f", "null key")], "request_id string, fingerprint string, note string")
    both = artifacts.upsert(artifacts.upsert(cache, new, ["request_id"]), new, ["request_id"])
    assert sorted((r["request_id"] or "", r["note"]) for r in both.collect()) == [("", "null key"), ("a", "newer")]
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, at int, v string")
    assert sorted(tuple(r) for r in artifacts.last_wins(log, ["id"], "at").select("id", "v").collect()) == [("a", "y"), ("b", "z")]


def test_batches_resume(spark, tmp_path):
    rows, seen = spark.range(25).withColumnRenamed("id", "Index"), []

    def step(df):
        seen.append(1)
        return df.withColumn("twice", F.col("Index") * 2)

    assert artifacts.run_batches(spark, str(tmp_path), rows, "Index", 10, step).count() == 25 and len(seen) == 3
    assert artifacts.run_batches(spark, str(tmp_path), rows, "Index", 10, step).count() == 25 and len(seen) == 3
    assert artifacts.run_batches(spark, str(tmp_path), rows.where("Index < 0"), "Index", 10, step).count() == 0


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    olds = [artifacts.replace_versioned(spark.range(n), path) for n in (1, 2, 3)]
    assert olds[0] is None and spark.read.parquet(path).count() == 3 and spark.read.parquet(olds[2]).count() == 2
    assert len(list(tmp_path.glob("t.old-*"))) == 1


def test_workbook(spark, tmp_path):
    rows = spark.createDataFrame([(1, "PASS <&>", None), (2, "a\x01b", 0.5), (None, None, None)], "Index int, Verdict string, Rate double")
    path = str(tmp_path / "w.xlsx")
    artifacts.write_workbook(path, {"Summary": rows.limit(0), "Detailed": rows})
    assert artifacts.read_workbook(path, "Summary") == []
    want = [{"Index": "1", "Verdict": "PASS <&>", "Rate": None}, {"Index": "2", "Verdict": "ab", "Rate": "0.5"}]
    assert artifacts.read_workbook(path, "Detailed") == want
    assert len(artifacts.read_workbook(path, "Detailed", keep_blank=True)) == 3
