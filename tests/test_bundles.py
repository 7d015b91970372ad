"""Run artifacts, sinks, judges, rendering and review packets on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from datagauge.functions import render
from datagauge.operators import judge, review, sections
from datagauge.sources import artifacts, bundles, samples


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_stage_bundles(spark, tmp_path):
    sheet = spark.createDataFrame([("1", "PASS"), ("2", "FAIL"), ("1", "PARTIAL"), (None, "x")], "Index string, Check string")
    artifacts.write_workbook(f"{tmp_path}/w.xlsx", {"Detailed": sheet, "Summary": sheet.limit(0)})
    got = bundles.stage1(spark, f"{tmp_path}/w.xlsx")
    assert [tuple(r) for r in got["detailed"].orderBy("Index").collect()] == [(1, "PARTIAL"), (2, "FAIL")] and got["summary"].count() == 0
    (tmp_path / "sample_results.csv").write_text("﻿Index,Suspicious\n1, True \n2,\n1,False\n")
    (tmp_path / "sample_model_results.csv").write_text("Index,TargetName,BestCombinedPassRate\n1,a,0.5\n1,b,0.5\n1,c,oops\n2,d,\n")
    for name in ("model_attempts.jsonl", "per_test_results.jsonl"):
        (tmp_path / name).write_text('{"Index": 1}\n\n{"Index": 2}\n')
    run = bundles.stage2(spark, str(tmp_path))
    assert {r["Index"]: r["TargetName"] for r in run["best"].collect()} == {1: "a", 2: "d"} and run["tests"].count() == 2 and run["manifest"] == {}
    assert [tuple(r) for r in bundles.read_stripped(spark, f"{tmp_path}/sample_results.csv").orderBy("Index").collect()] == [(1, "False"), (2, "")]
    bundles.write_json(f"{tmp_path}/r.json", {"stage3": {"detailed": ["ü"]}})
    assert bundles.stage3(f"{tmp_path}/r.json") == {"detailed": ["ü"]} and "ü" in (tmp_path / "r.json").read_text() and (tmp_path / "r.json").read_text().endswith("}\n")


def test_reviews(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Index,GroundTruthValidity,ErrorType,ReviewConfidence,Severity\n3, trustworthy ,hidden rule,high,major\nx,1,2,3,4\n")
    (tmp_path / "r.json").write_text(json.dumps({"reviews": [{"index": 4, "FinalAction": "fix", "Finding1DefectType": "own", "DefectType": "old"}]}))
    (a,) = bundles.reviews(spark, f"{tmp_path}/r.csv").collect()
    assert (a["Index"], a["BenchmarkTrustCheck"], a["SummaryConfidence"], a["Finding1DefectType"], a["Finding1Severity"], a["Finding1Confidence"], a["FinalAction"]) == (3, "trustworthy", "high", "hidden rule", "major", "high", "")
    (b,) = bundles.reviews(spark, f"{tmp_path}/r.json").collect()
    assert (b["Index"], b["FinalAction"], b["Finding1DefectType"]) == (4, "fix", "own")
    selected = spark.createDataFrame([(3, "baseline"), (5, "backfill")], "Index long, SelectionBucket string")
    rows = {r["Index"]: r for r in review.review_details(selected, bundles.reviews(spark, f"{tmp_path}/r.csv")).collect()}
    assert (rows[3]["ReviewStatus"], rows[3]["BenchmarkTrustCheck"], rows[5]["ReviewStatus"], rows[5]["Finding3Severity"]) == ("completed", "trustworthy", "pending", "")
    packet = review.review_packet(selected, spark.createDataFrame([(3, "p", "s", "i"), (9, "", "", "")], "Index long, Prompt string, StarterCode string, IdealResponse string"))
    assert packet.count() == 1 and len(packet.columns) == 2 + 3 + 8 + 1 + 12 and packet.first()["Prompt"] == "p" and packet.first()["Notes-FinalAction"] == ""
    assert one(spark, review.context_text(F.lit("High"), F.lit(""), F.lit(None).cast("string"), F.lit("r"))) == "Stage 2: High; benchmark_quality=n/a; failure_category=n/a; Stage 3 reason=r"
    know = lambda rows, name: spark.createDataFrame(rows, f"Index long, {name} string")
    got = review.admitted(know([(1, "a"), (2, "b"), (3, "c")], "c"), know([(1, ""), (2, "")], "s"), know([(2, "x"), (3, "y")], "t"), know([], "u"), know([(2, "v")], "w"))
    assert [tuple(r) for r in got.collect()] == [(2, "b", "x", None, "v")]


def test_failed_rows(spark):
    rows = spark.createDataFrame([(1, "m", 2, "model_candidate", "FAIL", "public", 0, "b"), (1, "m", 1, "model_candidate:x", "error", "public", 1, "a"), (1, "m", 1, "model_candidate", " Pass ", "public", 0, ""), (1, "o", 0, "oracle_solution", "fail", "public", 0, "z"), (2, "m", 1, "model_candidate", None, "public", 0, " ")], "Index long, target string, attempt int, source string, status string, visibility string, case_index int, failure_type string")
    assert [(r["Index"], r["attempt"]) for r in review.failed_attempts(rows).collect()] == [(1, 1), (1, 2), (2, 1)]
    # Of equals the first in the table's order, which begins with the source.
    assert [tuple(r) for r in review.dominant_failures(rows).collect()] == [(1, "b", 1)]
    titles = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, "c")], "Index long, t string")
    assert [tuple(r) for r in review.top_titles(titles, "t", 2).collect()] == [("b", 2), ("a", 2)]
    assert [r["attempt"] for r in review.canonical(rows.where("Index = 1"), "attempts").collect()] == [1, 1, 2, 0]


def test_file_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä", [1, 2])], "Index long, t string, l array<int>")
    assert bundles.write_csv_file(df, f"{tmp_path}/a.csv", bom=True) and (tmp_path / "a.csv").read_bytes().startswith(b"\xef\xbb\xbfIndex,t,l")
    assert not bundles.write_csv_file(df.limit(0), f"{tmp_path}/b.csv", bom=True) and not (tmp_path / "b.csv").exists()
    assert bundles.write_csv_file(df.limit(0), f"{tmp_path}/c.csv") and (tmp_path / "c.csv").read_text() == ""
    assert bundles.whitelisted(df, ["t", "missing", "Index"]).collect()[0].asDict() == {"t": "ä", "missing": "", "Index": 1}
    with pytest.raises(ValueError):
        bundles.collected(spark.range(3), most=2)
    for stamp in ("1", "2"):
        bundles.write_report(f"{tmp_path}/report", {"stage1": {"detailed": df, "run_manifest": {"a": 1}}}, stamp)
    names = sorted(p.name for p in (tmp_path / "report").iterdir())
    assert names == ["combined_analysis.json", "combined_analysis.xlsx", "combined_analysis_2.json", "combined_analysis_2.xlsx"]
    assert json.loads((tmp_path / "report/combined_analysis.json").read_text()) == {"timestamp": "2", "stage1": {"detailed": [{"Index": 1, "t": "ä", "l": [1, 2]}], "run_manifest": {"a": 1}}}
    rate = spark.createDataFrame([(0.5, "Usable")], "Rate double, Prompt string")
    artifacts.write_workbook(f"{tmp_path}/p.xlsx", {"S": rate}, percent=("Rate",))
    assert artifacts.read_workbook(f"{tmp_path}/p.xlsx", "S") == [{"Rate": "0.5", "Prompt": "Usable"}]
    bundles.write_html(f"{tmp_path}/x.html", df, "T & U", ["Index", "t"])
    assert "<h1>T &amp; U</h1>" in (tmp_path / "x.html").read_text() and "<p>ä</p>" in (tmp_path / "x.html").read_text()
    bundles.snapshot(f"{tmp_path}/snap", df, spark.createDataFrame([("n", "1 of 2")], "name string, evidence string"), {"k": 1}, ["Index", "t"])
    assert (tmp_path / "snap/summary.md").read_text() == "# Snapshot\n\n- n: 1 of 2\n" and (tmp_path / "snap/rows.csv").read_text() == "Index,t\n1,ä\n"
    (tmp_path / "src/d").mkdir(parents=True)
    (tmp_path / "src/d/f.txt").write_text("x")
    (tmp_path / "src/m.py").write_text('prompt = f"""\n  Judge {x}.\n"""\nother = """no"""')
    assert bundles.bundle(f"{tmp_path}/tree", {"stage1": (f"{tmp_path}/src", ["d", "none.txt", "m.py"])}) == {"stage1": ["d", "m.py"]} and (tmp_path / "tree/stage1/d/f.txt").exists()
    (p,) = bundles.extract_prompts(spark, f"{tmp_path}/src").collect()
    assert p["prompt"] == "Judge {x}." and p["source"].endswith("m.py")


def test_narratives(spark):
    queues = spark.createDataFrame([("defect", i, 10 + i, "why", "high", "usable") for i in range(1, 8)], "queue string, position int, doc_id long, reason string, priority string, utility string")
    rules = spark.createDataFrame([("s", 5, 0.1, 0.2, 0.3)], "signal string, n long, delta double, lift double, strength double")
    text = bundles.narrative(7, ["r1", "r2"], "s", [], queues, rules)
    assert "- Biggest structural risks: r1; r2" in text and text.count("- Index ") == 5 and "pass_delta=0.1" in text and "None recorded." in text
    assert "No relationship rows" in bundles.narrative(0, [], "", [], queues.limit(0), rules.limit(0))
    comparisons = spark.createDataFrame([(1, "a", True, "n"), (2, "tie", False, "")], "Index long, winner string, suspicious boolean, note string")
    models = spark.createDataFrame([("a", 0.5, 0.0), ("a", 1.0, 1.0)], "target string, rate double, pass_at_1 double")
    text = bundles.run_narrative(comparisons, models, 3, 9)
    assert "- a: avg best combined pass rate 0.750, avg CombinedPass@1 0.500" in text and "- sample 1: n" in text and "- tie: 1" in text
    rows = spark.createDataFrame([(2, "easy", "f|g", "PASS", "x\n" + "y" * 300), (1, None, None, None, None)], "Index long, difficulty string, function_name string, verdict string, note string")
    lines = bundles.column_report(rows, "c").splitlines()
    assert lines[6] == "| 1 |  |  |  |  |" and lines[7].startswith("| 2 | easy | f/g | PASS | x yyy") and lines[7].endswith("... |")


def test_manifests_and_checkpoints(spark, tmp_path):
    manifests = spark.createDataFrame([("b", [3, 1], ["q3"]), ("a", [1, 2], ["q1", "q2"]), ("c", None, None)], "output_dir string, sample_indices array<int>, question_ids array<string>")
    r = bundles.manifest_union(manifests).first()
    assert (r["batch_count"], r["batch_output_dirs"], r["sample_indices"], sorted(r["question_ids"])) == (3, ["a", "b", "c"], [1, 2, 3], ["q1", "q2", "q3"])
    rows = spark.createDataFrame([(i,) for i in range(5)], "Index int")
    assert bundles.recompute(manifests, rows, lambda df: df.agg(F.count("*").alias("n"))).first()["n"] == 3
    todo = spark.createDataFrame([(f"r{i}",) for i in range(5)], "request_id string")
    step = lambda df: df.withColumn("v", F.lit(1))
    assert artifacts.run_checkpointed(todo, f"{tmp_path}/done", step, size=2, most=1) == 1 and artifacts.run_checkpointed(todo, f"{tmp_path}/done", step, size=2) == 2
    assert sorted(r["request_id"] for r in spark.read.json(f"{tmp_path}/done").collect()) == [f"r{i}" for i in range(5)]
    a, b = (spark.createDataFrame([(1, x)], "k int, v string") for x in "ab")
    artifacts.upsert_locked(a, f"{tmp_path}/t", ["k"])
    artifacts.upsert_locked(b, f"{tmp_path}/t", ["k"])
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/t").collect()] == [(1, "b")]
    (tmp_path / "t.lock").write_text("")
    with pytest.raises(Exception, match="(?i)exist"):
        artifacts.upsert_locked(a, f"{tmp_path}/t", ["k"])
    cache = spark.createDataFrame([("1", "f1", "n1"), ("0", "f2", "old")], "version string, fingerprint string, note string")
    asked = []

    def fetch(missing):
        asked.append(missing.count())
        return missing.select(F.lit("1").alias("version"), "fingerprint", F.lit("new").alias("note"))

    rows = spark.createDataFrame([(1, "f1"), (2, "f2"), (3, "f2")], "id int, fingerprint string")
    got, known = artifacts.attach_cached(rows, artifacts.current(cache, "1"), fetch)
    assert {r["id"]: r["note"] for r in got.collect()} == {1: "n1", 2: "new", 3: "new"} and asked == [1] and known.count() == 2


def test_sample_selection(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"question_title": f"t{i}", "metadata": "{}", "public_test_cases": "[]", "private_test_cases": "[]"}) for i in range(5)))
    (tmp_path / "i.txt").write_text("4\n0\n4\n")
    path = str(tmp_path / "a.jsonl")
    indices = samples.parse_indices(str(tmp_path / "i.txt"))
    assert [(r["position"], r["title"]) for r in samples.read_samples(spark, path, indices=indices, limit=1).orderBy("position").collect()] == [(0, "t4"), (1, "t0"), (2, "t4")]
    assert [r["title"] for r in samples.read_samples(spark, path, offset=1, limit=2).orderBy("Index").collect()] == ["t1", "t2"]
    with pytest.raises(IndexError):
        samples.read_samples(spark, path, indices=[1, 9])
    with pytest.raises(ValueError):
        samples.parse_indices("1, x")


def client(target, prompt, schema):
    if prompt == "boom":
        raise RuntimeError("no")
    return prompt


def test_judges(spark):
    requests = [("a", "t", '{"verdict": " pass", "note": "n"}', []), ("b", "t", 'say {"verdict": "maybe", "note": ""}', []), ("c", "t", "boom", []), ("d", "t", '{"verdict": "FAIL"}', []), ("e", "t", "[1]", [])]
    rows = spark.createDataFrame(requests, "request_id string, target string, prompt string, allowed_columns array<string>")
    said = {r["request_id"]: (r["verdict"], r["note"]) for r in judge.verdicts(judge.ask(rows, client, judge.VERDICT_SCHEMA, 2)).collect()}
    assert said["a"] == ("PASS", "n") and said["b"] == ("UNCLEAR", "") and said["c"] == ("UNCLEAR", "RuntimeError: no") and said["d"][0] == said["e"][0] == "UNCLEAR"
    audits = {r["request_id"]: r for r in judge.audits(judge.ask(rows, client)).collect()}
    assert (audits["a"]["final_verdict"], audits["a"]["likely_root_cause"], audits["a"]["confidence"], audits["a"]["reason"]) == ("unclear", "other", "low", "")
    assert audits["c"]["reason"] == "Request failed: RuntimeError: no" and audits["c"]["recommended_followup"].startswith("Retry")
    note = json.dumps({"notes": [{"column": "x", "note": " 1 "}, {"column": "y", "note": "2"}, {"column": "x", "note": "3"}, {"column": "z", "note": ""}]})
    asked = spark.createDataFrame([("a", "t", note, ["x"]), ("b", "t", note, []), ("c", "t", "boom", ["x"])], "request_id string, target string, prompt string, allowed_columns array<string>")
    assert {r["request_id"]: r["notes"] for r in judge.notes(judge.ask(asked, client, judge.NOTES_SCHEMA)).collect()} == {"a": {"x": "3"}, "b": {"x": "3", "y": "2"}, "c": {}}
    plain = {r["request_id"]: (r["text"], r["error"] == "") for r in judge.texts(rows.where("request_id in ('c', 'e')"), client).collect()}
    assert plain == {"c": (None, False), "e": ("[1]", True)}
    vectors = spark.createDataFrame([("ab",), (None,)], "text string")
    assert sorted(r["vector"] for r in judge.embeddings(vectors, lambda ts: [[len(t), 1] for t in ts]).collect()) == [[0.0, 1.0], [2.0, 1.0]]
    assert [r["vector"] for r in judge.embeddings(vectors, lambda ts: 1 / 0).collect()] == [[], []]
    assert judge.run_jobs([("a", lambda: 1), ("b", lambda: 2)], 1) == {"a": 1, "b": 2}
    config = judge.StageConfig("local", enabled=True)
    assert config.override(primary="x", comparison=None).primary == "x" and config.primary == "local"


def test_case_context_and_requests(spark):
    tests = spark.createDataFrame([(1, "public", 0, "i", "o", "functional")], "Index long, visibility string, case_index int, input string, output string, testtype string")
    made = spark.createDataFrame([(1, 3, "gi", "go", "edge")], "Index long, case_index int, input string, output string, focus string")
    failed = spark.createDataFrame([(1, "public", 0, "e"), (1, "generated", 3, "e"), (1, "private", 0, "e"), (1, "odd", 0, '{"a":1}')], "Index long, visibility string, case_index int, expected string")
    got = {r["visibility"]: (r["input"], r["output"], r["focus"]) for r in judge.case_context(failed, tests, made).collect()}
    assert got == {"public": ("i", "o", "functional"), "generated": ("gi", "go", "edge"), "private": ("", "", ""), "odd": ("", '{"a":1}', "")}
    rows = spark.createDataFrame([(7, "T", 2, "", 4, "i", "o", "f", "a", "x", "E", "m", "c")], "Index long, title string, attempt int, visibility string, case_index int, input string, output string, focus string, actual string, failure_type string, exception string, message string, code string")
    spec = judge.audit_specs(rows).first()
    assert spec["request_id"] == "sample7_attempt2_unknown_4" and "## Expected\no" in spec["prompt"] and spec["Index"] == 7
    results = [(1, "m", 1, "private", 0, "fail", "", "", "", '{"a":1}', "2"), (1, "m", 1, "public", 11, "error", "", "KeyError", "long " * 50, "", ""), (1, "m", 1, "public", 0, "pass", "", "", "", "", "")]
    note = judge.test_notes(spark.createDataFrame(results, "Index long, target string, attempt int, visibility string, case_index int, status string, failure_type string, exception string, message string, expected string, actual string")).first()
    assert note["allowed_columns"] == ["Public_12", "Private_01"] and note["request_id"] == "stage2:1:m"
    first, second = note["evidence"].split("\n")
    assert first.startswith("- Public_12: result=ERROR:KeyError; exception_type=KeyError; exception_message=long") and first.endswith("...") and second == '- Private_01: result=FAIL:incorrect_output; expected={"a": 1}; actual=2'


def test_rendering(spark):
    assert render.markdown("# A\n\n1. x\n2. `y`\ntext *e*\nmore **b**\n\n---\n```py\na < b\n```\nend $k$") == '<h2>A</h2><ol><li>x</li><li><code>y</code></li></ol><p>text <em>e</em> more <strong>b</strong></p><hr><div class="code-block"><div class="code-label">py</div><pre><code>a &lt; b</code></pre></div><p>end <span class="math inline">k</span></p>'
    assert render.markdown(None) == '<p class="muted">Empty</p>' and render.markdown("```\nopen") == '<div class="code-block"><pre><code>open</code></pre></div>'
    assert render.json_html({"my_key": [True, None, 1.5, "x"], "e": {}}) == '<section class="kv-card depth-0"><h3>My Key</h3><div class="list-wrap"><section class="list-item depth-1"><div class="list-index">Item 0</div><p><span class="pill true">true</span></p></section><section class="list-item depth-1"><div class="list-index">Item 1</div><p class="muted">null</p></section><section class="list-item depth-1"><div class="list-index">Item 2</div><p>1.5</p></section><section class="list-item depth-1"><div class="list-index">Item 3</div><p>x</p></section></div></section><section class="kv-card depth-0"><h3>E</h3><p class="muted">Empty object</p></section>'
    assert render.json_html('{"a": 1}') == '<section class="kv-card depth-0"><h3>A</h3><p>1</p></section>' and render.json_html([]) == '<p class="muted">Empty list</p>'
    assert [r["h"] for r in spark.createDataFrame([("x",), (None,)], "t string").select(render.markdown_html("t").alias("h")).collect()] == ["<p>x</p>", '<p class="muted">Empty</p>']
    summary = F.struct(F.lit(3).alias("count"), F.lit(1.5).alias("mean"), F.lit(2).alias("median"), F.lit(None).cast("int").alias("q1"), F.lit(3).alias("q3"))
    assert one(spark, render.distribution_text(summary)) == "count=3, mean=1.5, median=2, q1=None, q3=3"
    assert one(spark, render.compact_json(F.lit('{"b":1, "a": {"d": "ü", "c": [2,  1]}}'))) == '{"a": {"c": [2, 1], "d": "ü"}, "b": 1}'
    assert one(spark, render.compact_json(F.lit("{not  json"))) == "{not json"
    assert [one(spark, render.compact_json(F.lit(x))) for x in ("{}", None, '"a"', "1" * 200)] == ["", "", '"a"', "1" * 157 + "..."]
    assert [one(spark, render.case_label(F.lit(v), F.lit(i))) for v, i in (("public", 0), ("generated", 101), ("", 8))] == ["Public_01", "Generated_102", "Test_09"]
    assert [tuple(one(spark, render.case_order(F.lit(x)))) for x in ("Public_02", "Private_01", "Odd_x")] == [(0, 2), (1, 1), (9, 999)]
    prompt = one(spark, render.solver_prompt(F.lit(" P "), F.lit("```python\ndef f(): pass\n```")))
    assert prompt.startswith("Solve the following") and prompt.endswith("Problem Statement:\nP\n\nStarter Code:\n```python\ndef f(): pass\n```\n")
    assert one(spark, render.solver_prompt(F.lit("P"), F.lit(None).cast("string"))).endswith("Problem Statement:\nP\n")


def test_parts_of_a_sample():
    assert len(sections.checks_of("prompt")) == 28 and len(sections.checks_of("ideal")) + len(sections.checks_of("tests")) == 48
