"""Code in responses: extraction, typed equality, the runner and the evaluation of attempts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from datagauge.functions import code
from datagauge.operators import code as runner


@pytest.mark.parametrize("expected, actual, equal", [
    ('"0"', '"0"', True), ('"0"', "0", False), ('"true"', "true", False), ("3", "3.0", True), ("3", "3.01", False), ("2.276367", "2.2763671875", True),
    ('{"x":1.0}', '{"x":1.01}', False), ('{"v":-0.461125,"a":[1.91211,-0.54688]}', '{"v":-0.46112500000000023,"a":[1.912109375,-0.546875]}', True),
    ("true", "1", False), ("[1,2]", "[2,1]", False), ("null", "0", False), ("null", "null", True), ('{"a":1}', '{"b":1}', False),
])
def test_typed_equality(expected, actual, equal):
    assert code.same(json.loads(expected), json.loads(actual)) is equal


def test_typed_equality_in_expressions(spark):
    rng = random.Random(11)

    def value(depth):
        kind = rng.randrange(9 if depth else 7)
        if kind == 7:
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        if kind == 8:
            return {rng.choice(["a", "b", "k#", 'q"1', "\\2"]): value(depth - 1) for _ in range(rng.randrange(3))}
        return [None, True, False, rng.randrange(-2, 3), rng.choice([0.5, 1.0, 1e20, 2.25, 123456.75, -3e-7]), rng.choice(["", "1", '"', "\\", "#", "é\n5", "1.5"]), rng.randrange(10**17, 10**17 + 2)][kind]

    def nudged(x):
        if isinstance(x, list):
            return [nudged(y) for y in x]
        if isinstance(x, dict):
            return {k: nudged(x[k]) for k in reversed(x)}
        return x + rng.choice([0, 1e-6, 1e-3]) if isinstance(x, float) else rng.choice([x, x, x, float(x)]) if type(x) is int else rng.choice([x] * 9 + [0])

    pairs = []
    for i in range(1500):
        x = value(3)
        pairs.append((x, value(2) if i % 3 == 0 else nudged(x)))
    rows = [(i, json.dumps(x, ensure_ascii=bool(i % 2)), json.dumps(y), code.same(x, y)) for i, (x, y) in enumerate(pairs)]
    assert 300 < sum(r[3] for r in rows) < 1300
    rows += [(-1, None, "1", False), (-2, "1", "{", False), (-3, "", "", False), (-4, "[1, 2]", "[1,2]", True), (-5, "1e2", "100", True)]
    got = spark.createDataFrame(rows, "id long, x string, y string, want boolean").withColumn("got", code.typed_equal("x", "y"))
    assert [r for r in got.where("NOT got <=> want").collect()] == []


def test_numbers_and_mismatches():
    assert code.same(10**6 + 0.5, 10**6 + 0.5001) is True and code.same(1.0, 1.00002) is False and code.same(1, True) is False
    assert code.mismatch(1, "1") == code.mismatch(1, 1.0) == "format_mismatch" and code.mismatch(1, 2) == "incorrect_output"
    assert code.loosely_same([1], "[1]") and code.loosely_same("a", "a") and not code.loosely_same(1, "x")


@pytest.mark.parametrize("response, status, want", [
    ("import os\n\ndef f(x):\n    return x", "ok", "import os\n\ndef f(x):\n    return x"),
    ("Sure, here it is:\n\ndef f(x):\n    return x", "ok", "def f(x):\n    return x"),
    ("Look:\n```python\ndef f(): pass\n```\nor ```x```", "ok", "def f(): pass"),
    ("```def g(): pass```", "ok", "def g(): pass"),
    ("def f(x):\n    return x\n\nThis runs in linear time.", "ok", "def f(x):\n    return x"),
    ("X = 1\n\n@dec\ndef f():\n    return X", "ok", "X = 1\n\n@dec\ndef f():\n    return X"),
    ("def broken(:\n    x\n\ndef f():\n    return 1", "ok", "def f():\n    return 1"),
    ("  ", "no_code", ""), (None, "no_code", ""), ("As an AI, ```def f(): pass```", "refusal", ""), ("Sorry, but no.", "refusal", ""), ("I cannot see why def f works", "malformed_response", ""),
    ("only prose here", "malformed_response", ""), ("x = 1\ny = 2", "malformed_response", ""), ("x = a" + ".b" * 100_000 + "\ndef f(): pass", "ok", "def f(): pass"),
])
def test_extraction(response, status, want):
    assert code.extract(response)[:2] == (status, want) and code.extract(response)[2]


def test_suffix_against_all_parts():
    """The shortcut over the parser's errors finds what trying every end finds."""
    rng, pieces = random.Random(6), ["def f(a):", "    return a", "x = (", ")", "class A:", "    y = 1", "some prose, here", "# note", '"""', "import os", "@dec", "async def g():", "    pass", "", "if x:", "else:"]

    def brute(text):
        rows = text.splitlines()
        if not any(x.lstrip().startswith(("def ", "async def ")) for x in rows):
            return ""
        for i, x in enumerate(rows):
            if code.BEGINS.match(x.lstrip()):
                for j in range(len(rows), i, -1):
                    if code._defines(code.parsed(part := "\n".join(rows[i:j]).strip())):
                        return part
        return ""

    for _ in range(1500):
        text = "\n".join(rng.choices(pieces, k=rng.randint(1, 12)))
        assert code.suffix(text) == brute(text), text


def test_facts_of_deep_code(spark):
    deep = "x = a" + ".b" * 100_000
    rows = spark.createDataFrame([(deep,), ("def f(a, b): pass",), (None,)], "t string")
    got = [r["f"] for r in rows.select(code.code_facts("t").alias("f")).collect()]
    assert [g["functions"] for g in got] == [0, 1, 0] and got[1]["arity"] == 2
    assert code.signature(deep) == (0, 0, None, 0, 0, 0, False)


GOOD, LOOP = "def f(x):\n    print('noise')\n    return str(x)", "def f(x):\n    while True: pass"
CASES = [
    (1, GOOD, "f", "0", '"0"'), (2, GOOD, "f", "0", "0"), (3, "def f(x): return {'→': x}", "f", "1.0000000001", '{"→": 1}'), (4, "def f(x): return (", "f", "1", "1"), (5, LOOP, "f", "1", "1"),
    (6, "def f(x): raise KeyError(x)", "f", "1", "1"), (7, GOOD, "g", "1", "1"), (8, GOOD, "f", "{", "1"), (9, "import sys\ndef f(x): sys.exit(0)", "f", "1", "1"), (10, "def f(a, b): return a + b", "f", "1\n\n2", "4"), (11, None, "f", "1", None),
]


def test_runner(spark):
    rows = spark.createDataFrame(CASES, "case_id long, code string, function string, input string, output string")
    with pytest.raises(PermissionError):
        runner.run_tests(rows)
    got = {r["case_id"]: (r["status"], r["failure_type"], r["exception"]) for r in runner.run_tests(rows, timeout=4, enabled=True).collect()}
    assert got == {
        1: ("pass", "", ""), 2: ("fail", "format_mismatch", ""), 3: ("pass", "", ""), 4: ("error", "syntax_error", "SyntaxError"), 5: ("timeout", "timeout", "TimeoutExpired"), 6: ("error", "runtime_error", "KeyError"),
        7: ("error", "runtime_error", "KeyError"), 8: ("error", "invalid_test_case", "JSONDecodeError"), 9: ("error", "runtime_error", "SystemExit"), 10: ("fail", "incorrect_output", ""), 11: ("error", "invalid_test_case", "TypeError"),
    }
    probes = spark.createDataFrame([(1, GOOD, "f"), (2, GOOD, "g"), (3, "def f(", "f"), (4, "while True: pass", "f")], "id long, code string, function string")
    assert {r["id"]: (r["probe"], r["probe_exception"]) for r in runner.probe(probes, timeout=3, enabled=True).collect()} == {1: ("ok", ""), 2: ("error", "KeyError"), 3: ("error", "SyntaxError"), 4: ("timeout", "TimeoutExpired")}
    assert runner.last_json('x\n{"a": 1}\n\n') == {"a": 1} and runner.last_json("{oops") == {} and runner.last_json("[1]") == {} and runner.last_json("") == {}


def test_attempts_and_samples(spark):
    samples = spark.createDataFrame([(1, "def f(x): return x + 1", "f"), (2, "def f(x): return x", " ")], "Index long, ideal string, function_name string")
    tests = spark.createDataFrame([(1, "public", 0, "1", "2"), (1, "private", 0, "5", "6"), (2, "public", 0, "1", "1")], "Index long, visibility string, case_index int, input string, output string")
    oracle = runner.oracle_rows(samples, tests, enabled=True)
    assert [(r["Index"], r["status"], r["target"], r["attempt"]) for r in oracle.collect()] == [(1, "pass", "oracle", 0)] * 2
    payload = json.dumps({"cases": [{"input_lines": ["7"], "focus": " big "}, {"input_lines": ["oops"], "focus": ""}, {"input_lines": ['"a"'], "focus": "type"}, {"input_lines": ["8"], "focus": "late"}]})
    cases = runner.generated_cases(spark.createDataFrame([(1, payload), (2, "no json")], "Index long, payload string"), 2)
    assert [(r["case_index"], r["args"], r["focus"]) for r in cases.orderBy("case_index").collect()] == [(0, ["7"], "big"), (2, ['"a"'], "type")]
    made, trace = runner.label_generated(samples, cases, enabled=True)
    assert [tuple(r) for r in made.collect()] == [(1, "generated", 0, "7", "8", "generated")] and sorted(r["status"] for r in trace.collect()) == ["error", "ok"]
    every = tests.unionByName(made.drop("testtype"))
    responses = [(1, "m1", 1, "```python\ndef f(x): return x + 1\n```", ""), (1, "m1", 2, "def f(x): return 2", ""), (1, "m2", 1, "As an AI", ""), (1, "m2", 2, "def f(x): return 2", "length"), (1, "m3", 1, "def g(x): return 2", None)]
    rates = oracle.groupBy("Index").agg(F.avg((F.col("status") == "pass").cast("double")).alias("oracle"))
    attempts, results = runner.evaluate_attempts(spark.createDataFrame(responses, "Index long, target string, attempt int, response string, incomplete string"), samples, every, rates, enabled=True)
    got = {(r["target"], r["attempt"]): (r["generation"], r["probe"], r["n_tests"], round(r["rate"], 4), r["efficacy"]) for r in attempts.collect()}
    assert got == {
        ("m1", 1): ("ok", "ok", 3, 1.0, "Low Efficacy"), ("m1", 2): ("ok", "ok", 3, 0.3333, "Suspicious (Needs Audit)"), ("m2", 1): ("refusal", "not_run", 0, 0.0, "Inconclusive"),
        ("m2", 2): ("incomplete_generation", "not_run", 0, 0.0, "Inconclusive"), ("m3", 1): ("ok", "error", 0, 0.0, "Inconclusive"),
    }
    assert results.count() == 6
    models = runner.model_results(attempts, [1, 2]).cache()
    assert {r["target"]: (r["attempt"], r["rate"], r["n_attempts"], r["successes"], r["pass_at_1"], r["pass_at_2"]) for r in models.collect()} == {"m1": (1, 1.0, 2, 1, 0.5, 1.0), "m2": (1, 0.0, 2, 0, 0.0, 0.0), "m3": (1, 0.0, 1, 0, 0.0, 0.0)}
    (row,) = runner.comparison_rows(models, [1]).collect()
    assert (row["model_a_target"], row["model_b_target"], row["rate_delta"], row["n_models"], row["suspicious"]) == ("m1", "m2", 1.0, 3, False)
    notes = spark.createDataFrame([(1, "single-model run"), (1, "other"), (9, "single-model run")], "Index long, note string")
    assert sorted(r["note"] for r in runner.relabel_single(notes, models.where("target = 'm1'")).collect()) == ["other", "single-model run", "single-model run; Low Efficacy"]
    dry = spark.createDataFrame([(1, "def f(x): return '[1]'", "f", [("1", "[1]"), ("{", "1")]), (2, "def f(", "f", [("1", "1")]), (3, None, None, None)], "sample_id long, ideal string, function_name string, tests array<struct<input:string,output:string>>")
    assert [tuple(r) for r in runner.dry_run(dry, enabled=True).orderBy("sample_id").collect()] == [(1, True, 1, 2), (2, False, 0, 1), (3, False, 0, 0)]
    assert runner.parse_ks("5, 0,2,,9", 5) == [1, 2, 5] and runner.parse_ks("", 3) == [1]
