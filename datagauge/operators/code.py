"""Code in responses: extraction, syntax facts, typed equality, and the optional runner with its evaluation of attempts and samples."""

from __future__ import annotations

import json
import os
import subprocess
import sys
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code, ladders
from ..sources.tables import table
from . import outcomes


def q_code_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of the code in each assistant message, with facts of what was found."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", code.extract_code("text").alias("x")).select("conv_id", "turn", "x.*")
    return rows.select("conv_id", "turn", "status", F.length("code").alias("n_chars"), code.code_facts("code").alias("f")).select("conv_id", "turn", "status", "n_chars", "f.functions", "f.classes")


def q_typed_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event payloads against themselves, with every number as text, moved by up to 209 ten-millionths, among keys in another order, and with a null behind."""
    rows = table(spark, sf_dir, "events").select("event_id", "props")
    texts = F.regexp_replace("props", r":\s*(-?[0-9.]+)", r': "$1"')
    moved = F.regexp_replace(F.col("props"), F.lit("([0-9]+)"), F.concat(F.lit("$1."), F.lpad((11 * F.pmod("event_id", F.lit(20))).cast("string"), 7, "0")))
    ordered = [F.concat(F.lit(before), "props", F.lit(after)) for before, after in (('{"a": ', ', "b": 1}'), ('{"b":1.0,"a":', "}"))]
    listed = [F.concat(F.lit("["), "props", F.lit(after)) for after in ("]", ",null]")]
    same = {"same": ("props", "props"), "same_as_text": ("props", texts), "same_moved": ("props", moved), "same_ordered": ordered, "same_longer": listed}
    return rows.select("event_id", *(code.typed_equal(*pair).alias(name) for name, pair in same.items()))


#: What runs in a process of its own: imports the candidate and, in test mode, calls its function; the last line it prints is its result.
HARNESS = """
import json, sys
job = json.loads(sys.stdin.read())
space = {"__name__": "candidate"}
try:
    exec(compile(job["code"], "candidate", "exec"), space)
    call = space[job["function"]]
    print(json.dumps({"ok": True, "result": call(*job["args"]) if job["mode"] == "test" else None}))
except BaseException as e:
    print(json.dumps({"ok": False, "exception": type(e).__name__, "message": str(e)}))
"""
RESULT = "status string, expected string, actual string, exception string, message string, failure_type string"


def last_json(text: str) -> dict:
    """The object in the last line that is not blank; empty where there is none."""
    rows = [x for x in text.splitlines() if x.strip()]
    try:
        got = json.loads(rows[-1]) if rows else {}
    except ValueError:
        got = {}
    return got if isinstance(got, dict) else {}


def run_job(mode: str, source: str, function: str, args: list, timeout: float) -> dict:
    """Runs a candidate in a new interpreter and an empty folder; status ok, error or timeout, with result or exception."""
    job = json.dumps({"mode": mode, "code": source, "function": function, "args": args})
    env = {"PATH": os.environ.get("PATH", ""), "PYTHONUTF8": "1", "PYTHONDONTWRITEBYTECODE": "1"}
    with tempfile.TemporaryDirectory() as empty:
        try:
            done = subprocess.run([sys.executable, "-I", "-c", HARNESS], input=job, capture_output=True, text=True, encoding="utf-8", errors="backslashreplace", timeout=timeout, cwd=empty, env=env)
        except subprocess.TimeoutExpired:
            return {"status": "timeout", "exception": "TimeoutExpired"}
    got = last_json(done.stdout)
    if done.returncode or got.get("ok") is not True:
        return {"status": "error", "exception": got.get("exception") or "ExecutionError", "message": got.get("message", "")}
    return {"status": "ok", "result": got.get("result")}


def failure(exception: str) -> str:
    return "syntax_error" if "syntax" in exception.lower() else "runtime_error"


def run_test(source: str, function: str, inputs: str, output: str, timeout: float) -> tuple:
    """A row of RESULT: arguments are one JSON value a line, the expected output is one."""
    try:
        args, expected = [json.loads(x) for x in (inputs or "").splitlines() if x.strip()], json.loads(output)
    except (TypeError, ValueError) as e:
        return "error", output, None, type(e).__name__, str(e), "invalid_test_case"
    got = run_job("test", source, function, args, timeout)
    want = json.dumps(expected, ensure_ascii=False)
    if got["status"] == "timeout":
        return "timeout", want, None, "TimeoutExpired", "", "timeout"
    if got["status"] == "error":
        return "error", want, None, got["exception"], got["message"], failure(got["exception"])
    same = code.same(expected, got["result"])
    return "pass" if same else "fail", want, json.dumps(got["result"], ensure_ascii=False), "", "", "" if same else code.mismatch(expected, got["result"])


def _guard(enabled: bool) -> None:
    if not enabled:
        raise PermissionError("running code of a dataset must be enabled explicitly")


def probe(candidates: DataFrame, timeout: float = 10.0, enabled: bool = False) -> DataFrame:
    """The columns of ``candidates`` (code, function, others) with probe (ok, error, timeout) and probe_exception: whether a candidate imports and holds its function."""
    _guard(enabled)
    schema = candidates.withColumns({"probe": F.lit(""), "probe_exception": F.lit("")}).schema

    def run(batches):
        for batch in batches:
            got = [run_job("probe", c or "", f or "", [], timeout) for c, f in zip(batch["code"], batch["function"], strict=True)]
            yield batch.assign(probe=[g["status"] for g in got], probe_exception=[g.get("exception", "") for g in got])

    return candidates.mapInPandas(run, schema)


def run_tests(cases: DataFrame, timeout: float = 10.0, enabled: bool = False) -> DataFrame:
    """The columns of ``cases`` but the code (code, function, input, output, others), with those of RESULT: each test in a new process on an executor.

    Off unless ``enabled``: the code comes from the data. A process has an empty folder, no environment and ``timeout`` seconds; it is not a sandbox.
    """
    _guard(enabled)
    rest = cases.drop("code")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), RESULT])

    def run(batches):
        for batch in batches:
            got = [run_test(*x, timeout) for x in zip(batch["code"].fillna(""), batch["function"].fillna(""), batch["input"], batch["output"], strict=True)]
            found = pd.DataFrame(got, columns=[x.split()[0] for x in RESULT.split(", ")], index=batch.index)
            yield pd.concat([batch.drop(columns="code"), found], axis=1)

    return cases.mapInPandas(run, schema)


def dry_run(samples: DataFrame, timeout: float = 10.0, enabled: bool = False) -> DataFrame:
    """sample_id, run_ok, run_passed, run_total of each ideal response over all its tests, compared by plain equality (texts that are JSON are read).

    ``samples``: sample_id, ideal, function_name, tests (array of input, output). In a process on an executor, not in the driver.
    """
    _guard(enabled)

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                passed, total, ok = 0, 0, run_job("probe", r.ideal or "", r.function_name or "", [], timeout)["status"] == "ok"
                for t in r.tests if ok and r.tests is not None else []:
                    total += 1
                    try:
                        args, want = [json.loads(x) for x in t["input"].splitlines() if x.strip()], json.loads(t["output"])
                    except (TypeError, ValueError):
                        continue
                    got = run_job("test", r.ideal, r.function_name, args, timeout)
                    passed += got["status"] == "ok" and code.loosely_same(want, got["result"])
                out.append((r.sample_id, ok, passed, total if ok else len(r.tests) if r.tests is not None else 0))
            yield pd.DataFrame(out, columns=["sample_id", "run_ok", "run_passed", "run_total"])

    return samples.select("sample_id", "ideal", "function_name", "tests").mapInPandas(run, "sample_id long, run_ok boolean, run_passed int, run_total int")


def oracle_rows(samples: DataFrame, tests: DataFrame, timeout: float = 10.0, enabled: bool = False) -> DataFrame:
    """The ideal response of each sample (Index, ideal, function_name) over its provided tests (Index, visibility, case_index, input, output); samples without a function have none."""
    named = samples.where(F.trim(F.coalesce("function_name", F.lit(""))) != "").select("Index", F.col("ideal").alias("code"), F.col("function_name").alias("function"))
    rows = run_tests(named.join(tests.select("Index", "visibility", "case_index", "input", "output"), "Index"), timeout, enabled)
    return rows.withColumns({"source": F.lit("oracle_solution"), "target": F.lit("oracle"), "attempt": F.lit(0)})


def generated_case(args: Column, expected: Column) -> list[Column]:
    """Input and output of a generated test: a JSON value a line, and one."""
    return [F.array_join(args, "\n").alias("input"), expected.alias("output")]


def generated_cases(payloads: DataFrame, most: int) -> DataFrame:
    """(Index, case_index, args, focus): the first ``most`` cases of each generator's answer whose every line is JSON.

    ``payloads``: Index, payload (JSON object with cases of input_lines and focus). case_index is the case's place among all.
    """
    cases = F.from_json("payload", "cases array<struct<input_lines:array<string>,focus:string>>")["cases"]
    rows = payloads.select("Index", F.posexplode(cases).alias("case_index", "c"))
    args = F.filter(F.col("c.input_lines"), lambda x: F.trim(x) != "")
    good = F.col("c.input_lines").isNotNull() & F.forall(args, lambda x: F.try_parse_json(x).isNotNull())
    rows = rows.where(good).select("Index", "case_index", args.alias("args"), F.trim(F.coalesce("c.focus", F.lit(""))).alias("focus"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("case_index", "args", "focus"))), 1, most)  # an answer holds a handful
    return rows.groupBy("Index").agg(first.alias("x")).select("Index", F.inline("x"))


def label_generated(samples: DataFrame, cases: DataFrame, timeout: float = 10.0, enabled: bool = False) -> tuple[DataFrame, DataFrame]:
    """(tests, trace): the generated cases on which the ideal response runs, with its results as expected outputs; and a row of the run for every case."""
    rows = samples.select("Index", F.col("ideal").alias("code"), F.col("function_name").alias("function")).join(cases, "Index")
    rows = rows.select("*", *generated_case(F.col("args"), F.lit("null"))).drop("args")
    ran = run_tests(rows, timeout, enabled).withColumn("status", F.when(F.col("status").isin("pass", "fail"), "ok").otherwise(F.col("status")))
    trace = ran.withColumns({"source": F.lit("generated_case_oracle"), "visibility": F.lit("generated"), "attempt": F.lit(0), "expected": F.when(F.col("status") == "ok", F.col("actual")), "failure_type": F.lit("")})
    accepted = trace.where("status = 'ok'").select("Index", F.lit("generated").alias("visibility"), "case_index", "input", F.col("actual").alias("output"), F.lit("generated").alias("testtype"))
    return accepted, trace


def rates(results: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys``: tests, rate, tests and rate by visibility, and the most frequent failure type (of equals the one seen first: public tests before private and generated ones, by their number)."""
    ok = F.col("status") == "pass"
    parts = []
    for v in ("public", "private", "generated"):
        mine = F.col("visibility") == v
        parts += [F.count_if(mine).alias(f"n_{v}"), F.coalesce(F.try_divide(F.count_if(mine & ok), F.count_if(mine)), F.lit(0.0)).alias(f"{v}_rate")]
    provided = F.col("visibility").isin("public", "private")
    base = results.groupBy(*keys).agg(F.count("*").alias("n_tests"), F.coalesce(F.try_divide(F.count_if(ok), F.count("*")), F.lit(0.0)).alias("rate"), F.coalesce(F.try_divide(F.count_if(ok & provided), F.count_if(provided)), F.lit(0.0)).alias("provided_rate"), *parts)
    place = F.struct(F.expr("array_position(array('public', 'private', 'generated'), visibility)"), "case_index")
    kinds = results.where("coalesce(failure_type, '') <> ''").groupBy(*keys, "failure_type").agg(F.count("*").alias("n"), F.min(place).alias("seen"))
    top = kinds.groupBy(*keys).agg(F.min_by("failure_type", F.struct(-F.col("n"), "seen")).alias("dominant"))
    return base.join(top, keys, "left").withColumn("dominant", F.coalesce("dominant", F.lit("")))


def evaluate_attempts(responses: DataFrame, samples: DataFrame, tests: DataFrame, oracle: DataFrame | None = None, timeout: float = 10.0, enabled: bool = False) -> tuple[DataFrame, DataFrame]:
    """(attempts, results): extraction, probe, tests, rates and the classifier's outcome of every response.

    ``responses``: Index, target, attempt, response, incomplete (why the generation is, or empty). ``tests``: Index, visibility, case_index, input, output. ``oracle``: Index, oracle
    (its rate). What is not generated whole is not probed, and what does not import is not run: such attempts have no tests and rate 0.
    """
    keys = ["Index", "target", "attempt"]
    found = responses.select(*keys, "incomplete", code.extract_code("response").alias("x")).select(*keys, "incomplete", "x.*")
    broken = F.coalesce("incomplete", F.lit("")) != ""
    rows = found.select(*keys, F.when(broken, "incomplete_generation").otherwise(F.col("status")).alias("generation"), "code").join(samples.select("Index", F.col("function_name").alias("function")), "Index")
    probed = probe(rows.where("generation = 'ok'"), timeout, enabled)
    rows = rows.where("generation <> 'ok'").withColumns({"probe": F.lit("not_run"), "probe_exception": F.lit("")}).unionByName(probed)
    results = run_tests(rows.where("probe = 'ok'").select(*keys, "code", "function").join(tests.select("Index", "visibility", "case_index", "input", "output"), "Index"), timeout, enabled)
    c = F.col
    summed = rows.drop("code").join(rates(results, keys), keys, "left")
    numbers = [f for f in summed.columns if f.startswith("n_") or f.endswith("rate")]
    summed = summed.select(*(F.coalesce(f, F.lit(0)).alias(f) if f in numbers else F.col(f) for f in summed.columns if f != "dominant"), F.coalesce("dominant", F.lit("")).alias("dominant"))
    summed = summed.join(oracle, "Index", "left") if oracle is not None else summed.withColumn("oracle", F.lit(None).cast("double"))
    outcome = ladders.efficacy(c("generation"), c("probe"), c("rate"), c("public_rate"), c("private_rate"), c("generated_rate"), c("n_public"), c("n_private"), c("n_generated"), c("oracle"), c("dominant"))
    return summed.withColumn("o", outcome).select("*", *(c(f"o.{n}").alias(n) for n in ladders.OUTCOME)).drop("o"), results


def model_results(attempts: DataFrame, ks: list[int]) -> DataFrame:
    """Per sample and target: the best attempt by (rate, provided, generated), the first of equals; mean rate, successes, pass@k."""
    done = (F.col("probe") == "ok") & (F.col("rate") >= 0.9999)
    best = F.max_by(F.struct("attempt", "rate", "provided_rate", "generated_rate", *ladders.OUTCOME), F.struct("rate", "provided_rate", "generated_rate", (-F.col("attempt")).alias("first")))
    rows = attempts.groupBy("Index", "target").agg(best.alias("b"), F.count("*").alias("n_attempts"), F.round(F.avg("rate"), 4).alias("mean_rate"), F.count_if(done).alias("successes"))
    return rows.select("Index", "target", "b.*", "n_attempts", "mean_rate", "successes", *(F.round(outcomes.pass_at_k(F.col("n_attempts"), F.col("successes"), k), 4).alias(f"pass_at_{k}") for k in ks))


def comparison_rows(models: DataFrame, ks: list[int]) -> DataFrame:
    """A row for each sample: its first two models by name side by side, the differences of their rates, whether any is suspicious or needs an audit."""
    kept = ["target", "rate", "provided_rate", "generated_rate", "efficacy", "quality_signal", *(f"pass_at_{k}" for k in ks)]
    rows = models.groupBy("Index").agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("m"), F.max("suspicious").alias("suspicious"), F.max("needs_audit").alias("needs_audit"), F.count("*").alias("n_models"))
    side = {p: F.get("m", F.lit(i)) for i, p in enumerate(("model_a", "model_b"))}
    rows = rows.select("Index", "n_models", "suspicious", "needs_audit", *(m[k].alias(f"{p}_{k}") for p, m in side.items() for k in kept))
    return rows.withColumns({f"{k}_delta": F.round(F.col(f"model_a_{k}") - F.col(f"model_b_{k}"), 4) for k in ("rate", "provided_rate", "generated_rate")})


def relabel_single(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Notes that are exactly ``single-model run`` take the quality signal of a suspicious model, else its label; the last target by name of a sample holds."""
    last = models.groupBy("Index").agg(F.max_by(F.struct("suspicious", "quality_signal", "efficacy"), "target").alias("m"))
    filled = lambda c, other: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", other).otherwise(F.trim(c))
    text = F.when(F.col("m.suspicious"), filled(F.col("m.quality_signal"), "needs audit")).otherwise(filled(F.col("m.efficacy"), "evaluated"))
    joined = rows.join(last, "Index", "left")
    new = (F.trim("note") == "single-model run") & F.col("m").isNotNull()
    return joined.withColumn("note", F.when(new, F.concat(F.lit("single-model run; "), text)).otherwise(F.col("note"))).drop("m")


def parse_ks(raw: str, attempts: int) -> list[int]:
    """The k of pass@k: numbers between commas, each moved into 1 .. ``attempts``, distinct and ascending; 1 if there is none."""
    return sorted({max(1, min(int(x), attempts)) for x in raw.split(",") if x.strip()}) or [1]


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
ORACLE = {
    "typed_equality": r"""SELECT event_id, coalesce(json_valid(props), false) same, coalesce(json_valid(props) AND NOT regexp_matches(props, ':\s*-?[0-9.]'), false) same_as_text,
 coalesce(json_valid(props) AND (NOT regexp_matches(props, '[0-9]') OR 11 * (event_id % 20) <= 100), false) same_moved, coalesce(json_valid(props), false) same_ordered, false same_longer FROM events""",
}
