"""Calls of external judges as a table function: requests go to a client that the caller gives, answers come back as rows.

No client is part of this engine and no query makes a call. A client is a function of (target, prompt, schema) that returns a text or an object; it runs in the
executors, at most ``most`` calls at a time in a task. A call that fails gives the default answer with the error's name, so that a row is never lost.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import render, scalars

Client = Callable[[str, str, dict | None], object]
#: Labels that an audit's answer must have, with what stands for a blank.
AUDIT = {"final_verdict": "unclear", "pipeline_integrity": "unclear", "test_validity": "unclear", "sample_validity": "unclear", "likely_root_cause": "other", "confidence": "low", "reason": "", "recommended_followup": ""}
VERDICTS = ("PASS", "PARTIAL", "FAIL", "UNCLEAR", "NA")
VERDICT_SCHEMA = {"type": "object", "required": ["verdict", "note"]}
NOTES_SCHEMA = {"type": "object", "required": ["notes"]}


@dataclass(frozen=True)
class StageConfig:
    """Which targets a stage asks; ``override`` gives a changed copy for a run."""

    primary: str
    comparison: tuple[str, ...] = ()
    generator: str = ""
    enabled: bool = False

    def override(self, **changes) -> StageConfig:
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


def run_jobs(jobs: list[tuple[str, Callable[[], object]]], most: int = 8) -> dict[str, object]:
    """Results by id, at most ``most`` jobs at a time; the first error is raised when all have ended."""
    with ThreadPoolExecutor(max(1, most)) as pool:
        waiting = [(name, pool.submit(job)) for name, job in jobs]
    return {name: w.result() for name, w in waiting}


def as_object(answer: object, schema: dict | None) -> dict:
    """An answer as an object with the keys that its schema requires; a text may hold the object between its outermost braces."""
    if isinstance(answer, str):
        try:
            answer = json.loads(answer)
        except ValueError:
            a, b = answer.find("{"), answer.rfind("}")
            if a < 0 or b < a:
                raise
            answer = json.loads(answer[a : b + 1])
    if not isinstance(answer, dict):
        raise ValueError("not an object")
    if lacking := [k for k in (schema or {}).get("required", ()) if k not in answer]:
        raise ValueError(f"without {', '.join(lacking)}")
    return answer


def ask(requests: DataFrame, client: Client, schema: dict | None = None, most: int = 8) -> DataFrame:
    """The columns of ``requests`` (request_id, target, prompt, others) with payload (JSON, null if the call failed) and error (empty, or the exception's name and text)."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)

    def one(target: str, prompt: str) -> tuple[str | None, str]:
        try:
            return json.dumps(as_object(client(target, prompt, schema), schema), ensure_ascii=False), ""
        except Exception as e:  # whatever a client raises is an answer's state, not the job's
            return None, f"{type(e).__name__}: {e}"

    def run(batches):
        for batch in batches:
            got = run_jobs([(str(i), lambda t=t, p=p: one(t, p)) for i, (t, p) in enumerate(zip(batch["target"], batch["prompt"], strict=True))], most)
            found = [got[str(i)] for i in range(len(batch))]
            yield batch.assign(payload=pd.Series([f[0] for f in found], index=batch.index, dtype=object), error=pd.Series([f[1] for f in found], index=batch.index, dtype=object))

    return requests.mapInPandas(run, f"{kinds}, payload string, error string")


def texts(requests: DataFrame, client: Client, most: int = 8) -> DataFrame:
    """Plain answers: the columns of ``requests`` with text, finish and error. A client returns a text, or an object with text and finish."""
    wrapped = ask(requests, lambda t, p, s: x if isinstance(x := client(t, p, s), dict) else {"text": x, "finish": ""}, {"required": ["text"]}, most)
    answer = F.from_json("payload", "text string, finish string")
    return wrapped.withColumn("__a", answer).select(*requests.columns, F.col("__a.text").alias("text"), F.coalesce("__a.finish", F.lit("")).alias("finish"), "error")


def embeddings(rows: DataFrame, client: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """The columns of ``rows`` (text, others) with vector, asked in lists of ``batch``; a list whose call fails has empty vectors."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(parts):
        for part in parts:
            out: list[list[float]] = []
            for lo in range(0, len(part), batch):
                some = part["text"].iloc[lo : lo + batch].fillna("").tolist()
                try:
                    got = [list(map(float, v)) for v in client(some)]
                    out += got if len(got) == len(some) else [[]] * len(some)
                except Exception:  # no vector is a state of the row: its similarity is 0
                    out += [[]] * len(some)
            yield part.assign(vector=pd.Series(out, index=part.index, dtype=object))

    return rows.mapInPandas(run, f"{kinds}, vector array<double>")


def verdicts(answers: DataFrame) -> DataFrame:
    """``answers`` of ``ask`` with verdict and note; a failed call, and a verdict outside the ladder, is UNCLEAR."""
    a = F.from_json("payload", "verdict string, note string")
    said = F.upper(F.trim(a["verdict"]))
    return answers.withColumns({"verdict": F.when(said.isin(*VERDICTS), said).otherwise("UNCLEAR"), "note": F.trim(F.coalesce(a["note"], F.col("error"), F.lit("")))})


def normalised_audit(payload: Column) -> Column:
    """A struct of AUDIT from an answer's JSON: blanks, missing keys and what is no object take the defaults."""
    a = F.from_json(payload, ", ".join(f"{k} string" for k in AUDIT))
    filled = [(F.trim(F.coalesce(a[k], F.lit(""))), default, k) for k, default in AUDIT.items()]
    return F.struct(*(F.when(v == "", default).otherwise(v).alias(k) for v, default, k in filled))


def audits(answers: DataFrame) -> DataFrame:
    """``answers`` of ``ask`` with the audit's labels; a failed call says so in its reason and asks to be tried again."""
    rows = answers.withColumn("__a", normalised_audit(F.col("payload"))).select(*answers.columns, *(F.col(f"__a.{k}").alias(k) for k in AUDIT))
    lost = F.col("payload").isNull()
    return rows.withColumns({"reason": F.when(lost, F.concat(F.lit("Request failed: "), F.col("error"))).otherwise(F.col("reason")), "recommended_followup": F.when(lost, "Retry with fewer calls at a time, or read the trace.").otherwise(F.col("recommended_followup"))})


def notes(answers: DataFrame) -> DataFrame:
    """(request_id, notes): map of column to note; only columns that were asked for (all, if none is named), no blank notes. ``answers``: request_id, allowed_columns, payload; the last note of a column holds."""
    found = F.coalesce(F.from_json("payload", "notes array<struct<column:string,note:string>>")["notes"], F.array().cast("array<struct<column:string,note:string>>"))
    trimmed = F.transform(found, lambda n: F.struct(F.trim(n["column"]).alias("column"), F.trim(n["note"]).alias("note")))
    allowed = F.coalesce("allowed_columns", F.array().cast("array<string>"))
    good = F.filter(trimmed, lambda n: (n["column"] != "") & (n["note"] != "") & ((F.size(allowed) == 0) | F.array_contains(allowed, n["column"])))
    merged = F.aggregate(good, F.create_map().cast("map<string,string>"), lambda m, n: F.map_concat(F.map_filter(m, lambda k, v: k != n["column"]), F.create_map(n["column"], n["note"])))
    return answers.select("request_id", merged.alias("notes"))


def case_context(failed: DataFrame, tests: DataFrame, generated: DataFrame) -> DataFrame:
    """``failed`` (Index, visibility, case_index, expected, others) with input, output and focus of its case: public and private ones from the sample's ``tests``
    (Index, visibility, case_index, input, output, testtype), generated ones from ``generated`` (Index, case_index, input, output, focus); others keep what was expected."""
    keys = ["Index", "visibility", "case_index"]
    own = tests.where("visibility IN ('public', 'private')").select(*keys, F.col("input").alias("__i"), F.col("output").alias("__o"), F.col("testtype").alias("__f"))
    made = generated.select("Index", F.lit("generated").alias("visibility"), "case_index", F.col("input").alias("__i"), F.col("output").alias("__o"), F.col("focus").alias("__f"))
    rows = failed.join(own.unionByName(made).dropDuplicates(keys), keys, "left")
    known = F.col("visibility").isin("public", "private", "generated")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(*failed.columns, blank("__i").alias("input"), F.when(known, blank("__o")).otherwise(blank("expected")).alias("output"), blank("__f").alias("focus"))


def audit_specs(failed: DataFrame) -> DataFrame:
    """A request for each failed test: id, prompt, and the row that its answer will complete.

    ``failed``: Index, title, attempt, visibility, case_index, input, output, focus, actual, failure_type, exception, message, code.
    """
    c = F.col
    part = lambda title, value: F.concat(F.lit(f"## {title}\n"), F.coalesce(value, F.lit("")))
    prompt = F.concat_ws("\n\n", F.lit("Decide whether the model, the test or the pipeline is at fault for this failed test."), part("Sample", F.concat_ws(" ", c("Index").cast("string"), c("title"))), part("Input", c("input")), part("Expected", c("output")), part("Actual", c("actual")), part("Failure", F.concat_ws(" ", c("failure_type"), c("exception"), c("message"))), part("Code", scalars.head_tail(c("code"))))
    return failed.select(render.request_id(c("Index"), c("attempt"), c("visibility"), c("case_index")).alias("request_id"), prompt.alias("prompt"), "Index", "attempt", "visibility", "case_index", "failure_type")


def test_notes(tests: DataFrame) -> DataFrame:
    """Note requests of a run: request_id, allowed_columns and evidence of every attempt with a test that is not passed, tests in the order of their columns.

    ``tests``: Index, target, attempt, visibility, case_index, status, failure_type, exception, message, expected, actual.
    """
    c = F.col
    rows = tests.withColumns({"column": render.case_label(c("visibility"), c("case_index")), "cell": scalars.test_cell(c("status"), c("failure_type"), c("exception"))}).where("cell <> 'PASS'")
    line = render.test_line(c("column"), c("cell"), c("failure_type"), c("exception"), c("message"), c("expected"), c("actual"))
    one = F.struct(render.case_order(c("column")).alias("at"), "column", line.alias("line"))
    out = rows.groupBy("Index", "target", "attempt").agg(F.array_sort(F.collect_list(one)).alias("x"))  # an attempt's tests, a few dozen
    return out.select("Index", "target", F.format_string("stage2:%d:%s", "Index", "target").alias("request_id"), F.col("x.column").alias("allowed_columns"), F.array_join(F.col("x.line"), "\n").alias("evidence"))
