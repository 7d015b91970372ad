"""The column checks: facts of each sample from its own row, and a verdict of every check.

A sample holds its texts and its tests (nested), so nothing is shuffled. Null texts count as empty, null test lists as empty, checks
that a judge decides are UNCLEAR without a judgment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, code, patterns
from ..sources.tables import spread, table

TESTS = "array<struct<input:string,output:string,testtype:string>>"
SAMPLES = f"sample_id long, prompt string, starter string, ideal string, function_name string, difficulty string, public {TESTS}, private {TESTS}, run_ok boolean, run_passed int, run_total int, judgments map<string,string>"
# Phrases of the checks on rules, edge cases, constraints and imports.
RULES = {
    "rules_must": r"(?i)\b(exactly|can only|must|one at a time|independent|scheduled on any day|tie-break|assume|sequentially checked)\b",
    "rules_plain": r"(?i)\b(exactly|can only|one at a time|independent|assume|scheduled on any day|sequentially checked)\b",
    "rules_tie": r"(?i)\b(exactly|can only|one at a time|independent|assume|scheduled on any day|sequentially checked|tie-break)\b",
}
EDGES = r"(?i)(empty|invalid|error|duplicate|single element|no path|start equals end|unreachable|not found)"
LIMITS = r"(?i)(must|at least|at most|deadline|time window|capacity|security|availability|priority|group|service time)"
IMPORTED = r"\b(List|Dict|Set|Tuple|Any|Optional|Union|defaultdict|heapq|math|cmath|gcd|json)\b"
LITERAL = r"\b(True|False|None)\b|\{\s*'|:\s*'|'[,\]}]"
STUB = r'''^(import |from |def |"{3}|'{3})|^(pass|\.\.\.)$'''


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), lambda x: F.trim(x)), lambda x: x != "")


def _count(items: Column, on) -> Column:
    return F.size(F.filter(items, on))


def _matches(pattern: str):
    return lambda x: x.rlike(pattern)


def _fenced(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s*```[A-Za-z]*\s*\n", ""), r"\n\s*```\s*$", "")


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def facts(samples: DataFrame) -> DataFrame:
    """The columns that the ladders of ``functions.checks`` name, from SAMPLES; other columns are ignored."""
    col = F.col
    text = {c: F.coalesce(col(c), F.lit("")) for c in ("prompt", "starter", "ideal")}
    nested = {c: F.coalesce(col(c), F.array().cast(TESTS)) for c in ("public", "private")}
    rows = samples.select("sample_id", text["prompt"].alias("prompt"), *(_fenced(text[c]).alias(c) for c in ("starter", "ideal")), "function_name", "difficulty", *(v.alias(k) for k, v in nested.items()), F.coalesce("run_ok", F.lit(False)).alias("run_ok"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("run_passed", "run_total")), "judgments")
    blocks = F.filter(_all(col("prompt"), r"(?is)```(?:python)?\s*(.*?)```"), lambda x: x.rlike(r"\bdef\s+\w+\s*\("))
    block = F.coalesce(F.get(blocks, F.lit(0)), F.regexp_extract("prompt", r"(def\s+\w+\s*\([^`]+)", 1))
    shown = [_all(col("prompt"), rf"(?is){w}\s*```(?:python)?\s*(.*?)```") for w in ("Sample Input", "Sample Output")]
    either = _all(col("prompt"), r"(?is)Example.*?```(?:python)?\s*(.*?)```")
    both = (F.size(shown[0]) > 0) & (F.size(shown[1]) > 0)
    pair = [F.when(both, shown[i][0]).when(F.size(either) >= 2, F.get(either, F.lit(i))) for i in (0, 1)]
    rows = rows.withColumns({"tests": F.concat("public", "private"), "p": code.signature_facts(block), "s": code.signature_facts("starter"), "i": code.signature_facts("ideal")})
    tests = col("tests")
    values = F.transform(F.flatten(F.transform(tests, lambda t: F.array(t["input"], t["output"]))), lambda v: F.trim(F.coalesce(v, F.lit(""))))
    braced = F.filter(values, lambda v: v.startswith("{"))
    arity = F.transform(tests, lambda t: F.size(_lines(F.coalesce(t["input"], F.lit("")))))
    rows = rows.withColumns({"values": values, "braced": braced, "arities": arity, "blob": F.lower(F.array_join(F.flatten(F.transform(F.slice("tests", 1, 8), lambda t: F.array(F.coalesce(t["input"], F.lit("")), F.coalesce(t["output"], F.lit(""))))), "\n"))})
    errors = F.array_distinct(F.flatten(F.transform(tests, lambda t: _all(F.coalesce(t["output"], F.lit("")), r'"error"\s*:\s*"([^"]+)"'))))
    keys = F.array_distinct(F.flatten(F.transform(tests, lambda t: F.coalesce(F.json_object_keys(F.trim(t["output"])), F.array().cast("array<string>")))))
    names = F.array(F.trim("function_name"), col("p.name"), col("s.name"), col("i.name"))
    edges, limits = (F.array_distinct(_all(col("prompt"), x)) for x in (EDGES, LIMITS))
    own = F.filter(F.transform(F.split("ideal", r"\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"^[ \-#\t]+|[ \-#\t]+$", "")), lambda x: (F.length(x) < 160) & (x != "") & ~F.contains(F.lower("prompt"), F.lower(x)))
    got = F.flatten(F.transform(_all(col("starter"), r"(?m)^\s*from\s+[\w.]+\s+import\s+(.+)$"), lambda x: F.split(x, ",")))
    got = F.concat(got, F.flatten(F.transform(_all(col("starter"), r"(?m)^\s*import\s+(.+)$"), lambda x: F.transform(F.split(x, ","), lambda y: F.split(F.trim(y), r"\.| as ")[0]))))
    got = F.transform(got, lambda x: F.trim(F.split(F.trim(x), " as ")[0]))
    return rows.select(
        "sample_id", "prompt", "starter", "ideal", "function_name", "difficulty", "run_ok", "run_passed", "run_total", "judgments",
        F.size("public").alias("n_public"), F.size("private").alias("n_private"), F.size("tests").alias("n_tests"),
        F.aggregate("private", F.lit(0), lambda n, t: n + F.coalesce(F.length(t["input"]), F.lit(0)) + F.coalesce(F.length(t["output"]), F.lit(0))).alias("private_chars"),
        _count(tests, lambda t: t["input"].isNotNull() & t["output"].isNotNull() & t["testtype"].isNotNull()).alias("n_fields"),
        _count(tests, lambda t: F.ltrim(t["input"]).startswith("{")).alias("n_in_object"), _count(tests, lambda t: F.ltrim(t["output"]).startswith("{")).alias("n_out_object"),
        F.size("braced").alias("n_braced"), _count(col("braced"), lambda v: F.try_parse_json(v).isNotNull()).alias("n_parsed"), _count(col("values"), lambda v: v.rlike(LITERAL)).alias("n_literals"),
        _count(col("arities"), lambda n: n == col("s.arity")).alias("n_arity"), _count(col("arities"), lambda n: n > col("s.arity")).alias("n_over"),
        F.size(F.array_distinct(F.filter(names, lambda x: F.coalesce(x, F.lit("")) != ""))).alias("n_names"),
        col("p.bad_types").alias("prompt_bad_types"), col("i.functions").alias("ideal_functions"), col("i.kwonly").alias("ideal_kwonly"),
        col("s.functions").alias("starter_functions"), col("s.classes").alias("starter_classes"), col("s.arity").alias("starter_arity"), col("s.defaults").alias("starter_defaults"),
        _count(_lines(col("starter")), lambda x: ~x.rlike(STUB)).alias("starter_extra"),
        F.size(errors).alias("n_errors"), F.size(F.array_except(errors, _all(col("prompt"), r"'error'\s*:\s*'([^']+)'"))).alias("extra_errors"),
        _count(keys, lambda k: ~F.contains(F.lower("prompt"), F.lower(k))).alias("missing_keys"),
        *(_count(own, _matches(p)).alias(k) for k, p in RULES.items()),
        F.size(edges).alias("n_edges"), _count(edges, lambda x: F.contains("blob", F.lower(x))).alias("edges_tested"),
        F.size(limits).alias("n_limits"), _count(limits, lambda x: F.contains("blob", F.lower(x))).alias("limits_tested"),
        F.size(F.array_except(F.array_except(_all(col("starter"), IMPORTED), got), F.array(F.lit("json")))).alias("n_missing_imports"),
        *(_squeezed(x).alias(f"example_{k}") for k, x in zip(("in", "out"), pair, strict=True)),
        *(_squeezed(F.coalesce(F.get("public", F.lit(0))[c], F.lit(""))).alias(f"first_{k}") for k, c in (("in", "input"), ("out", "output"))),
    )


def verdicts(samples: DataFrame) -> DataFrame:
    """sample_id and a column for each of the 76 checks, under its own name (with a dot: quote it)."""
    rows = patterns.matched(facts(samples), checks.CHECKS)
    return rows.select("sample_id", *(F.expr(checks.render(n, f"coalesce(try_element_at(judgments, '{n}'), 'UNCLEAR')")).alias(n) for n in checks.CHECKS))


def long(rows: DataFrame) -> DataFrame:
    """sample_id, check, verdict."""
    return rows.select("sample_id", F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("verdict")) for n in rows.columns if n != "sample_id"))).alias("x")).select("sample_id", "x.*")


_JUDGED = "CASE quality WHEN 1 THEN 'PASS' WHEN 0 THEN 'FAIL' ELSE 'UNCLEAR' END"
_LEVEL = "CASE WHEN n_chars < 2000 THEN 'easy' WHEN n_chars < 8000 THEN 'medium' ELSE 'hard' END"


def _column(name: str) -> str:
    return "check_" + name.replace(".", "_")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: a document's text is prompt and solution, its quality the judgment, its length the difficulty."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    text = F.coalesce("text", F.lit(""))
    return spread(table(spark, sf_dir, "documents"), "doc_id").join(labels, "doc_id", "left").select("doc_id", text.alias("prompt"), text.alias("ideal"), F.expr(_LEVEL).alias("difficulty"), F.expr(_JUDGED).alias("judged"))


def q_prompt_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = patterns.matched(_documents(spark, sf_dir), checks.PROMPT)
    return rows.select("doc_id", *(F.expr(checks.render(n, "judged")).alias(_column(n)) for n in checks.PROMPT))


def q_solution_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = patterns.matched(_documents(spark, sf_dir), checks.SOLUTION)
    return rows.select("doc_id", *(F.expr(checks.render(n, "judged")).alias(_column(n)) for n in checks.SOLUTION))


def q_suite_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: a customer's line items are the tests, those of status F public, their quantity the length of private ones."""
    items = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    hidden = F.col("l_linestatus") == "O"
    rows = items.groupBy("o_custkey").agg(F.count("*").alias("n_tests"), F.count_if(~hidden).alias("n_public"), F.count_if(hidden).alias("n_private"), F.sum(F.when(hidden, 100 * F.col("l_quantity")).otherwise(0.0)).alias("private_chars"))
    return rows.select("o_custkey", *(F.expr(checks.render(n, "'UNCLEAR'")).alias(_column(n)) for n in checks.COUNTS))


def q_all_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks in long form; adapter: an assistant's message is the solution, the user's before it the prompt."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    none = F.array().cast(TESTS)
    rows = turns.where("role = 'assistant'").join(asked, ["conv_id", "turn"], "left")
    samples = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"), "prompt", F.lit("def solve(x):\n    pass").alias("starter"), F.col("text").alias("ideal"), F.lit("solve").alias("function_name"), F.lit("easy").alias("difficulty"), none.alias("public"), none.alias("private"), F.lit(False).alias("run_ok"), F.lit(0).alias("run_passed"), F.lit(0).alias("run_total"), F.create_map().cast("map<string,string>").alias("judgments"))
    return long(verdicts(samples))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
_D = f"d AS (SELECT d.doc_id, coalesce(text, '') prompt, coalesce(text, '') ideal, {_LEVEL} difficulty, {_JUDGED} judged FROM documents d LEFT JOIN (SELECT doc_id, max(quality) quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id)"
ORACLE = {
    name: f"WITH {_D} SELECT doc_id, " + ", ".join(f'{checks.render(n, "judged", duck=True)} "{_column(n)}"' for n in part) + " FROM d"
    for name, part in (("prompt_checks", checks.PROMPT), ("solution_checks", checks.SOLUTION))
} | {
    "suite_checks": "WITH s AS (SELECT o_custkey, count(*) n_tests, count(*) FILTER (l_linestatus <> 'O') n_public, count(*) FILTER (l_linestatus = 'O') n_private, sum(CASE WHEN l_linestatus = 'O' THEN 100 * l_quantity ELSE 0 END) private_chars FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT o_custkey, "
    + ", ".join(f'{checks.render(n, "0", duck=True)} "{_column(n)}"' for n in checks.COUNTS) + " FROM s"
}
