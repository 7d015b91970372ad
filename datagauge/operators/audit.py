"""Sample signals, audit ladders, queues, review selection and decisions.

Adapter: a document is a sample. Its quality gives the static score (1: 0.9, 0: 0.3, unlabelled: 0.7), its length a pass rate (n_chars mod 101 in
hundredths), copies of its text its redundancy; what the tables lack (attempts, models, oracle runs, kinds of failures) is derived from the id by ``ADAPTER``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import checks, ladders, patterns
from ..sources.tables import spread, table
from . import profile

QUEUE = 15
#: ANSI SQL: the inputs of the ladders that the shared tables don't hold.
ADAPTER = {
    "score": "CASE quality WHEN 1 THEN 0.9 WHEN 0 THEN 0.3 ELSE 0.7 END",
    "rate": "(n_chars % 101) / 100.0",
    "generation": "CASE WHEN coalesce(text, '') = '' OR doc_id % 37 = 5 THEN 'no_code' ELSE 'ok' END",
    "probe": "CASE WHEN doc_id % 31 = 7 THEN 'error' ELSE 'ok' END",
    "n_public": "5",
    "n_private": "CASE WHEN doc_id % 6 = 0 THEN 0 ELSE 10 END",
    "n_generated": "CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 0 END",
    "public": "CASE WHEN doc_id % 13 = 4 THEN 1.0 WHEN doc_id % 10 = 0 THEN 0.9 ELSE (n_chars % 101) / 100.0 END",
    "private": "CASE WHEN doc_id % 13 = 4 THEN 0.0 WHEN doc_id % 17 = 3 THEN 0.1 ELSE (n_chars % 101) / 100.0 END",
    "generated": "CASE WHEN doc_id % 10 = 0 THEN 0.3 ELSE (n_chars % 101) / 100.0 END",
    "oracle": "CASE WHEN doc_id % 23 = 2 THEN 0.9 WHEN doc_id % 3 = 0 THEN NULL ELSE 1.0 END",
    "dominant": "CASE WHEN doc_id % 7 = 1 THEN 'format_mismatch' ELSE 'incorrect_output' END",
    "n_attempts": "1 + doc_id % 4",
    "ok_rate": "CASE WHEN doc_id % 29 = 3 THEN 0.5 ELSE 1.0 END",
    "spread": "(doc_id % 11) / 25.0",
    "deviation": "(doc_id % 11) / 100.0",
    "n_models": "doc_id % 3",
    "gap": "(doc_id % 19) / 40.0",
    "n_efficacy": "CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END",
    "n_signal": "CASE WHEN doc_id % 8 = 0 THEN 2 ELSE 1 END",
    "n_suspicion": "CASE WHEN doc_id % 41 = 0 THEN 2 ELSE 1 END",
    "redundancy": "CASE WHEN copies > 1 THEN 1.0 WHEN doc_id % 27 = 1 THEN 0.75 WHEN doc_id % 43 = 1 THEN 0.6 ELSE 0.0 END",
    "note": "CASE WHEN doc_id % 4 = 0 THEN 'tie' ELSE '' END",
}
_FLOATS = ("score", "rate", "public", "private", "generated", "oracle", "ok_rate", "spread", "deviation", "gap", "redundancy")
#: The usability of prompt, ideal response and tests.
_USABLE = ("CASE quality WHEN 0 THEN 'Unusable' WHEN 1 THEN 'Usable' ELSE 'Needs Fixing' END", "CASE WHEN doc_id % 4 = 0 THEN 'Unusable' ELSE 'Usable' END", "CASE WHEN doc_id % 9 = 0 THEN 'Needs Fixing' ELSE 'Usable' END")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: the ladders' inputs and their results. Texts are read once for their features and once for their copies' marks."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    features = profile.flagged(profile.features(docs)).select("doc_id", "n_words", "n_lines", F.col("flags").alias("outliers"))
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("t"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = docs.join(docs.groupBy("t").agg(F.count("*").alias("copies")), "t").join(labels, "doc_id", "left")
    given = {k: F.expr(v).cast("double") if k in _FLOATS else F.expr(v) for k, v in ADAPTER.items()}
    rows = rows.select("doc_id", "lang", "source", "n_chars", "quality", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"), *(v.alias(k) for k, v in given.items())).join(features, "doc_id")
    return laddered(rows)


def laddered(rows: DataFrame) -> DataFrame:
    """``rows`` with the result of every ladder: outcome, threshold, variance, disagreement, contradiction, priority, exemplar, utility, regime, reasons.

    Rows that don't state ``n_public`` have as many public tests as ``ADAPTER`` gives.
    """
    c = F.col
    n_public = c("n_public") if "n_public" in rows.columns else F.expr(ADAPTER["n_public"])
    rows = rows.withColumn("o", ladders.efficacy(c("generation"), c("probe"), c("rate"), c("public"), c("private"), c("generated"), n_public, c("n_private"), c("n_generated"), c("oracle"), c("dominant")))
    rows = rows.select("*", *(c(f"o.{n}").alias(n) for n in ("difficulty", "failure_category", "quality_signal", "efficacy", "needs_audit")), (c("o.suspicious") | c("toxic")).alias("suspicious")).drop("o")
    rows = rows.withColumns({
        "oracle": F.coalesce("oracle", F.lit(1.0)),
        "threshold": ladders.threshold(c("rate"), c("efficacy"), c("suspicious")),
        "variance": ladders.variance_label(c("n_attempts"), c("ok_rate"), c("spread"), c("deviation")),
        "disagreement": ladders.disagreement_label(c("n_models"), c("gap"), c("n_efficacy"), c("n_signal"), c("n_suspicion")),
        "contradiction": ladders.contradiction(c("score"), c("suspicious"), c("rate"), c("efficacy")),
        "n_outliers": F.size(F.filter(F.split("outliers", ";"), lambda x: x != "")),
    })
    rows = rows.withColumns({"sensitivity": c("threshold.label"), "defect": ladders.defect(c("suspicious"), c("oracle")), "trivial": ladders.trivial(c("efficacy"), c("rate"))})
    rows = rows.withColumns({
        "priority": ladders.priority(c("defect"), c("contradiction"), c("redundancy"), c("n_outliers"), c("needs_audit"), c("variance"), c("sensitivity"), c("disagreement")),
        "exemplar": ladders.exemplar(c("score"), c("efficacy"), c("suspicious"), c("contradiction"), c("variance"), c("disagreement"), c("sensitivity"), c("redundancy"), c("n_outliers")),
        "regime": ladders.regime(c("suspicious"), c("sensitivity"), c("variance"), c("disagreement"), c("rate")),
        "reasons": ladders.audit_reasons(c("redundancy"), c("variance"), c("disagreement"), c("sensitivity"), c("contradiction"), c("defect"), c("trivial"), c("n_outliers")),
        "defect_reason": ladders.defect_reason(c("oracle"), c("quality_signal"), c("note")),
    })
    return rows.withColumn("utility", ladders.utility(c("defect"), c("trivial"), c("contradiction"), c("exemplar")))


def detailed(rows: DataFrame) -> DataFrame:
    """The report's columns in their order: identity, bands, the 14 checks as FLAG or PASS (a regime and a contradiction by name), priority and reasons."""
    c = F.col
    on = lambda cond: F.when(cond, "FLAG").otherwise("PASS")
    outlier = {"PromptLengthOutlier": "n_words", "StarterCodeOutlier": "n_lines", "IdealResponseOutlier": "n_chars", "TestCountOutlier": "n_tests", "PerformanceOutlier": "rate"}
    return rows.select(
        c("doc_id").alias("Index"), c("difficulty").alias("Difficulty"),
        ladders.banded(c("n_words"), "prompt").alias("PromptLengthBand"), ladders.banded(c("n_lines"), "starter").alias("StarterCodeLengthBand"), ladders.banded(c("n_lines"), "ideal").alias("IdealResponseLengthBand"), ladders.banded(5 + c("n_private") + c("n_generated"), "tests").alias("TestCountBand"),
        *(ladders.flag(c("outliers"), v).alias(k) for k, v in outlier.items()),
        on(c("redundancy") >= ladders.REDUNDANT).alias("RedundancyStatus"), on(c("variance") != "stable").alias("AttemptVarianceCheck"), on(~c("disagreement").isin("aligned", "single_model")).alias("ModelDisagreementCheck"), on(c("sensitivity") != "stable").alias("ThresholdSensitivityCheck"),
        c("regime").alias("DifficultySignalRegime"), F.when(c("contradiction") == "", "none").otherwise(c("contradiction")).alias("ContradictionCheck"),
        on((c("priority") == "critical") & c("defect")).alias("BenchmarkDefectCandidate"), on(c("trivial")).alias("TrivialityCheck"), on(c("exemplar")).alias("ExemplarCheck"),
        c("priority").alias("AuditPriority"), c("reasons").alias("AuditReason"),
    )


#: The columns of ``detailed`` that may carry notes.
NOTED = ("PromptLengthOutlier", "StarterCodeOutlier", "IdealResponseOutlier", "TestCountOutlier", "PerformanceOutlier", "RedundancyStatus", "AttemptVarianceCheck", "ModelDisagreementCheck", "ThresholdSensitivityCheck", "DifficultySignalRegime", "ContradictionCheck", "BenchmarkDefectCandidate", "TrivialityCheck", "ExemplarCheck")


def with_notes(rows: DataFrame, notes: DataFrame | None = None, key: str = "Index") -> DataFrame:
    """Every noted column followed by its ``Notes-`` column (blank without a note); ``notes``: key and notes (map of column to text)."""
    rows = rows.withColumn("__n", F.lit(None).cast("map<string,string>")) if notes is None else rows.join(notes.select(key, F.col("notes").alias("__n")), key, "left")
    columns: list[Column] = []
    for name in (c for c in rows.columns if c != "__n"):
        columns.append(F.col(f"`{name}`"))
        if name in NOTED:
            columns.append(F.coalesce(F.try_element_at("__n", F.lit(name)), F.lit("")).alias(f"Notes-{name}"))
    return rows.select(*columns)


def without_internal(rows: DataFrame) -> DataFrame:
    """Without the columns whose name begins with an underscore."""
    return rows.drop(*(c for c in rows.columns if c.startswith("_")))


def note_lines(rows: DataFrame) -> DataFrame:
    """doc_id, request_id, the columns that call for a note, and a line of evidence for each; samples without any are left out."""
    c, text = F.col, lambda **kw: F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in kw.items()))
    lines = [
        ("PromptLengthOutlier", ladders.flag(c("outliers"), "n_words") == "FLAG", text(prompt_words=c("n_words"))),
        ("StarterCodeOutlier", ladders.flag(c("outliers"), "n_lines") == "FLAG", text(starter_code_lines=c("n_lines"))),
        ("RedundancyStatus", c("redundancy") >= ladders.REDUNDANT, text(similarity=c("redundancy"))),
        ("AttemptVarianceCheck", c("variance") != "stable", text(label=c("variance"), attempt_count=c("n_attempts"), pass_range=c("spread"), pass_std=c("deviation"))),
        ("ModelDisagreementCheck", ~c("disagreement").isin("aligned", "single_model"), text(label=c("disagreement"), model_count=c("n_models"), best_gap=c("gap"))),
        ("ThresholdSensitivityCheck", c("sensitivity") != "stable", text(label=c("sensitivity"), boundary=c("threshold.boundary"), distance=c("threshold.distance"))),
        ("DifficultySignalRegime", c("regime") != "discriminative", text(regime=c("regime"), combined_pass_rate=c("rate"))),
        ("ContradictionCheck", c("contradiction") != "", text(label=c("contradiction"), stage1_score=c("score"))),
        ("BenchmarkDefectCandidate", c("defect"), text(oracle_pass_rate=c("oracle"), benchmark_quality=c("quality_signal"))),
        ("TrivialityCheck", c("trivial"), text(combined_pass_rate=c("rate"), efficacy_label=c("efficacy"))),
        ("ExemplarCheck", c("exemplar"), text(stage1_score=c("score"), efficacy_label=c("efficacy"))),
    ]
    made = F.array_compact(F.array(*(F.when(on, F.struct(F.lit(n).alias("column"), F.concat(F.lit(f"- {n}: "), t).alias("line"))) for n, on, t in lines)))
    out = rows.select("doc_id", F.concat(F.lit("stage3:"), c("doc_id").cast("string")).alias("request_id"), made.alias("x")).where(F.size("x") > 0)
    return out.select("doc_id", "request_id", F.col("x.column").alias("allowed_columns"), F.array_join(F.col("x.line"), "\n").alias("evidence"))


def q_enriched_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels, vectors, benchmark items, pages and conversations of the same id: five left joins; what is missing takes defaults."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("cluster"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.length("text").alias("item_chars"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.length("html").alias("page_chars"))
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("turns"))
    rows = docs
    for side in (table(spark, sf_dir, "labels"), vec, items, pages, turns):
        rows = rows.join(side, "doc_id", "left")
    return rows.select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.coalesce("cluster", F.lit(-1)).alias("cluster"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("item_chars", "page_chars", "turns")))


def q_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).select("doc_id", "contradiction")


def q_audit_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).select("doc_id", "efficacy", "sensitivity", "priority", "utility", "regime")


def q_enriched_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide row of every sample, inputs and results."""
    rows = signals(spark, sf_dir)
    rows = rows.withColumns({"boundary": F.col("threshold.boundary"), "distance": F.col("threshold.distance"), "threshold_reason": F.col("threshold.reason")}).drop("threshold", "quality", "n_chars")
    return rows.select(*(F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))


def q_detailed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_notes(detailed(signals(spark, sf_dir)))


def q_note_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many columns of each sample call for a note, and which comes first."""
    return note_lines(signals(spark, sf_dir)).select("doc_id", "request_id", F.size("allowed_columns").alias("n"), F.col("allowed_columns")[0].alias("first_column"))


def q_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).where("exemplar").select("doc_id", "score", "efficacy")


def decided(usable: Column) -> Column:
    """The decision on a row of ``laddered``. ``usable``: array of the usability of prompt, ideal response and tests."""
    c = F.col
    on = lambda cond: F.when(cond, "FLAG").otherwise("PASS")
    return ladders.decision(usable, c("suspicious"), c("efficacy"), c("quality_signal"), c("contradiction"), on((c("priority") == "critical") & c("defect")), on(c("redundancy") >= ladders.REDUNDANT), on(c("trivial")), on(c("exemplar")), c("priority"))


def q_decision_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).select("doc_id", decided(F.array(*map(F.expr, _USABLE))).alias("d")).select("doc_id", "d.*")


def queues(rows: DataFrame) -> DataFrame:
    """The five top lists from one pass: a row enters each list that it fits under a key of (number, text, id), and the ranked window keeps ``QUEUE`` of a list in every task before it shuffles."""
    c, one, no_text = F.col, F.lit(0.0), F.lit("")
    lists = {
        "defect": (c("defect"), (c("priority") != "critical").cast("double"), c("defect_reason"), c("doc_id"), c("defect_reason")),
        "redundancy": (c("redundancy") >= ladders.REDUNDANT, -c("redundancy"), no_text, c("doc_id"), F.format_string("similarity %.4f", "redundancy")),
        # The reference sorts this list in reverse: weak static scores first, then the largest ids.
        "contradiction": (c("contradiction") != "", (c("contradiction") == "high_static_low_dynamic").cast("double"), no_text, -c("doc_id"), c("contradiction")),
        "trivial": (c("trivial"), one, c("priority"), c("doc_id"), F.lit("near-saturated pass rate with otherwise clean Stage 1 signals")),
        "exemplar": (c("exemplar"), one, c("priority"), c("doc_id"), F.lit("clean, interpretable, non-redundant evaluation candidate")),
    }
    fits = F.array(*(F.when(on, F.struct(F.lit(n).alias("queue"), number.alias("number"), text.alias("text"), at.alias("at"), reason.alias("reason"))) for n, (on, number, text, at, reason) in lists.items()))
    found = rows.select("doc_id", "priority", "utility", F.inline(F.filter(fits, lambda x: x.isNotNull())))
    ranked = found.withColumn("position", F.row_number().over(Window.partitionBy("queue").orderBy("number", "text", "at")))
    return ranked.where(c("position") <= QUEUE).select("queue", "position", "doc_id", "reason", "priority", "utility")


def q_audit_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues(signals(spark, sf_dir))


def escalate(current: Column, requested: Column) -> Column:
    """The requested priority only where it is more urgent; unknown ones change nothing."""
    return F.when(ladders.rank(requested) < ladders.rank(current), requested).otherwise(current)


def override(rows: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """Priorities raised by judges (key, priority), where at most one model was run; a computed exemplar stays as it was."""
    asked = judged.select(key, F.col("priority").alias("__asked"))
    joined = rows.join(asked, key, "left")
    return joined.withColumn("priority", F.when(F.col("n_models") <= 1, escalate(F.col("priority"), F.col("__asked"))).otherwise(F.col("priority"))).drop("__asked")


def q_refine_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: a judge asks for one rank more urgent for documents of src0, for normal else."""
    rows = signals(spark, sf_dir)
    raised = F.element_at(F.array(*map(F.lit, ladders.PRIORITIES)), F.greatest(ladders.rank(F.col("priority")), F.lit(1)).cast("int"))
    judged = rows.select("doc_id", F.when(F.col("source") == "src0", raised).otherwise("normal").alias("priority"))
    return override(rows, judged, "doc_id").select("doc_id", "priority")


def verdicts(docs: DataFrame) -> DataFrame:
    """The checks of a prompt's text; what a judge decides is UNCLEAR, all are for a null text."""
    rows = patterns.matched(docs.select("doc_id", F.col("text").alias("prompt"), F.lit("medium").alias("difficulty")), checks.PROMPT)
    return rows.select("doc_id", *(F.when(F.col("prompt").isNull(), "UNCLEAR").otherwise(F.expr(checks.render(n, "'UNCLEAR'"))).alias(c) for c, n in CHECKS.items()))


#: Column names of the prompt's checks.
CHECKS = {"check_" + n.replace(".", "_"): n for n in checks.PROMPT}


def q_regex_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spread(table(spark, sf_dir, "documents"), "doc_id"))


def q_cache_miss_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text is a benchmark item already (hit) or not (miss), by content hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    known = table(spark, sf_dir, "benchmark").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).distinct().withColumn("hit", F.lit(True))
    return docs.join(known, "h", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("hit"))


def q_last_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type."""
    last = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(last.alias("l")).select("user_id", "event_type", "l.event_id", "l.value")


def q_json_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First characters and sizes of JSON texts."""
    return table(spark, sf_dir, "events").groupBy(F.substring(F.trim("props"), 1, 1).alias("first_char")).agg(F.count("*").alias("n"), F.max(F.length("props")).alias("longest"))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
_GIVEN = ", ".join(f"({v}){'::DOUBLE' if k in _FLOATS else ''} {k}" for k, v in ADAPTER.items())
#: The rows' inputs, from the tables and the adapter.
_GIVEN_ROWS = f"""{profile._F}, {profile._O},
s0 AS (SELECT d.*, quality, coalesce(toxic = 1, false) toxic, count(*) OVER (PARTITION BY coalesce(text, '')) copies, n_words, n_lines, flags outliers FROM documents d
 LEFT JOIN (SELECT doc_id, max(quality) quality, max(toxic) toxic FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id JOIN f ON f.doc_id = d.doc_id JOIN o ON o.doc_id = d.doc_id),
s1 AS (SELECT doc_id, lang, source, quality, toxic, n_words, n_lines, outliers, {_GIVEN} FROM s0)"""
#: The ladders once more over s1, in SQL of their own.
LADDERS = """s2 AS (SELECT *, CASE WHEN generation <> 'ok' THEN 1 WHEN probe <> 'ok' THEN 2 WHEN oracle < 1 THEN 3 WHEN public = 1 AND private = 0 AND n_private > 0 THEN 4
 WHEN n_public > 0 AND n_private > 0 AND abs(public - private) >= 0.5 AND greatest(public, private) >= 0.75 THEN 5 WHEN n_generated > 0 AND public >= 0.9 AND generated <= 0.4 THEN 6 WHEN rate >= 0.95 THEN 7
 WHEN rate >= 0.25 THEN CASE WHEN dominant = 'format_mismatch' THEN CASE WHEN rate > 0.8 THEN 8 ELSE 9 END WHEN rate > 0.8 THEN 10 ELSE 11 END WHEN rate = 0 THEN 12 ELSE 13 END o FROM s1),
s3 AS (SELECT s2.* REPLACE (coalesce(oracle, 1.0) AS oracle),
 CASE WHEN o <= 3 THEN 'unknown' WHEN o = 7 THEN 'trivial' WHEN o = 12 THEN 'extreme' ELSE 'reasonable' END difficulty,
 CASE WHEN o = 1 THEN 'generation_failure' WHEN o = 2 THEN 'execution_failure' WHEN o IN (3, 4, 5) THEN 'benchmark_suspicion' WHEN o = 7 THEN 'clean_pass' WHEN o = 12 THEN 'logical_or_test_failure' ELSE 'logical_or_edge_failure' END failure_category,
 CASE o WHEN 3 THEN 'misaligned_or_broken' WHEN 4 THEN 'hidden_or_underspecified_requirements' WHEN 5 THEN 'public_private_divergence' WHEN 6 THEN 'generated_tests_expose_weakness' WHEN 8 THEN 'ambiguous_or_brittle' WHEN 9 THEN 'ambiguous_or_brittle' ELSE 'clean_evaluation' END quality_signal,
 CASE WHEN o <= 2 THEN 'Inconclusive' WHEN o <= 5 THEN 'Suspicious (Needs Audit)' WHEN o IN (6, 9, 11) THEN 'High Efficacy' WHEN o = 7 THEN 'Low Efficacy' ELSE 'Moderate Efficacy' END efficacy,
 o IN (3, 4, 5, 8, 9) needs_audit, o IN (3, 4, 5, 8, 9) OR toxic suspicious, CASE WHEN outliers = '' THEN 0 ELSE len(string_split(outliers, ';')) END n_outliers,
 abs(rate - 0.25::DOUBLE) d1, abs(rate - 0.8::DOUBLE) d2, abs(rate - 0.95::DOUBLE) d3,
 CASE WHEN n_attempts = 0 THEN 'unknown' WHEN n_attempts = 1 THEN 'stable' WHEN ok_rate < 1 OR spread >= 0.35 OR deviation >= 0.15 THEN 'volatile' WHEN spread >= 0.2 OR deviation >= 0.08 THEN 'moderate' ELSE 'stable' END variance,
 CASE WHEN n_models = 0 THEN 'unknown' WHEN n_models = 1 THEN 'single_model' WHEN gap >= 0.45 OR n_suspicion > 1 OR (n_efficacy > 1 AND gap >= 0.25) THEN 'strong_disagreement' WHEN gap >= 0.25 OR n_efficacy > 1 OR n_signal > 1 THEN 'moderate_disagreement' ELSE 'aligned' END disagreement FROM s2),
s4 AS (SELECT *, CASE WHEN d1 <= least(d2, d3) THEN 'high_efficacy_floor' WHEN d2 <= d3 THEN 'moderate_high_split' ELSE 'saturation_boundary' END boundary, round(least(d1, d2, d3), 4) distance,
 CASE WHEN suspicious OR efficacy = 'Inconclusive' THEN 'caveated' WHEN least(d1, d2, d3) <= 0.025 THEN 'high' WHEN least(d1, d2, d3) <= 0.05 THEN 'moderate' ELSE 'stable' END sensitivity,
 CASE WHEN score >= 0.82 AND (suspicious OR rate <= 0.2 OR efficacy = 'Inconclusive') THEN 'high_static_low_dynamic' WHEN score <= 0.45 AND rate >= 0.9 THEN 'low_static_high_dynamic' ELSE '' END contradiction,
 suspicious OR oracle < 0.9999 defect, efficacy = 'Low Efficacy' OR rate >= 0.95 trivial FROM s3),
s5 AS (SELECT *, CASE WHEN defect OR contradiction = 'high_static_low_dynamic' THEN 'critical' WHEN redundancy >= 0.82 OR n_outliers >= 2 OR contradiction <> '' OR disagreement = 'strong_disagreement' THEN 'high'
 WHEN needs_audit OR redundancy >= 0.72 OR n_outliers > 0 OR variance = 'volatile' OR sensitivity <> 'stable' OR disagreement = 'moderate_disagreement' THEN 'medium' ELSE 'normal' END priority,
 score >= 0.78 AND efficacy IN ('High Efficacy', 'Moderate Efficacy') AND NOT suspicious AND contradiction = '' AND variance = 'stable' AND disagreement IN ('aligned', 'single_model') AND sensitivity = 'stable' AND redundancy < 0.55 AND n_outliers = 0 exemplar,
 CASE WHEN suspicious THEN 'caveated' WHEN sensitivity <> 'stable' THEN 'threshold_fragile' WHEN variance = 'volatile' OR disagreement = 'strong_disagreement' THEN 'unstable' WHEN rate >= 0.95 THEN 'saturated' WHEN rate <= 0.1 THEN 'extreme_or_blocked' ELSE 'discriminative' END regime,
 CASE WHEN oracle < 0.9999 THEN 'oracle or benchmark artifact appears misaligned' ELSE quality_signal END defect_reason,
 CASE WHEN efficacy = 'Inconclusive' THEN 'upstream efficacy is already inconclusive' WHEN suspicious THEN 'suspicious benchmark behavior already dominates interpretation' WHEN sensitivity = 'high' THEN 'pass rate sits very close to ' || boundary WHEN sensitivity = 'moderate' THEN 'pass rate sits near ' || boundary ELSE '' END threshold_reason,
 concat_ws(', ', CASE WHEN redundancy >= 0.55 THEN 'redundancy' END, CASE WHEN variance <> 'stable' THEN 'attempt_variance' END, CASE WHEN disagreement NOT IN ('aligned', 'single_model') THEN 'model_disagreement' END, CASE WHEN sensitivity <> 'stable' THEN 'threshold_sensitivity' END,
 nullif(contradiction, ''), CASE WHEN defect THEN 'benchmark_defect' END, CASE WHEN trivial THEN 'triviality' END, CASE WHEN n_outliers > 0 THEN 'outlier' END) r FROM s4),
s AS (SELECT * EXCLUDE (r), CASE WHEN r = '' THEN 'no elevated audit signal' ELSE r END reasons, CASE WHEN defect THEN 'caveated' WHEN trivial THEN 'saturated' WHEN contradiction <> '' THEN 'contradictory' WHEN exemplar THEN 'strong' ELSE 'usable' END utility FROM s5)"""
_S = f"{_GIVEN_ROWS}, {LADDERS}"
_V = "v AS (SELECT doc_id, " + ", ".join(f"CASE WHEN prompt IS NULL THEN 'UNCLEAR' ELSE {checks.render(n, chr(39) + 'UNCLEAR' + chr(39), duck=True)} END \"{c}\"" for c, n in CHECKS.items()) + " FROM (SELECT doc_id, text prompt, 'medium' difficulty FROM documents))"
_R = "CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"


def _q(name: str, on: str, order: str, reason: str) -> str:
    return f"SELECT '{name}' queue, row_number() OVER (ORDER BY {order}) position, doc_id, {reason} reason, priority, utility FROM s WHERE {on} QUALIFY row_number() OVER (ORDER BY {order}) <= {QUEUE}"


_FLAG = "CASE WHEN {} THEN 'FLAG' ELSE 'PASS' END"
_HELD = "list_contains(string_split(outliers, ';'), '{}')"
_DETAILED = {
    "PromptLengthOutlier": _FLAG.format(_HELD.format("n_words")),
    "StarterCodeOutlier": _FLAG.format(_HELD.format("n_lines")),
    "IdealResponseOutlier": _FLAG.format(_HELD.format("n_chars")),
    "TestCountOutlier": "'PASS'",
    "PerformanceOutlier": "'PASS'",
    "RedundancyStatus": _FLAG.format("redundancy >= 0.55"),
    "AttemptVarianceCheck": _FLAG.format("variance <> 'stable'"),
    "ModelDisagreementCheck": _FLAG.format("disagreement NOT IN ('aligned', 'single_model')"),
    "ThresholdSensitivityCheck": _FLAG.format("sensitivity <> 'stable'"),
    "DifficultySignalRegime": "regime",
    "ContradictionCheck": "CASE WHEN contradiction = '' THEN 'none' ELSE contradiction END",
    "BenchmarkDefectCandidate": _FLAG.format("defect"),
    "TrivialityCheck": _FLAG.format("trivial"),
    "ExemplarCheck": _FLAG.format("exemplar"),
}
_NOTED = "[" + ", ".join(f"CASE WHEN {on} THEN '{n}' END" for n, on in (("PromptLengthOutlier", _HELD.format("n_words")), ("StarterCodeOutlier", _HELD.format("n_lines")), ("RedundancyStatus", "redundancy >= 0.55"), ("AttemptVarianceCheck", "variance <> 'stable'"), ("ModelDisagreementCheck", "disagreement NOT IN ('aligned', 'single_model')"), ("ThresholdSensitivityCheck", "sensitivity <> 'stable'"), ("DifficultySignalRegime", "regime <> 'discriminative'"), ("ContradictionCheck", "contradiction <> ''"), ("BenchmarkDefectCandidate", "defect"), ("TrivialityCheck", "trivial"), ("ExemplarCheck", "exemplar"))) + "]"
#: Which decision a row takes, by its usabilities us.
KIND = "CASE WHEN (priority = 'critical' AND defect) OR suspicious THEN 1 WHEN len(list_filter(us, lambda x: x = 'Unusable')) >= 2 THEN 2 WHEN redundancy >= 0.55 THEN 3 WHEN trivial THEN 4 WHEN exemplar THEN 5 WHEN list_contains(us, 'Needs Fixing') THEN 6 ELSE 7 END"
_DECIDED = f"u AS (SELECT *, [{', '.join(_USABLE)}] us FROM s), c AS (SELECT *, {KIND} k FROM u)"
ORACLE = {
    "enriched_join": """SELECT d.doc_id, lang, coalesce(quality, -1) quality, coalesce(toxic, 0) toxic, coalesce(e.label, -1) "cluster", coalesce(length(b.text), 0) item_chars, coalesce(length(html), 0) page_chars, coalesce(turns, 0) turns FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
 LEFT JOIN embeddings e ON vec_id = d.doc_id LEFT JOIN benchmark b ON item_id = d.doc_id LEFT JOIN pages ON page_id = d.doc_id LEFT JOIN (SELECT conv_id, count(*) turns FROM conversations GROUP BY 1) ON conv_id = d.doc_id""",
    "contradiction": f"WITH {_S} SELECT doc_id, contradiction FROM s",
    "audit_priority": f"WITH {_S} SELECT doc_id, efficacy, sensitivity, priority, utility, regime FROM s",
    "enriched_samples": f"WITH {_S} SELECT doc_id, lang, source, toxic, n_words, n_lines, outliers, " + ", ".join(f"round({k}, 4) {k}" if k in _FLOATS else k for k in ADAPTER) + ", difficulty, failure_category, quality_signal, efficacy, needs_audit, suspicious, variance, disagreement, contradiction, n_outliers, sensitivity, defect, trivial, priority, exemplar, regime, reasons, defect_reason, utility, boundary, distance, threshold_reason FROM s",
    "detailed_rows": f"""WITH {_S} SELECT doc_id "Index", difficulty "Difficulty", CASE WHEN n_words < 150 THEN 'short' WHEN n_words <= 500 THEN 'medium' ELSE 'long' END "PromptLengthBand", CASE WHEN n_lines <= 5 THEN 'minimal' WHEN n_lines <= 20 THEN 'moderate' ELSE 'large' END "StarterCodeLengthBand",
 CASE WHEN n_lines <= 80 THEN 'compact' WHEN n_lines <= 250 THEN 'moderate' ELSE 'large' END "IdealResponseLengthBand", CASE WHEN 5 + n_private + n_generated < 10 THEN 'sparse' WHEN 5 + n_private + n_generated <= 20 THEN 'recommended' ELSE 'heavy' END "TestCountBand", """ + ", ".join(f"{e} \"{n}\", '' \"Notes-{n}\"" for n, e in _DETAILED.items()) + ' , priority "AuditPriority", reasons "AuditReason" FROM s',
    "note_requests": f"WITH {_S}, nl AS (SELECT doc_id, list_filter({_NOTED}, lambda x: x IS NOT NULL) l FROM s) SELECT doc_id, 'stage3:' || doc_id request_id, len(l) n, l[1] first_column FROM nl WHERE len(l) > 0",
    "exemplars": f"WITH {_S} SELECT doc_id, score, efficacy FROM s WHERE exemplar",
    "decision_table": f"""WITH {_S}, {_DECIDED} SELECT doc_id, CASE k WHEN 1 THEN 'FIX_OR_REMOVE' WHEN 2 THEN 'FIX' WHEN 3 THEN 'DEDUPE_OR_DOWNWEIGHT' WHEN 4 THEN 'DEPRIORITIZE' WHEN 6 THEN 'FIX' ELSE 'KEEP' END "action", priority,
 concat_ws(' ', CASE k WHEN 1 THEN 'Stage 2 or Stage 3 flagged the sample as likely benchmark-defective.' WHEN 2 THEN 'Stage 1 marked multiple artifact layers as unusable.' WHEN 3 THEN 'Stage 3 found a material redundancy signal.' WHEN 4 THEN 'Stage 3 marked the sample as trivial or saturated.'
 WHEN 5 THEN 'Stage 3 surfaced the sample as a strong exemplar candidate.' WHEN 6 THEN 'Stage 1 found repairable artifact-quality issues.' ELSE 'No strong structural or behavioral defect signal was raised in Stage 1 to Stage 3.' END,
 CASE WHEN contradiction <> '' THEN 'Stage 3 contradiction signal: ' || contradiction || '.' END, CASE WHEN quality_signal <> 'clean_evaluation' THEN 'Stage 2 benchmark-quality caveat: ' || quality_signal || '.' END, 'Stage 2 efficacy label: ' || efficacy || '.') rationale,
 concat_ws('; ', CASE k WHEN 1 THEN 'sample_results.csv::Suspicious; enriched_samples.csv::BenchmarkDefectCandidate' WHEN 3 THEN 'enriched_samples.csv::RedundancyStatus' WHEN 4 THEN 'enriched_samples.csv::TrivialityCheck' WHEN 5 THEN 'enriched_samples.csv::ExemplarCheck' WHEN 7 THEN 'guideline_audit.xlsx::Summary; sample_results.csv::ModelAEfficacyLabel' ELSE 'guideline_audit.xlsx::Summary' END,
 CASE WHEN contradiction <> '' THEN 'enriched_samples.csv::ContradictionCheck' END, CASE WHEN quality_signal <> 'clean_evaluation' THEN 'sample_results.csv::ModelABenchmarkQualitySignal' END) evidence, CASE k WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 6 THEN 'medium' ELSE 'low' END cost FROM c""",
    "audit_queues": f"WITH {_S} " + " UNION ALL ".join("SELECT * FROM (" + _q(*x) + ")" for x in (("defect", "defect", "priority <> 'critical', defect_reason, doc_id", "defect_reason"), ("redundancy", "redundancy >= 0.55", "redundancy DESC, doc_id", "printf('similarity %.4f', redundancy)"), ("contradiction", "contradiction <> ''", "(contradiction <> 'high_static_low_dynamic') DESC, doc_id DESC", "contradiction"), ("trivial", "trivial", "priority, doc_id", "'near-saturated pass rate with otherwise clean Stage 1 signals'"), ("exemplar", "exemplar", "priority, doc_id", "'clean, interpretable, non-redundant evaluation candidate'"))),
    "refine_priority": f"WITH {_S} SELECT doc_id, CASE WHEN n_models <= 1 AND source = 'src0' THEN (['critical', 'high', 'medium', 'normal'])[greatest({_R}, 1)] ELSE priority END priority FROM s",
    "regex_checks": f"WITH {_V} SELECT * FROM v",
    "cache_miss_split": "SELECT doc_id, sha256(coalesce(text, '')) IN (SELECT sha256(coalesce(text, '')) FROM benchmark) hit FROM documents",
    "last_wins_dedup": "SELECT user_id, event_type, event_id, \"value\" FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "json_shape": "SELECT substring(trim(props), 1, 1) first_char, count(*) n, max(length(props)) longest FROM events GROUP BY 1",
}
