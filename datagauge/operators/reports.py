"""Summaries over the audited samples: scorecard, findings, advice, judges' disagreement, models' means, text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ladders, rules, scalars
from ..sources.tables import spread, table, written
from . import audit, outcomes, sections

#: Labels of the counters that a scorecard shows, in its order.
COUNTERS = {
    "efficacy": ("High Efficacy", "Inconclusive", "Low Efficacy", "Moderate Efficacy", "Suspicious (Needs Audit)"),
    "variance": ("moderate", "stable", "volatile"),
    "disagreement": ("aligned", "moderate_disagreement", "single_model", "strong_disagreement", "unknown"),
    "sensitivity": ("caveated", "high", "moderate", "stable"),
}
FLAGS = ("n_chars", "n_lines", "n_words")
QUALITY = ("ambiguous_or_brittle", "clean_evaluation", "generated_tests_expose_weakness", "hidden_or_underspecified_requirements", "misaligned_or_broken", "public_private_divergence")
#: What a distribution is of.
SIZES = {"words": "n_words", "tests": "5 + n_private + n_generated"}
_ONES = "sum(CASE WHEN {} THEN 1 ELSE 0 END)"
#: Totals over the samples, and what they show; ANSI SQL, also used as such. A sample with a labelled pair has a redundancy above 0.
TOTALS = {
    "n": "count(*)",
    "suspicious_n": _ONES.format("suspicious"),
    "low_n": _ONES.format("efficacy = 'Low Efficacy'"),
    "labels_n": "count(DISTINCT efficacy)",
    "labelled_n": _ONES.format("redundancy > 0"),
    "redundant_n": _ONES.format("redundancy >= 0.55"),
    "contradictory_n": _ONES.format("contradiction <> ''"),
    "strong_static_n": _ONES.format("contradiction = 'high_static_low_dynamic'"),
    "defect_n": _ONES.format("defect"),
    "uneven_n": _ONES.format("variance <> 'stable'"),
    "fragile_n": _ONES.format("sensitivity <> 'stable'"),
    "volatile_n": _ONES.format("variance = 'volatile'"),
    "differing_n": _ONES.format("disagreement NOT IN ('aligned', 'single_model')"),
    "outlier_n": _ONES.format("n_outliers > 0"),
    **{f"{c}_{i}": _ONES.format(f"{c} = '{x}'") for c, of in COUNTERS.items() for i, x in enumerate(of)},
    **{f"flag_{i}": _ONES.format(f"concat(';', outliers, ';') LIKE '%;{x};%'") for i, x in enumerate(FLAGS)},
}


def _counted(prefix: str, labels: tuple[str, ...]) -> str:
    return "coalesce(nullif(concat_ws('; ', " + ", ".join(f"CASE WHEN {prefix}_{i} > 0 THEN '{x}=' || CAST({prefix}_{i} AS STRING) END" for i, x in enumerate(labels)) + "), ''), 'none')"


#: Area, test and wording of a scorecard's rows. Each is ANSI SQL over the totals: result, evidence, interpretation, caveat, recommendation.
_QUEUED = {c: f"least({c}_n, {audit.QUEUE})" for c in ("redundant", "defect", "contradictory")}
SCORECARD = (
    ("dataset_scope", "dataset_size", "CASE WHEN n >= 100 THEN 'PASS' ELSE 'REVIEW' END", "CAST(n AS STRING) || ' samples analyzed.'", "CASE WHEN n >= 100 THEN 'Large enough for dataset-level structure checks.' ELSE 'Small slice; conclusions may be unstable.' END", "''", "''"),
    ("difficulty_regime", "efficacy_distribution", "CASE WHEN labels_n >= 3 THEN 'PASS' ELSE 'REVIEW' END", _counted("efficacy", COUNTERS["efficacy"]), "CASE WHEN labels_n >= 3 THEN 'The dataset spans multiple observed difficulty regimes.' ELSE 'The observed difficulty regime looks narrow or unstable.' END",
     f"CASE WHEN defect_n > 0 THEN CAST({_QUEUED['defect']} AS STRING) || ' benchmark-defect candidates may distort the apparent difficulty mix.' ELSE '' END", "CASE WHEN defect_n > 0 THEN 'Audit suspicious defect candidates before fully trusting the difficulty profile.' ELSE '' END"),
    ("redundancy", "template_overlap_scan", "CASE WHEN redundant_n > 0 THEN 'REVIEW' ELSE 'PASS' END", f"CAST({_QUEUED['redundant']} AS STRING) || ' redundancy candidates; top issue count from summary risk scan.'", "CASE WHEN redundant_n > 0 THEN 'Repeated templates reduce information density.' ELSE 'No strong template recycling surfaced with the current redundancy scan.' END",
     "'Embeddings were unavailable, so the scan relied on lexical and structural signals only.'", "CASE WHEN redundant_n > 0 THEN 'Deduplicate or downweight repeated templates.' ELSE 'Consider stronger redundancy checks only if time allows.' END"),
    ("stability", "attempt_variance_scan", "CASE WHEN uneven_n > 0 THEN 'REVIEW' ELSE 'PASS' END", _counted("variance", COUNTERS["variance"]), "'Large best-vs-worst swings suggest unstable benchmark signal across repeated attempts.'", "'Attempt variance is only visible when multiple attempts were run.'", "'Prioritize unstable samples for Stage 4 and avoid over-trusting best-attempt views.'"),
    ("stability", "model_disagreement_scan", "CASE WHEN differing_n > 0 THEN 'REVIEW' ELSE 'PASS' END", _counted("disagreement", COUNTERS["disagreement"]), "'Cross-model disagreement can reveal ambiguous or misleading benchmark items.'",
     "'In single-model Stage 2 runs, this comes from a lightweight Stage 3 dual-auditor pass rather than a second full benchmark execution.'", "'Audit samples with large model gaps before treating them as clean capability signal.'"),
    ("stability", "threshold_sensitivity_scan", "CASE WHEN fragile_n > 0 THEN 'REVIEW' ELSE 'PASS' END", _counted("sensitivity", COUNTERS["sensitivity"]), "'Near-threshold items can flip interpretation under small heuristic changes.'", "'This tests the fragility of heuristic cutoffs, not benchmark correctness itself.'", "'Send near-threshold items to manual review before treating regime counts as stable.'"),
    ("structural_health", "length_and_test_count_outliers", "CASE WHEN outlier_n > 0 THEN 'REVIEW' ELSE 'PASS' END", _counted("flag", FLAGS), "CASE WHEN outlier_n > 0 THEN 'Outliers may represent broken, atypical, or unusually informative items.' ELSE 'No notable outlier concentration detected.' END", "''", "CASE WHEN outlier_n > 0 THEN 'Inspect the outlier queue during Stage 4.' ELSE '' END"),
    ("cross_stage_caveat", "high_static_low_dynamic_contradictions", "CASE WHEN contradictory_n > 0 THEN 'REVIEW' ELSE 'PASS' END", f"CAST({_QUEUED['contradictory']} AS STRING) || ' contradiction candidates.'", "CASE WHEN contradictory_n > 0 THEN 'Some items may look well-formed but still fail to provide trustworthy evaluation signal.' ELSE 'No major contradiction concentration detected.' END",
     "'This is contextual evidence from earlier stages, not a standalone Stage 3 structural test.'", "CASE WHEN contradictory_n > 0 THEN 'Send contradiction candidates to manual audit first.' ELSE '' END"),
    ("contextual_signal", "strongest_upstream_caveat", "'INFO'", "coalesce(top_text, 'n/a (support=0, support_share=0, reliability=n/a, suspicious_lift=0)')", "'Useful as a caveat when reading dataset-level findings, not as a replacement for Stage 3 structure tests.'", "'Relationship analysis is descriptive and can overemphasize sparse signals.'", "''"),
    ("recommendation", "next_step", "'ACTION'", "statement", "''", "''", "statement"),
    ("distribution_context", "prompt_length_distribution", "'INFO'", "words_text", "'Prompt length spread is descriptive context for coverage and outlier review.'", "''", "''"),
    ("distribution_context", "test_count_distribution", "'INFO'", "tests_text", "'Test-count spread helps explain saturation, brittleness, and audit cost.'", "''", "''"),
)
COLUMNS = ("area", "test", "result", "evidence", "interpretation", "caveat", "recommendation")
#: Name, count shown, when it is stated; the first four of either kind are. Then the statement, ANSI SQL over the totals.
FINDINGS = {
    "risk": (
        ("suspicious", "suspicious_n", "suspicious_n >= 0.08 * n", "suspicious_share || '% of samples are already flagged as suspicious or broken.'"),
        ("redundant", "redundant_n", "labelled_n > 0", "CAST(redundant_n AS STRING) || ' samples appear materially redundant or template-recycled.'"),
        ("strong_static_weak_dynamic", "strong_static_n", "strong_static_n > 0", "CAST(strong_static_n AS STRING) || ' samples look strong statically but fail dynamically.'"),
        ("volatile", "volatile_n", "volatile_n > 0", "CAST(volatile_n AS STRING) || ' samples show volatile repeated-attempt behavior.'"),
        ("disagreement", "differing_n", "differing_n > 0", "CAST(differing_n AS STRING) || ' samples show material cross-model disagreement.'"),
        ("quality_signal", "quality_n", "quality_top <> 'clean_evaluation'", "'Most common non-clean benchmark quality signal: ' || quality_top || ' (' || CAST(quality_n AS STRING) || ' samples).'"),
    ),
    "advice": (
        ("deduplicate", "redundant_n", "labelled_n > 0", "'Deduplicate or downweight near-identical prompt templates before using aggregate scores.'"),
        ("review_strongest_signal", "top_n", "top_signal IS NOT NULL", "'Prioritize manual review for samples failing ' || top_signal || '.'"),
        ("caveat_unstable", "volatile_n", "volatile_n > 0", "'Treat unstable repeated-attempt samples as caveated benchmark signal, not clean difficulty evidence.'"),
        ("triage_by_disagreement", "differing_n", "differing_n > 0", "'Use cross-model disagreement to triage ambiguous benchmark items before trusting aggregate conclusions.'"),
        ("refresh_easiest", "low_n", "low_n >= 0.2 * n", "'Refresh the easiest items: the benchmark shows noticeable saturation.'"),
        ("review_suspicious_first", "suspicious_n", "suspicious_n > 0", "'Stage 4 should start with suspicious benchmark-defect candidates, not random sampling.'"),
    ),
}
#: Findings of a kind that a report states.
STATED = 4
DISAGREEMENT = "CASE WHEN n_differ >= 2 OR priorities > 1 THEN 'strong_disagreement' WHEN n_differ = 1 THEN 'moderate_disagreement' ELSE 'aligned' END"


def _plain(value: Column) -> Column:
    """A number with four decimals at most, without zeros at its end."""
    return F.regexp_replace(F.format_string("%.4f", value.cast("double")), r"(\.\d+?)0+$", "$1")


def totals(rows: DataFrame) -> DataFrame:
    """One row, in one partial aggregate; without rows there is none. The commonest quality signal: of equally common ones the one seen first, by id."""
    quality = F.array_max(F.array(*(F.struct(F.count_if(F.col("quality_signal") == x).alias("n"), (-F.min(F.when(F.col("quality_signal") == x, F.col("doc_id")))).alias("first"), F.lit(x).alias("label")) for x in QUALITY)))
    sizes = [F.struct(F.round(F.avg(F.expr(v)), 4).alias("mean"), F.percentile(F.expr(v), F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q")).alias(k) for k, v in SIZES.items()]
    one = rows.agg(*(F.expr(e).cast("long").alias(n) for n, e in TOTALS.items()), quality.alias("quality"), *sizes).where("n > 0")
    spread_of = lambda k: F.concat(F.lit("count="), F.col("n").cast("string"), *(x for name, v in (("mean", F.col(f"{k}.mean")), ("median", F.col(f"{k}.q")[1]), ("q1", F.col(f"{k}.q")[0]), ("q3", F.col(f"{k}.q")[2])) for x in (F.lit(f", {name}="), _plain(F.round(v, 4)))))
    share = F.format_string("%.1f", 100 * F.col("suspicious_n") / F.col("n"))
    return one.select(*TOTALS, share.alias("suspicious_share"), F.col("quality.label").alias("quality_top"), F.col("quality.n").alias("quality_n"), *(spread_of(k).alias(f"{k}_text") for k in SIZES))


def with_strongest(one: DataFrame, related: DataFrame) -> DataFrame:
    """The row of totals with the strongest relationship between static checks and outcomes (nulls without any)."""
    top = related.orderBy(F.desc("strength"), F.desc("n"), "signal").limit(1)
    said = F.concat("signal", F.lit(" (support="), F.col("n").cast("string"), F.lit(", support_share="), _plain(F.col("share")), F.lit(", reliability="), "reliability", F.lit(", suspicious_lift="), _plain(F.col("lift")), F.lit(")"))
    return one.join(F.broadcast(top.select(F.col("signal").alias("top_signal"), F.col("n").alias("top_n"), said.alias("top_text"))), F.lit(True), "left")


def stated(one: DataFrame, kind: str) -> DataFrame:
    """position, finding, samples, statement of the first four of a kind that hold, with the totals."""
    rows = F.array(*(F.when(F.expr(on), F.struct(F.lit(name).alias("finding"), F.col(shown).alias("samples"), F.expr(text).alias("statement"))) for name, shown, on, text in FINDINGS[kind]))
    return one.select("*", F.posexplode(F.slice(F.array_compact(rows), 1, STATED)).alias("at", "f")).select(*one.columns, (F.col("at") + 1).alias("position"), "f.*")


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Read by the totals and by the relationships.
    rows = written(audit.signals(spark, sf_dir), "signals")
    # One row, read by every part of a report.
    return written(with_strongest(totals(rows), sections.check_relationships(spark, sf_dir, rows)), "summary")


def q_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's rows in its order: what was tested, the result, its evidence and what to make of it; a row for each next step."""
    one = _summary(spark, sf_dir)
    row = lambda i, x: F.struct(F.lit(i).alias("place"), *(F.lit(v).alias(k) if k in COLUMNS[:2] else F.expr(v).alias(k) for k, v in zip(COLUMNS, x, strict=True)))
    fixed = one.select(F.inline(F.array(*(row(i, x) for i, x in enumerate(SCORECARD, 1) if x[1] != "next_step"))))
    steps = stated(one, "advice").select("position", F.inline(F.array(*(row(i, x) for i, x in enumerate(SCORECARD, 1) if x[1] == "next_step"))))
    rows = fixed.withColumn("position", F.lit(1)).unionByName(steps)
    return rows.select("place", "position", *COLUMNS)


def q_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four risks and pieces of advice that hold, in words."""
    one = _summary(spark, sf_dir)
    parts = [stated(one, kind).select(F.lit(kind).alias("kind"), "position", "finding", "samples", "statement") for kind in FINDINGS]
    return parts[0].unionByName(parts[1])


def judges(judgments: DataFrame, key: str) -> DataFrame:
    """Per sample: which of utility, risk and priority its judges differ in, the label, a proxy of the gap, the most urgent priority.

    Blank and null labels are one label; a priority outside the ladder is the least urgent; one judge is aligned with itself.
    """
    clean = {c: F.trim(F.coalesce(c, F.lit(""))) for c in ("utility", "risk", "priority")}
    rows = judgments.select(key, *(e.alias(c) for c, e in clean.items()))
    rank = ladders.rank(F.col("priority"))
    rows = rows.groupBy(key).agg(F.count("*").alias("n_judgments"), F.count_distinct("utility").alias("utilities"), F.count_distinct("risk").alias("risks"), F.count_distinct("priority").alias("priorities"), F.min(rank).alias("rank"))
    rows = rows.withColumn("n_differ", sum((F.col(c) > 1).cast("int") for c in ("utilities", "risks", "priorities")))
    urgent = F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "normal", "normal"))), F.col("rank") + 1)
    return rows.select(key, "n_judgments", F.expr(DISAGREEMENT).alias("label"), F.round(F.col("n_differ") / 3, 4).alias("gap_proxy"), urgent.alias("priority"))


def q_auditor_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: a user is a sample, an event a judgment: its type the utility, its hour's half the risk, its value's band the priority."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("utility"), F.when(F.hour("ts") < 12, "early").otherwise("late").alias("risk"), F.expr("CASE WHEN `value` >= 90 THEN 'critical' WHEN `value` >= 50 THEN 'high' WHEN `value` >= 10 THEN 'medium' ELSE 'normal' END").alias("priority"))
    return judges(rows, "user_id")


def q_model_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model: samples, mean best rate, share of samples solved, and its labels."""
    rows = outcomes.models(spark, sf_dir).groupBy(F.col("o_orderpriority").alias("model"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("rate") + 1e-9, 4).alias("mean_best"), F.round(F.avg((F.col("rate") >= 0.9999).cast("double")) + 1e-9, 4).alias("solved"), F.count_if("suspicious").alias("suspicious"))


def q_comparison_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sets a sample's first two models by name apart; private tests stand for generated ones."""
    one = F.struct(F.col("o_orderpriority").alias("name"), F.col("efficacy").alias("label"), "rate", F.col("private_rate").alias("edge"), "n_tests")
    # A sample has a row for each model, and there are few.
    rows = outcomes.models(spark, sf_dir).groupBy("o_custkey").agg(F.array_sort(F.collect_list(one)).alias("m"))
    a, b = F.col("m")[0], F.get("m", F.lit(1))
    rows = rows.select("o_custkey", a["name"].alias("first"), b["name"].alias("second"), a["label"].alias("first_label"), a["rate"].alias("first_rate"), b["rate"].alias("second_rate"), a["edge"].alias("first_edge"), b["edge"].alias("second_edge"), a["n_tests"].alias("n_edge"))
    return rows.select("o_custkey", "first", "second", F.expr(rules.COMPARISON.replace('"', "`")).alias("note"))


def q_imperfect_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each check that a document does not pass, as (document, check, verdict)."""
    rows = audit.verdicts(spread(table(spark, sf_dir, "documents"), "doc_id"))
    names = list(audit.CHECKS)
    return rows.unpivot(["doc_id"], names, "check", "verdict").where("verdict IN ('FAIL', 'PARTIAL', 'UNCLEAR')").select("doc_id", "check", "verdict")


def q_verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.verdicts(spread(table(spark, sf_dir, "documents"), "doc_id")).unpivot([], list(audit.CHECKS), "check", "verdict").groupBy("check", "verdict").agg(F.count("*").alias("n"))


def q_text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts and shapes of every text; long results as hashes."""
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", scalars.slug(F.col("source")).alias("slug"), F.md5(scalars.excerpt(c, 80)).alias("excerpt"), F.md5(scalars.shortened(c, 120)).alias("shortened"), F.md5(scalars.head_tail(c)).alias("head_tail"), scalars.looks_like_json(c).alias("json"), scalars.ratio_verdict(F.length(F.coalesce(c, F.lit(""))) / 400).alias("verdict"))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
_P = r"regexp_replace(printf('%.4f', ({})::DOUBLE), '(\.\d+?)0+$', '\1')"
_G = (
    sections.RELATED
    + ", g0 AS (SELECT * FROM (SELECT "
    + ", ".join(f"({e})::BIGINT {n}" for n, e in TOTALS.items())
    + ", "
    + ", ".join(f"'count=' || count(*) || ', mean=' || {_P.format(f'round(avg({v}), 4)')} || ', median=' || {_P.format(f'round(quantile_cont({v}, 0.5), 4)')} || ', q1=' || {_P.format(f'round(quantile_cont({v}, 0.25), 4)')} || ', q3=' || {_P.format(f'round(quantile_cont({v}, 0.75), 4)')} {k}_text" for k, v in SIZES.items())
    + " FROM s) WHERE n > 0), g1 AS (SELECT quality_signal quality_top, count(*) quality_n FROM s GROUP BY 1 ORDER BY count(*) DESC, min(doc_id) LIMIT 1), "
    + f"g2 AS (SELECT signal top_signal, n top_n, signal || ' (support=' || n || ', support_share=' || {_P.format('share')} || ', reliability=' || reliability || ', suspicious_lift=' || {_P.format('lift')} || ')' top_text FROM related ORDER BY strength DESC, n DESC, signal LIMIT 1), "
    + "g AS (SELECT *, printf('%.1f', 100 * suspicious_n / n) suspicious_share FROM g0 CROSS JOIN g1 LEFT JOIN g2 ON true), "
    + "w AS (" + " UNION ALL ".join(f"SELECT '{k}' kind, {i} i, '{m}' finding, {s} samples, {t} statement FROM g WHERE {on}" for k, of in FINDINGS.items() for i, (m, s, on, t) in enumerate(of, 1))
    + '), st AS (SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY i) "position", finding, samples, statement FROM w QUALIFY row_number() OVER (PARTITION BY kind ORDER BY i) <= 4) '
)
_X = r"regexp_replace(coalesce(text, ''), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"
_Y = r"trim(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g'), ' ')"
_U = " UNION ALL ".join(f"SELECT doc_id, '{c}' \"check\", {c} verdict FROM v" for c in audit.CHECKS)
_J = """WITH e AS (SELECT user_id, event_type u, hour(ts) < 12 r, CASE WHEN "value" >= 90 THEN 0 WHEN "value" >= 50 THEN 1 WHEN "value" >= 10 THEN 2 ELSE 3 END p FROM events),
c AS (SELECT user_id, count(*) n_judgments, count(DISTINCT p) priorities, (count(DISTINCT u) > 1)::INT + (count(DISTINCT r) > 1)::INT + (count(DISTINCT p) > 1)::INT n_differ, min(p) k FROM e GROUP BY 1)"""
ORACLE = {
    "scorecard": _G + " UNION ALL ".join(f"""SELECT {i} place, {'"position"' if x[1] == "next_step" else 1} "position", '{x[0]}' area, '{x[1]}' test, {', '.join(f'{v} {k}' for k, v in zip(COLUMNS[2:], x[2:], strict=True))} FROM {"st WHERE kind = 'advice'" if x[1] == "next_step" else "g"}""" for i, x in enumerate(SCORECARD, 1)),
    "findings": _G + "SELECT * FROM st",
    "auditor_disagreement": f"{_J} SELECT user_id, n_judgments, {DISAGREEMENT} \"label\", round(n_differ / 3, 4) gap_proxy, (['critical', 'high', 'medium', 'normal'])[k + 1] priority FROM c",
    "model_means": f"WITH {outcomes._ATT} SELECT o_orderpriority model, count(*) n, round(avg(rate) + 1e-9, 4) mean_best, round(avg((rate >= 0.9999)::INT) + 1e-9, 4) solved, count(*) FILTER (suspicious) suspicious FROM m GROUP BY 1",
    "comparison_notes": f"""WITH {outcomes._ATT}, k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) i FROM m),
 t AS (SELECT a.o_custkey, a.o_orderpriority "first", b.o_orderpriority "second", a.efficacy first_label, a.rate first_rate, b.rate second_rate, a.private_rate first_edge, b.private_rate second_edge, a.n_tests n_edge FROM k a LEFT JOIN k b ON b.o_custkey = a.o_custkey AND b.i = 2 WHERE a.i = 1)
 SELECT o_custkey, "first", "second", {rules.COMPARISON} note FROM t""",
    "imperfect_checks": f"WITH {audit._V}, u AS ({_U}) SELECT * FROM u WHERE verdict <> 'PASS'",
    "verdict_counts": f'WITH {audit._V}, u AS ({_U}) SELECT "check", verdict, count(*) n FROM u GROUP BY ALL',
    "text_scalars": f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') t, {_X} x, {_Y} y FROM documents), e AS (SELECT *, lower(regexp_replace(regexp_replace(coalesce(source, ''), '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g')) l FROM d)
 SELECT doc_id, CASE WHEN l = '' THEN 'model' ELSE l END slug, md5(CASE WHEN length(x) <= 80 THEN x ELSE regexp_replace(substring(x, 1, 77), '[ \\t\\r\\n]+$', '') || '...' END) excerpt,
 md5(CASE WHEN length(y) <= 120 THEN y ELSE substring(y, 1, 117) || '...' END) shortened, md5(CASE WHEN length(t) <= 5600 THEN t ELSE left(t, 3200) || chr(10) || '...' || chr(10) || right(t, 2200) END) head_tail,
 (starts_with(x, '{{') AND ends_with(x, '}}')) OR (starts_with(x, '[') AND ends_with(x, ']')) json, CASE WHEN length(t) >= 400 THEN 'PASS' WHEN length(t) >= 200 THEN 'PARTIAL' ELSE 'FAIL' END verdict FROM e""",
}
