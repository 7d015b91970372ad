"""The classifiers on inputs whose results are known."""

import pytest
from pyspark.sql import functions as F

from datagauge.functions import ladders, text
from datagauge.operators import audit, profile, sections


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def classify(spark, rate, public=None, private=None, generated=0.0, n=(5, 10, 0), oracle=1.0, generation="ok", probe="ok", dominant=""):
    public, private = rate if public is None else public, rate if private is None else private
    r = one(spark, ladders.efficacy(F.lit(generation), F.lit(probe), F.lit(rate), F.lit(public), F.lit(private), F.lit(generated), *map(F.lit, n), F.lit(oracle).cast("double"), F.lit(dominant)))
    return r["efficacy"].split(" ")[0], r["quality_signal"], r["difficulty"], r["suspicious"]


@pytest.mark.parametrize("given, want", [
    (dict(rate=1.0, oracle=0.9), ("Suspicious", "misaligned_or_broken", "unknown", True)),
    (dict(rate=0.5, public=1.0, private=0.0), ("Suspicious", "hidden_or_underspecified_requirements", "reasonable", True)),
    (dict(rate=0.7, public=1.0, private=0.5), ("Suspicious", "public_private_divergence", "reasonable", True)),
    (dict(rate=0.95), ("Low", "clean_evaluation", "trivial", False)),
    (dict(rate=0.80), ("High", "clean_evaluation", "reasonable", False)),
    (dict(rate=0.81), ("Moderate", "clean_evaluation", "reasonable", False)),
    (dict(rate=0.25), ("High", "clean_evaluation", "reasonable", False)),
    (dict(rate=0.10), ("Moderate", "clean_evaluation", "reasonable", False)),
    (dict(rate=0.0), ("Moderate", "clean_evaluation", "extreme", False)),
    (dict(rate=0.5, dominant="format_mismatch"), ("High", "ambiguous_or_brittle", "reasonable", True)),
    (dict(rate=0.9, dominant="format_mismatch"), ("Moderate", "ambiguous_or_brittle", "reasonable", True)),
    (dict(rate=0.9, generated=0.4, n=(5, 10, 3)), ("High", "generated_tests_expose_weakness", "reasonable", False)),
    (dict(rate=1.0, private=0.0, n=(5, 0, 0)), ("Low", "clean_evaluation", "trivial", False)),
    (dict(rate=1.0, oracle=None), ("Low", "clean_evaluation", "trivial", False)),
    (dict(rate=1.0, generation="refusal"), ("Inconclusive", "clean_evaluation", "unknown", False)),
    (dict(rate=1.0, probe="timeout"), ("Inconclusive", "clean_evaluation", "unknown", False)),
])
def test_efficacy(spark, given, want):
    assert classify(spark, **given) == want


def test_threshold(spark):
    at = lambda rate, label, hot=False: tuple(one(spark, ladders.threshold(F.lit(rate), F.lit(label), F.lit(hot)))[:3])
    assert at(0.948, "Low Efficacy") == ("saturation_boundary", 0.002, "high") and at(0.50, "High Efficacy")[2] == "stable"
    assert at(0.948, "Inconclusive")[2] == "caveated" and at(0.5, "High Efficacy", True)[2] == "caveated" and at(0.76, "High Efficacy")[2] == "moderate"


def test_variance_and_disagreement(spark):
    v = lambda *x: one(spark, ladders.variance_label(*map(F.lit, x)))
    assert v(3, 0.6667, 0.65, 0.2953) == "volatile" and v(1, 1.0, 0.0, 0.0) == "stable" and v(0, 1.0, 0.0, 0.0) == "unknown" and v(2, 1.0, 0.2, 0.0) == "moderate" and v(2, 0.5, 0.0, 0.0) == "volatile"
    d = lambda *x: one(spark, ladders.disagreement_label(*map(F.lit, x)))
    assert d(2, 0.7, 2, 1, 1) == "strong_disagreement" and d(1, 0.0, 1, 1, 1) == "single_model" and d(2, 0.1, 1, 2, 1) == "moderate_disagreement" and d(2, 0.0, 1, 1, 2) == "strong_disagreement" and d(2, 0.1, 1, 1, 1) == "aligned"


BASE = dict(score=0.9, rate=0.5, generation="ok", probe="ok", public=0.5, private=0.5, generated=0.0, n_private=10, n_generated=0, oracle=1.0, dominant="", n_attempts=1, ok_rate=1.0, spread=0.0, deviation=0.0, n_models=1, gap=0.0, n_efficacy=1, n_signal=1, n_suspicion=1, redundancy=0.0, note="", toxic=False, outliers="")


@pytest.mark.parametrize("given, want", [
    (dict(), dict(priority="normal", exemplar=True, utility="strong", regime="discriminative", contradiction="", reasons="no elevated audit signal")),
    (dict(score=0.7), dict(exemplar=False, utility="usable")),
    (dict(toxic=True), dict(priority="critical", utility="caveated", regime="caveated", contradiction="high_static_low_dynamic")),
    (dict(oracle=0.9, score=0.5), dict(priority="critical", defect_reason="oracle or benchmark artifact appears misaligned")),
    (dict(rate=0.1, public=0.1, private=0.1), dict(contradiction="high_static_low_dynamic", priority="critical", regime="extreme_or_blocked", utility="contradictory")),
    (dict(score=0.4, rate=0.9, public=0.9, private=0.9), dict(contradiction="low_static_high_dynamic", priority="high")),
    (dict(redundancy=0.82), dict(priority="high", reasons="redundancy", exemplar=False)),
    (dict(redundancy=0.72), dict(priority="medium")),
    (dict(redundancy=0.6), dict(priority="normal", reasons="redundancy")),
    (dict(outliers="n_words"), dict(priority="medium", reasons="outlier", exemplar=False)),
    (dict(outliers="n_words;n_lines"), dict(priority="high")),
    (dict(n_attempts=3, spread=0.4), dict(priority="medium", regime="unstable", variance="volatile", exemplar=False)),
    (dict(n_models=2, gap=0.5), dict(priority="high", regime="unstable", disagreement="strong_disagreement")),
    (dict(n_models=2, gap=0.3), dict(priority="medium", disagreement="moderate_disagreement", reasons="model_disagreement")),
    (dict(n_models=0), dict(disagreement="unknown", exemplar=False, reasons="model_disagreement")),
    (dict(rate=0.97, public=0.97, private=0.97), dict(sensitivity="high", regime="threshold_fragile", priority="medium", utility="saturated", reasons="threshold_sensitivity, triviality")),
    (dict(rate=1.0, public=1.0, private=1.0), dict(sensitivity="stable", utility="saturated")),
    (dict(generation="no_code"), dict(efficacy="Inconclusive", contradiction="high_static_low_dynamic", sensitivity="caveated", priority="critical")),
])
def test_audit_ladders(spark, given, want):
    row = {"doc_id": 1} | BASE | given
    got = audit.laddered(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for k, v in row.items()))).first()
    assert {k: got[k] for k in want} == want


def test_small_ladders(spark):
    bands = [one(spark, ladders.banded(F.lit(v), k)) for k, v in (("prompt", 149), ("prompt", 150), ("prompt", 500), ("prompt", 501), ("starter", 5), ("starter", 6), ("starter", 21), ("ideal", 80), ("ideal", 81), ("ideal", 251), ("tests", 9), ("tests", 10), ("tests", 20), ("tests", 21))]
    assert bands == ["short", "medium", "medium", "long", "minimal", "moderate", "large", "compact", "moderate", "large", "sparse", "recommended", "recommended", "heavy"]
    assert one(spark, ladders.flag(F.lit("a; b"), "b")) == "FLAG" and one(spark, ladders.flag(F.lit(None).cast("string"), "b")) == "PASS"
    assert one(spark, ladders.pair_label(F.lit("near_duplicate"), F.lit("semantic_duplicate"))) == "semantic_duplicate" and one(spark, ladders.pair_label(F.lit(""), F.lit(""))) == "template_overlap"
    flags = lambda *x: one(spark, ladders.utility_of_flags(*map(F.lit, x)))
    assert [flags("FLAG", "FLAG", "x", "FLAG"), flags("PASS", "FLAG", "x", "FLAG"), flags("PASS", "PASS", "x", "FLAG"), flags("PASS", "PASS", "none", "FLAG"), flags("PASS", "PASS", "", "PASS")] == ["caveated", "saturated", "contradictory", "strong", "usable"]
    assert one(spark, ladders.spread_result(F.lit(3))) == "PASS" and one(spark, ladders.spread_text(F.lit(2))).startswith("The observed")
    assert one(spark, ladders.action_text(F.array(F.lit("keep"), F.lit("fix")))).startswith("Prioritize fix") and one(spark, ladders.action_text(F.array().cast("array<string>"))) == ""
    assert one(spark, audit.escalate(F.lit("medium"), F.lit("high"))) == "high" and one(spark, audit.escalate(F.lit("high"), F.lit("medium"))) == "high" and one(spark, audit.escalate(F.lit("high"), F.lit("odd"))) == "high"


def test_decision(spark):
    use = lambda *u: F.array(*map(F.lit, u))
    run = lambda u, hot=False, eff="High Efficacy", sig="clean_evaluation", con="none", flags=("PASS",) * 4, pr="": one(spark, ladders.decision(use(*u), F.lit(hot), F.lit(eff), F.lit(sig), F.lit(con), *map(F.lit, flags), F.lit(pr)))
    fine = ("Usable",) * 3
    assert [run(fine, True)["action"], run(("Unusable", "Unusable", "Usable"))["cost"], run(fine, flags=("PASS", "FLAG", "PASS", "PASS"))["action"], run(fine, flags=("PASS", "PASS", "FLAG", "PASS"))["action"], run(fine, flags=("PASS", "PASS", "PASS", "FLAG"))["rationale"][:30], run(("Usable", "Needs Fixing", "Unusable"))["cost"], run(fine)["action"]] == ["FIX_OR_REMOVE", "high", "DEDUPE_OR_DOWNWEIGHT", "DEPRIORITIZE", "Stage 3 surfaced the sample as", "medium", "KEEP"]
    r = run(fine, con="low_static_high_dynamic", sig="ambiguous_or_brittle", eff="")
    assert r["priority"] == "normal" and r["rationale"].endswith("signal: low_static_high_dynamic. Stage 2 benchmark-quality caveat: ambiguous_or_brittle.") and r["evidence"].count(";") == 3


def test_usability(spark):
    names = list(sections.checks.CHECKS)

    def run(runtime="5/5", **verdicts):
        row = {n: verdicts.get(n, "PASS") for n in names}
        df = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{n}` string" for n in names))
        return tuple(df.select(sections.usability(F.lit(runtime)).alias("u")).first()["u"])

    assert run() == ("Usable",) * 3
    assert run(**{"6.1_prompt_test_solution_aligned": "UNCLEAR"}) == ("Needs Fixing",) * 3
    assert run(**{"1.1_function_signature_present": "FAIL"})[0] == "Unusable" and run("2/5")[1] == "Unusable" and run("4/5")[1] == "Needs Fixing" and run("odd")[1] == "Unusable"
    assert run(**{n: "FAIL" for n in ("1.2_not_vague", "1.2_no_conflicting_objectives")})[0] == "Needs Fixing"
    assert run(**{n: "FAIL" for n in ("1.2_not_vague", "1.2_no_conflicting_objectives", "1.2_no_unrealistic_constraints")})[0] == "Unusable"
    assert run(**{n: "FAIL" for n in ("6.1_prompt_test_solution_aligned", "6.2_model_breaking_prompt_defined_only")}) == ("Needs Fixing", "Needs Fixing", "Unusable")
    assert run(**{n: "FAIL" for n in ("6.1_prompt_test_solution_aligned", "6.2_model_breaking_prompt_defined_only", "6.2_no_unmentioned_internal_logic")}) == ("Unusable",) * 3
    assert run(**{"3.3_json_escaping_valid": "FAIL"})[2] == "Needs Fixing" and run(**{"3.3_json_escaping_valid": "FAIL", "3.3_output_json_object": "FAIL"})[2] == "Unusable"
    assert run(**{"2.3_executes_without_error": "FAIL"})[1] == "Unusable" and run(**{"7_no_logic": "PARTIAL"}) == ("Needs Fixing", "Usable", "Usable")


def test_scores(spark):
    names = list(sections.checks.CHECKS)
    row = {n: "PASS" for n in names} | {"1.1_not_verbose": "FAIL", "1.2_not_vague": "PARTIAL", "3.3_json_encoded": "FAIL", "3.4_not_large_or_redundant": "NA", "3.3.1_exception_tests_aligned": "NA", "4_coverage_confidence": "UNCLEAR", "7_no_logic": None, "7_no_helpers": " "}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{n}` string" for n in names))
    cell = sections.cells()
    r = df.select(sections.stage_score(cell).alias("score"), sections.section_scores().alias("s"), sections.critical_fails().alias("c"), sections.failures(cell, 2).alias("top"), sections.failures(cell).alias("all"), sections.status_counts(cell).alias("n"), sections.counts_in(["1.1_not_verbose", "1.2_not_vague"]).alias("p"), sections.subsection_scores().alias("sub")).first()
    assert r["score"] == round((76 - 8 + 0.5 + 0.25) / 72, 4) and r["c"] == 1 and r["top"] == ["1.1_not_verbose", "1.2_not_vague"] and len(r["all"]) == 4
    assert r["n"] == {"PASS": 68, "FAIL": 2, "PARTIAL": 1, "NA": 2, "UNCLEAR": 1} and tuple(r["p"]) == (1, 1, 0) and r["s"]["section_4"] == 0.625
    sub = {x["subsection"]: (x["mean"], x["label"]) for x in r["sub"]}
    assert sub["3.4"] == (None, "NA") and sub["4"] == (0.625, None) and sub["2.1"] == (1.0, None) and len(sub) == 16


def test_relationships(spark):
    rows = [(i, 0.15 if i < 8 else 0.8, i < 4, ["supported_signal"] * (i < 8) + ["sparse_signal"] * (i >= 16), 1.0 - i / 20) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, rate double, suspicious boolean, flags array<string>, score double")
    got = {r["signal"]: r for r in profile.top_rules(profile.contrasts(df, F.col("flags")).unionByName(profile.score_correlations(df, ["score"]))).collect()}
    r = got["supported_signal"]
    assert (r["n"], r["share"], r["mean_rate"], r["suspicious_rate"], r["delta"], r["lift"], r["strength"], r["reliability"]) == (8, 0.4, 0.15, 0.5, -0.65, 0.5, 0.36, "broad")
    assert "sparse_signal" not in got and got["score"]["kind"] == "section_score"
    assert profile.contrasts(df.limit(9), F.col("flags")).count() == 0 and profile.score_correlations(df.limit(9), ["score"]).count() == 0


def test_texts(spark):
    t = lambda c, x: one(spark, c(F.lit(x)))
    assert t(text.template, 'Return 12 items "x"') == "return <<id>> <id> <<id>>"
    assert t(text.template, "Input: __init__ of  a Function's 'word' __x ab") == "input: <magic> of a function <<id>> <id>' <id> ab"
    assert t(text.template, "über_x éabc abc") == "über_x éabc <id>"
    assert t(text.normalise, " A B \x0bc\n") == "a b c" and t(text.word_count, "naïve über co") == 3 and t(text.word_count, None) == 0
    assert [t(text.line_count, x) for x in ("\n\n", "a\nb\n", "a\r\nb\rc", "a b\r", None)] == [0, 2, 3, 2, 0]
    assert t(text.tokens, "Def solve(x_1):") == ["def", "solve", "x_1"] and t(text.mixed_signature, "ab") == ["ab"]
    tests = F.array(F.struct(F.lit("public").alias("visibility"), F.lit("t").alias("testtype"), F.lit("1").alias("input"), F.lit(None).cast("string").alias("output")))
    assert one(spark, text.test_signature(tests))[:2] == ["publ", "ubli"] and one(spark, text.test_signature(F.lit(None).cast("array<struct<visibility:string,testtype:string,input:string,output:string>>"))) == []
    assert one(spark, text.embedding_text(F.lit(" T "), F.lit(""), F.lit("p" * 3000), F.lit(None).cast("string"))) == "T\n" + "p" * 2500
