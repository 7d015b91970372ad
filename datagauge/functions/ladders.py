"""The audit's classifiers as columns: the first branch that holds wins. Null conditions don't hold, null texts count as empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The outcome of each case (difficulty, failure category, quality signal, efficacy, suspicious, needs audit).
_AUDIT = "Suspicious (Needs Audit)"
OUTCOMES = {
    "not_generated": ("unknown", "generation_failure", "clean_evaluation", "Inconclusive", False, False),
    "not_run": ("unknown", "execution_failure", "clean_evaluation", "Inconclusive", False, False),
    "oracle": ("unknown", "benchmark_suspicion", "misaligned_or_broken", _AUDIT, True, True),
    "hidden": ("reasonable", "benchmark_suspicion", "hidden_or_underspecified_requirements", _AUDIT, True, True),
    "divergent": ("reasonable", "benchmark_suspicion", "public_private_divergence", _AUDIT, True, True),
    "exposed": ("reasonable", "logical_or_edge_failure", "generated_tests_expose_weakness", "High Efficacy", False, False),
    "saturated": ("trivial", "clean_pass", "clean_evaluation", "Low Efficacy", False, False),
    "brittle_moderate": ("reasonable", "logical_or_edge_failure", "ambiguous_or_brittle", "Moderate Efficacy", True, True),
    "brittle_high": ("reasonable", "logical_or_edge_failure", "ambiguous_or_brittle", "High Efficacy", True, True),
    "moderate": ("reasonable", "logical_or_edge_failure", "clean_evaluation", "Moderate Efficacy", False, False),
    "high": ("reasonable", "logical_or_edge_failure", "clean_evaluation", "High Efficacy", False, False),
    "none": ("extreme", "logical_or_test_failure", "clean_evaluation", "Moderate Efficacy", False, False),
    "low": ("reasonable", "logical_or_edge_failure", "clean_evaluation", "Moderate Efficacy", False, False),
}
OUTCOME = ("difficulty", "failure_category", "quality_signal", "efficacy", "suspicious", "needs_audit")
# Bands (upper ends, names), boundaries of a pass rate, margins.
BANDS = {
    "prompt": ((149, "short"), (500, "medium"), (None, "long")),
    "starter": ((5, "minimal"), (20, "moderate"), (None, "large")),
    "ideal": ((80, "compact"), (250, "moderate"), (None, "large")),
    "tests": ((9, "sparse"), (20, "recommended"), (None, "heavy")),
}
BOUNDARIES = (("high_efficacy_floor", 0.25), ("moderate_high_split", 0.8), ("saturation_boundary", 0.95))
MARGIN = 0.05
PRIORITIES = ("critical", "high", "medium", "normal")
PAIR_LABELS = ("exact_duplicate", "semantic_duplicate", "near_duplicate", "template_overlap")
REDUNDANT = 0.55


def first(cases: list[tuple[Column, object]], default: object) -> Column:
    """The value of the first case that holds."""
    out = None
    for on, value in cases:
        out = F.when(on, value) if out is None else out.when(on, value)
    return out.otherwise(default)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conditions])


def efficacy(generation: Column, probe: Column, rate: Column, public: Column, private: Column, generated: Column, n_public: Column, n_private: Column, n_generated: Column, oracle: Column, dominant: Column) -> Column:
    """A struct of OUTCOME. Rates without tests are 0; ``oracle`` null: no oracle run."""
    brittle, split = F.coalesce(dominant == "format_mismatch", F.lit(False)), rate > 0.8
    middle = first([(brittle & split, "brittle_moderate"), (brittle, "brittle_high"), (split, "moderate")], "high")
    case = first(
        [
            (~generation.eqNullSafe("ok"), "not_generated"),
            (~probe.eqNullSafe("ok"), "not_run"),
            (oracle < 1, "oracle"),
            ((public == 1) & (private == 0) & (n_private > 0), "hidden"),
            ((n_public > 0) & (n_private > 0) & (F.abs(public - private) >= 0.5) & (F.greatest(public, private) >= 0.75), "divergent"),
            ((n_generated > 0) & (public >= 0.9) & (generated <= 0.4), "exposed"),
            (rate >= 0.95, "saturated"),
            (rate >= 0.25, middle),
            (rate == 0, "none"),
        ],
        "low",
    )
    table = F.create_map(*(x for k, v in OUTCOMES.items() for x in (F.lit(k), F.struct(*(F.lit(c).alias(n) for n, c in zip(OUTCOME, v, strict=True))))))
    return F.element_at(table, case)


def threshold(rate: Column, efficacy_: Column, suspicious: Column) -> Column:
    """A struct of boundary (the nearest, of equals the lowest), distance, label and reason."""
    near = F.array_min(F.array(*(F.struct(F.abs(rate - v).alias("distance"), F.lit(v).alias("at"), F.lit(n).alias("name")) for n, v in BOUNDARIES)))
    lost = F.coalesce(efficacy_ == "Inconclusive", F.lit(False))
    label = first([(lost | suspicious, "caveated"), (near["distance"] <= MARGIN / 2, "high"), (near["distance"] <= MARGIN, "moderate")], "stable")
    reason = first(
        [
            (lost, "upstream efficacy is already inconclusive"),
            (suspicious, "suspicious benchmark behavior already dominates interpretation"),
            (label == "high", F.concat(F.lit("pass rate sits very close to "), near["name"])),
            (label == "moderate", F.concat(F.lit("pass rate sits near "), near["name"])),
        ],
        "",
    )
    return F.struct(near["name"].alias("boundary"), F.round(near["distance"], 4).alias("distance"), label.alias("label"), reason.alias("reason"))


def variance_label(n: Column, ok_rate: Column, spread: Column, deviation: Column) -> Column:
    return first([(n.isNull() | (n == 0), "unknown"), (n == 1, "stable"), ((ok_rate < 1) | (spread >= 0.35) | (deviation >= 0.15), "volatile"), ((spread >= 0.2) | (deviation >= 0.08), "moderate")], "stable")


def disagreement_label(n: Column, gap: Column, efficacies: Column, signals: Column, suspicions: Column) -> Column:
    """The last three: numbers of distinct values."""
    strong = (gap >= 0.45) | (suspicions > 1) | ((efficacies > 1) & (gap >= 0.25))
    return first([(n.isNull() | (n == 0), "unknown"), (n == 1, "single_model"), (strong, "strong_disagreement"), ((gap >= 0.25) | (efficacies > 1) | (signals > 1), "moderate_disagreement")], "aligned")


def contradiction(score: Column, suspicious: Column, rate: Column, efficacy_: Column) -> Column:
    """Empty where static and dynamic results agree."""
    weak = any_of([suspicious, rate <= 0.2, efficacy_ == "Inconclusive"])
    return first([((score >= 0.82) & weak, "high_static_low_dynamic"), ((score <= 0.45) & (rate >= 0.9), "low_static_high_dynamic")], "")


def defect(suspicious: Column, oracle: Column) -> Column:
    return any_of([suspicious, oracle < 0.9999])


def trivial(efficacy_: Column, rate: Column) -> Column:
    return any_of([efficacy_ == "Low Efficacy", rate >= 0.95])


def priority(defect_: Column, contradiction_: Column, redundancy: Column, n_outliers: Column, needs_audit: Column, variance: Column, threshold_: Column, disagreement: Column) -> Column:
    urgent = any_of([defect_, contradiction_ == "high_static_low_dynamic"])
    high = any_of([redundancy >= 0.82, n_outliers >= 2, contradiction_ != "", disagreement == "strong_disagreement"])
    medium = any_of([needs_audit, redundancy >= 0.72, n_outliers > 0, variance == "volatile", threshold_ != "stable", disagreement == "moderate_disagreement"])
    return first([(urgent, "critical"), (high, "high"), (medium, "medium")], "normal")


def rank(priority_: Column) -> Column:
    """0 for the most urgent; unknown ones come last."""
    return first([(priority_ == p, i) for i, p in enumerate(PRIORITIES)], len(PRIORITIES))


def exemplar(score: Column, efficacy_: Column, suspicious: Column, contradiction_: Column, variance: Column, disagreement: Column, threshold_: Column, redundancy: Column, n_outliers: Column) -> Column:
    return all_of([score >= 0.78, efficacy_.isin("High Efficacy", "Moderate Efficacy"), ~suspicious, contradiction_ == "", variance == "stable", disagreement.isin("aligned", "single_model"), threshold_ == "stable", redundancy < REDUNDANT, n_outliers == 0])


def utility(defect_: Column, trivial_: Column, contradiction_: Column, exemplar_: Column) -> Column:
    return first([(defect_, "caveated"), (trivial_, "saturated"), (contradiction_ != "", "contradictory"), (exemplar_, "strong")], "usable")


def utility_of_flags(defect_: Column, trivial_: Column, contradiction_: Column, exemplar_: Column) -> Column:
    """The same ladder over FLAG cells and a contradiction cell that may be ``none``."""
    return first([(defect_ == "FLAG", "caveated"), (trivial_ == "FLAG", "saturated"), (~F.coalesce(contradiction_, F.lit("")).isin("", "none"), "contradictory"), (exemplar_ == "FLAG", "strong")], "usable")


def regime(suspicious: Column, threshold_: Column, variance: Column, disagreement: Column, rate: Column) -> Column:
    unstable = any_of([variance == "volatile", disagreement == "strong_disagreement"])
    return first([(suspicious, "caveated"), (~threshold_.eqNullSafe("stable"), "threshold_fragile"), (unstable, "unstable"), (rate >= 0.95, "saturated"), (rate <= 0.1, "extreme_or_blocked")], "discriminative")


def defect_reason(oracle: Column, signal: Column, note: Column) -> Column:
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return first([(oracle < 0.9999, "oracle or benchmark artifact appears misaligned"), (filled(signal), signal), (filled(note), note)], "suspicious benchmark behavior")


def audit_reasons(redundancy: Column, variance: Column, disagreement: Column, threshold_: Column, contradiction_: Column, defect_: Column, trivial_: Column, n_outliers: Column) -> Column:
    parts = [
        F.when(redundancy >= REDUNDANT, "redundancy"),
        F.when(~F.coalesce(variance, F.lit("")).isin("", "stable"), "attempt_variance"),
        F.when(~F.coalesce(disagreement, F.lit("")).isin("", "aligned", "single_model"), "model_disagreement"),
        F.when(~F.coalesce(threshold_, F.lit("")).isin("", "stable"), "threshold_sensitivity"),
        F.when(contradiction_ != "", contradiction_),
        F.when(defect_, "benchmark_defect"),
        F.when(trivial_, "triviality"),
        F.when(n_outliers > 0, "outlier"),
    ]
    text = F.concat_ws(", ", *parts)
    return F.when(text == "", "no elevated audit signal").otherwise(text)


def banded(value: Column, kind: str) -> Column:
    *ends, (_, last) = BANDS[kind]
    return first([(value <= top, name) for top, name in ends], last)


def flag(flags: Column, name: str) -> Column:
    """FLAG if a ``;`` list holds a name."""
    held = F.array_contains(F.transform(F.split(F.coalesce(flags, F.lit("")), ";"), lambda x: F.trim(x)), name)
    return F.when(held, "FLAG").otherwise("PASS")


def pair_label(left: Column, right: Column) -> Column:
    """The stronger of two rows' labels."""
    return first([((left == k) | (right == k), k) for k in PAIR_LABELS[:-1]], PAIR_LABELS[-1])


def spread_result(n_classes: Column) -> Column:
    """Whether enough difficulty classes occur."""
    return F.when(n_classes >= 3, "PASS").otherwise("REVIEW")


def spread_text(n_classes: Column) -> Column:
    return F.when(n_classes >= 3, "The dataset spans multiple observed difficulty regimes.").otherwise("The observed difficulty regime looks narrow or unstable.")


def action_text(actions: Column) -> Column:
    """What to do first, given the array of the reviews' actions."""
    has = lambda a: F.coalesce(F.array_contains(actions, a), F.lit(False))
    texts = (("remove", "Validate the remove candidates first; they have the largest benchmark-quality impact."), ("fix", "Prioritize fix candidates before broadening manual audit coverage."), ("keep", "Use keep decisions as calibration exemplars for earlier stages."))
    return first([(has(a), t) for a, t in texts], "")


# Decision, cost, rationale and evidence of each case.
_SAMPLES, _ROWS, _SHEET = "sample_results.csv", "enriched_samples.csv", "guideline_audit.xlsx::Summary"
DECISIONS = {
    "defect": ("FIX_OR_REMOVE", "medium", "Stage 2 or Stage 3 flagged the sample as likely benchmark-defective.", (f"{_SAMPLES}::Suspicious", f"{_ROWS}::BenchmarkDefectCandidate")),
    "unusable": ("FIX", "high", "Stage 1 marked multiple artifact layers as unusable.", (_SHEET,)),
    "redundant": ("DEDUPE_OR_DOWNWEIGHT", "low", "Stage 3 found a material redundancy signal.", (f"{_ROWS}::RedundancyStatus",)),
    "trivial": ("DEPRIORITIZE", "low", "Stage 3 marked the sample as trivial or saturated.", (f"{_ROWS}::TrivialityCheck",)),
    "exemplar": ("KEEP", "low", "Stage 3 surfaced the sample as a strong exemplar candidate.", (f"{_ROWS}::ExemplarCheck",)),
    "fixable": ("FIX", "medium", "Stage 1 found repairable artifact-quality issues.", (_SHEET,)),
    "clean": ("KEEP", "low", "No strong structural or behavioral defect signal was raised in Stage 1 to Stage 3.", (_SHEET, f"{_SAMPLES}::ModelAEfficacyLabel")),
}


def decision(usabilities: Column, suspicious: Column, efficacy_: Column, signal: Column, contradiction_: Column, defect_flag: Column, redundancy_flag: Column, triviality_flag: Column, exemplar_flag: Column, priority_: Column) -> Column:
    """A struct of action, priority, rationale, evidence and cost. ``usabilities``: array of the three usability labels."""
    case = first(
        [
            (any_of([defect_flag == "FLAG", suspicious]), "defect"),
            (F.size(F.filter(usabilities, lambda u: u == "Unusable")) >= 2, "unusable"),
            (redundancy_flag == "FLAG", "redundant"),
            (triviality_flag == "FLAG", "trivial"),
            (exemplar_flag == "FLAG", "exemplar"),
            (F.array_contains(usabilities, "Needs Fixing"), "fixable"),
        ],
        "clean",
    )
    pick = lambda i: F.element_at(F.create_map(*(x for k, v in DECISIONS.items() for x in (F.lit(k), F.lit(v[i]) if i < 3 else F.array(*map(F.lit, v[3]))))), case)
    filled = lambda c, none: ~F.coalesce(c, F.lit("")).isin("", none)
    against, caveat = filled(contradiction_, "none"), filled(signal, "clean_evaluation")
    rationale = F.concat_ws(
        " ",
        pick(2),
        F.when(against, F.concat(F.lit("Stage 3 contradiction signal: "), contradiction_, F.lit("."))),
        F.when(caveat, F.concat(F.lit("Stage 2 benchmark-quality caveat: "), signal, F.lit("."))),
        F.when(filled(efficacy_, ""), F.concat(F.lit("Stage 2 efficacy label: "), efficacy_, F.lit("."))),
    )
    none = F.array().cast("array<string>")
    evidence = F.concat(pick(3), F.when(against, F.array(F.lit(f"{_ROWS}::ContradictionCheck"))).otherwise(none), F.when(caveat, F.array(F.lit(f"{_SAMPLES}::ModelABenchmarkQualitySignal"))).otherwise(none))
    level = F.when(filled(priority_, ""), priority_).otherwise("normal")
    return F.struct(pick(0).alias("action"), level.alias("priority"), rationale.alias("rationale"), F.array_join(F.array_distinct(evidence), "; ").alias("evidence"), pick(1).alias("cost"))
