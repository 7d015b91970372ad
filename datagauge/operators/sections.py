"""Scores and usability of a sample from its 76 verdicts: whole, by section and subsection; failing checks; what they go with.

Rows hold a column for each check under its own name, as ``operators.checks.verdicts`` makes them. Everything is computed within a row; a null or
blank verdict is no verdict. NA is counted but scores nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, ladders, patterns, scalars
from ..sources.tables import spread, table, written
from . import audit, profile

# Scores of verdicts, sections, those whose failures are critical, imperfect verdicts.
SCORES = {"PASS": 1.0, "PARTIAL": 0.5, "UNCLEAR": 0.25, "FAIL": 0.0}
VERDICTS = (*SCORES, "NA")
SECTIONS = ("1", "2", "3", "4", "6", "7")
CRITICAL = ("3.", "4_", "6.")
IMPERFECT = ("FAIL", "PARTIAL", "UNCLEAR")
SHOWN = 8
# Checks that count for the usability of a part beside those of its own sections.
ALIGNED, DEFINED, UNMENTIONED = "6.1_prompt_test_solution_aligned", "6.2_model_breaking_prompt_defined_only", "6.2_no_unmentioned_internal_logic"
SCHEMA, PARAMETERS, DRY_RUN = "6.1_output_schema_aligned", "6.2_no_extra_parameters", "4_cross_verified_dry_run"


def subsection(name: str) -> str:
    return name.split("_", 1)[0]


def category(name: str) -> str:
    """The part of a sample that a check is about."""
    return "prompt" if name[:2] in ("1.", "7_") else "ideal" if name.startswith("2.") else "tests"


def checks_of(part: str) -> list[str]:
    return [n for n in checks.CHECKS if category(n) == part]


def cells(names: list[str] | None = None) -> Column:
    """Array of (check, verdict) of the named checks that have one, in order."""
    one = [F.struct(F.lit(n).alias("check"), F.trim(F.col(f"`{n}`")).alias("verdict")) for n in names or checks.CHECKS]
    return F.filter(F.array(*one), lambda c: F.coalesce(c["verdict"], F.lit("")) != "")


def count(cell: Column, *verdicts: str) -> Column:
    return F.size(F.filter(cell, lambda c: c["verdict"].isin(*verdicts)))


def mean_score(cell: Column) -> Column:
    """Mean over the verdicts that score; null if none does."""
    total = sum((count(cell, v) * F.lit(s) for v, s in SCORES.items()), F.lit(0.0))
    return F.try_divide(total, count(cell, *SCORES))


def stage_score(cell: Column) -> Column:
    return F.coalesce(F.round(mean_score(cell), 4), F.lit(0.0))


def status_counts(cell: Column) -> Column:
    """Map of verdict to checks."""
    found = F.array_distinct(F.transform(cell, lambda c: c["verdict"]))
    return F.map_from_entries(F.transform(F.array_sort(found), lambda v: F.struct(v, F.size(F.filter(cell, lambda c: c["verdict"] == v)))))


def counts_in(names: list[str]) -> Column:
    """A struct of fails, partials and unclear ones among some checks."""
    cell = cells(names)
    return F.struct(*(count(cell, v).alias(v.lower()) for v in IMPERFECT))


def section_scores() -> Column:
    """A struct of each section's mean score; null for a section without one."""
    return F.struct(*(F.round(mean_score(cells([n for n in checks.CHECKS if n.startswith(s)])), 4).alias(f"section_{s}") for s in SECTIONS))


def subsection_scores() -> Column:
    """Array of (subsection, mean, label): the label is NA if all its checks are, UNCLEAR if none scores but one is unclear, else null."""
    out = []
    for s in dict.fromkeys(map(subsection, checks.CHECKS)):
        names = [n for n in checks.CHECKS if subsection(n) == s]
        cell = cells(names)
        label = F.when(mean_score(cell).isNotNull(), F.lit(None)).when(count(cell, "NA") == len(names), "NA").when(count(cell, "UNCLEAR") > 0, "UNCLEAR")
        out.append(F.struct(F.lit(s).alias("subsection"), F.round(mean_score(cell), 4).alias("mean"), label.alias("label")))
    return F.array(*out)


def critical_fails() -> Column:
    return count(cells([n for n in checks.CHECKS if n.startswith(CRITICAL)]), "FAIL")


def failures(cell: Column, most: int | None = None) -> Column:
    """Names of the checks that are not passed, in order; the first ``most``."""
    names = F.transform(F.filter(cell, lambda c: c["verdict"].isin(*IMPERFECT)), lambda c: c["check"])
    return names if most is None else F.slice(names, 1, most)


def _flawed(names: list[str]) -> Column:
    return count(cells(names), *IMPERFECT) > 0


def _failed(*names: str) -> Column:
    return ladders.all_of([F.col(f"`{n}`") == "FAIL" for n in names])


def usability(runtime: Column) -> Column:
    """A struct of prompt, ideal and tests: Unusable, Needs Fixing or Usable. ``runtime``: passed/total of the ideal response as text."""
    pair = scalars.pass_fraction(runtime)
    share = F.coalesce(F.try_divide(pair["passed"], pair["total"]), F.lit(0.0))
    vague, conflicting = "1.2_not_vague", "1.2_no_conflicting_objectives"
    unusable = {
        "prompt": [_failed("1.1_function_signature_present"), _failed("1.2_practical_algorithmic_problem", vague, conflicting), _failed(ALIGNED, DEFINED, UNMENTIONED), _failed(vague, conflicting, "1.2_no_unrealistic_constraints")],
        "ideal": [_failed("2.3_executes_without_error"), _failed("2.3_passes_internal_tests"), share < 0.5, _failed(UNMENTIONED, ALIGNED, DEFINED)],
        "tests": [
            _failed("3.3_json_encoded"), _failed("3.3_string_fields"), _failed(PARAMETERS), _failed(ALIGNED, DEFINED), _failed(DRY_RUN, ALIGNED),
            _failed("3.3_json_escaping_valid", "3.3_input_json_object"), _failed("3.3_json_escaping_valid", "3.3_output_json_object"),
        ],
    }
    also = {"prompt": [ALIGNED, DEFINED, UNMENTIONED, SCHEMA], "ideal": [UNMENTIONED, ALIGNED, DEFINED], "tests": [DEFINED, UNMENTIONED, ALIGNED, PARAMETERS, DRY_RUN]}
    out = []
    for part in unusable:
        flawed = _flawed(list(dict.fromkeys(checks_of(part) + also[part])))
        out.append(F.when(ladders.any_of(unusable[part]), "Unusable").when(flawed | (share < 1 if part == "ideal" else F.lit(False)), "Needs Fixing").otherwise("Usable").alias(part))
    return F.struct(*out)


#: Adapter: the facts of a document as a sample, as far as its text does not give them; ANSI SQL.
GIVEN = {
    "function_name": "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE lang END", "difficulty": "CASE WHEN n_chars < 2000 THEN 'easy' WHEN n_chars < 8000 THEN 'medium' ELSE 'hard' END",
    "judged": "CASE quality WHEN 1 THEN 'PASS' WHEN 0 THEN 'FAIL' ELSE CASE WHEN doc_id % 3 = 0 THEN 'PASS' ELSE 'UNCLEAR' END END",
    "run_ok": "doc_id % 10 <> 3", "run_passed": "CASE WHEN doc_id % 10 < 6 THEN 5 ELSE doc_id % 6 END", "run_total": "5", "n_public": "3 + doc_id % 5", "n_private": "7 + doc_id % 12", "n_tests": "10 + doc_id % 5 + doc_id % 12", "private_chars": "n_chars * 3",
    "n_fields": "CASE WHEN doc_id % 14 = 1 THEN 0 ELSE 10 + doc_id % 5 + doc_id % 12 END", "n_in_object": "CASE WHEN doc_id % 4 = 1 THEN 6 ELSE 10 + doc_id % 5 + doc_id % 12 END", "n_out_object": "CASE WHEN doc_id % 6 = 1 THEN 0 ELSE 10 + doc_id % 5 + doc_id % 12 END",
    "n_braced": "4", "n_parsed": "CASE WHEN doc_id % 8 = 1 THEN 0 WHEN doc_id % 8 = 2 THEN 2 ELSE 4 END", "n_literals": "CASE WHEN doc_id % 12 = 0 THEN 2 ELSE 0 END", "n_arity": "CASE WHEN doc_id % 5 = 1 THEN 8 ELSE 10 + doc_id % 5 + doc_id % 12 END", "n_over": "CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END",
    "n_names": "1 + doc_id % 3", "prompt_bad_types": "doc_id % 7 = 0", "ideal_functions": "doc_id % 3", "ideal_kwonly": "CASE WHEN doc_id % 15 = 0 THEN 1 ELSE 0 END", "starter_functions": "1 + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END", "starter_classes": "CASE WHEN doc_id % 16 = 0 THEN 1 ELSE 0 END", "starter_arity": "doc_id % 4", "starter_defaults": "doc_id % 2", "starter_extra": "CASE WHEN doc_id % 5 = 2 THEN 1 ELSE 0 END",
    "n_errors": "doc_id % 3", "extra_errors": "CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END", "missing_keys": "CASE WHEN doc_id % 7 = 3 THEN 3 ELSE doc_id % 2 END", "rules_must": "CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END", "rules_plain": "CASE WHEN doc_id % 14 = 0 THEN 1 ELSE 0 END", "rules_tie": "CASE WHEN doc_id % 15 = 0 THEN 1 ELSE 0 END",
    "n_edges": "doc_id % 3", "edges_tested": "doc_id % 2", "n_limits": "doc_id % 10", "limits_tested": "doc_id % 4", "n_missing_imports": "CASE WHEN doc_id % 6 = 5 THEN 1 ELSE 0 END",
    "example_in": "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'a' END", "example_out": "CASE WHEN doc_id % 5 = 0 THEN 'c' ELSE 'b' END", "first_in": "'a'", "first_out": "'b'",
}


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: every document with its 76 verdicts and the runtime of its solution."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    text = F.coalesce("text", F.lit(""))
    rows = spread(table(spark, sf_dir, "documents"), "doc_id").join(labels, "doc_id", "left").select("doc_id", text.alias("prompt"), *(F.expr(v).alias(k) for k, v in GIVEN.items()))
    rows = patterns.matched(rows, checks.CHECKS, {"ideal": "prompt", "starter": "prompt"}).withColumn("ideal", F.col("prompt"))
    return rows.select("doc_id", F.concat_ws("/", "run_passed", "run_total").alias("runtime"), *(F.expr(checks.render(n, "judged")).alias(n) for n in checks.CHECKS))


def q_sample_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 76 verdicts of every document, in long form."""
    return samples(spark, sf_dir).select("doc_id", F.inline(cells()))


def q_verdict_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    return rows.select("doc_id", stage_score(cells()).alias("score"), section_scores().alias("s"), critical_fails().alias("critical_fails"), *(count(cells(), v).alias(f"n_{v.lower()}") for v in VERDICTS)).select("doc_id", "score", "s.*", "critical_fails", *(f"n_{v.lower()}" for v in VERDICTS))


def q_subsection_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("doc_id", F.inline(subsection_scores()))


def q_usability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("doc_id", usability(F.col("runtime")).alias("u")).select("doc_id", "u.*")


def q_failing_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first checks that a document does not pass, how many there are, and how many fail, pass in part or are unclear for its prompt."""
    rows = samples(spark, sf_dir).select("doc_id", F.array_join(failures(cells(), SHOWN), "; ").alias("first_checks"), F.size(failures(cells())).alias("n"), counts_in(checks_of("prompt")).alias("p"))
    return rows.select("doc_id", "first_checks", "n", *(F.col(f"p.{v.lower()}").alias(f"prompt_{v.lower()}") for v in IMPERFECT))


def check_relationships(spark: SparkSession, sf_dir: str, signals: DataFrame) -> DataFrame:
    """The twenty strongest contrasts: of the samples that miss a check with the others, and of scores with the pass rate, given doc_id, rate and suspicious."""
    rows = samples(spark, sf_dir).select("doc_id", failures(cells()).alias("flags"), section_scores().alias("s"), stage_score(cells()).alias("stage"), critical_fails().cast("double").alias("critical"))
    scores = [f"section_{s}" for s in SECTIONS]
    rows = rows.select("doc_id", "flags", *(F.coalesce(f"s.{c}", F.lit(0.0)).alias(c) for c in scores), "stage", "critical")
    # Written: three aggregates read the rows, and the checks are matched once.
    rows = written(rows.join(signals.select("doc_id", "rate", "suspicious"), "doc_id"), "contrasts")
    return profile.top_rules(profile.contrasts(rows, F.col("flags")).unionByName(profile.score_correlations(rows, [*scores, "stage", "critical"])))


def q_check_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_relationships(spark, sf_dir, audit.signals(spark, sf_dir))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
_J = "judged"
_V = "sv AS (SELECT doc_id, run_passed || '/' || run_total runtime, " + ", ".join(f'{checks.render(n, _J, duck=True)} "{n}"' for n in checks.CHECKS) + " FROM (SELECT doc_id, coalesce(text, '') prompt, coalesce(text, '') ideal, coalesce(text, '') starter, " + ", ".join(f"{v} {k}" for k, v in GIVEN.items()) + " FROM (SELECT d.*, quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id)))"
_U = _V + ", su AS (UNPIVOT sv ON COLUMNS(* EXCLUDE (doc_id, runtime)) INTO NAME \"check\" VALUE verdict), sx AS (SELECT *, CASE verdict WHEN 'PASS' THEN 1.0 WHEN 'PARTIAL' THEN 0.5 WHEN 'UNCLEAR' THEN 0.25 WHEN 'FAIL' THEN 0.0 END v, verdict IN ('FAIL', 'PARTIAL', 'UNCLEAR') bad FROM su)"
_SCORED = f"""{_U}, sc AS (SELECT doc_id, coalesce(round(avg(v), 4), 0.0) score, {", ".join(f"round(avg(v) FILTER (starts_with(\"check\", '{s}')), 4) section_{s}" for s in SECTIONS)},
 count(*) FILTER (verdict = 'FAIL' AND (starts_with("check", '3.') OR starts_with("check", '4_') OR starts_with("check", '6.'))) critical_fails, {", ".join(f"count(*) FILTER (verdict = '{v}') n_{v.lower()}" for v in VERDICTS)} FROM sx GROUP BY 1)"""
#: Every relationship, beside the samples' ladders (s).
RELATED = f"""WITH {audit._S}, {_SCORED}, j AS (SELECT sc.doc_id, rate, suspicious::INT hot, sc.score stage, critical_fails critical, {", ".join(f"coalesce(section_{s}, 0) section_{s}" for s in SECTIONS)} FROM sc JOIN s ON s.doc_id = sc.doc_id),
 tt AS (SELECT count(*) tn, sum(rate) tr, sum(hot) ts, avg(rate) ar, avg(hot) ah FROM j), ee AS (SELECT "check" signal, count(*) n, sum(rate) r, sum(hot) h FROM sx JOIN j ON j.doc_id = sx.doc_id WHERE bad GROUP BY 1),
 ff AS (SELECT signal, 'failing_check' kind, n, n / tn share, r / n mean_rate, h / n suspicious_rate, r / n - (tr - r) / (tn - n) delta, h / n - (ts - h) / (tn - n) lift FROM ee, tt WHERE tn >= 10 AND n >= greatest(5, ceil(0.03 * tn)) AND tn > n
 UNION ALL """ + " UNION ALL ".join(f"SELECT '{c}', 'section_score', tn, 1.0, ar, ah, CASE WHEN rv = 0 THEN 0 ELSE corr_r END, CASE WHEN hv = 0 THEN 0 ELSE corr_h END FROM tt, (SELECT var_pop({c}) v, var_pop(rate) rv, var_pop(hot) hv, corr({c}, rate) corr_r, corr({c}, hot) corr_h FROM j) WHERE v > 0 AND tn >= 10" for c in [*(f"section_{s}" for s in SECTIONS), "stage", "critical"]) + """),
 gg AS (SELECT *, round((abs(delta) + 0.5 * abs(lift)) * greatest(share, 0.05) + 1e-9, 4) strength FROM ff),
 related AS (SELECT signal, kind, n, round(share + 1e-9, 4) share, round(mean_rate + 1e-9, 4) mean_rate, round(suspicious_rate + 1e-9, 4) suspicious_rate, round(delta + 1e-9, 4) delta, round(lift + 1e-9, 4) lift, strength, CASE WHEN kind = 'section_score' OR n >= 20 OR share >= 0.15 THEN 'broad' WHEN n >= 10 OR share >= 0.08 THEN 'moderate' ELSE 'narrow' END reliability
 FROM gg)"""
ORACLE = {
    "sample_verdicts": f'WITH {_U} SELECT doc_id, "check", verdict FROM su',
    "verdict_scores": f"WITH {_SCORED} SELECT * FROM sc",
    "subsection_scores": f"""WITH {_U} SELECT doc_id, string_split("check", '_')[1] subsection, round(avg(v), 4) mean, CASE WHEN count(v) > 0 THEN NULL WHEN count(*) FILTER (verdict <> 'NA') = 0 THEN 'NA' END "label" FROM sx GROUP BY 1, 2""",
    "usability": f"""WITH {_V}, ug AS (SELECT *, split_part(runtime, '/', 1)::INT / split_part(runtime, '/', 2)::INT share,
 list_contains([{", ".join(f'"{n}"' for n in checks.CHECKS if n[:2] in ("1.", "7_"))}, "6.1_prompt_test_solution_aligned", "6.2_model_breaking_prompt_defined_only", "6.2_no_unmentioned_internal_logic", "6.1_output_schema_aligned"]::VARCHAR[], 'FAIL') pf,
 len(list_filter([{", ".join(f'"{n}"' for n in checks.CHECKS if n[:2] in ("1.", "7_"))}, "6.1_prompt_test_solution_aligned", "6.2_model_breaking_prompt_defined_only", "6.2_no_unmentioned_internal_logic", "6.1_output_schema_aligned"], lambda x: x IN ('FAIL', 'PARTIAL', 'UNCLEAR'))) > 0 pb,
 len(list_filter([{", ".join(f'"{n}"' for n in checks.CHECKS if n.startswith("2."))}, "6.1_prompt_test_solution_aligned", "6.2_model_breaking_prompt_defined_only", "6.2_no_unmentioned_internal_logic"], lambda x: x IN ('FAIL', 'PARTIAL', 'UNCLEAR'))) > 0 ib,
 len(list_filter([{", ".join(f'"{n}"' for n in checks.CHECKS if n[0] in "346")}], lambda x: x IN ('FAIL', 'PARTIAL', 'UNCLEAR'))) > 0 tb, "6.1_prompt_test_solution_aligned" = 'FAIL' al, "6.2_model_breaking_prompt_defined_only" = 'FAIL' de, "6.2_no_unmentioned_internal_logic" = 'FAIL' un FROM sv)
 SELECT doc_id, CASE WHEN "1.1_function_signature_present" = 'FAIL' OR ("1.2_not_vague" = 'FAIL' AND "1.2_no_conflicting_objectives" = 'FAIL' AND ("1.2_practical_algorithmic_problem" = 'FAIL' OR "1.2_no_unrealistic_constraints" = 'FAIL')) OR (al AND de AND un) THEN 'Unusable' WHEN pb THEN 'Needs Fixing' ELSE 'Usable' END prompt,
 CASE WHEN "2.3_executes_without_error" = 'FAIL' OR "2.3_passes_internal_tests" = 'FAIL' OR share < 0.5 OR (al AND de AND un) THEN 'Unusable' WHEN ib OR share < 1 THEN 'Needs Fixing' ELSE 'Usable' END ideal,
 CASE WHEN "3.3_json_encoded" = 'FAIL' OR "3.3_string_fields" = 'FAIL' OR "6.2_no_extra_parameters" = 'FAIL' OR (al AND de) OR ("4_cross_verified_dry_run" = 'FAIL' AND al) OR ("3.3_json_escaping_valid" = 'FAIL' AND ("3.3_input_json_object" = 'FAIL' OR "3.3_output_json_object" = 'FAIL')) THEN 'Unusable' WHEN tb THEN 'Needs Fixing' ELSE 'Usable' END tests FROM ug""",
    "failing_checks": f"""WITH {_U}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, bad ORDER BY "check") i FROM sx)
 SELECT doc_id, coalesce(string_agg("check", '; ' ORDER BY "check") FILTER (bad AND i <= 8), '') first_checks, count(*) FILTER (bad) n, {", ".join(f"count(*) FILTER (verdict = '{v}' AND (starts_with(\"check\", '1.') OR starts_with(\"check\", '7_'))) prompt_{v.lower()}" for v in IMPERFECT)} FROM k GROUP BY 1""",
    "check_relationships": f"{RELATED} SELECT * FROM related ORDER BY strength DESC, n DESC, signal LIMIT 20",
}
