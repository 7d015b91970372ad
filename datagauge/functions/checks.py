"""The 76 column checks of a sample as verdict ladders over its texts and facts.

A ladder is a list of (condition, verdict) pairs and a last verdict; the first condition that holds decides. Conditions are SQL over the columns of
``operators.checks.facts``: ``#name`` stands for the number of matches of a pattern, ``@name`` for whether there is any, ``$judged`` for the verdict
of an external judge (UNCLEAR where there is none). Both Spark's and DuckDB's SQL are rendered from the same text.
"""

from __future__ import annotations

import re

# Patterns, by name: the column they are searched in, and the expression.
PATTERNS = {
    "objective": ("prompt", r"(?i)objective"),
    "constraints": ("prompt", r"(?i)constraints"),
    "input": ("prompt", r"(?i)input"),
    "output": ("prompt", r"(?i)output"),
    "function_signature": ("prompt", r"(?i)function signature"),
    "inflated": ("prompt", r"(?i)microsecond|nanosecond|ultra-fast|extreme load|fault tolerance|thread safety|lock-free|heavy-light decomposition|segment tree|trie|abc\b|distributed signal tracking|real-time"),
    "input_word": ("prompt", r"(?i)\bInput\b"),
    "output_word": ("prompt", r"(?i)\bOutput\b"),
    "constraint_word": ("prompt", r"(?i)\bConstraint"),
    "limits": ("prompt", r"(?i)O\(|time complexity|space complexity|[<>≤≥]=?\s*\d"),
    "edge": ("prompt", r"(?i)edge case|empty|invalid|error|return [^\n]* if|if [^\n]* return"),
    "returns": ("prompt", r"(?i)return"),
    "signed": ("prompt", r"def\s+\w+\s*\("),
    "libraries": ("prompt", r"(?i)numpy|pandas|scipy|tensorflow|torch|sklearn"),
    "stdlib": ("prompt", r"(?i)no external libr|standard libr|pure python only"),
    "words": ("prompt", r"[^ \t\n\r\f\x0B]+"),
    "headings": ("prompt", r"(?m)^#+\s|^[-*]\s|^\d+\."),
    "systems": ("prompt", r"(?i)segment tree|heavy-light decomposition|trie|alpha-beta|iterative deepening|thread|concurrent|lock|fault tolerance|near real-time|distributed|microsecond|nanosecond"),
    "minimize": ("prompt", r"(?i)minimize"),
    "maximize": ("prompt", r"(?i)maximize"),
    "must": ("prompt", r"(?i)must"),
    "should": ("prompt", r"(?i)should"),
    "advanced": ("prompt", r"(?i)segment tree|heavy-light decomposition|trie|alpha-beta|iterative deepening|union-find|backtracking|concurrent|thread|lock|real-time|fault tolerance|distributed|multi-phase"),
    "example": ("prompt", r"(?i)sample input|sample output|Example"),
    "unrealistic": ("prompt", r"(?i)microsecond|nanosecond|extreme load|fault tolerance|thread safety|lock-free|concurrent optimization|near real-time|distributed signal tracking"),
    "detail": ("prompt", r"(?i)return|output|must|constraints|input format|output format|function signature|sample input|sample output"),
    "conflict": ("prompt", r"(?i)minimi\w+[^\n]*maximi\w+|optimality[^\n]*computational overhead|latency[^\n]*fault tolerance|scalability[^\n]*near-microsecond|safest possible[^\n]*shortest path|balance [^\n]* and [^\n]* and [^\n]*"),
    "buzz": ("prompt", r"(?i)world-class|state-of-the-art|ultra-competitive|near-microsecond|fault tolerance|multi-layered decision engine|compressed heavy-light decomposition|lock-free|rapidly transforming"),
    "time_window": ("prompt", r"(?i)time window"),
    "random_word": ("prompt", r"(?i)\brandom\b"),
    "number_keys": ("prompt", r"\{\s*\d+\s*:"),
    "random_prompt": ("prompt", r"(?i)\b(?:random|time\.time|datetime\.now|uuid)\b"),
    "random_ideal": ("ideal", r"(?i)\b(?:random|time\.time|datetime\.now|uuid)\b"),
    "mutable": ("ideal", r"(?m)^[a-z_][a-z0-9_]*\s*=\s*(?:\{|\[|set\(|defaultdict\(|dict\(|list\()"),
    "constant": ("ideal", r"(?m)^[A-Z_][A-Z0-9_]*\s*="),
    "docs": ("ideal", r"\x22{3}|(?:^|[^\p{L}\p{N}_])[a-z_]{3,}(?:$|[^\p{L}\p{N}_])"),
    "arbitrary": ("ideal", r"\bMAX_(?:ITERATIONS|DEPTH)\b|\bBASE_MAX_ITERATIONS\b"),
    "code_lines": ("ideal", r"[^\n]*\S[^\n]*"),
    "main": ("ideal", r"if\s+__name__\s*==\s*[\x22\x27]__main__[\x22\x27]"),
    "parallel": ("ideal", r"\b(?:threading|multiprocessing|ThreadPoolExecutor|ProcessPoolExecutor|concurrent\.futures)\b"),
    "mp": ("ideal", r"\bmultiprocessing\b|Pool\s*\("),
    "nested_def": ("ideal", r"(?m)^\s{4,}def\s+\w+\s*\("),
    "with_pool": ("ideal", r"with\s+(?:multiprocessing\.)?Pool\s*\("),
    "sequential": ("ideal", r"(?i)sequential|fallback|if\s+not\s+use_multiprocessing"),
    "future": ("ideal", r"(?m)^\s*from\s+__future__\s+import"),
    "memo": ("ideal", "memo"),
    "cache": ("ideal", "cache"),
    "lru_cache": ("ideal", "lru_cache"),
    "third_party": ("ideal", r"(?m)^\s*(?:from|import)\s+(?:numpy|pandas|scipy|sklearn|torch|tensorflow)\b"),
    "signed_starter": ("starter", r"def\s+\w+\s*\("),
}


def _some(*names: str) -> str:
    return " + ".join(f"CAST(@{n} AS INT)" for n in names)


def _one(cond: str, yes: str = "PASS", no: str = "FAIL") -> list:
    return [(cond, yes), no]


_LAYOUT = _some("objective", "constraints", "input", "output", "function_signature")
_TARGET = _some("minimize", "maximize", "returns", "output", "must", "should")
_MEMO = "#memo + #cache + #lru_cache"
_NAMED = "coalesce(trim(function_name), '') <> ''"
_ADDED = [("contains(ideal, 'CLEAR RULES') AND NOT contains(prompt, 'CLEAR RULES')", "FAIL")]
_EXTRA = [("extra_errors > 0", "FAIL"), ("missing_keys > 2", "FAIL")]


def _ratio(count: str, first: list | None = None) -> list:
    return [*(first or []), (f"n_tests > 0 AND {count} = n_tests", "PASS"), (f"n_tests > 0 AND 2 * {count} >= n_tests", "PARTIAL"), "FAIL"]


PROMPT = {
    "1.1_structured_layout": [(f"{_LAYOUT} >= 3", "PASS"), (f"{_LAYOUT} >= 1", "PARTIAL"), "FAIL"],
    "1.1_realistic_context": [("#inflated >= 4", "FAIL"), ("#inflated >= 2 AND $judged = 'PASS'", "PARTIAL"), "$judged"],
    "1.1_input_format_explicit": _one("@input_word"),
    "1.1_output_format_explicit": _one("@output_word"),
    "1.1_constraints_defined": _one("@constraint_word"),
    "1.1_computational_limits_defined": [("@limits", "PASS"), ("@constraint_word", "PARTIAL"), "FAIL"],
    "1.1_edge_cases_defined": _one("@edge"),
    "1.1_return_conditions_defined": _one("@returns"),
    "1.1_function_signature_present": _one("@signed"),
    "1.1_no_external_libs_stated": [("@libraries", "FAIL"), ("@stdlib", "PASS"), "PARTIAL"],
    "1.1_not_verbose": [("#words > 1700 OR (#words > 1300 AND #headings > 18)", "FAIL"), ("#words < 950", "PASS"), ("#words > 1200 AND $judged = 'PASS'", "PARTIAL"), "$judged"],
    "1.2_practical_algorithmic_problem": [("#systems >= 5", "FAIL"), ("#systems >= 3 AND $judged = 'PASS'", "PARTIAL"), "$judged"],
    "1.2_measurable_objective": [(f"{_TARGET} >= 3", "PASS"), (f"{_TARGET} >= 1", "PARTIAL"), "FAIL"],
    "1.2_difficulty_balanced": [
        ("lower(difficulty) = 'easy' AND (#advanced >= 3 OR #words > 1000)", "FAIL"),
        ("lower(difficulty) = 'easy' AND (#advanced >= 2 OR #words > 750)", "PARTIAL"),
        ("lower(difficulty) = 'medium' AND (#advanced >= 6 OR #words > 1500)", "FAIL"),
        ("lower(difficulty) = 'medium' AND (#advanced >= 4 OR #words > 1100)", "PARTIAL"),
        ("lower(difficulty) = 'hard' AND #words < 220 AND #advanced = 0", "FAIL"),
        ("lower(difficulty) = 'hard' AND ((#advanced <= 1 AND #words < 320) OR #words > 1800)", "PARTIAL"),
        ("lower(difficulty) IN ('easy', 'medium', 'hard')", "PASS"),
        "PARTIAL",
    ],
    "1.2_example_present": _one("@example"),
    "1.2_no_unrealistic_constraints": [("#unrealistic >= 2", "FAIL"), ("#unrealistic = 1 AND $judged = 'PASS'", "PARTIAL"), "$judged"],
    "1.2_not_vague": [("#detail <= 2", "FAIL"), ("#detail <= 4 AND $judged = 'PASS'", "PARTIAL"), "$judged"],
    "1.2_no_conflicting_objectives": [("#conflict >= 2", "FAIL"), ("#conflict = 1 AND $judged = 'PASS'", "PARTIAL"), "$judged"],
    "1.2_no_buzzwords": [("#buzz >= 3", "FAIL"), ("#buzz >= 1 AND $judged = 'PASS'", "PARTIAL"), "$judged"],
    "1.2_no_time_window_constraints": _one("@time_window", "FAIL", "PASS"),
    "1.2_no_random_requirement": _one("@random_word", "FAIL", "PASS"),
    "3.3_no_nonstring_keys": _one("@number_keys", "FAIL", "PASS"),
}
SOLUTION = {
    "2.1_no_globals": [("@mutable", "FAIL"), ("#constant >= 4", "PARTIAL"), "PASS"],
    "2.1_consistent_naming_docs": _one("@docs", "PASS", "PARTIAL"),
    "2.1_no_arbitrary_limits": _one("@arbitrary", "FAIL", "PASS"),
    "2.1_no_sample_io_in_main": _one("@main", "FAIL", "PASS"),
    "2.1_no_parallelism": _one("@parallel", "FAIL", "PASS"),
    "2.1_deterministic_solution": _one("@random_ideal", "FAIL", "PASS"),
    "2.1_mp_module_level_functions": [("NOT @mp", "NA"), ("@nested_def", "FAIL"), "PASS"],
    "2.1_mp_context_manager": [("NOT @mp", "NA"), ("@with_pool", "PASS"), "FAIL"],
    "2.1_mp_sequential_fallback": [("NOT @mp", "NA"), ("@sequential", "PASS"), "FAIL"],
    "2.2_no_future_import": _one("@future", "FAIL", "PASS"),
    "2.2_no_redundant_memoization": [(f"{_MEMO} <= 2", "PASS"), (f"{_MEMO} <= 4", "PARTIAL"), "FAIL"],
    "2.2_clear_variable_names": ["$judged"],
    "2.2_no_nested_helpers": [("#nested_def = 0", "PASS"), ("#nested_def = 1", "PARTIAL"), "FAIL"],
    "2.2_stdlib_only": _one("@third_party", "FAIL", "PASS"),
}
COUNTS = {
    "3.2_min_5_public": _one("n_public >= 5"),
    "3.2_min_10_private": _one("n_private >= 10"),
    "3.2_recommended_15_20_total": [("n_tests BETWEEN 15 AND 20", "PASS"), ("n_tests BETWEEN 10 AND 30", "PARTIAL"), "FAIL"],
    "3.4_not_large_or_redundant": [("n_tests <= 30 AND private_chars <= 50000", "PASS"), ("n_tests <= 60", "PARTIAL"), "FAIL"],
    "4_coverage_confidence": [("n_tests >= 15", "PASS"), ("n_tests >= 10", "PARTIAL"), "FAIL"],
}
_RUN = [("run_total > 0 AND run_passed = run_total", "PASS"), ("run_passed > 0", "PARTIAL"), "FAIL"]
FACTS = {
    "1.1_metadata_alignment": [(f"NOT ({_NAMED})", "UNCLEAR"), ("n_names >= 3", "FAIL"), ("n_names = 2 OR NOT contains(lower(prompt), lower(trim(function_name)))", "PARTIAL"), "PASS"],
    "1.3_json_compatible_signature": [("NOT @signed AND NOT @signed_starter", "FAIL"), ("@signed AND prompt_bad_types", "FAIL"), "PASS"],
    "2.1_state_encapsulated": _one("contains(ideal, 'class ') OR ideal_functions >= 1", "PASS", "PARTIAL"),
    "2.1_single_entry_aligned": _one(f"{_NAMED} AND contains(ideal, trim(function_name))", "PASS", "PARTIAL"),
    "2.1_helpers_for_repeated_logic": [("ideal_functions > 1 OR contains(ideal, 'class ') OR #code_lines <= 45", "PASS"), ("#code_lines > 120", "FAIL"), "PARTIAL"],
    "2.2_no_keyword_only_args": _one("ideal_kwonly = 0"),
    "2.3_executes_without_error": _one("run_ok"),
    "2.3_passes_internal_tests": _RUN,
    "3.1_single_call_per_test": _ratio("n_arity", [("starter_arity <= 0", "FAIL")]),
    "3.1_public_test1_matches_prompt_example": [("NOT @example", "NA"), ("n_public = 0", "FAIL"), ("example_in IS NULL", "UNCLEAR"), ("example_in = first_in AND example_out = first_out", "PASS"), ("example_in = first_in OR example_out = first_out", "PARTIAL"), "FAIL"],
    "3.2_deterministic": _one("@random_prompt OR @random_ideal", "FAIL", "PASS"),
    "3.2_entry_function_only": _one(_NAMED, "PASS", "UNCLEAR"),
    "3.3_json_encoded": _one("n_fields = n_tests"),
    "3.3_string_fields": _one("n_fields = n_tests"),
    "3.3_input_json_object": _ratio("n_in_object"),
    "3.3_output_json_object": _ratio("n_out_object"),
    "3.3_json_escaping_valid": [("n_braced = n_parsed", "PASS"), ("n_parsed > 0", "PARTIAL"), "FAIL"],
    "3.3_optional_values_included": _ratio("n_arity", [("starter_defaults <= 0", "NA")]),
    "3.3_no_python_literals": _one("n_literals > 0", "FAIL", "PASS"),
    "3.3.1_exception_tests_aligned": [("n_errors = 0", "NA"), ("extra_errors > 0", "FAIL"), "PARTIAL"],
    "4_cross_verified_dry_run": _RUN,
    "6.1_prompt_test_solution_aligned": [*_ADDED, *_EXTRA, ("rules_must > 0", "FAIL"), "$judged"],
    "6.1_entry_name_consistent": [("n_names = 1", "PASS"), ("n_names = 2", "PARTIAL"), "FAIL"],
    "6.1_signature_arity_consistent": [("n_tests = 0", "UNCLEAR"), ("n_over = 0", "PASS"), "FAIL"],
    "6.1_output_schema_aligned": [("missing_keys = 0", "PASS"), ("missing_keys <= 2", "PARTIAL"), "FAIL"],
    "6.2_model_breaking_prompt_defined_only": [*_EXTRA, ("rules_plain > 0", "FAIL"), "$judged"],
    "6.2_no_extra_parameters": _one("n_over > 0", "FAIL", "PASS"),
    "6.2_no_unmentioned_internal_logic": [*_ADDED, ("extra_errors > 0", "FAIL"), ("rules_tie > 0", "FAIL"), "$judged"],
    "6.3_prompt_edge_cases_tested": [("n_edges = 0", "NA"), ("edges_tested >= least(2, n_edges)", "PASS"), "$judged"],
    "6.3_prompt_constraints_tested": [("n_limits = 0", "NA"), ("limits_tested >= least(3, greatest(1, floor(n_limits / 3)))", "PASS"), "$judged"],
    "7_necessary_imports": _one("n_missing_imports = 0", "PASS", "PARTIAL"),
    "7_only_entry_signature": [("starter_functions = 1 AND starter_classes = 0 AND starter_extra = 0", "PASS"), ("starter_functions = 1", "PARTIAL"), "FAIL"],
    "7_no_classes": _one("starter_classes = 0"),
    "7_no_helpers": _one("starter_functions <= 1"),
    "7_no_logic": _one("starter_extra = 0"),
}
CHECKS = dict(sorted((PROMPT | SOLUTION | COUNTS | FACTS).items()))


def render(name: str, judged: str, duck: bool = False) -> str:
    """SQL of a check's verdict; ``judged`` is the SQL of the judge's verdict. Spark's reads the columns of ``patterns.matched``."""

    def hits(m: re.Match) -> str:
        if not duck:
            return f"m_{m[2]}" if m[1] == "#" else f"(m_{m[2]} > 0)"
        column, pattern = PATTERNS[m[2]]
        return f"len(regexp_extract_all({column}, '{pattern}'))" if m[1] == "#" else f"regexp_matches({column}, '{pattern}')"

    *ladder, last = CHECKS[name]
    cases = "".join(f" WHEN {re.sub('([#@])([a-z_]+)', hits, cond.replace('$judged', judged))} THEN '{verdict}'" for cond, verdict in ladder)
    end = judged if last == "$judged" else f"'{last}'"
    return f"CASE{cases} ELSE {end} END" if cases else end
