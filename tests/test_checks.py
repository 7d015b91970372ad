"""The column checks on samples whose verdicts are known."""

import pytest

from datagauge.functions import checks
from datagauge.functions.code import signature
from datagauge.operators.checks import SAMPLES, long, verdicts

PROMPT = "Objective: return the sum.\nConstraints: n <= 10, time complexity O(n)\nFunction signature:\n```python\ndef add(a: int, b: int) -> int:\n```\nSample Input\n```\n1\n2\n```\nSample Output\n```\n3\n```\nAn empty input is an error: {'error': 'bad'}. Output must be a number with no external libraries."
IDEAL = "```python\ndef add(a, b):\n    # must be exactly positive\n    return a + b\n```"
TEST = ("1\n2", "3", "functional")


#: Inflated prompt, sprawling solution, crowded starter, tests that don't fit.
WORST_PROMPT = "A world-class, state-of-the-art, rapidly transforming engine with microsecond and nanosecond limits, thread safety, fault tolerance, a segment tree, a trie and alpha-beta search.\nminimize cost and maximize gain\nscalability at near-microsecond speed\nTasks have a time window. Keys: {1: 2}. Example\nSample Input\n```\n9\n```\nSample Output\n```\n8\n```\n" + "word " * 1800
WORST_IDEAL = "from __future__ import annotations\nimport multiprocessing, random\nMAX_DEPTH = 3\nmemo = {}\ndef f(x):\n    def inner():\n        return memo\n    def other():\n        return lru_cache, cache\n    with multiprocessing.Pool() as p:\n        return p\nif __name__ == '__main__':\n    f(1)\n"
#: What a judge decides is passed, and so is nearly all else.
BEST_PROMPT = "Objective: minimize the cost and return the output. You must treat empty and invalid rows.\nInput and Output: objects. Constraints: at most 5.\nFunction signature: def best(rows: list) -> dict:\nOn an error return {'error': 'bad'}."
JUDGED = ("1.1_realistic_context", "1.2_practical_algorithmic_problem", "1.2_no_unrealistic_constraints", "1.2_not_vague", "1.2_no_conflicting_objectives", "1.2_no_buzzwords", "2.2_clear_variable_names", "6.1_prompt_test_solution_aligned", "6.2_model_breaking_prompt_defined_only", "6.2_no_unmentioned_internal_logic", "6.3_prompt_edge_cases_tested", "6.3_prompt_constraints_tested")


@pytest.fixture(scope="module")
def got(spark):
    good = (1, PROMPT, "def add(a, b):\n    pass", IDEAL, "add", "easy", [TEST] * 6, [TEST] * 10, True, 16, 16, {"1.2_not_vague": "PASS"}, "extra")
    bad = (2, "numpy random", "from typing import List\nX = 1\nclass A:\n    def f(self, x: Dict) -> Set: pass", "import numpy\nx = []\ndef g(*, k):\n    pass", "h", "odd", [('{"a": None', '{"error": "no", "zz": 1}', None)], None, False, 0, 1, None, "extra")
    none = (3, None, None, None, None, None, None, None, None, None, None, None, "extra")
    worst = (4, WORST_PROMPT, "def f(x=1):\n    pass\ndef g():\n    pass", WORST_IDEAL, " ", "hard", [("1\n2", '{"zzqa": 1, "zzqb": 2, "zzqc": 3}', "t")], [("1", "{oops", "t")] * 69, True, 3, 70, None, "extra")
    case = ('{"rows": "empty, invalid, at most"}', '{"error": "bad"}', "t")
    best = (5, BEST_PROMPT, "from typing import List\ndef best(rows=None):\n    pass", "def best(rows):\n" + "    x = 1\n" * 130, "best", "medium", [case] * 5, [case] * 10, True, 15, 15, dict.fromkeys(JUDGED, "PASS"), "extra")
    rows = spark.createDataFrame([good, bad, none, worst, best], SAMPLES + ", lang string")
    out = {i: {} for i in range(1, 6)}
    for r in long(verdicts(rows)).collect():
        out[r["sample_id"]][r["check"]] = r["verdict"]
    return out


def test_every_check_gives_a_verdict(got):
    assert len(checks.CHECKS) == 76
    assert all(set(v) == set(checks.CHECKS) and set(v.values()) <= {"PASS", "PARTIAL", "FAIL", "NA", "UNCLEAR"} for v in got.values())


@pytest.mark.parametrize("sample, check, verdict", [
    (1, "1.1_structured_layout", "PASS"), (1, "1.1_metadata_alignment", "PASS"), (1, "1.1_no_external_libs_stated", "PASS"), (1, "1.2_not_vague", "PASS"),
    (1, "1.1_realistic_context", "UNCLEAR"), (1, "1.2_difficulty_balanced", "PASS"), (1, "1.3_json_compatible_signature", "PASS"), (1, "2.3_passes_internal_tests", "PASS"),
    (1, "3.1_single_call_per_test", "PASS"), (1, "3.1_public_test1_matches_prompt_example", "PASS"), (1, "3.2_recommended_15_20_total", "PASS"), (1, "3.3_input_json_object", "FAIL"),
    (1, "3.3_json_escaping_valid", "PASS"), (1, "3.3.1_exception_tests_aligned", "NA"), (1, "6.1_prompt_test_solution_aligned", "FAIL"), (1, "6.2_no_extra_parameters", "PASS"),
    (1, "6.3_prompt_edge_cases_tested", "UNCLEAR"), (1, "7_only_entry_signature", "PASS"), (1, "7_no_logic", "PASS"),
    (2, "1.1_metadata_alignment", "FAIL"), (2, "1.1_no_external_libs_stated", "FAIL"), (2, "1.2_difficulty_balanced", "PARTIAL"), (2, "1.2_no_random_requirement", "FAIL"),
    (2, "2.1_no_globals", "FAIL"), (2, "2.2_no_keyword_only_args", "FAIL"), (2, "2.2_stdlib_only", "FAIL"), (2, "3.3_json_encoded", "FAIL"), (2, "3.3_json_escaping_valid", "PARTIAL"),
    (2, "3.3_no_python_literals", "FAIL"), (2, "3.3.1_exception_tests_aligned", "FAIL"), (2, "6.1_output_schema_aligned", "PARTIAL"), (2, "7_necessary_imports", "PARTIAL"),
    (2, "7_no_classes", "FAIL"), (2, "7_no_logic", "FAIL"), (3, "6.1_signature_arity_consistent", "UNCLEAR"), (3, "2.3_executes_without_error", "FAIL"), (3, "3.2_min_5_public", "FAIL"),
])
def test_verdict(got, sample, check, verdict):
    assert got[sample][check] == verdict


#: Verdicts of the last two samples, worked out from the rules: first of the one that fails most, then of the one that passes most.
EXPECTED = {
    "1.1_structured_layout": ("PARTIAL", "PASS"), "1.1_realistic_context": ("FAIL", "PASS"), "1.1_input_format_explicit": ("PASS", "PASS"), "1.1_output_format_explicit": ("PASS", "PASS"), "1.1_constraints_defined": ("FAIL", "PASS"),
    "1.1_computational_limits_defined": ("FAIL", "PARTIAL"), "1.1_edge_cases_defined": ("FAIL", "PASS"), "1.1_return_conditions_defined": ("FAIL", "PASS"), "1.1_function_signature_present": ("FAIL", "PASS"), "1.1_no_external_libs_stated": ("PARTIAL", "PARTIAL"),
    "1.1_metadata_alignment": ("UNCLEAR", "PASS"), "1.1_not_verbose": ("FAIL", "PASS"), "1.2_practical_algorithmic_problem": ("FAIL", "PASS"), "1.2_measurable_objective": ("PASS", "PASS"), "1.2_difficulty_balanced": ("PARTIAL", "PASS"),
    "1.2_example_present": ("PASS", "FAIL"), "1.2_no_unrealistic_constraints": ("FAIL", "PASS"), "1.2_not_vague": ("FAIL", "PASS"), "1.2_no_conflicting_objectives": ("FAIL", "PASS"), "1.2_no_buzzwords": ("FAIL", "PASS"), "1.2_no_time_window_constraints": ("FAIL", "PASS"),
    "1.2_no_random_requirement": ("PASS", "PASS"), "1.3_json_compatible_signature": ("PASS", "PASS"), "2.1_no_globals": ("FAIL", "PASS"), "2.1_state_encapsulated": ("PASS", "PASS"), "2.1_consistent_naming_docs": ("PASS", "PASS"), "2.1_no_arbitrary_limits": ("FAIL", "PASS"),
    "2.1_single_entry_aligned": ("PARTIAL", "PASS"), "2.1_helpers_for_repeated_logic": ("PASS", "FAIL"), "2.1_no_sample_io_in_main": ("FAIL", "PASS"), "2.1_no_parallelism": ("FAIL", "PASS"), "2.1_deterministic_solution": ("FAIL", "PASS"), "2.1_mp_module_level_functions": ("FAIL", "NA"),
    "2.1_mp_context_manager": ("PASS", "NA"), "2.1_mp_sequential_fallback": ("FAIL", "NA"), "2.2_no_keyword_only_args": ("PASS", "PASS"), "2.2_no_future_import": ("FAIL", "PASS"), "2.2_no_redundant_memoization": ("FAIL", "PASS"), "2.2_clear_variable_names": ("UNCLEAR", "PASS"),
    "2.2_no_nested_helpers": ("FAIL", "PASS"), "2.2_stdlib_only": ("PASS", "PASS"), "2.3_executes_without_error": ("PASS", "PASS"), "2.3_passes_internal_tests": ("PARTIAL", "PASS"), "3.1_single_call_per_test": ("PARTIAL", "PASS"), "3.1_public_test1_matches_prompt_example": ("FAIL", "NA"),
    "3.2_min_5_public": ("FAIL", "PASS"), "3.2_min_10_private": ("PASS", "PASS"), "3.2_recommended_15_20_total": ("FAIL", "PASS"), "3.2_deterministic": ("FAIL", "PASS"), "3.2_entry_function_only": ("UNCLEAR", "PASS"), "3.3_json_encoded": ("PASS", "PASS"), "3.3_string_fields": ("PASS", "PASS"),
    "3.3_input_json_object": ("FAIL", "PASS"), "3.3_output_json_object": ("PASS", "PASS"), "3.3_json_escaping_valid": ("PARTIAL", "PASS"), "3.3_optional_values_included": ("PARTIAL", "PASS"), "3.3_no_python_literals": ("PASS", "PASS"), "3.3_no_nonstring_keys": ("FAIL", "PASS"),
    "3.3.1_exception_tests_aligned": ("NA", "PARTIAL"), "3.4_not_large_or_redundant": ("FAIL", "PASS"), "4_coverage_confidence": ("PASS", "PASS"), "4_cross_verified_dry_run": ("PARTIAL", "PASS"), "6.1_prompt_test_solution_aligned": ("FAIL", "PASS"), "6.1_entry_name_consistent": ("PASS", "PASS"),
    "6.1_signature_arity_consistent": ("FAIL", "PASS"), "6.1_output_schema_aligned": ("FAIL", "PASS"), "6.2_model_breaking_prompt_defined_only": ("FAIL", "PASS"), "6.2_no_extra_parameters": ("FAIL", "PASS"), "6.2_no_unmentioned_internal_logic": ("UNCLEAR", "PASS"), "6.3_prompt_edge_cases_tested": ("NA", "PASS"),
    "6.3_prompt_constraints_tested": ("UNCLEAR", "PASS"), "7_necessary_imports": ("PASS", "PASS"), "7_only_entry_signature": ("FAIL", "PASS"), "7_no_classes": ("PASS", "PASS"), "7_no_helpers": ("FAIL", "PASS"), "7_no_logic": ("PASS", "PASS"),
}


def test_all_verdicts(got):
    assert set(EXPECTED) == set(checks.CHECKS)
    assert {n: (got[4][n], got[5][n]) for n in EXPECTED if (got[4][n], got[5][n]) != EXPECTED[n]} == {}


def test_signature():
    assert signature("def f(a, b=1, *, c: Dict[int, str] = None): pass") == (1, 0, "f", 3, 1, 2, True)
    assert signature("def f(x: List[str]) -> Dict[str, int]")[:4] == (1, 0, "f", 1) and signature(None) == (0, 0, None, 0, 0, 0, False)
