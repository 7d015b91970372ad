"""The one-pass matcher against each pattern searched by itself."""

import random
import re

import pyarrow as pa

from datagauge.functions import checks, patterns

WORDS = ["", "a", "Input", "inputs", "OUTPUT", "constraint", "Constraints", "return", "if", "def f(", "def  ü1 (", "O(n)", "< 5", "≤3", "==", "x = {", "X=1", "import numpy", "from torch import x", "Pool(", "with Pool (", "multiprocessing", "time.time", "RANDOM", "random2", "#", "- x", "1. y", "{ 3 :", "abc", "abcd", "trie", "balance a and b and c", "minimize the maximum", "maximize", "minimise x maximise", "memo", "lru_cache", "__name__", 'if __name__ == "__main__"', "from __future__ import", "    def g(", "MAX_DEPTH", "real-time", "edge case", "ÄRGER", " ", " ", "\t", "\u0130nput", "\u0131nput", "mu\u017ft", "loc\u212a", "sample input", "function signature", "no external libraries", "sequential", "if not use_multiprocessing", "thread", "''' doc", '"""']


def alone(name, counted, text):
    n = len(re.findall(patterns.PATTERNS[name][1].replace(r"[^\p{L}\p{N}_]", r"\W"), text))
    return n if counted else int(n > 0)


def test_matches_of_every_pattern():
    used = patterns.used(checks.CHECKS)
    assert {checks.PATTERNS[p][0] for p in used} == {"prompt", "ideal", "starter"} and len(used) > 45
    rng, count, seen = random.Random(3), patterns.matcher(used), set()
    for _ in range(400):
        text = "".join(w + rng.choice([" ", "\n", "", "_", "."]) for w in rng.choices(WORDS, k=rng.randrange(14)))
        want = [alone(p, c, text) for p, c in used.items()]
        assert count(text) == want, text
        seen |= {p for p, n in zip(used, want, strict=True) if n}
    missed = set(used) - seen - {"buzz", "time_window", "objective", "should", "must", "unrealistic", "advanced", "systems", "inflated", "conflict"}
    assert not missed


def test_columns(spark):
    rows = spark.createDataFrame([(1, "Input return input", None, "x"), (2, None, "memo memo = cache\n" * 50_000, "y"), (3, "", "", "z")], "id long, prompt string, ideal string, starter string")
    got = {r["id"]: r for r in patterns.matched(rows, checks.CHECKS).collect()}
    assert got[1]["m_input"] == got[1]["m_returns"] == 1 and got[1]["m_words"] == 3 and got[1]["m_memo"] is None and got[1]["starter"] == "x"
    assert got[2]["m_memo"] == 100_000 and got[2]["m_words"] is None and got[3]["m_words"] == 0
    same = patterns.matched(rows.drop("ideal", "starter"), ["2.2_no_redundant_memoization"], {"ideal": "prompt"})
    assert same.columns == ["id", "prompt", "m_cache", "m_lru_cache", "m_memo"] and same.count() == 3
    assert patterns.matched(rows.limit(0), checks.CHECKS).count() == 0


def test_batches_are_taken_in_pieces():
    batch = pa.RecordBatch.from_pydict({"prompt": ["a" * 10, None, "b" * 30, "", "c" * 5, "d" * 5], "k": [1, 2, 3, 4, 5, 6]})
    got = list(patterns.pieces(batch, ["prompt"], 12))
    assert [p.num_rows for p in got] == [2, 1, 3] and pa.Table.from_batches(got).to_pydict() == batch.to_pydict()
