"""Pair signals, nearest vectors, judges and small text functions on rows with known results."""

import numpy as np
from pyspark.sql import functions as F

from datagauge.functions import scalars
from datagauge.operators import pairs, reports, sections

SAMPLE = "id long, prompt array<string>, template array<string>, tests array<string>, starter array<string>, title array<string>, function array<string>, name string, vector array<double>"


def test_pair_signals(spark):
    rows = [
        (1, ["abc", "bcd"], ["tpl"], ["test_a"], ["def solve", "return"], ["array"], ["solve"], "solve", [1.0, 0.0]),
        (2, ["xyz"], ["tpl"], ["test_a"], ["def solve", "return"], ["list"], ["solve"], "solve", [0.99, 0.01]),
        (3, ["p"], ["a"], ["t"], ["s"], ["shared", "title"], ["f"], "f", []),
        (4, ["q"], ["b"], ["u"], ["r"], ["shared", "title"], ["g"], "g", []),
        (5, ["m"], ["c"], ["v"], [], ["one"], ["h"], "h", None),
        (6, ["n"], ["d"], ["w"], [], ["two"], ["i"], "i", None),
    ]
    got = {(r["left"], r["right"]): r for r in pairs.score_pairs(spark.createDataFrame([(1, 2), (3, 4), (5, 6), (1, 99)], "left long, right long"), spark.createDataFrame(rows, SAMPLE)).collect()}
    assert set(got) == {(1, 2), (5, 6)}
    both = got[1, 2]
    assert (both["lexical"], both["structural"], both["combined"], both["label"]) == (1.0, 1.0, 1.0, "semantic_duplicate")
    assert abs(both["embedding"] - 0.99995) < 1e-5
    assert got[5, 6]["label"] == "template_overlap"


def test_nearest_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(60, 8)), 1)
    vectors[17] = vectors[4]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(100, None), (101, []), (102, [0.0] * 8), (103, [float("nan")] * 8), (104, [1.0, 2.0]), (105, [None] * 8), (106, [float("-inf")] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["neighbour"], r["similarity"]) for r in pairs.nearest_vectors(table.where("vec_id % 2 = 0"), table, block=16).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = np.round(unit @ unit.T, 9)
    np.fill_diagonal(near, -2)
    assert set(got) == set(range(0, 60, 2))
    for i, (j, s) in got.items():
        assert abs(s - near[i].max()) < 1e-8 and j == np.flatnonzero(near[i] == near[i].max())[0]
    assert pairs.nearest_vectors(table.limit(0), table).collect() == []


def test_judges(spark):
    rows = [(7, "usable", "none", "medium"), (7, "caveated", "defect", "high"), (8, "usable", " ", "normal"), (8, "usable", None, "normal"), (9, "usable", "a", "low"), (9, "usable", "b", "low"), (10, None, None, None)]
    got = {r["k"]: tuple(r)[1:] for r in reports.judges(spark.createDataFrame(rows, "k long, utility string, risk string, priority string"), "k").collect()}
    assert got == {7: (2, "strong_disagreement", 1.0, "high"), 8: (2, "aligned", 0.0, "normal"), 9: (2, "moderate_disagreement", 0.3333, "normal"), 10: (1, "aligned", 0.0, "normal")}


def test_scalars(spark):
    def one(column, kind="string", value=None):
        return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]

    assert one(lambda c: scalars.excerpt(c, 8), value="  abcd efghi ") == "abcd..."
    assert one(lambda c: scalars.excerpt(c, 8)) == ""
    assert one(lambda c: scalars.shortened(c, 8), value="a\n b  cdefghi") == "a b c..."
    assert one(lambda c: scalars.head_tail(c, 2, 2, 1), value="abcdef") == "ab\n...\nef"
    assert one(lambda c: scalars.head_tail(c, 2, 2, 1), value="abcde") == "abcde"
    assert one(scalars.unfenced, value="```python\nx = 1\n```") == "x = 1"
    assert [one(scalars.slug, value=v) for v in ("GPT 4/x!", "--", None)] == ["gpt_4_x", "--", "model"]
    assert [one(scalars.looks_like_json, value=v) for v in (" {1} ", "[1}", None)] == [True, False, False]
    assert one(scalars.flags, value="a; b;;a ") == ["a", "b"]
    assert [tuple(one(scalars.pass_fraction, value=v)) for v in ("2/5", "x/5", None, "")] == [(2, 5), (0, 0), (0, 0), (0, 0)]
    assert [one(scalars.ratio_verdict, "double", v) for v in (1.0, 0.5, 0.49)] == ["PASS", "PARTIAL", "FAIL"]
    assert one(scalars.compact_notes, "array<string>", ["a\nb", " ", "a b", None, "c", "d"]) == "a b; c"
    assert [one(scalars.counts_text, "map<string,int>", v) for v in ({"b": 2, "a": 1}, {}, None)] == ["a=1; b=2", "none", "none"]
    assert [one(lambda c, s=s: scalars.test_cell(F.lit(s), c, F.lit("E")), value=v) for s, v in (("pass", None), ("fail", "x"), ("fail", " "), ("timeout", "y"), ("error", None), ("crash", None))] == ["PASS", "FAIL:x", "FAIL:incorrect_output", "TIMEOUT", "ERROR:E", "CRASH"]
    assert [one(scalars.execution_failure, value=v) for v in ("SyntaxError", None)] == ["syntax_error", "runtime_error"]
    assert [one(lambda c, f=f: scalars.incomplete_reason(c, F.lit(f), F.lit("done")), value=v) for v, f in (("max", "stop"), (None, "length"), (None, "stop"))] == ["max", "length", ""]
    assert [one(scalars.repaired, value=v) for v in ("cafÃ©\r\nx\ry", "Ã", "日Ã©", "café", None)] == ["café\nx\ny", "Ã", "日Ã©", "café", ""]
    assert [one(scalars.json_object, value=v) for v in ('{"a": 1}', 'say {"a": 1} ok', "[1]", "{x}", None, "")] == ['{"a":1}', '{"a":1}', None, None, None, None]


def test_relationships_match_the_checks_once(spark):
    plan = sections.q_check_relationships(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan
