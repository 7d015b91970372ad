"""The join of the stages' results: missing stages, clashing columns, ties."""

from datagauge.operators import stages


def test_missing_stages_and_clashing_columns(spark):
    samples = spark.createDataFrame([(1, "mine"), (2, "mine"), (3, "mine"), (None, "mine")], "doc_id long, rate string")
    static = spark.createDataFrame([(1, 0.9, 0, "Usable", "Usable", "Usable"), (2, 0.9, 1, "Unusable", "Unusable", "Usable")], "doc_id long, score double, critical_fails int, prompt_use string, ideal_use string, tests_use string")
    dynamic = spark.createDataFrame(
        [(1, 7, "ok", "ok", 0.5, 0.5, 0.5, 5, 5, "incorrect_output", 1, 0.0, 0.0, 1.0, 1, 0.0, 1, 1, 1)],
        "doc_id long, attempt long, generation string, probe string, rate double, public double, private double, n_public int, n_private int, dominant string, n_attempts int, spread double, deviation double, ok_rate double, n_models int, gap double, n_efficacy int, n_signal int, n_suspicion int",
    )
    near = spark.createDataFrame([(3, 1.0, 9, 3, 2)], "doc_id long, redundancy double, closest long, cluster_id long, cluster_size long")
    marks = spark.createDataFrame([(1, "")], "doc_id long, outliers string")
    rows = {r.doc_id: r for r in stages.joined(samples, [static, dynamic, near, marks]).collect()}
    assert set(rows) == {1, 2, 3, None}
    one = rows[1]
    assert (one.rate, one.efficacy, one.priority, one.exemplar, one.action, one.cluster_id, one.cluster_size) == (0.5, "High Efficacy", "normal", True, "KEEP", 1, 1)
    assert (rows[2].efficacy, rows[2].contradiction, rows[2].variance, rows[2].disagreement, rows[2].action) == ("Inconclusive", "high_static_low_dynamic", "unknown", "unknown", "FIX")
    assert (rows[3].score, rows[3].redundancy, rows[3].cluster_size, rows[3].priority, rows[3].action) == (0.0, 1.0, 2, "high", "DEDUPE_OR_DOWNWEIGHT")
    assert (rows[None].score, rows[None].cluster_id, rows[None].generation) == (0.0, None, "no_code")
    assert stages.joined(samples.limit(0), [static, dynamic, near, marks]).count() == 0


def test_dominant_ties(spark):
    tests = spark.createDataFrame([(1, 2, "a"), (1, 1, "b"), (1, 3, None), (2, 1, "a"), (2, 1, "b"), (3, 1, "a"), (3, 2, "c"), (3, 3, "c"), (4, 1, None)], "l_orderkey long, l_linenumber int, kind string")
    assert {r.l_orderkey: r.dominant for r in stages.dominant(tests).collect()} == {1: "b", 2: "b", 3: "c"}


def test_redundant_takes_the_closest_and_chains(spark):
    pairs = spark.createDataFrame([(1, 2, 0.6), (2, 3, 0.6), (3, 4, 0.9)], "left long, right long, prompt_sim double")
    rows = {r.doc_id: (r.redundancy, r.closest, r.cluster_id, r.cluster_size) for r in stages.redundant(pairs).collect()}
    assert rows == {1: (0.6, 2, 1, 4), 2: (0.6, 1, 1, 4), 3: (0.9, 4, 1, 4), 4: (0.9, 3, 1, 4)}
    assert stages.redundant(pairs.limit(0)).count() == 0
