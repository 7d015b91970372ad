"""Selection, merged sections and evidence on odd rows."""

from datagauge.operators import review

ROW = "id long, priority string, contradictory boolean, disagrees boolean, varies boolean, redundant boolean, exemplary boolean, cluster_id long, cluster_size long"
NO = (False,) * 5


def test_select_review(spark):
    rows = [
        (1, "normal", True, True, False, False, False, 1, 1), (2, "normal", True, False, False, False, False, 2, 1),
        (3, "high", False, True, True, True, False, 3, 2), (4, "critical", False, False, True, True, False, 3, 2), (10, "critical", False, True, False, False, False, 10, 1),
        (5, "odd", False, False, False, True, True, 5, 9), (6, None, None, None, None, None, None, None, None), (7, "high", *NO, 7, 1), (8, "normal", *NO, 8, 1), (9, "normal", False, False, False, False, True, 9, 1),
    ]
    table = spark.createDataFrame(rows, ROW)
    select = lambda quotas, most: [tuple(r) for r in review.select_review(table, quotas, most).collect()]
    quotas = {"contradiction": 1, "disagreement": 2, "redundancy": 2, "baseline": 2}
    # Models that disagree come before attempts that vary (10, 4); the first of cluster 3 is taken already, so the cluster gives none; exemplars before other
    # normal samples (9, 2); then the most urgent of the rest.
    assert select(quotas, 7) == [(3, "backfill"), (2, "baseline"), (9, "baseline"), (1, "contradiction"), (4, "disagreement"), (10, "disagreement"), (5, "redundancy")]
    # A selection that is too large loses what was chosen last.
    assert select(quotas, 5) == [(9, "baseline"), (1, "contradiction"), (4, "disagreement"), (10, "disagreement"), (5, "redundancy")]
    assert review.select_review(table.limit(0)).collect() == []
    more = review.with_reviewed(spark.createDataFrame([(1, "x")], "id long, bucket string"), spark.createDataFrame([(1,), (9,), (9,)], "id long"))
    assert sorted(map(tuple, more.collect())) == [(1, "x"), (9, "reviewed")]


def test_merge_sections(spark):
    a = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, v string, w string")
    b = spark.createDataFrame([(2, None, 5), (3, "c", 6)], "k long, v string, `z.z` long")
    got = {r[0]: tuple(r)[1:] for r in review.merge_sections([a, b], "k").collect()}
    assert got == {1: ("a", "x", None), 2: (None, "y", 5), 3: ("c", None, 6)}


def test_evidence_and_reviews(spark):
    rows = [(1, "public", i, False, "t" if i % 2 else " ") for i in range(20)] + [(1, None, None, None, None), (2, "public", 1, True, "x")]
    got = {r["k"]: r for r in review.evidence(spark.createDataFrame(rows, "k long, visibility string, case_index int, passed boolean, failure_type string"), "k").collect()}
    assert (got[1]["n_tests"], got[1]["n_failed"], got[1]["visibility"], got[1]["failures"]) == (21, 21, "public=20; unknown=1", "mismatch=11; t=10")
    assert got[1]["shown"].split("; ")[:2] == ["public test 0: mismatch", "public test 1: t"] and len(got[1]["shown"].split("; ")) == review.SHOWN
    assert tuple(got[2])[1:] == (1, 0, "public=1", "none", "")
    old = review.reviews(spark.createDataFrame([(1, "yes", "low")], "id long, GroundTruthValidity string, ReviewConfidence string"))
    assert old.first()["BenchmarkTrustCheck"] == "yes" and old.first()["SummaryConfidence"] == "low" and old.first()["DefectType"] == ""
