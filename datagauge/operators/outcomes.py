"""Test outcomes: tests roll up to attempts, attempts to samples, samples get labels.

Adapter: customer = sample, orders = attempt (o_orderkey its order, o_orderpriority its model), lineitem = test (l_returnflag
'R' fails, l_linestatus 'F' public and 'O' private).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ladders
from ..sources.tables import table


#: Most columns of a pivot.
MOST_CASES = 1000


def ratio(passed: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(passed, total), F.lit(0.0))


def test_rollup(tests: DataFrame) -> DataFrame:
    """Per attempt: tests, passes and rates, whole and by visibility. One partial aggregate, no second pass."""
    ok = F.col("l_returnflag") != "R"
    by = {"public": "F", "private": "O"}
    rows = tests.groupBy("l_orderkey").agg(
        F.count("*").alias("n_tests"),
        F.count_if(ok).alias("n_passed"),
        *(F.count_if(F.col("l_linestatus") == v).alias(f"{k}_tests") for k, v in by.items()),
        *(F.count_if(ok & (F.col("l_linestatus") == v)).alias(f"{k}_passed") for k, v in by.items()),
    )
    return rows.select("l_orderkey", "n_tests", "n_passed", ratio(F.col("n_passed"), F.col("n_tests")).alias("rate"), *(ratio(F.col(f"{k}_passed"), F.col(f"{k}_tests")).alias(f"{k}_rate") for k in by), *(f"{k}_tests" for k in by))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts with their rollup; one without tests has rate 0. Its probe is ok unless its order is pending."""
    rolled = test_rollup(table(spark, sf_dir, "lineitem")).withColumnRenamed("l_orderkey", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", (F.col("o_orderstatus") != "P").alias("ok")).join(rolled, "o_orderkey", "left")
    return rows.select("o_orderkey", "o_custkey", "o_orderpriority", "ok", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tests", "public_tests", "private_tests")), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("rate", "public_rate", "private_rate")))


def q_test_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = test_rollup(table(spark, sf_dir, "lineitem"))
    return rows.select(*(F.round(c, 4).alias(c) if c.endswith("rate") else F.col(c) for c in rows.columns))


def label(rows: DataFrame) -> DataFrame:
    """``rows`` of attempts with the outcome of the classifier; they hold no generated tests and no oracle run."""
    none, ok = F.lit(0), F.lit("ok")
    found = ladders.efficacy(ok, ok, F.col("rate"), F.col("public_rate"), F.col("private_rate"), F.lit(0.0), F.col("public_tests"), F.col("private_tests"), none, F.lit(None).cast("double"), F.lit(""))
    return rows.withColumn("__o", found).select("*", *(F.col(f"__o.{c}").alias(c) for c in ladders.OUTCOME)).drop("__o")


def best_attempt(rows: DataFrame) -> DataFrame:
    """Per sample the attempt with the largest (rate, public, private), the first of equals: an aggregate, not a sort."""
    key = F.struct("rate", "public_rate", "private_rate", (-F.col("o_orderkey")).alias("first"))
    best = F.max_by(F.struct("o_orderkey", "ok", "rate", "public_rate", "private_rate", "n_tests", "public_tests", "private_tests"), key)
    return rows.groupBy("o_custkey").agg(best.alias("b"), F.count("*").alias("n_attempts"), F.avg("rate").alias("mean_rate"), F.count_if(F.col("rate") >= 0.9999).alias("successes")).select("o_custkey", "b.*", "n_attempts", "mean_rate", "successes")


def q_attempt_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = best_attempt(attempts(spark, sf_dir))
    return rows.select("o_custkey", F.col("o_orderkey").alias("best_attempt"), F.round("rate", 4).alias("best_rate"), "n_attempts", F.round(F.col("mean_rate") + 1e-9, 4).alias("mean_rate"), "successes")  # ties round up whatever the order of summing


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n-c, k) / C(n, k) as a product; 0 without attempts or successes, 1 if k draws can't miss."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda p, i: p * F.try_divide(n - c - i, n - i))
    return F.when((n <= 0) | (c <= 0) | F.lit(k <= 0), 0.0).when((n <= k) | (n - c < k), 1.0).otherwise(1.0 - miss)


def q_pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = best_attempt(attempts(spark, sf_dir))
    return rows.select("o_custkey", *(F.round(pass_at_k(F.col("n_attempts"), F.col("successes"), k), 4).alias(f"pass_at_{k}") for k in (1, 2, 5)))


def q_efficacy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(best_attempt(attempts(spark, sf_dir))).select("o_custkey", *ladders.OUTCOME)


def q_attempt_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of each sample's attempts; sums of rates are rounded before the ladder."""
    rows = attempts(spark, sf_dir).groupBy("o_custkey").agg(F.count("*").alias("n_attempts"), F.avg("rate").alias("mean"), F.max("rate").alias("best"), F.min("rate").alias("worst"), F.stddev_pop("rate").alias("rate_std"), F.avg(F.col("ok").cast("double")).alias("ok_rate"))
    rows = rows.select("o_custkey", "n_attempts", F.round(F.col("mean") + 1e-9, 4).alias("mean"), F.round("best", 4).alias("best"), F.round("worst", 4).alias("worst"), F.round(F.col("best") - F.col("worst") + 1e-9, 4).alias("rate_range"), F.round(F.col("rate_std") + 1e-9, 4).alias("rate_std"), F.round(F.col("ok_rate") + 1e-9, 4).alias("ok_rate"))
    return rows.withColumn("stability", ladders.variance_label(F.col("n_attempts"), F.col("ok_rate"), F.col("rate_range"), F.col("rate_std")))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sample and model: its best rate and label."""
    rows = attempts(spark, sf_dir).groupBy("o_custkey", "o_orderpriority").agg(F.max_by(F.struct("rate", "public_rate", "private_rate", "n_tests", "public_tests", "private_tests"), F.struct("rate", "public_rate", "private_rate", (-F.col("o_orderkey")).alias("f"))).alias("b"))
    return label(rows.select("o_custkey", "o_orderpriority", "b.*"))


def q_model_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models(spark, sf_dir).groupBy("o_custkey").agg(F.count("*").alias("n_models"), F.round(F.max("rate") - F.min("rate"), 4).alias("gap"), *(F.count_distinct(c).alias(f"n_{c}") for c in ("efficacy", "quality_signal", "suspicious")))
    return rows.withColumn("disagreement", ladders.disagreement_label(F.col("n_models"), F.col("gap"), F.col("n_efficacy"), F.col("n_quality_signal"), F.col("n_suspicious")))


def q_model_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and second model of each sample; a tie under .05."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("rate"), "o_orderpriority")
    rows = models(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    rows = rows.groupBy("o_custkey").agg(F.max(F.when(F.col("rn") == 1, F.col("o_orderpriority"))).alias("first"), F.max(F.when(F.col("rn") == 2, F.col("o_orderpriority"))).alias("second"), F.round(F.max("rate") - F.min("rate"), 4).alias("lead"))
    return rows.withColumn("winner", F.when(F.col("second").isNull(), F.col("first")).when(F.col("lead") < 0.05, "tie").otherwise(F.col("first")))


def q_threshold_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = label(best_attempt(attempts(spark, sf_dir)).withColumn("rate", F.round("rate", 4)))
    return rows.select("o_custkey", ladders.threshold(F.col("rate"), F.col("efficacy"), F.col("suspicious")).alias("t")).select("o_custkey", "t.*")


def pivoted(tests: DataFrame, key: str, case: str, value: str) -> DataFrame:
    """A row each ``key`` with a column for every case number that occurs (an error beyond ``MOST_CASES`` of them), the largest value of several."""
    numbers = sorted(r[0] for r in tests.where(F.col(case).isNotNull()).select(F.col(case).cast("long")).distinct().limit(MOST_CASES + 1).collect())
    if len(numbers) > MOST_CASES:
        raise ValueError(f"more than {MOST_CASES} case numbers are no columns")
    rows = tests.groupBy(key).pivot(case, numbers).agg(F.max(value))
    return rows.select(key, *(F.col(f"`{n}`").alias(f"case_{n:02d}") for n in numbers))


def q_pivot_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivoted(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag")


def q_dominant_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent failure type per user, the one seen first among equals."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("seen"))
    return rows.groupBy("user_id").agg(F.max_by(F.struct("event_type", "n"), F.struct("n", (-F.col("seen")).alias("s"))).alias("b")).select("user_id", F.col("b.event_type").alias("failure_type"), F.col("b.n").alias("n"))


def q_test_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed tests of each sample's best attempt, else of its attempt with most tests."""
    rows = attempts(spark, sf_dir)
    best = rows.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct((F.col("n_tests") > 0).alias("has"), F.col("rate"), F.col("n_tests"), (-F.col("o_orderkey")).alias("f"))).alias("l_orderkey"))
    failed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linestatus")
    return best.join(failed, "l_orderkey", "left").groupBy("o_custkey", F.col("l_orderkey").alias("attempt")).agg(F.count("l_linestatus").alias("n_failed"), F.count_if(F.col("l_linestatus") == "F").alias("public_failed"))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}

#: Without generated tests, oracle run and failure types, five cases are left.
_OUTCOME = """CASE WHEN public_rate = 1 AND private_rate = 0 AND vt > 0 THEN {'difficulty': 'reasonable', 'failure_category': 'benchmark_suspicion', 'quality_signal': 'hidden_or_underspecified_requirements', 'efficacy': 'Suspicious (Needs Audit)', 'suspicious': true, 'needs_audit': true}
 WHEN pt > 0 AND vt > 0 AND abs(public_rate - private_rate) >= 0.5 AND greatest(public_rate, private_rate) >= 0.75 THEN {'difficulty': 'reasonable', 'failure_category': 'benchmark_suspicion', 'quality_signal': 'public_private_divergence', 'efficacy': 'Suspicious (Needs Audit)', 'suspicious': true, 'needs_audit': true}
 WHEN rate >= 0.95 THEN {'difficulty': 'trivial', 'failure_category': 'clean_pass', 'quality_signal': 'clean_evaluation', 'efficacy': 'Low Efficacy', 'suspicious': false, 'needs_audit': false}
 WHEN rate = 0 THEN {'difficulty': 'extreme', 'failure_category': 'logical_or_test_failure', 'quality_signal': 'clean_evaluation', 'efficacy': 'Moderate Efficacy', 'suspicious': false, 'needs_audit': false}
 ELSE {'difficulty': 'reasonable', 'failure_category': 'logical_or_edge_failure', 'quality_signal': 'clean_evaluation', 'efficacy': CASE WHEN rate >= 0.25 AND rate <= 0.8 THEN 'High Efficacy' ELSE 'Moderate Efficacy' END, 'suspicious': false, 'needs_audit': false} END"""
_ATT = """r AS (SELECT l_orderkey, count(*) n_tests, sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) n_passed,
 sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) pt, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) vt,
 sum(CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'R' THEN 1 ELSE 0 END) pp, sum(CASE WHEN l_linestatus = 'O' AND l_returnflag <> 'R' THEN 1 ELSE 0 END) vp FROM lineitem GROUP BY 1),
a AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus <> 'P' ok, coalesce(n_tests, 0) n_tests, coalesce(pt, 0) pt, coalesce(vt, 0) vt, coalesce(n_passed / nullif(n_tests, 0), 0.0)::DOUBLE rate,
 coalesce(pp / nullif(pt, 0), 0.0)::DOUBLE public_rate, coalesce(vp / nullif(vt, 0), 0.0)::DOUBLE private_rate FROM orders LEFT JOIN r ON l_orderkey = o_orderkey),
ra AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY rate DESC, public_rate DESC, private_rate DESC, o_orderkey) rn FROM a),
b AS (SELECT * FROM ra WHERE rn = 1),
g AS (SELECT o_custkey, count(*) n_attempts, avg(rate) mean_rate, count(*) FILTER (rate >= 0.9999) successes, max(rate) - min(rate) rr, stddev_pop(rate) rs FROM a GROUP BY 1),
rm AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY rate DESC, public_rate DESC, private_rate DESC, o_orderkey) mn FROM a),
m AS (SELECT *, outcome.efficacy, outcome.quality_signal, outcome.suspicious FROM (SELECT *, """ + _OUTCOME + """ outcome FROM rm WHERE mn = 1))"""


def _k(k: int) -> str:
    miss = " * ".join(f"((n_attempts - successes - {i}) / (n_attempts - {i}))" for i in range(k))
    return f"round(CASE WHEN successes <= 0 THEN 0.0 WHEN n_attempts <= {k} OR n_attempts - successes < {k} THEN 1.0 ELSE 1.0 - {miss} END, 4) pass_at_{k}"


ORACLE = {
    "test_rollup": f"WITH {_ATT} SELECT l_orderkey, n_tests, CAST(n_passed AS BIGINT) n_passed, round(n_passed / n_tests, 4) rate, round(coalesce(pp / nullif(pt, 0), 0), 4) public_rate, round(coalesce(vp / nullif(vt, 0), 0), 4) private_rate, pt::BIGINT public_tests, vt::BIGINT private_tests FROM r",
    "attempt_rollup": f"WITH {_ATT} SELECT o_custkey, o_orderkey best_attempt, round(rate, 4) best_rate, n_attempts, round(mean_rate + 1e-9, 4) mean_rate, successes FROM b JOIN g USING (o_custkey)",
    "pass_at_k": f"WITH {_ATT} SELECT o_custkey, {_k(1)}, {_k(2)}, {_k(5)} FROM g",
    "efficacy_labels": f"WITH {_ATT} SELECT o_custkey, unnest({_OUTCOME}) FROM b",
    "attempt_variance": f"""WITH {_ATT}, v AS (SELECT o_custkey, count(*) n_attempts, round(avg(rate) + 1e-9, 4) mean, round(max(rate), 4) best, round(min(rate), 4) worst, round(max(rate) - min(rate) + 1e-9, 4) rate_range, round(stddev_pop(rate) + 1e-9, 4) rate_std, round(avg(ok::INT) + 1e-9, 4) ok_rate FROM a GROUP BY 1)
 SELECT *, CASE WHEN n_attempts = 1 THEN 'stable' WHEN ok_rate < 1 OR rate_range >= 0.35 OR rate_std >= 0.15 THEN 'volatile' WHEN rate_range >= 0.2 OR rate_std >= 0.08 THEN 'moderate' ELSE 'stable' END stability FROM v""",
    "model_disagreement": f"""WITH {_ATT}, d AS (SELECT o_custkey, count(*) n_models, round(max(rate) - min(rate), 4) gap, count(DISTINCT efficacy) n_efficacy, count(DISTINCT quality_signal) n_quality_signal, count(DISTINCT suspicious) n_suspicious FROM m GROUP BY 1)
 SELECT *, CASE WHEN n_models = 1 THEN 'single_model' WHEN gap >= 0.45 OR n_suspicious > 1 OR (n_efficacy > 1 AND gap >= 0.25) THEN 'strong_disagreement' WHEN gap >= 0.25 OR n_efficacy > 1 OR n_quality_signal > 1 THEN 'moderate_disagreement' ELSE 'aligned' END disagreement FROM d""",
    "model_winner": f"""WITH {_ATT}, w AS (SELECT o_custkey, o_orderpriority p, rate, row_number() OVER (PARTITION BY o_custkey ORDER BY rate DESC, o_orderpriority) k FROM m),
 x AS (SELECT o_custkey, max(CASE WHEN k = 1 THEN p END) first, max(CASE WHEN k = 2 THEN p END) "second", round(max(rate) - min(rate), 4) "lead" FROM w WHERE k <= 2 GROUP BY 1)
 SELECT *, CASE WHEN "second" IS NULL THEN first WHEN "lead" < 0.05 THEN 'tie' ELSE first END winner FROM x""",
    "threshold_sensitivity": f"""WITH {_ATT}, s AS (SELECT o_custkey, rate, ({_OUTCOME}).suspicious suspicious FROM (SELECT * REPLACE (round(rate, 4) AS rate) FROM b)),
 d AS (SELECT *, abs(rate - 0.25::DOUBLE) p, abs(rate - 0.8::DOUBLE) q, abs(rate - 0.95::DOUBLE) r FROM s), e AS (SELECT *, least(p, q, r) m, CASE WHEN p <= least(q, r) THEN 'high_efficacy_floor' WHEN q <= r THEN 'moderate_high_split' ELSE 'saturation_boundary' END boundary FROM d)
 SELECT o_custkey, boundary, round(m, 4) distance, CASE WHEN suspicious THEN 'caveated' WHEN m <= 0.025 THEN 'high' WHEN m <= 0.05 THEN 'moderate' ELSE 'stable' END "label",
 CASE WHEN suspicious THEN 'suspicious benchmark behavior already dominates interpretation' WHEN m <= 0.025 THEN 'pass rate sits very close to ' || boundary WHEN m <= 0.05 THEN 'pass rate sits near ' || boundary ELSE '' END reason FROM e""",
    "pivot_tests": "SELECT l_orderkey, " + ", ".join(f"max(CASE WHEN l_linenumber = {i} THEN l_returnflag END) case_{i:02d}" for i in range(1, 8)) + " FROM lineitem GROUP BY 1",
    "dominant_failure": "SELECT user_id, event_type failure_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) k FROM (SELECT user_id, event_type, count(*) n, min(event_id) seen FROM events GROUP BY 1, 2)) WHERE k = 1",
    "test_evidence": f"WITH {_ATT}, e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (n_tests > 0) DESC, rate DESC, n_tests DESC, o_orderkey) k FROM a) WHERE k = 1) SELECT e.o_custkey, e.o_orderkey attempt, count(l.l_linestatus) n_failed, count(*) FILTER (l.l_linestatus = 'F') public_failed FROM e LEFT JOIN lineitem l ON l.l_orderkey = e.o_orderkey AND l.l_returnflag = 'R' GROUP BY 1, 2",
}
