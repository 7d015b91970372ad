"""The flagship join: what the stages found of each sample, and the ladders over it.

Static verdicts (``sections``), attempts and models (``outcomes``), similar samples (``similarity``) and outliers (``profile``) are computed by their own operators; each comes
down to one row a sample before it is joined, so the joins are left joins of keys that are distinct on both sides, and no text travels in them.

A sample that a stage knows nothing of keeps its row: without verdicts a score of 0; without attempts rates of 0, no code, variance and disagreement
unknown; without a similar sample a redundancy of 0 and a cluster of its own; without an oracle run an oracle rate of 1. Null ids match nothing and keep their row.

Adapter: a document is a sample; the orders of the customer of that number are its attempts, their priority the model, line items the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread, table, written
from . import audit, outcomes, profile, sections, similarity

#: What a sample without results of a stage takes.
MISSING = {"score": 0.0, "critical_fails": 0, "rate": 0.0, "public": 0.0, "private": 0.0, "n_public": 0, "n_private": 0, "n_attempts": 0, "spread": 0.0, "deviation": 0.0, "ok_rate": 0.0, "n_models": 0, "gap": 0.0, "n_efficacy": 0, "n_signal": 0, "n_suspicion": 0, "redundancy": 0.0, "cluster_size": 1, "outliers": ""}


def static(verdicts: DataFrame) -> DataFrame:
    """doc_id, score, critical_fails and the usability of prompt, ideal response and tests from rows of 76 verdicts."""
    rows = verdicts.select("doc_id", sections.stage_score(sections.cells()).alias("score"), sections.critical_fails().alias("critical_fails"), sections.usability(F.col("runtime")).alias("u"))
    return rows.select("doc_id", "score", "critical_fails", *(F.col(f"u.{c}").alias(f"{c}_use") for c in ("prompt", "ideal", "tests")))


def dominant(tests: DataFrame) -> DataFrame:
    """Of each attempt the commonest kind of its failed tests, of equals the one seen first, then the last by name: l_orderkey, dominant. ``tests``: l_orderkey, l_linenumber, kind (null: passed)."""
    each = tests.where("kind IS NOT NULL").groupBy("l_orderkey", "kind").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("seen"))
    return each.groupBy("l_orderkey").agg(F.max_by("kind", F.struct("n", (-F.col("seen")).alias("s"), "kind")).alias("dominant"))


def dynamic(attempts: DataFrame, kinds: DataFrame, variance: DataFrame, models: DataFrame) -> DataFrame:
    """One row a sample that has attempts: its best attempt's results, the spread of all, and how far its models differ."""
    best = outcomes.best_attempt(attempts).join(kinds.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left")
    best = best.select("o_custkey", F.col("o_orderkey").alias("attempt"), F.lit("ok").alias("generation"), F.when(F.col("ok"), "ok").otherwise("error").alias("probe"), "rate", F.col("public_rate").alias("public"), F.col("private_rate").alias("private"), F.col("public_tests").alias("n_public"), F.col("private_tests").alias("n_private"), "dominant")
    rows = best.join(variance.select("o_custkey", "n_attempts", F.col("rate_range").alias("spread"), F.col("rate_std").alias("deviation"), "ok_rate"), "o_custkey", "left")
    return rows.join(models.select("o_custkey", "n_models", "gap", F.col("n_efficacy"), F.col("n_quality_signal").alias("n_signal"), F.col("n_suspicious").alias("n_suspicion")), "o_custkey", "left").withColumnRenamed("o_custkey", "doc_id")


def redundant(pairs: DataFrame) -> DataFrame:
    """doc_id, redundancy, closest (of equals the smallest pair), cluster_id and cluster_size of every sample in a pair (left, right, prompt_sim)."""
    both = pairs.select(F.col("left").alias("doc_id"), F.col("right").alias("other"), "prompt_sim").unionByName(pairs.select(F.col("right").alias("doc_id"), F.col("left").alias("other"), "prompt_sim"))
    order = F.struct("prompt_sim", (-F.least("doc_id", "other")).alias("l"), (-F.greatest("doc_id", "other")).alias("r"))
    near = both.groupBy("doc_id").agg(F.max_by(F.struct(F.col("prompt_sim").alias("redundancy"), F.col("other").alias("closest")), order).alias("b")).select("doc_id", "b.*")
    roots = similarity.components(pairs.select("left", "right")).select(F.col("node").alias("doc_id"), F.col("root").alias("cluster_id"))
    sizes = roots.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))
    return near.join(roots.join(sizes, "cluster_id"), "doc_id")


def joined(samples: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """``samples`` with one row of each part by doc_id, what is missing filled, and every ladder over it. Of columns that samples and parts share, the parts' hold."""
    taken = {c for p in parts for c in p.columns if c != "doc_id"}
    rows = samples.drop(*taken)
    for part in parts:
        rows = rows.join(part, "doc_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in MISSING.items()})
    rows = rows.withColumns({"generation": F.coalesce("generation", F.lit("no_code")), "probe": F.coalesce("probe", F.lit("error")), "cluster_id": F.coalesce("cluster_id", "doc_id"), "generated": F.lit(0.0), "n_generated": F.lit(0), "oracle": F.lit(None).cast("double"), "note": F.lit(""), "toxic": F.lit(False)})
    rows = audit.laddered(rows)
    uses = F.array(*(F.coalesce(f"{c}_use", F.lit("")) for c in ("prompt", "ideal", "tests")))
    return rows.withColumn("action", audit.decided(uses)["action"])


COLUMNS = ("doc_id", "score", "critical_fails", "prompt_use", "ideal_use", "tests_use", "attempt", "rate", "dominant", "efficacy", "quality_signal", "suspicious", "n_attempts", "variance", "n_models", "disagreement", "sensitivity", "redundancy", "closest", "cluster_id", "cluster_size", "outliers", "contradiction", "priority", "exemplar", "regime", "reasons", "utility", "action")


def stage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the stages' results and its ladders."""
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("l_returnflag") == "R", F.when(F.col("l_discount") > 0.05, "format_mismatch").otherwise("incorrect_output"))
    kinds = dominant(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind")))
    found = dynamic(outcomes.attempts(spark, sf_dir), kinds, outcomes.q_attempt_variance(spark, sf_dir), outcomes.q_model_disagreement(spark, sf_dir))
    pairs = written(similarity.q_jaccard_pairs(spark, sf_dir), "stage-pairs")
    marks = profile.flagged(profile.features(spread(docs, "doc_id"))).select("doc_id", F.col("flags").alias("outliers"))
    return joined(docs.select("doc_id"), [static(sections.samples(spark, sf_dir)), found, redundant(pairs), marks])


def q_stage_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_rows(spark, sf_dir).select(*(F.round(c, 4).alias(c) if c == "rate" else F.col(c) for c in COLUMNS))


def q_stage_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five top lists over the stages' own results."""
    return audit.queues(stage_rows(spark, sf_dir))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
_ROWS = f"""WITH RECURSIVE sc AS ({sections.ORACLE["verdict_scores"]}), us AS ({sections.ORACLE["usability"]}), va AS ({outcomes.ORACLE["attempt_variance"]}), md AS ({outcomes.ORACLE["model_disagreement"]}),
be AS (WITH {outcomes._ATT} SELECT * FROM b), jp AS ({similarity.ORACLE["jaccard_pairs"]}), fl AS (WITH {profile._F}, {profile._O} SELECT doc_id, flags FROM o),
dk AS (SELECT l_orderkey, CASE WHEN l_discount > 0.05 THEN 'format_mismatch' ELSE 'incorrect_output' END kind, count(*) n, min(l_linenumber) seen FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
dm AS (SELECT l_orderkey, kind FROM dk QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, seen, kind DESC) = 1),
je AS (SELECT "left" a, "right" b, prompt_sim FROM jp UNION ALL SELECT "right", "left", prompt_sim FROM jp),
jn AS (SELECT a, b, prompt_sim FROM je QUALIFY row_number() OVER (PARTITION BY a ORDER BY prompt_sim DESC, least(a, b), greatest(a, b)) = 1),
jw AS (SELECT a node, b reach FROM je UNION SELECT jw.node, je.b FROM jw JOIN je ON je.a = jw.reach), jr AS (SELECT node, min(reach) root FROM jw GROUP BY 1), jc AS (SELECT node, root, count(*) OVER (PARTITION BY root) members FROM jr),
s1 AS (SELECT d.doc_id, coalesce(sc.score, 0) score, coalesce(sc.critical_fails, 0) critical_fails, us.prompt prompt_use, us.ideal ideal_use, us.tests tests_use, be.o_orderkey attempt, CASE WHEN be.o_orderkey IS NULL THEN 'no_code' ELSE 'ok' END generation, CASE WHEN be.ok THEN 'ok' ELSE 'error' END probe,
 coalesce(be.rate, 0)::DOUBLE rate, coalesce(be.public_rate, 0)::DOUBLE public, coalesce(be.private_rate, 0)::DOUBLE private, 0.0::DOUBLE generated, coalesce(be.pt, 0) n_public, coalesce(be.vt, 0) n_private, 0 n_generated, NULL::DOUBLE oracle, dm.kind dominant,
 coalesce(va.n_attempts, 0) n_attempts, coalesce(va.rate_range, 0) spread, coalesce(va.rate_std, 0) deviation, coalesce(va.ok_rate, 0) ok_rate, coalesce(md.n_models, 0) n_models, coalesce(md.gap, 0) gap, coalesce(md.n_efficacy, 0) n_efficacy, coalesce(md.n_quality_signal, 0) n_signal, coalesce(md.n_suspicious, 0) n_suspicion,
 coalesce(jn.prompt_sim, 0)::DOUBLE redundancy, jn.b closest, coalesce(jc.root, d.doc_id) cluster_id, coalesce(jc.members, 1) cluster_size, coalesce(fl.flags, '') outliers, '' note, false toxic
 FROM documents d LEFT JOIN sc ON sc.doc_id = d.doc_id LEFT JOIN us ON us.doc_id = d.doc_id LEFT JOIN be ON be.o_custkey = d.doc_id LEFT JOIN dm ON dm.l_orderkey = be.o_orderkey LEFT JOIN va ON va.o_custkey = d.doc_id LEFT JOIN md ON md.o_custkey = d.doc_id
 LEFT JOIN jn ON jn.a = d.doc_id LEFT JOIN jc ON jc.node = d.doc_id LEFT JOIN fl ON fl.doc_id = d.doc_id), {audit.LADDERS}"""
ORACLE = {
    "stage_join": f"""{_ROWS}, u AS (SELECT *, [prompt_use, ideal_use, tests_use] us FROM s), c AS (SELECT *, {audit.KIND} k FROM u) SELECT {", ".join("round(rate, 4) rate" if c == "rate" else c for c in COLUMNS if c != "action")},
 CASE k WHEN 1 THEN 'FIX_OR_REMOVE' WHEN 2 THEN 'FIX' WHEN 3 THEN 'DEDUPE_OR_DOWNWEIGHT' WHEN 4 THEN 'DEPRIORITIZE' WHEN 6 THEN 'FIX' ELSE 'KEEP' END "action" FROM c""",
    "stage_queues": audit.ORACLE["audit_queues"].replace(f"WITH {audit._S}", _ROWS, 1),
}
