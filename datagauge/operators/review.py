"""Review of a slice: its selection, sections merged by key, evidence of failed tests, completion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ladders, scalars
from ..sources.tables import table, written
from . import audit


QUOTAS = {"contradiction": 8, "disagreement": 8, "redundancy": 6, "baseline": 4}
MOST = 30
#: Of the query ``review_selection``.
SMALLER, SMALLER_MOST = {"contradiction": 6, "disagreement": 5, "redundancy": 7, "baseline": 4}, 20
SHOWN = 8
#: Columns of reviews and the older names that fill them.
OLDER = {"BenchmarkTrustCheck": "GroundTruthValidity", "Notes-BenchmarkTrustCheck": "Notes-GroundTruthValidity", "DefectType": "ErrorType", "SummaryConfidence": "ReviewConfidence"}


def select_review(rows: DataFrame, quotas: dict[str, int] | None = None, most: int = MOST) -> DataFrame:
    """(id, bucket) of the samples to review, in order of bucket and id.

    ``rows``: id, priority, contradictory, disagrees, varies, redundant, exemplary (boolean), cluster_id, cluster_size. A bucket takes
    the first of its order that no earlier one took: contradictions by id; disagreements by urgency, those of models before those of attempts alone; the redundant
    by their cluster's size, each cluster by its first alone; of normal priority exemplars before others. What is left of ``most`` goes by urgency, and a selection that
    is larger loses what was chosen last. Each step is a bounded sort, and what is chosen has at most ``most`` rows or the quotas' sum.
    """
    quotas = QUOTAS | (quotas or {})
    rows = written(rows.withColumn("rank", ladders.rank(F.col("priority"))), "review-rows")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    first = F.min_by(F.struct("id", "rank"), F.struct("rank", "id"))
    per_cluster = rows.where("redundant").groupBy("cluster_id").agg(first.alias("f"), F.max("cluster_size").alias("cluster_size")).select("f.*", "cluster_size")
    pools = {
        "contradiction": (rows.where("contradictory"), [F.col("id")]),
        "disagreement": (rows.where("disagrees or varies"), [F.col("rank"), no("disagrees"), no("varies"), F.col("id")]),
        "redundancy": (per_cluster, [F.desc("cluster_size"), F.col("rank"), F.col("id")]),
        "baseline": (rows.where("priority = 'normal'"), [no("exemplary"), F.col("id")]),
        "backfill": (rows, [F.col("rank"), F.col("id")]),
    }
    chosen = None
    for turn, (bucket, (pool, order)) in enumerate(pools.items()):
        left = pool if chosen is None else pool.join(F.broadcast(chosen.select("id")), "id", "left_anti")
        one = left.orderBy(*order).limit(quotas.get(bucket, most))
        one = one.select("id", F.lit(bucket).alias("bucket"), F.lit(turn).alias("turn"), F.row_number().over(Window.partitionBy(F.lit(turn)).orderBy(*order)).alias("place"))
        chosen = written(one if chosen is None else chosen.unionByName(one), "review")
    return chosen.orderBy("turn", "place").limit(most).select("id", "bucket").orderBy("bucket", "id")


def with_reviewed(selected: DataFrame, reviewed: DataFrame) -> DataFrame:
    """The selection, and reviewed ids that it lacks as a bucket of their own."""
    lacking = reviewed.select("id").distinct().join(selected, "id", "left_anti").select("id", F.lit("reviewed").alias("bucket"))
    return selected.select("id", "bucket").unionByName(lacking)


def merge_sections(sections: list[DataFrame], key: str) -> DataFrame:
    """A full outer join by ``key``; of columns that sections share, the last section with the row holds, nulls included."""

    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        ca, cb = [c for c in a.columns if c != key], [c for c in b.columns if c != key]
        left = a.select(key, *(F.col(f"`{c}`").alias(f"__a_{c}") for c in ca))
        right = b.select(key, F.lit(True).alias("__b"), *(F.col(f"`{c}`").alias(f"__b_{c}") for c in cb))

        def pick(c: str) -> Column:
            if c not in cb:
                return F.col(f"`__a_{c}`")
            return F.when(F.col("__b"), F.col(f"`__b_{c}`")).otherwise(F.col(f"`__a_{c}`")) if c in ca else F.col(f"`__b_{c}`")

        return left.join(right, key, "full").select(key, *(pick(c).alias(c) for c in dict.fromkeys([*ca, *cb])))

    return reduce(two, sections)


#: What a reviewer fills in, a finding's parts in each of three slots.
ANSWERS = ("BenchmarkTrustCheck", "FailureAttribution", "PipelineCalibrationCheck", "FinalAction")
FINDINGS = tuple(n.format(i) for i in (1, 2, 3) for n in ("Finding{}DefectType", "Finding{}Severity", "Finding{}Confidence", "Notes-Finding{}"))


def reviews(rows: DataFrame) -> DataFrame:
    """Reviews with today's column names; an older column fills one that is missing."""
    for name, older in OLDER.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.col(f"`{older}`") if older in rows.columns else F.lit(""))
    return rows.drop(*OLDER.values())


def context_text(efficacy: Column, signal: Column, category: Column, reason: Column) -> Column:
    """What earlier stages found, blanks as n/a."""
    shown = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "n/a").otherwise(c)
    parts = (("Stage 2: ", efficacy), ("benchmark_quality=", signal), ("failure_category=", category), ("Stage 3 reason=", reason))
    return F.concat_ws("; ", *(F.concat(F.lit(k), shown(v)) for k, v in parts))


def review_details(selected: DataFrame, answered: DataFrame, key: str = "Index") -> DataFrame:
    """The selection with every answer and finding (blank without a review) and whether the review is completed or pending."""
    names = [*ANSWERS, "SummaryConfidence", *FINDINGS]
    given = answered.select(key, F.lit(True).alias("__done"), *((F.col(f"`{n}`") if n in answered.columns else F.lit("")).cast("string").alias(n) for n in names))
    rows = selected.join(given, key, "left")
    status = F.when(F.col("__done"), "completed").otherwise("pending")
    return rows.select(*selected.columns, *(F.coalesce(f"`{n}`", F.lit("")).alias(n) for n in names), status.alias("ReviewStatus"))


def review_packet(selected: DataFrame, samples: DataFrame, key: str = "Index") -> DataFrame:
    """What a reviewer gets: the selection with the samples' whole texts (Prompt, StarterCode, IdealResponse) and a blank column for every answer, note and finding."""
    blanks = [n for a in ANSWERS for n in (a, f"Notes-{a}")] + ["SummaryConfidence", *FINDINGS]
    texts = ("Prompt", "StarterCode", "IdealResponse")
    return selected.join(samples.select(key, *texts), key).select(*selected.columns, *texts, *(F.lit("").alias(n) for n in blanks))


def admitted(candidates: DataFrame, samples: DataFrame, stage3: DataFrame, stage1: DataFrame, stage2: DataFrame, key: str = "Index") -> DataFrame:
    """Candidates that are samples and have a row of the third stage, with what the first two stages know of them, if anything."""
    rows = candidates.join(samples.select(key), key, "left_semi").join(stage3, key)
    return rows.join(stage1, key, "left").join(stage2, key, "left")


def failed_attempts(tests: DataFrame) -> DataFrame:
    """Tests of models that are not passed, by sample, target and attempt in order. ``tests``: Index, target, attempt, source, status; runs of the ideal response don't count."""
    bad = ~F.lower(F.trim(F.coalesce("status", F.lit("")))).isin("ok", "pass", "passed", "success")
    return tests.where(F.col("source").startswith("model_candidate") & bad).orderBy("Index", "target", "attempt", "visibility", "case_index")


def dominant_failures(tests: DataFrame) -> DataFrame:
    """(Index, failure_type, n): the most frequent kind among the models' failed tests, of equals the one seen first in the order of ``SORTS``; blanks and the ideal response's runs don't count."""
    kind = F.trim(F.coalesce("failure_type", F.lit("")))
    rows = tests.where(F.col("source").startswith("model_candidate")).withColumn("failure_type", kind).where("failure_type <> ''")
    seen = F.min(F.struct(*(c for c in SORTS["tests"] if c in tests.columns)))
    n = rows.groupBy("Index", "failure_type").agg(F.count("*").alias("n"), seen.alias("seen"))
    return n.groupBy("Index").agg(F.min_by(F.struct("failure_type", "n"), F.struct(-F.col("n"), "seen")).alias("b")).select("Index", "b.*")


def top_titles(samples: DataFrame, title: str, most: int = 10) -> DataFrame:
    """The most frequent titles, those seen first among equals (by ``Index``)."""
    return samples.groupBy(title).agg(F.count("*").alias("n"), F.min("Index").alias("seen")).orderBy(F.desc("n"), "seen").limit(most).select(title, "n")


#: The order of each table of a run.
SORTS = {"samples": ["Index"], "models": ["Index", "target"], "attempts": ["Index", "target", "attempt"], "tests": ["Index", "source", "target", "attempt", "visibility", "case_index"]}


def canonical(rows: DataFrame, name: str) -> DataFrame:
    return rows.orderBy(*(c for c in SORTS[name] if c in rows.columns))


def evidence(tests: DataFrame, key: str) -> DataFrame:
    """Per ``key``: tests, failures, the mix of visibilities and failures as text, the first ``SHOWN`` failures.

    ``tests``: key, visibility, case_index, passed, failure_type; blanks are unknown and mismatch. Counts are summed before texts are made of them.
    """
    blank = lambda c, other: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", other).otherwise(F.trim(F.col(c)))
    ok = F.coalesce("passed", F.lit(False))
    rows = tests.select(key, blank("visibility", "unknown").alias("visibility"), "case_index", ok.alias("ok"), F.when(~ok, blank("failure_type", "mismatch")).alias("failure"))
    # A key has a row for each of its few kinds; their texts are made within it.
    kinds = rows.groupBy(key, "visibility", "failure").agg(F.count("*").alias("n")).groupBy(key).agg(F.collect_list(F.struct("visibility", "failure", "n")).alias("__k"))
    total = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s + x["n"])
    bad = F.filter("__k", lambda x: x["failure"].isNotNull())

    def mix(items: Column, c: str) -> Column:
        names = F.array_sort(F.array_distinct(F.transform(items, lambda x: x[c])))
        return scalars.counts_text(F.map_from_entries(F.transform(names, lambda v: F.struct(v, total(F.filter(items, lambda x: x[c] == v))))))

    base = kinds.select(key, total(F.col("__k")).alias("n_tests"), total(bad).alias("n_failed"), mix(F.col("__k"), "visibility").alias("visibility"), mix(bad, "failure").alias("failures"))
    w = Window.partitionBy(key).orderBy("visibility", "case_index", "failure")
    label = F.concat(F.col("visibility"), F.lit(" test"), F.coalesce(F.concat(F.lit(" "), F.col("case_index").cast("string")), F.lit("")), F.lit(": "), F.col("failure"))
    shown = rows.where("NOT ok").withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= SHOWN).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__place", label.alias("label")))), lambda x: x["label"]), "; ").alias("shown"))
    return base.join(shown, key, "left").select(key, "n_tests", "n_failed", "visibility", "failures", F.coalesce("shown", F.lit("")).alias("shown"))


def completion(selected: DataFrame, answers: DataFrame, columns: list[str]) -> DataFrame:
    """(area, value, n): samples of each bucket, selected and completed ones, and the answers of completed reviews; blank answers are not counted."""
    rows = selected.join(answers.withColumn("done", F.lit(True)), "id", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    facts = [F.struct(F.lit("bucket").alias("area"), F.col("bucket").alias("value")), F.struct(F.lit("review").alias("area"), F.lit("selected").alias("value")), F.when(F.col("done"), F.struct(F.lit("review").alias("area"), F.lit("completed").alias("value")))]
    facts += [F.when(F.col("done") & (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""), F.struct(F.lit(c).alias("area"), F.trim(F.col(c).cast("string")).alias("value"))) for c in columns]
    return rows.select(F.explode(F.array_compact(F.array(*facts))).alias("f")).select("f.*").groupBy("area", "value").agg(F.count("*").alias("n"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))


def _candidates(rows: DataFrame, cluster: Column, size: Column | str) -> DataFrame:
    """What ``select_review`` takes, from signals; contradictions are those of their queue."""
    queued = audit.queues(rows).where("queue = 'contradiction'").select(F.col("doc_id").alias("id"), F.lit(True).alias("contradictory"))
    flags = {"disagrees": "disagreement NOT IN ('aligned', 'single_model')", "varies": "variance <> 'stable'", "redundant": f"redundancy >= {ladders.REDUNDANT}", "exemplary": "exemplar"}
    rows = rows.select(F.col("doc_id").alias("id"), "priority", *(F.expr(v).alias(k) for k, v in flags.items()), cluster.alias("cluster_id"), size.alias("cluster_size"))
    return rows.join(F.broadcast(queued), "id", "left")


def q_review_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: a source and language are a cluster."""
    rows = audit.signals(spark, sf_dir)
    size = rows.groupBy("source", "lang").agg(F.count("*").alias("cluster_size")).withColumns({"s": F.col("source"), "l": F.col("lang")}).drop("source", "lang")
    rows = rows.join(size, rows["source"].eqNullSafe(size["s"]) & rows["lang"].eqNullSafe(size["l"]))
    return select_review(_candidates(rows, F.to_json(F.struct("source", "lang")), F.col("cluster_size")))


def q_review_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: each sample is a cluster of its own. Smaller quotas, and fewer in all than they sum to."""
    rows = _candidates(audit.signals(spark, sf_dir), F.col("doc_id"), F.lit(1))
    return select_review(rows, SMALLER, SMALLER_MOST).select(F.col("id").alias("doc_id"), "bucket")


def q_merged_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, vectors and labels as three sections; ``label`` of the last two is the labels' where there is a row."""
    parts = [table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(-1).alias("label")), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), _labels(spark, sf_dir).select("doc_id", F.col("quality").alias("label"), "toxic")]
    return merge_sections(parts, "doc_id")


def q_failure_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linestatus") == "F", "public").otherwise("private").alias("visibility"), F.col("l_linenumber").alias("case_index"), (F.col("l_returnflag") != "R").alias("passed"), F.when(F.col("l_discount") > 0.05, "format").alias("failure_type"))
    return evidence(rows, "l_orderkey")


def q_review_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("bucket"))
    return completion(selected, _labels(spark, sf_dir).withColumnRenamed("doc_id", "id"), ["quality", "toxic"])


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
_R = audit._R
_L = "l AS (SELECT doc_id, max(quality) quality, max(toxic) toxic FROM labels GROUP BY 1)"


def _selection(cluster: str, size: str, quotas: dict[str, int], most: int, shown: str) -> str:
    taken = lambda *names: " AND doc_id NOT IN (" + " UNION ALL ".join(f"SELECT id FROM {n}" for n in names) + ")"
    pick = lambda pool, on, order, quota: f"SELECT doc_id id, row_number() OVER (ORDER BY {order}) place FROM {pool} WHERE {on} ORDER BY {order} LIMIT {quota}"
    other, differs = "disagreement NOT IN ('aligned', 'single_model')", "variance <> 'stable'"
    return f"""WITH {audit._S}, r AS (SELECT *, {_R} k, {size} z FROM s),
 qc AS (SELECT doc_id FROM r WHERE contradiction <> '' ORDER BY (contradiction <> 'high_static_low_dynamic') DESC, doc_id DESC LIMIT {audit.QUEUE}),
 c1 AS ({pick("qc", "true", "doc_id", quotas["contradiction"])}),
 c2 AS ({pick("r", f"({other} OR {differs})" + taken("c1"), f"k, NOT ({other}), NOT ({differs}), doc_id", quotas["disagreement"])}),
 fc AS (SELECT * FROM r WHERE redundancy >= 0.55 QUALIFY row_number() OVER (PARTITION BY {cluster} ORDER BY k, doc_id) = 1),
 c3 AS ({pick("fc", "true" + taken("c1", "c2"), "z DESC, k, doc_id", quotas["redundancy"])}),
 c4 AS ({pick("r", "priority = 'normal'" + taken("c1", "c2", "c3"), "NOT exemplar, doc_id", quotas["baseline"])}),
 c5 AS ({pick("r", "true" + taken("c1", "c2", "c3", "c4"), "k, doc_id", most)}),
 u AS (SELECT id, place, 'contradiction' bucket, 0 t FROM c1 UNION ALL SELECT id, place, 'disagreement', 1 FROM c2 UNION ALL SELECT id, place, 'redundancy', 2 FROM c3 UNION ALL SELECT id, place, 'baseline', 3 FROM c4 UNION ALL SELECT id, place, 'backfill', 4 FROM c5)
 SELECT {shown}, bucket FROM (SELECT * FROM u ORDER BY t, place LIMIT {most})"""


ORACLE = {
    "review_slice": _selection("source, lang", "count(*) OVER (PARTITION BY source, lang)", QUOTAS, MOST, "id"),
    "review_selection": _selection("doc_id", "1", SMALLER, SMALLER_MOST, "id doc_id"),
    "merged_sections": f"""WITH {_L}, x AS (SELECT coalesce(d.doc_id, vec_id) doc_id, lang, CASE WHEN vec_id IS NOT NULL THEN e.label WHEN d.doc_id IS NOT NULL THEN -1 END v FROM documents d FULL JOIN embeddings e ON vec_id = d.doc_id)
 SELECT coalesce(x.doc_id, l.doc_id) doc_id, lang, CASE WHEN l.doc_id IS NOT NULL THEN quality ELSE v END "label", toxic FROM x FULL JOIN l ON l.doc_id = x.doc_id""",
    "failure_evidence": f"""WITH t AS (SELECT l_orderkey o, CASE WHEN l_linestatus = 'F' THEN 'public' ELSE 'private' END v, l_linenumber c, CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_discount > 0.05 THEN 'format' ELSE 'mismatch' END END f FROM lineitem),
 n AS (SELECT o, count(*) n_tests, count(f) n_failed FROM t GROUP BY 1), a AS (SELECT o, string_agg(v || '=' || n, '; ' ORDER BY v) v FROM (SELECT o, v, count(*) n FROM t GROUP BY ALL) GROUP BY 1),
 b AS (SELECT o, string_agg(f || '=' || n, '; ' ORDER BY f) f FROM (SELECT o, f, count(*) n FROM t WHERE f IS NOT NULL GROUP BY ALL) GROUP BY 1),
 s AS (SELECT o, string_agg(v || ' test ' || c || ': ' || f, '; ' ORDER BY k) s FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY v, c, f) k FROM t WHERE f IS NOT NULL) WHERE k <= {SHOWN} GROUP BY 1)
 SELECT n.o l_orderkey, n_tests, n_failed, v visibility, coalesce(f, 'none') failures, coalesce(s, '') shown FROM n JOIN a ON a.o = n.o LEFT JOIN b ON b.o = n.o LEFT JOIN s ON s.o = n.o""",
    "review_rollup": f"""WITH {_L}, j AS (SELECT d.lang, l.doc_id done, quality, toxic FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id),
 u AS (SELECT 'bucket' area, lang "value" FROM j UNION ALL SELECT 'review', 'selected' FROM j UNION ALL SELECT 'review', 'completed' FROM j WHERE done IS NOT NULL
 UNION ALL SELECT 'quality', quality::VARCHAR FROM j WHERE quality IS NOT NULL UNION ALL SELECT 'toxic', toxic::VARCHAR FROM j WHERE toxic IS NOT NULL) SELECT area, "value", count(*) n FROM u GROUP BY ALL""",
}
