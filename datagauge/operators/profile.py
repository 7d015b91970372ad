"""Profiles of a table: text features, numeric summaries, frequencies, outliers, contrasts and correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..sources.tables import spread, table, written

METRICS = ("n_chars", "n_words", "n_lines")


def features(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"), text.word_count(F.col("text")).alias("n_words"), text.line_count(F.col("text")).alias("n_lines"))
    return rows.withColumns({"size_band": text.band(F.col("n_words"), 150, 500), "line_band": text.band(F.col("n_lines"), 5, 20)})


def q_text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spread(table(spark, sf_dir, "documents"), "doc_id")).select("doc_id", "n_words", "n_lines", "size_band", "line_band")


def summary(name: str, value: Column) -> list[Column]:
    quartiles = F.percentile(value, F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    return [F.count(value).alias(f"{name}_n"), F.round(F.avg(value), 4).alias(f"{name}_mean"), F.min(value).alias(f"{name}_min"), F.max(value).alias(f"{name}_max"), quartiles.alias(f"{name}_q")]


def q_numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spread(table(spark, sf_dir, "documents"), "doc_id"))
    one = rows.agg(*(c for m in METRICS for c in summary(m, F.col(m).cast("double"))))
    parts = [one.select(F.lit(m).alias("metric"), F.col(f"{m}_n").alias("n"), F.col(f"{m}_mean").alias("mean"), F.col(f"{m}_min").alias("least"), F.col(f"{m}_max").alias("most"), *(F.round(F.col(f"{m}_q")[i], 4).alias(q) for i, q in enumerate(("q1", "median", "q3")))) for m in METRICS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_freq_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("lang", "source")))).alias("x")).select("x.*")
    return rows.groupBy("field", "value").agg(F.count("*").alias("n"))


def flagged(rows: DataFrame) -> DataFrame:
    """Metrics outside q1 - 1.5 iqr .. q3 + 1.5 iqr; none where n < 4 or iqr = 0. The fences are one row.

    The quartiles are exact, of counts by distinct value: no more values than the longest text has characters.
    """
    rows = written(rows, "features")
    fences = rows.agg(F.count("*").alias("__n"), *(F.percentile(F.col(m).cast("double"), F.array(F.lit(0.25), F.lit(0.75))).alias(f"__{m}") for m in METRICS))
    out = []
    for m in METRICS:
        q1, q3 = F.col(f"__{m}")[0], F.col(f"__{m}")[1]
        far = (F.col(m) < q1 - 1.5 * (q3 - q1)) | (F.col(m) > q3 + 1.5 * (q3 - q1))
        out.append(F.when((F.col("__n") >= 4) & (q3 != q1) & far, F.lit(m)))
    joined = rows.join(F.broadcast(fences))
    return joined.select(*rows.columns, F.concat_ws(";", *out).alias("flags"))


def q_iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(features(spread(table(spark, sf_dir, "documents"), "doc_id"))).where("flags <> ''").select("doc_id", "flags")


def q_outlier_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_iqr_outliers(spark, sf_dir).select(F.explode(F.split("flags", ";")).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def pearson(a: str, b: str) -> Column:
    """0 without variance."""
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))


def q_pearson_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spread(table(spark, sf_dir, "documents"), "doc_id")).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality")), "doc_id").withColumns({m: F.col(m).cast("double") for m in METRICS})
    return rows.agg(*(F.round(pearson(m, "quality"), 4).alias(f"{m}_r") for m in METRICS))


def q_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each language and source value: share of good documents against the rest, where support suffices."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    total = rows.agg(F.count("*").alias("tn"), F.sum("quality").alias("tq"), F.sum("toxic").alias("tt"))
    each = rows.select("quality", "toxic", F.explode(F.array(F.concat(F.lit("lang="), F.col("lang")), F.concat(F.lit("source="), F.col("source")))).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"), F.sum("quality").alias("q"), F.sum("toxic").alias("t"))
    each = each.join(F.broadcast(total)).where("tn >= 10 AND n >= greatest(5, ceil(0.03 * tn)) AND tn > n")
    each = each.withColumns({"share": F.col("n") / F.col("tn"), "delta": F.expr("q / n - (tq - q) / (tn - n)"), "lift": F.expr("t / n - (tt - t) / (tn - n)")})
    strength = (F.abs("delta") + 0.5 * F.abs("lift")) * F.greatest("share", F.lit(0.05))
    return each.select("flag", "n", F.round("share", 4).alias("share"), F.round("delta", 4).alias("delta"), F.round("lift", 4).alias("lift"), F.round(strength, 4).alias("strength"), F.expr(rules.RELIABILITY).alias("reliability"))


#: Rules that a report shows.
TOP = 20


def contrasts(rows: DataFrame, flags: Column) -> DataFrame:
    """For each flag of the samples (rate, suspicious): the mean rate and suspicion of those that hold it against the others, where support suffices.

    One aggregate over the flags and one row of totals; nothing for fewer than 10 samples.
    """
    hot = F.col("suspicious").cast("double")
    total = rows.agg(F.count("*").alias("tn"), F.sum("rate").alias("tr"), F.sum(hot).alias("ts"))
    each = rows.select("rate", "suspicious", F.explode(F.array_distinct(flags)).alias("signal")).groupBy("signal").agg(F.count("*").alias("n"), F.sum("rate").alias("r"), F.sum(hot).alias("s"))
    each = each.join(F.broadcast(total)).where("tn >= 10 AND n >= greatest(5, ceil(0.03 * tn)) AND tn > n")
    each = each.withColumns({"share": F.col("n") / F.col("tn"), "delta": F.expr("r / n - (tr - r) / (tn - n)"), "lift": F.expr("s / n - (ts - s) / (tn - n)")})
    return each.select("signal", F.lit("failing_check").alias("kind"), "n", "share", (F.col("r") / F.col("n")).alias("mean_rate"), (F.col("s") / F.col("n")).alias("suspicious_rate"), "delta", "lift")


def score_correlations(rows: DataFrame, scores: list[str]) -> DataFrame:
    """For each score with more than one value: its correlations with rate and suspicion over all samples."""
    hot = F.col("suspicious").cast("double")
    base = rows.withColumn("__hot", hot)
    one = base.agg(F.count("*").alias("n"), F.avg("rate").alias("mean_rate"), F.avg("__hot").alias("suspicious_rate"), *(c for k in scores for c in (pearson(k, "rate").alias(f"{k}_d"), pearson(k, "__hot").alias(f"{k}_l"), (F.max(k) > F.min(k)).alias(f"{k}_on"))))
    parts = F.array(*(F.struct(F.lit(k).alias("signal"), F.col(f"{k}_d").alias("delta"), F.col(f"{k}_l").alias("lift"), F.col(f"{k}_on").alias("on")) for k in scores))
    found = one.where("n >= 10").select("n", "mean_rate", "suspicious_rate", F.inline(parts)).where("on")
    return found.select("signal", F.lit("section_score").alias("kind"), "n", F.lit(1.0).alias("share"), "mean_rate", "suspicious_rate", "delta", "lift")


def top_rules(found: DataFrame, most: int = TOP) -> DataFrame:
    """The strongest rules with strength and reliability; ties by support, then name."""
    # Ties of sums round up, whatever the order of summing.
    strength = F.round((F.abs("delta") + 0.5 * F.abs("lift")) * F.greatest("share", F.lit(0.05)) + 1e-9, 4)
    rows = found.withColumn("strength", strength).withColumn("reliability", F.when(F.col("kind") == "section_score", "broad").otherwise(F.expr(rules.RELIABILITY)))
    rows = rows.orderBy(F.desc("strength"), F.desc("n"), "signal").limit(most)
    return rows.select("signal", "kind", "n", *(F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("share", "mean_rate", "suspicious_rate", "delta", "lift")), "strength", "reliability")


def q_template_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.template(F.col("text")).alias("template"))
    return rows.groupBy(F.sha2("template", 256).alias("template_id")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
_F = rf"""f AS (SELECT doc_id, lang, source, n_chars::DOUBLE n_chars, len(regexp_extract_all(coalesce(text, ''), '{text.WORD}')) n_words,
 CASE WHEN body = '' THEN 0 ELSE len(regexp_extract_all(body, '{text.LINE_END}')) + (NOT regexp_matches(body, '{text.LINE_END}\z'))::INT END n_lines
 FROM (SELECT *, regexp_replace(coalesce(text, ''), '^\n+|\n+$', '', 'g') body FROM documents))"""
_O = "n AS (SELECT count(*) cnt, " + ", ".join(f"quantile_cont({m}, 0.25) {m}_a, quantile_cont({m}, 0.75) {m}_b" for m in METRICS) + " FROM f), o AS (SELECT doc_id, concat_ws(';', " + ", ".join(f"CASE WHEN cnt >= 4 AND {m}_a <> {m}_b AND ({m} < {m}_a - 1.5 * ({m}_b - {m}_a) OR {m} > {m}_b + 1.5 * ({m}_b - {m}_a)) THEN '{m}' END" for m in METRICS) + ") flags FROM f, n)"
ORACLE = {
    "text_features": f"WITH {_F} SELECT doc_id, n_words, n_lines, CASE WHEN n_words < 150 THEN 'short' WHEN n_words < 500 THEN 'medium' ELSE 'long' END size_band, CASE WHEN n_lines < 5 THEN 'short' WHEN n_lines < 20 THEN 'medium' ELSE 'long' END line_band FROM f",
    "numeric_profile": f"WITH {_F} " + " UNION ALL ".join(f"SELECT '{m}' metric, count({m}) n, round(avg({m}), 4) mean, min({m})::DOUBLE least, max({m})::DOUBLE most, round(quantile_cont({m}, 0.25), 4) q1, round(quantile_cont({m}, 0.5), 4) median, round(quantile_cont({m}, 0.75), 4) q3 FROM f" for m in METRICS),
    "freq_tables": "SELECT 'lang' field, lang \"value\", count(*) n FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL",
    "iqr_outliers": f"WITH {_F}, {_O} SELECT doc_id, flags FROM o WHERE flags <> ''",
    "outlier_flag_counts": f"WITH {_F}, {_O} SELECT flag, count(*) n FROM (SELECT unnest(string_split(flags, ';')) flag FROM o WHERE flags <> '') GROUP BY 1",
    "pearson_signals": f"WITH {_F}, j AS (SELECT f.*, quality::DOUBLE quality FROM f JOIN labels USING (doc_id)) SELECT " + ", ".join(f"round(CASE WHEN var_pop({m}) = 0 OR var_pop(quality) = 0 THEN 0 ELSE corr({m}, quality) END, 4) {m}_r" for m in METRICS) + " FROM j",
    "relationships": f"""WITH j AS (SELECT d.*, quality, toxic FROM documents d JOIN labels USING (doc_id)), t AS (SELECT count(*) tn, sum(quality) tq, sum(toxic) tt FROM j),
 e AS (SELECT flag, count(*) n, sum(quality) q, sum(toxic) t FROM (SELECT quality, toxic, unnest(['lang=' || lang, 'source=' || source]) flag FROM j) GROUP BY 1),
 s AS (SELECT flag, n, n / tn share, q / n - (tq - q) / (tn - n) delta, t / n - (tt - t) / (tn - n) lift FROM e, t WHERE tn >= 10 AND n >= greatest(5, ceil(0.03 * tn)) AND tn > n)
 SELECT flag, n, round(share, 4) share, round(delta, 4) delta, round(lift, 4) lift, round((abs(delta) + 0.5 * abs(lift)) * greatest(share, 0.05), 4) strength, {rules.RELIABILITY} reliability FROM s""",
    "template_groups": f"SELECT sha256(t) template_id, count(*) n, min(doc_id) first_doc FROM (SELECT doc_id, {text.sql_template('text')} t FROM documents) GROUP BY t HAVING count(*) > 1",
}
