"""Filter interaction audit: what each of five filters removes, alone, together, and in every order.

Only joint-failure counts leave the documents: for each of the 32 sets S of filters, the number of documents that fail all of S (a sum of
flag products), and as many for labelled good and toxic ones. All else follows from them per part, whatever the number of documents:
survivors of a set Q are the sum over S within Q of (-1)^|S| N(S), documents that fail a filter only come by Moebius inversion, and as the game
"documents that Q removes" has the Harsanyi dividends (-1)^(|R|+1) N(R), a filter's Shapley value is the sum of those it belongs to, each over |R|.

Null texts are empty: they fail ``A``, and ``E`` if a smaller id's text is empty. Null languages form the part of the empty string.
Null ids are neither smaller nor larger than others, and have no labels. Repeated rows each count; they are no copies of one another, as no id is
smaller. Of several labels of an id any that says good or toxic counts; null labels say nothing. Without documents there are no parts.
Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_failures(text: Column) -> Column:
    """Bits of the filters that a text fails by itself: A few words, B repetitive, C capitals, D symbols."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [
        F.size(words) < 100,
        100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        100 * capitals > 10 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, fails, n, good, toxic) that together count every document: ``fails`` has the bits of the filters it fails.

    Texts travel as SHA-256. Rows are summed by id within a text first, so a text that a third of all rows share is spread by their ids, and
    a text's smallest id is sought among one row for each language that it occurs in.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("mark"), text_failures(text).alias("own"))
    rows = rows.groupBy("doc_id", "part", "mark", "own").agg(F.count("*").alias("n"))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("key"))
    said = said.agg(*(F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    # Rows without an id have no labels: their text keeps them apart, so that they don't meet in one task.
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), "mark")).join(said, "key", "left")
    n, good, toxic = F.col("n"), F.col("n") * F.coalesce("good", F.lit(0)), F.col("n") * F.coalesce("toxic", F.lit(0))
    known = F.col("doc_id").isNotNull()
    texts = rows.groupBy("mark", "part", "own").agg(
        *(F.sum(c).alias(k) for c, k in ((n, "n"), (good, "good"), (toxic, "toxic"))),
        F.coalesce(F.sum(F.when(~known, n)), F.lit(0)).alias("without_id"),
        F.min(F.when(known, F.struct("doc_id", n.alias("n"), good.alias("good"), toxic.alias("toxic")))).alias("least"),
    )
    first = F.col("least.doc_id") == F.min("least.doc_id").over(Window.partitionBy("mark"))
    at_first = {k: F.coalesce(F.when(first, F.col(f"least.{k}")), F.lit(0)) for k in ("n", "good", "toxic")}
    at_first["n"] = at_first["n"] + F.col("without_id")
    sides = [F.struct((F.col("own") + extra).alias("fails"), *(c(k).alias(k) for k in at_first)) for extra, c in ((0, at_first.get), (1 << 4, lambda k: F.col(k) - at_first[k]))]
    return texts.select("part", F.array(*sides).alias("sides")).select("part", F.inline("sides")).where("n > 0")


def joint(rows: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """One row per part: arrays n, good and toxic by set of filters (index: its bits), each a sum of flag products."""
    sums = {k: [F.sum(F.when(F.col("fails").bitwiseAND(F.lit(s)) == s, F.col(k)).otherwise(0)) for s in range(1 << filters)] for k in ("n", "good", "toxic")}
    return rows.groupBy("part").agg(*(F.array(*c).alias(k) for k, c in sums.items()))


def invert(sums: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The audit of every order and step, from joint-failure counts only."""
    k, sets = len(filters), f"sequence(0, {(1 << len(filters)) - 1})"
    parity = "if(bit_count(s) % 2 = 0, 1L, -1L)"

    def survivors(c: str) -> Column:
        return F.expr(f"transform({sets}, q -> aggregate(filter({sets}, s -> (s & q) = s), 0L, (a, s) -> a + {parity} * {c}[s]))").alias(f"kept_{c}")

    def by_filter(weight: str, name: str) -> Column:
        return F.expr(f"transform(sequence(0, {k - 1}), i -> aggregate(filter({sets}, s -> (s & shiftleft(1, i)) <> 0), 0L, (a, s) -> a - {parity} * {weight} * n[s]))").alias(name)

    parts = sums.select("part", "n", *map(survivors, ("n", "good", "toxic")), by_filter("1L", "alone"), by_filter(f"({math.factorial(k)}L div bit_count(s))", "credit"))
    orders = " ".join(map("".join, itertools.permutations(filters)))
    steps = parts.select("*", F.explode(F.split(F.lit(orders), " ")).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    steps = steps.withColumn("at", F.expr(f"transform(sequence(1, step), i -> instr('{filters}', substr(filter_order, i, 1)) - 1)"))
    steps = steps.withColumn("after", F.expr("aggregate(at, 0, (a, i) -> a + shiftleft(1, i))")).withColumn("at", F.element_at("at", -1)).withColumn("bit", F.expr("shiftleft(1, at)"))
    before, after, at = F.col("after") - F.col("bit"), F.col("after"), F.col("at")
    lost = {c: F.col(f"kept_{c}")[before] - F.col(f"kept_{c}")[after] for c in ("n", "good", "toxic")}
    out = [F.col("kept_n")[after], lost["n"], F.col("n")[F.col("bit")] - lost["n"], F.col("alone")[at], lost["good"], lost["toxic"], F.col("credit")[at]]
    return steps.select("part", "filter_order", "step", *(c.cast("long").alias(n) for c, n in zip(out, COUNTS, strict=True)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return invert(joint(marked(docs, labels)))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(store.table(spark, sf_dir, "documents"), store.table(spark, sf_dir, "labels"))


#: Counts each order and step for itself, from how many documents of a part fail which filters.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') part, coalesce(text, '') t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) bad FROM labels GROUP BY 1),
f AS (SELECT w.part, len(ws) < 100 a, 100 * len(list_distinct(ws)) < 80 * len(ws) b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) c,
  regexp_matches(t, '[#$%&*|]') d, coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) e, coalesce(l.good, 0) good, coalesce(l.bad, 0) bad
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
p AS (SELECT part, a, b, c, d, e, count(*) n, sum(good) good, sum(bad) bad FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) x),
o AS (SELECT x1.x || x2.x || x3.x || x4.x || x5.x o FROM x x1, x x2, x x3, x x4, x x5 WHERE len(list_distinct([x1.x, x2.x, x3.x, x4.x, x5.x])) = 5),
s AS (SELECT o, k step, substr(o, k, 1) x FROM o, (SELECT unnest([1, 2, 3, 4, 5]) k)),
g AS (SELECT p.*, s.*, CASE x WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END own,
  a::int + b::int + c::int + d::int + e::int fails,
  least(CASE WHEN a THEN strpos(o, 'A') ELSE 9 END, CASE WHEN b THEN strpos(o, 'B') ELSE 9 END, CASE WHEN c THEN strpos(o, 'C') ELSE 9 END, CASE WHEN d THEN strpos(o, 'D') ELSE 9 END, CASE WHEN e THEN strpos(o, 'E') ELSE 9 END) gone
  FROM p, s),
r AS (SELECT part, o filter_order, step::int step, x, coalesce(sum(n) FILTER (gone > step), 0)::bigint kept, coalesce(sum(n) FILTER (gone = step), 0)::bigint removed,
  coalesce(sum(n) FILTER (own AND gone < step), 0)::bigint redundant, coalesce(sum(n) FILTER (own AND fails = 1), 0)::bigint unique_fails,
  coalesce(sum(good) FILTER (gone = step), 0)::bigint good_lost, coalesce(sum(bad) FILTER (gone = step), 0)::bigint toxic_lost
  FROM g GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::bigint shapley FROM r
"""
