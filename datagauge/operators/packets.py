"""Queries of the smaller operators over the shared tables: test columns, signatures, review rows, judges' answers, manifests, rankings.

Adapter: line items are tests as in ``outcomes``; a failed one's kind follows from its discount, its exception from its tax.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code, ladders, render, scalars, text
from ..sources import bundles
from ..sources.tables import table
from . import audit, judge, review

_TESTS = {
    "status": "CASE WHEN l_returnflag <> 'R' THEN 'pass' WHEN l_linenumber = 3 THEN 'timeout' WHEN l_tax > 0.05 THEN 'error' ELSE 'fail' END",
    "failure_type": "CASE WHEN l_returnflag <> 'R' THEN '' WHEN l_discount > 0.05 THEN 'format_mismatch' ELSE '' END",
    "exception": "CASE WHEN l_returnflag = 'R' AND l_tax > 0.05 AND l_discount < 0.03 THEN 'KeyError' ELSE '' END",
    "visibility": "CASE l_linestatus WHEN 'F' THEN 'public' ELSE 'private' END",
}


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("Index"), F.col("l_linenumber").alias("case_index"), *(F.expr(v).alias(k) for k, v in _TESTS.items()))


def q_test_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every line item: its column's name, its place among the columns, its cell, its request's id."""
    rows = tests(spark, sf_dir).withColumn("label", render.case_label(F.col("visibility"), F.col("case_index")))
    at = render.case_order(F.col("label"))
    return rows.select("Index", "label", at["kind"].alias("kind"), at["number"].alias("number"), scalars.test_cell(F.col("status"), F.col("failure_type"), F.col("exception")).alias("cell"), render.request_id(F.col("Index"), F.lit(1), F.col("visibility"), F.col("case_index")).alias("request_id"))


def q_test_note_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a test that is not passed: how many, the first in the order of their columns, the evidence as a hash."""
    rows = tests(spark, sf_dir).dropDuplicates(["Index", "visibility", "case_index", "status", "failure_type", "exception"])
    rows = rows.select("Index", F.lit("m").alias("target"), F.lit(1).alias("attempt"), "visibility", "case_index", "status", "failure_type", "exception", *(F.lit("").alias(c) for c in ("message", "expected", "actual")))
    return judge.test_notes(rows).select("Index", "request_id", F.size("allowed_columns").alias("n"), F.col("allowed_columns")[0].alias("first_column"), F.md5("evidence").alias("evidence"))


def q_candidate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent kind of each order's failed tests; items shipped by mode of an even line are the oracle's and don't count."""
    source = F.when(F.col("case_index") % 2 == 0, "oracle_solution").otherwise("model_candidate")
    return review.dominant_failures(tests(spark, sf_dir).withColumn("source", source))


def q_case_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each failed test was given: public and private ones from the part, lines from 5 on as generated ones from the supplier, line 4 keeps what was expected."""
    items = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    kind = F.when(F.col("l_linenumber") >= 5, "generated").when(F.col("l_linenumber") == 4, "other").when(F.col("l_linestatus") == "F", "public").otherwise("private")
    failed = items.select(F.when(kind == "generated", F.col("l_suppkey")).otherwise(F.col("l_partkey")).alias("Index"), kind.alias("visibility"), F.lit(0).alias("case_index"), F.lit("x").alias("expected")).groupBy("Index", "visibility", "case_index", "expected").agg(F.count("*").alias("n"))
    parts = table(spark, sf_dir, "part")
    own = [parts.select(F.col("p_partkey").alias("Index"), F.lit(v).alias("visibility"), F.lit(0).alias("case_index"), F.col("p_name").alias("input"), F.col(o).alias("output"), F.col("p_type").alias("testtype")) for v, o in (("public", "p_brand"), ("private", "p_type"))]
    made = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("Index"), F.lit(0).alias("case_index"), F.col("s_name").alias("input"), F.col("s_nationkey").cast("string").alias("output"), F.lit("edge").alias("focus"))
    return judge.case_context(failed, own[0].unionByName(own[1]), made)


def q_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the signatures of every benchmark item, and its text for embeddings as a hash."""
    t = F.coalesce("text", F.lit(""))
    name = F.regexp_extract(t, "^[A-Za-z]*", 0)
    one = F.array(F.struct(F.lit("public").alias("visibility"), F.lit("functional").alias("testtype"), F.substring(t, 1, 40).alias("input"), F.substring(t, -40, 40).alias("output")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(text.tokens(t)).alias("n_tokens"), F.size(text.mixed_signature(F.substring(t, 1, 60))).alias("n_starter"), F.size(text.mixed_signature(name)).alias("n_function"), F.size(text.test_signature(one)).alias("n_tests"), F.size(text.windows(text.template(t))).alias("n_template"), F.md5(text.embedding_text(name, F.lit(""), t, F.lit(None).cast("string"))).alias("embedding_text"))


def q_review_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critical samples with what earlier stages found; adapter: labels are their reviews, quality the action, toxic the trust."""
    rows = audit.signals(spark, sf_dir).where("priority = 'critical'").select(F.col("doc_id").alias("Index"), review.context_text(F.col("efficacy"), F.col("quality_signal"), F.col("failure_category"), F.col("reasons")).alias("context"))
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("Index")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    given = labels.select("Index", F.when(F.col("q") == 1, "keep").otherwise("fix").alias("FinalAction"), F.when(F.col("t") == 1, "defective").otherwise("trustworthy").alias("BenchmarkTrustCheck"))
    return review.review_details(rows, given).select("Index", "context", "FinalAction", "BenchmarkTrustCheck", "FailureAttribution", "ReviewStatus")


def q_review_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exemplary samples with their whole text, as a hash, and the number of columns to fill in."""
    rows = audit.signals(spark, sf_dir).where("exemplar").select(F.col("doc_id").alias("Index"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("Index"), F.coalesce("text", F.lit("")).alias("Prompt"), F.lit("").alias("StarterCode"), F.col("source").alias("IdealResponse"))
    packet = review.review_packet(rows, docs)
    blanks = [c for c in packet.columns if c not in ("Index", "Prompt", "StarterCode", "IdealResponse")]
    return packet.select("Index", F.md5("Prompt").alias("prompt"), F.col("IdealResponse").alias("ideal"), sum((F.col(f"`{c}`") == "").cast("int") for c in blanks).alias("n_blank"))


def q_flag_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The utility of every document from its report's flags."""
    rows = audit.detailed(audit.signals(spark, sf_dir))
    return rows.select("Index", ladders.utility_of_flags(*map(F.col, ("BenchmarkDefectCandidate", "TrivialityCheck", "ContradictionCheck", "ExemplarCheck"))).alias("utility"))


def q_review_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: classes of difficulty that occur, whether they suffice, in words, and what its actions advise."""
    rows = audit.signals(spark, sf_dir).select("source", "difficulty", F.when(F.col("defect"), "remove").when(F.col("sensitivity") != "stable", "fix").otherwise("keep").alias("action"))
    found = rows.groupBy("source").agg(F.count_distinct("difficulty").alias("n"), F.collect_set("action").alias("actions"))
    return found.select("source", "n", ladders.spread_result(F.col("n")).alias("result"), ladders.spread_text(F.col("n")).alias("text"), ladders.action_text(F.col("actions")).alias("advice"))


def q_judged_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: an event is a judge's answer; its type the verdict (views are blank), its value the reason; clicks are calls that failed."""
    verdict = F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type"))
    answers = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "click", F.to_json(F.struct(verdict.alias("final_verdict"), F.floor("value").cast("string").alias("reason")))).alias("payload"), F.when(F.col("event_type") == "click", "TimeoutError: late").otherwise("").alias("error"))
    return judge.audits(answers).select("event_id", "final_verdict", "likely_root_cause", "confidence", "reason", "recommended_followup")


def q_judged_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: a conversation is an answer with its first three turns as notes, for the columns user and assistant; the last note of a column holds."""
    rows = table(spark, sf_dir, "conversations").where("turn <= 3").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    note = F.transform("x", lambda t: F.struct(t["role"].alias("column"), F.substring(F.coalesce(t["text"], F.lit("")), 1, 20).alias("note")))
    answers = rows.select(F.col("conv_id").alias("request_id"), F.array(F.lit("user"), F.lit("assistant")).alias("allowed_columns"), F.to_json(F.struct(note.alias("notes"))).alias("payload"))
    got = judge.notes(answers)
    return got.select(F.col("request_id").alias("conv_id"), *(F.coalesce(F.try_element_at("notes", F.lit(c)), F.lit("")).alias(f"{c}_note") for c in ("user", "assistant")))


def q_manifest_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter: a nation is a batch, the customers' market segments its samples."""
    segment = F.expr("CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'HOUSEHOLD' THEN 3 WHEN 'FURNITURE' THEN 4 ELSE 5 END")
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_set(segment).alias("sample_indices"), F.array(F.min("c_name")).alias("question_ids"))
    one = bundles.manifest_union(rows.select(F.format_string("batch_%02d", "c_nationkey").alias("output_dir"), "sample_indices", "question_ids"))
    return one.select("batch_count", F.array_join("batch_output_dirs", ",").alias("dirs"), F.array_join(F.transform("sample_indices", lambda x: x.cast("string")), ",").alias("indices"), F.size("question_ids").alias("n_questions"))


def q_top_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent part types."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("Index"), F.col("p_type").alias("title"))
    return review.top_titles(rows, "title")


def q_compact_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event payloads on one short line; blanks where there is nothing to show."""
    return table(spark, sf_dir, "events").select("event_id", F.md5(render.compact_json(F.col("props"), 24)).alias("compact"))


def q_code_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each assistant message gave code or none, by the branches before any parsing; what needs the parser is ``other``."""
    found = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", code.extract_code("text").alias("x"))
    return found.select("conv_id", "turn", F.when(F.col("x.status").isin("no_code", "refusal"), F.col("x.note")).otherwise("other").alias("note"))


#: What a dataset's profile summarises and counts.
NUMBERS = ("n_words", "n_lines", "score", "rate", "public", "private", "oracle", "redundancy", "n_attempts", "spread", "deviation", "gap")
KINDS = ("lang", "difficulty", "efficacy", "failure_category", "quality_signal", "variance", "disagreement", "sensitivity", "contradiction", "priority", "utility", "regime")


def q_dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve numeric summaries of the enriched samples: count, mean, least, quartiles, most."""
    rows = audit.signals(spark, sf_dir).unpivot([], [F.col(c).cast("double").alias(c) for c in NUMBERS], "metric", "v")
    quartiles = F.percentile("v", F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    found = rows.groupBy("metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), quartiles.alias("q"))
    return found.select("metric", "n", *(F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("mean", "least", "most")), *(F.round(F.col("q")[i], 4).alias(k) for i, k in enumerate(("q1", "median", "q3"))))


def q_dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve frequency tables of the enriched samples in one aggregate, and each as text."""
    rows = audit.signals(spark, sf_dir).unpivot([], list(KINDS), "field", "value")
    n = rows.groupBy("field", "value").agg(F.count("*").alias("n"))
    return n.groupBy("field").agg(F.count("*").alias("n_values"), F.sum("n").alias("n"), F.md5(scalars.counts_text(F.map_from_entries(F.collect_list(F.struct(F.coalesce("value", F.lit("None")).alias("value"), "n"))))).alias("counts"))


def q_test_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of the event payloads as tests: by first sign, how many are no object, and how many hold a literal of Python."""
    p = F.trim(F.coalesce("props", F.lit("")))
    rows = table(spark, sf_dir, "events").groupBy(F.substring(p, 1, 1).alias("first_char"))
    return rows.agg(F.count("*").alias("n"), F.count_if(~p.startswith("{")).alias("n_no_object"), F.count_if(p.rlike("True|False|None")).alias("n_python"))


def q_safe_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the part table as numbers and truth values, and without control signs."""
    size, name = F.col("p_size").cast("string"), F.split_part("p_name", F.lit(" "), F.lit(1))
    odd = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit(" "), size, F.lit(".75 "))).when(F.col("p_partkey") % 7 == 0, name).when(F.col("p_partkey") % 11 == 0, "").otherwise(size)
    truth = F.when(F.col("p_partkey") % 3 == 0, " TRUE ").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.to_float(odd).alias("number"), scalars.to_float(odd, None).alias("number_or_null"), scalars.to_int(odd).alias("whole"), scalars.to_bool(truth).alias("truth"), scalars.printable(F.concat(F.lit("a\u0001\t"), F.col("p_name"))).alias("printable"))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
_B = "coalesce(text, '')"
_LINES = "t AS (SELECT l_orderkey \"Index\", l_linenumber case_index, " + ", ".join(f"{v} {k}" for k, v in _TESTS.items()) + " FROM lineitem)"
_LABEL = "CASE visibility WHEN 'public' THEN 'Public_' ELSE 'Private_' END || lpad((case_index + 1)::VARCHAR, 2, '0')"
_CELL = "CASE status WHEN 'pass' THEN 'PASS' WHEN 'timeout' THEN 'TIMEOUT' WHEN 'fail' THEN 'FAIL:' || coalesce(nullif(failure_type, ''), 'incorrect_output') ELSE 'ERROR:' || coalesce(nullif(failure_type, ''), nullif(exception, ''), 'error') END"


def _windows(t: str, n: int) -> str:
    window = " || ".join("a[i]" if k == 0 else f"a[i + {k}]" for k in range(n))
    return f"(SELECT CASE WHEN t = '' THEN []::VARCHAR[] WHEN len(a) <= {n} THEN [t] ELSE list_distinct(list_transform(range(1, len(a) - {n - 2}), lambda i: {window})) END FROM (SELECT string_split(t, '') a, t FROM (SELECT {t} t)))"


def _toks(t: str) -> str:
    return f"list_filter(string_split_regex({text.sql_normalised(t)}, '[^a-z0-9_]+'), lambda x: x <> '')"


ORACLE = {
    "dataset_profile": f"WITH {audit._S}, w AS (UNPIVOT (SELECT " + ", ".join(f"{c}::DOUBLE {c}" for c in NUMBERS) + " FROM s) ON COLUMNS(*) INTO NAME metric VALUE v) SELECT metric, count(*) n, round(avg(v) + 1e-9, 4) mean, round(min(v) + 1e-9, 4) least, round(max(v) + 1e-9, 4) most, round(quantile_cont(v, 0.25), 4) q1, round(quantile_cont(v, 0.5), 4) median, round(quantile_cont(v, 0.75), 4) q3 FROM w GROUP BY 1",
    "dataset_counts": f"WITH {audit._S}, w AS (" + " UNION ALL ".join(f"SELECT '{c}' field, coalesce({c}, 'None') v, count(*) n FROM s GROUP BY 2" for c in KINDS) + ") SELECT field, count(*) n_values, sum(n)::BIGINT n, md5(string_agg(v || '=' || n, '; ' ORDER BY v)) counts FROM w GROUP BY 1",
    "test_shapes": "SELECT left(p, 1) first_char, count(*) n, count(*) FILTER (NOT starts_with(p, '{')) n_no_object, count(*) FILTER (contains(p, 'True') OR contains(p, 'False') OR contains(p, 'None')) n_python FROM (SELECT trim(coalesce(props, ''), ' ') p FROM events) GROUP BY 1",
    "safe_casts": "SELECT p_partkey, coalesce(v, 0) \"number\", v number_or_null, coalesce(trunc(v)::BIGINT, 0) whole, p_partkey % 3 = 0 truth, 'a' || chr(9) || p_name printable FROM (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN p_size + 0.75::DOUBLE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size::DOUBLE END v FROM part)",
    "test_columns": f"WITH {_LINES} SELECT \"Index\", {_LABEL} \"label\", CASE visibility WHEN 'public' THEN 0 ELSE 1 END kind, case_index + 1 \"number\", {_CELL} cell, 'sample' || \"Index\" || '_attempt1_' || visibility || '_' || case_index request_id FROM t",
    "test_note_requests": f"""WITH {_LINES}, u AS (SELECT *, {_LABEL} lb, {_CELL} ce FROM (SELECT DISTINCT * FROM t)), v AS (SELECT *, visibility = 'private' k, '- ' || lb || ': result=' || ce || CASE WHEN failure_type <> '' THEN '; failure_type=' || failure_type ELSE '' END || CASE WHEN exception <> '' THEN '; exception_type=' || exception ELSE '' END line FROM u WHERE ce <> 'PASS')
 SELECT "Index", 'stage2:' || "Index" || ':m' request_id, count(*) n, first(lb ORDER BY k, case_index, lb, line) first_column, md5(string_agg(line, chr(10) ORDER BY k, case_index, lb, line)) evidence FROM v GROUP BY 1""",
    "candidate_failures": f"WITH {_LINES} SELECT \"Index\", failure_type, n FROM (SELECT \"Index\", failure_type, count(*) n, row_number() OVER (PARTITION BY \"Index\" ORDER BY count(*) DESC, min(row(visibility, case_index))) k FROM t WHERE case_index % 2 = 1 AND failure_type <> '' GROUP BY 1, 2) WHERE k = 1",
    "case_contexts": """WITH f AS (SELECT CASE WHEN l_linenumber >= 5 THEN l_suppkey ELSE l_partkey END "Index", CASE WHEN l_linenumber >= 5 THEN 'generated' WHEN l_linenumber = 4 THEN 'other' WHEN l_linestatus = 'F' THEN 'public' ELSE 'private' END visibility, count(*) n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
 SELECT "Index", visibility, 0 case_index, 'x' expected, n, coalesce(CASE WHEN visibility IN ('public', 'private') THEN p_name WHEN visibility = 'generated' THEN s_name END, '') input, CASE visibility WHEN 'public' THEN coalesce(p_brand, '') WHEN 'private' THEN coalesce(p_type, '') WHEN 'generated' THEN coalesce(s_nationkey::VARCHAR, '') ELSE 'x' END output,
 coalesce(CASE WHEN visibility IN ('public', 'private') THEN p_type WHEN visibility = 'generated' AND s_suppkey IS NOT NULL THEN 'edge' END, '') focus FROM f LEFT JOIN part ON p_partkey = "Index" LEFT JOIN supplier ON s_suppkey = "Index\"""",
    "signatures": f"""SELECT item_id, len({_toks(_B)}) n_tokens, len(list_distinct(list_concat({_windows(text.sql_normalised(f"left({_B}, 60)"), 5)}, {_toks(f"left({_B}, 60)")}))) n_starter,
 len(list_distinct(list_concat({_windows(f"lower(regexp_extract({_B}, '^[A-Za-z]*'))", 5)}, {_toks(f"regexp_extract({_B}, '^[A-Za-z]*')")}))) n_function, len({_windows(text.sql_normalised(f"'public:functional:' || left({_B}, 40) || ':' || right({_B}, 40)"), 4)}) n_tests, len({_windows(text.sql_template(_B), 5)}) n_template,
 md5(CASE WHEN w = '' THEN '' ELSE w || CASE WHEN b = '' THEN '' ELSE chr(10) END END || left(b, 2500)) embedding_text FROM (SELECT *, regexp_extract({_B}, '^[A-Za-z]*') w, regexp_replace({_B}, '^{text.SPACE}|{text.SPACE}$', '', 'g') b FROM benchmark)""",
    "review_details": f"""WITH {audit._S}, l AS (SELECT doc_id, max(quality) q, max(toxic) x FROM labels GROUP BY 1) SELECT s.doc_id "Index", 'Stage 2: ' || efficacy || '; benchmark_quality=' || quality_signal || '; failure_category=' || failure_category || '; Stage 3 reason=' || reasons context,
 CASE WHEN l.doc_id IS NULL THEN '' WHEN q = 1 THEN 'keep' ELSE 'fix' END "FinalAction", CASE WHEN l.doc_id IS NULL THEN '' WHEN x = 1 THEN 'defective' ELSE 'trustworthy' END "BenchmarkTrustCheck", '' "FailureAttribution", CASE WHEN l.doc_id IS NULL THEN 'pending' ELSE 'completed' END "ReviewStatus" FROM s LEFT JOIN l ON l.doc_id = s.doc_id WHERE priority = 'critical'""",
    "review_packet": f'WITH {audit._S} SELECT s.doc_id "Index", md5(coalesce(text, \'\')) prompt, d.source ideal, 21 n_blank FROM s JOIN documents d ON d.doc_id = s.doc_id WHERE exemplar',
    "flag_utility": f"WITH {audit._S} SELECT doc_id \"Index\", utility FROM s",
    "review_advice": f"""WITH {audit._S}, a AS (SELECT source, count(DISTINCT difficulty) n, bool_or(defect) r, bool_or(NOT defect AND sensitivity <> 'stable') f FROM s GROUP BY 1) SELECT source, n, CASE WHEN n >= 3 THEN 'PASS' ELSE 'REVIEW' END "result", CASE WHEN n >= 3 THEN 'The dataset spans multiple observed difficulty regimes.' ELSE 'The observed difficulty regime looks narrow or unstable.' END "text",
 CASE WHEN r THEN 'Validate the remove candidates first; they have the largest benchmark-quality impact.' WHEN f THEN 'Prioritize fix candidates before broadening manual audit coverage.' ELSE 'Use keep decisions as calibration exemplars for earlier stages.' END advice FROM a""",
    "judged_audits": """SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'unclear' ELSE event_type END final_verdict, 'other' likely_root_cause, 'low' confidence, CASE WHEN event_type = 'click' THEN 'Request failed: TimeoutError: late' ELSE coalesce(floor("value")::BIGINT::VARCHAR, '') END reason, CASE WHEN event_type = 'click' THEN 'Retry with fewer calls at a time, or read the trace.' ELSE '' END recommended_followup FROM events""",
    "judged_notes": """WITH n AS (SELECT conv_id, role, turn, trim(left(coalesce(text, ''), 20), ' ') note FROM conversations WHERE turn <= 3), l AS (SELECT conv_id, role, arg_max(note, turn) note FROM n WHERE note <> '' GROUP BY 1, 2)
 SELECT c.conv_id, coalesce(max(note) FILTER (role = 'user'), '') user_note, coalesce(max(note) FILTER (role = 'assistant'), '') assistant_note FROM (SELECT DISTINCT conv_id FROM n) c LEFT JOIN l ON l.conv_id = c.conv_id GROUP BY 1""",
    "manifest_union": """WITH c AS (SELECT c_nationkey k, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'HOUSEHOLD' THEN 3 WHEN 'FURNITURE' THEN 4 ELSE 5 END s FROM customer) SELECT count(DISTINCT k) batch_count, (SELECT string_agg('batch_' || lpad(k::VARCHAR, 2, '0'), ',' ORDER BY k) FROM (SELECT DISTINCT k FROM c)) dirs, (SELECT string_agg(s::VARCHAR, ',' ORDER BY s) FROM (SELECT DISTINCT s FROM c)) indices, count(DISTINCT k) n_questions FROM c""",
    "top_titles": "SELECT p_type title, count(*) n FROM part GROUP BY 1 ORDER BY n DESC, min(p_partkey) LIMIT 10",
    "compact_values": f"SELECT event_id, md5(CASE WHEN coalesce(props, '') IN ('', 'null', '\"\"', '{{}}') THEN '' WHEN length(p) <= 24 THEN p ELSE left(p, 21) || '...' END) compact FROM (SELECT *, trim(regexp_replace(coalesce(props, ''), '[ \\t\\r\\n]+', ' ', 'g'), ' ') p FROM events)",
    "code_notes": f"""SELECT conv_id, turn, CASE WHEN regexp_replace(coalesce(text, ''), '{text.SPACE}', '', 'g') = '' THEN 'Model returned an empty response.' WHEN regexp_matches(lower(text), 'i can''t help|i cannot help|i can’t provide|i cannot provide|sorry, but|as an ai') THEN 'Model refused or declined to answer.' ELSE 'other' END note FROM conversations WHERE role = 'assistant'""",
}
