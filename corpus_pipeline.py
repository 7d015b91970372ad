"""Documents to token ids: language, toxicity, near-duplicates, mixture, SentencePiece.

Each stage works on all that the one before it kept and, but for the last, returns the columns of documents. A
stage's learned parts are fitted on its own input. Null texts are ``und`` and go in the first stage; an empty table passes all
stages empty; documents that repeat an id count as one group from the third stage on, of which the least row stays; null ids stay in until the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datagauge.llm import langid, minhash, mixing, pieces, store, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least score of a language prediction.
SURE = 0.5
#: Words of a shingle; the two of op9 are that query's own.
SHINGLE = 5


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a predicted language; learned as in the query, from three quarters of the labelled ones."""
    docs = docs.select(*COLUMNS)
    model = langid.LanguageModel.fit(docs.where(store.fold(F.col("doc_id"), 4) != 2))
    return langid.predict(docs, model, COLUMNS).where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select(*COLUMNS)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    docs = docs.select(*COLUMNS)
    labels = store.table(spark, sf_dir, "labels").where(store.fold(F.col("doc_id"), 5) != 0)
    return toxicity.score(docs, toxicity.ToxicityModel.fit(docs, labels), COLUMNS).where("predicted = 0").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates by five-word shingles."""
    docs = docs.select(*COLUMNS)
    with store.scope() as keep:
        ids = minhash.link(docs, SHINGLE).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")).where("kept")
        ids = keep(store.materialize(ids.select("doc_id", "rows"), "pipeline-kept"))
    once = docs.join(ids.where("rows = 1"), "doc_id", "left_semi")
    # Only rows that repeat an id are aggregated with their texts.
    rest = [c for c in COLUMNS if c != "doc_id"]
    again = docs.join(ids.where("rows > 1"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("least")).select("doc_id", "least.*")
    return once.unionByName(again).unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, each as often as it is taken."""
    docs = docs.select(*COLUMNS)
    with store.scope() as keep:
        # By id, source and text: null ids stand on many rows.
        taken = mixing.mix(docs, F.array("source"))[0].groupBy(F.col("doc_id").alias("taken_id"), F.col("mark"), F.col("own")[0].alias("taken_source")).agg(F.max("taken_copies").alias("copies")).where("copies > 0")
        taken = keep(store.materialize(taken, "pipeline-taken"))
    same = F.col("doc_id").eqNullSafe(F.col("taken_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("mark")) & F.col("source").eqNullSafe(F.col("taken_source"))
    return docs.join(taken, same).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether they decode to its text."""
    return pieces.encode_rows(docs.select("doc_id", "source", "text"), ["doc_id", "source"])


STAGES = [
    ("language", languages),
    ("toxicity", civil),
    ("near_duplicates", distinct),
    ("mixture", mixture),
    ("sentencepiece", encoded),
]
#: SQL expresses none of the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again."""
    docs = store.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with store.scope() as keep:
            after = keep(store.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        store.drop(docs)  # a table of the stage before; the input itself is not one
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
