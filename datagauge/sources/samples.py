"""The sample source: JSON lines whose metadata and tests are JSON texts themselves."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.checks import TESTS

ROW = "question_title string, question_content string, difficulty string, starter_code string, ideal_response string, metadata string, public_test_cases string, private_test_cases string"


def parse_indices(raw: str | None) -> list[int] | None:
    """Indices of a list parted by commas or white space, or of the file that it names; None for an empty text; anything else raises ValueError."""
    text = (raw or "").strip()
    if text and not re.fullmatch(r"[-\d,\s]+", text) and Path(text).is_file():
        text = Path(text).read_text(encoding="utf-8-sig")
    parts = re.split(r"[,\s]+", text)
    return [int(p) for p in parts if p] or None


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Index and value of every line that is not blank, counted from 0 over files by name.

    Lines are counted in each block of a file where they are read; only a row for each block is put in order.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).where(F.trim("value") != "")
    rows = rows.withColumn("id", F.monotonically_increasing_id())
    blocks = rows.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "start", (before - F.col("first")).alias("shift"))
    return rows.join(blocks, ["file", "start"]).select((F.col("id") + F.col("shift")).alias("Index"), "value")


def decode(value: Column, schema: str, strict: bool = True) -> Column:
    """A JSON text by its schema; a malformed one raises, or is null if not ``strict``."""
    return F.from_json(value, schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})


def read_samples(spark: SparkSession, path: str, indices: list[int] | None = None, limit: int | None = None, strict: bool = True, offset: int = 0) -> DataFrame:
    """Samples as ``operators.checks`` takes them, with Index, position and title; all, or ``limit`` from ``offset`` on.

    ``indices`` go before both: a row for each, repeated where an index is, ``position`` its place in the list; one that is out of range raises IndexError.
    """
    lines = numbered_lines(spark, path)
    if indices is not None:
        wanted = spark.createDataFrame([(i, n) for n, i in enumerate(indices)], "Index long, position long")
        lacking = wanted.join(lines, "Index", "left_anti").select("Index").distinct().collect()
        if lacking:
            raise IndexError(f"no samples {sorted(r[0] for r in lacking)}")
        lines = lines.join(F.broadcast(wanted), "Index")  # the list is the caller's own
    else:
        lines = lines.where(F.col("Index") >= offset).withColumn("position", F.col("Index") - offset)
        lines = lines if limit is None else lines.where(F.col("position") < limit)
    rows = lines.select("Index", "position", decode(F.col("value"), ROW, strict).alias("r")).select("Index", "position", "r.*")
    tests = [F.coalesce(decode(F.col(f"{x}_test_cases"), TESTS, strict), F.array().cast(TESTS)).alias(x) for x in ("public", "private")]
    name = decode(F.col("metadata"), "func_name string", strict)["func_name"]
    return rows.select("Index", "position", F.col("Index").alias("sample_id"), F.col("question_title").alias("title"), F.col("question_content").alias("prompt"), F.col("starter_code").alias("starter"), F.col("ideal_response").alias("ideal"), name.alias("function_name"), "difficulty", *tests)


def test_rows(samples: DataFrame) -> DataFrame:
    """A row for each test: Index, visibility, case_index (from 1 in each visibility), input, output, testtype."""
    parts = [samples.select("Index", F.lit(v).alias("visibility"), F.posexplode(v).alias("at", "t")).select("Index", "visibility", (F.col("at") + 1).alias("case_index"), "t.*") for v in ("public", "private")]
    return parts[0].unionByName(parts[1])
