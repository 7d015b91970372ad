"""Artifacts of a run as tables: the bundles that stages read, and files that they write for people. Files live where the driver runs and hold bounded slices."""

from __future__ import annotations

import csv
import json
import re
import shutil
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import artifacts, tables

#: Rows of a report's table.
ROWS = 1 << 20
LEGACY = {
    "BenchmarkTrustCheck": ("GroundTruthValidity",),
    "Notes-BenchmarkTrustCheck": ("Notes-GroundTruthValidity",),
    "FailureAttribution": (),
    "Notes-FailureAttribution": (),
    "PipelineCalibrationCheck": ("LabelCalibrationCheck",),
    "Notes-PipelineCalibrationCheck": ("Notes-LabelCalibrationCheck",),
    "FinalAction": (),
    "Notes-FinalAction": (),
    "SummaryConfidence": ("ReviewConfidence",),
}
#: Parts of a finding, and the columns of one finding that older reviews had.
FINDING = {"Finding{}DefectType": ("DefectType", "ErrorType"), "Finding{}Severity": ("Severity",), "Finding{}Confidence": ("ReviewConfidence",), "Notes-Finding{}": ("Notes-DefectType",)}
SLOTS = (1, 2, 3)


def keyed(rows: list[dict], key: str = "Index") -> list[dict]:
    """The last row of each whole-number key, ascending; rows without one are left out."""
    found = {int(str(r[key]).strip()): r for r in rows if re.fullmatch(r"-?\d+", str(r.get(key) or "").strip())}
    return [found[k] for k in sorted(found)]


def frame(spark: SparkSession, rows: list[dict], key: str = "Index") -> DataFrame:
    """Rows of texts as a table, its key a number; columns are those of all rows."""
    names = list(dict.fromkeys([key, *(n for r in rows for n in r)]))
    schema = ", ".join(f"`{n}` {'long' if n == key else 'string'}" for n in names)
    return spark.createDataFrame([tuple(int(r[n]) if n == key else r.get(n) for n in names) for r in rows], schema)


def read_stripped(spark: SparkSession, path: str, key: str = "Index") -> DataFrame:
    """A CSV with every value stripped and missing ones blank, its key a number; the last row of a key in file order holds."""
    rows = tables.read(spark, path, "csv").withColumn("__at", F.monotonically_increasing_id())
    plain = rows.select(F.trim(key).cast("long").alias(key), *(F.trim(F.coalesce(f"`{c}`", F.lit(""))).alias(c) for c in rows.columns if c not in (key, "__at")), "__at")
    return artifacts.last_wins(plain, [key], "__at").drop("__at")


def stage1(spark: SparkSession, workbook: str) -> dict[str, DataFrame]:
    """The sheets Detailed and Summary by Index."""
    return {name.lower(): frame(spark, keyed(artifacts.read_workbook(workbook, name))) for name in ("Detailed", "Summary")}


def stage2(spark: SparkSession, folder: str) -> dict[str, DataFrame | dict]:
    """Samples, models, attempts and tests of a run with its manifest; ``best``: the first model row in file order with the largest rate, unreadable rates last."""
    root = Path(folder)
    models = tables.read(spark, str(root / "sample_model_results.csv"), "csv").withColumn("__at", F.monotonically_increasing_id())
    rate = F.coalesce(F.col("BestCombinedPassRate").try_cast("double"), F.lit(float("-inf")))
    kept = [c for c in models.columns if c not in ("Index", "__at")]
    best = models.groupBy(F.col("Index").cast("long").alias("Index")).agg(F.max_by(F.struct(*(f"`{c}`" for c in kept)), F.struct(rate.alias("rate"), (-F.col("__at")).alias("first"))).alias("b")).select("Index", "b.*")
    out = {"samples": tables.read(spark, str(root / "sample_results.csv"), "csv"), "models": models.drop("__at"), "best": best}
    out |= {name: tables.read(spark, str(root / file), "jsonl") for name, file in (("attempts", "model_attempts.jsonl"), ("tests", "per_test_results.jsonl"))}
    manifest = root / "run_manifest.json"
    return out | {"manifest": json.loads(manifest.read_text(encoding="utf-8")) if manifest.exists() else {}}


def stage3(path: str) -> dict:
    """The payload of the third stage in a report's JSON file; empty if it holds none."""
    return json.loads(Path(path).read_text(encoding="utf-8")).get("stage3", {})


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """Human reviews of a CSV or JSON file (a list, or an object with reviews) by Index, under today's names; older names and the single older finding fill what is missing."""
    text = Path(path).read_text(encoding="utf-8-sig")
    loaded = list(csv.DictReader(text.splitlines(True))) if path.lower().endswith(".csv") else json.loads(text)
    loaded = loaded.get("reviews", []) if isinstance(loaded, dict) else loaded

    def value(r: dict, *names: str) -> str:
        return next((str(r[n] or "").strip() for n in names if n in r), "")

    rows = []
    for r in loaded:
        row = {"Index": r.get("Index", r.get("index"))} | {n: value(r, n, *older) for n, older in LEGACY.items()}
        row |= {n.format(s): value(r, n.format(s)) for s in SLOTS for n in FINDING}
        if not row["Finding1DefectType"] and value(r, "DefectType", "ErrorType"):
            row |= {n.format(1): value(r, *older) for n, older in FINDING.items()}
        rows.append(row)
    return frame(spark, keyed(rows))


def write_json(path: str, payload: object) -> None:
    """Indented, signs outside ASCII as they are, ended by a newline."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload, ensure_ascii=False, indent=2, default=str) + "\n", encoding="utf-8")


def collected(df: DataFrame, most: int = ROWS) -> list[dict]:
    """A slice's rows for a file; more than ``most`` is an error, not a cut."""
    rows = [r.asDict(True) for r in df.limit(most + 1).toLocalIterator()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a file; write a table")
    return rows


def whitelisted(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only these columns, in this order; a missing one is blank."""
    return df.select(*(F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in columns))


def write_csv_file(df: DataFrame, path: str, bom: bool = False) -> bool:
    """One CSV file with a header. Without rows: an empty file, or with ``bom`` (for spreadsheets) none at all; returns whether there is a file."""
    rows = collected(df)
    if not rows and bom:
        return False
    with Path(path).open("w", encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
        if rows:
            out = csv.DictWriter(f, fieldnames=df.columns)
            out.writeheader()
            out.writerows({k: json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, list | dict) else v for k, v in r.items()} for r in rows)
    return True


def write_report(folder: str, stages: dict[str, dict[str, DataFrame | object]], stamp: str | None = None) -> tuple[str, str]:
    """All stages' tables as one workbook and one JSON file under a stamp, copied to stable names; older stamped files go. ``stages``: name, then part, then table or value."""
    root, stamp = Path(folder), stamp or time.strftime("%Y%m%d_%H%M%S")
    root.mkdir(parents=True, exist_ok=True)
    book, data = root / f"combined_analysis_{stamp}.xlsx", root / f"combined_analysis_{stamp}.json"
    sheets = {f"{stage} {part}"[:31]: df for stage, parts in stages.items() for part, df in parts.items() if isinstance(df, DataFrame)}
    artifacts.write_workbook(str(book), sheets)
    write_json(str(data), {"timestamp": stamp} | {stage: {part: collected(v) if isinstance(v, DataFrame) else v for part, v in parts.items()} for stage, parts in stages.items()})
    for made in (book, data):
        shutil.copy2(made, root / f"combined_analysis{made.suffix}")
    for old in root.glob("combined_analysis_*.*"):
        if old.suffix in (".xlsx", ".json") and old not in (book, data):
            old.unlink()
    return str(book), str(data)


def narrative(size: int, risks: list[str], signal: str, advice: list[str], queues: DataFrame, rules: DataFrame, shown: int = 5) -> str:
    """The third stage in words: size, risks, strongest signal, advice, the first of each queue and the strongest rules.

    ``queues``: queue, position, doc_id, reason, priority, utility; ``rules``: signal, n, delta, lift, strength.
    """
    lines = ["# Stage 3 Dataset Analysis", "", f"- Samples analyzed: {size}", f"- Biggest structural risks: {'; '.join(risks) or 'None detected.'}", f"- Strongest Stage 1 to Stage 2 signal: {signal or 'n/a'}", f"- Recommended next actions: {'; '.join(advice) or 'None recorded.'}", "", "## Audit Queues"]
    by_queue: dict[str, list] = {}
    for r in queues.where(F.col("position") <= shown).orderBy("queue", "position").collect():
        by_queue.setdefault(r["queue"], []).append(f"- Index {r['doc_id']}: {r['reason']} [priority={r['priority']}, utility={r['utility']}]")
    for name, entries in by_queue.items():
        lines += [f"### {name}", *entries]
    top = rules.orderBy(F.desc("strength"), F.desc("n"), "signal").limit(shown).collect()
    lines += ["", "## Stage 1 to Stage 2 Relationships", *(f"- {r['signal']}: sample_count={r['n']}, pass_delta={r['delta']}, suspicious_lift={r['lift']}" for r in top)]
    return "\n".join(lines if top else [*lines, "- No relationship rows generated."]) + "\n"


def run_narrative(comparisons: DataFrame, models: DataFrame, n_attempts: int, n_tests: int) -> str:
    """The second stage in words. ``comparisons``: Index, winner, suspicious, note; ``models``: target, rate, pass_at_1. Suspicious samples are listed, as many as a file holds."""
    lines = ["# Stage 2 Summary", "", f"Samples evaluated: {comparisons.count()}", f"Model result rows: {models.count()}", f"Attempt rows: {n_attempts}", f"Per-test rows: {n_tests}", "", "## Comparison Winners"]
    lines += [f"- {r['winner']}: {r['count']}" for r in comparisons.groupBy("winner").count().orderBy("winner").collect()]
    means = models.groupBy("target").agg(F.avg("rate").alias("rate"), F.avg("pass_at_1").alias("p")).orderBy("target").collect()
    lines += ["", "## Model Performance", *(f"- {r['target']}: avg best combined pass rate {r['rate']:.3f}, avg CombinedPass@1 {r['p']:.3f}" for r in means), "", "## Suspicious Samples"]
    odd = collected(comparisons.where("suspicious").select("Index", "note").orderBy("Index"))
    return "\n".join([*lines, *(f"- sample {r['Index']}: {r['note']}" for r in odd)] if odd else [*lines, "- none"]) + "\n"


def column_report(rows: DataFrame, name: str) -> str:
    """One check's verdicts as a Markdown table. ``rows``: Index, difficulty, function_name, verdict, note; notes are cut at 220 characters."""
    cell = lambda x: "" if x is None else str(x).replace("|", "/").replace("\n", " ")
    found = collected(rows.select("Index", "difficulty", "function_name", "verdict", "note").orderBy("Index"))
    cut = lambda t: t if len(t) <= 220 else t[:217] + "..."
    lines = [f"# Single Column Report: {name}", "", f"Samples evaluated: {len(found)}", "", "| Index | Difficulty | Function | Verdict | Notes |", "| --- | --- | --- | --- | --- |"]
    lines += [f"| {r['Index']} | {cell(r['difficulty'])} | {cell(r['function_name'])} | {cell(r['verdict'])} | {cut(cell(r['note']).strip())} |" for r in found]
    return "\n".join(lines) + "\n"


#: A prompt in a module: the text between triple quotes after ``prompt =``.
PROMPT = re.compile(r"prompt\s*=\s*f?([\"']{3})(.*?)\1", re.S)


def extract_prompts(spark: SparkSession, modules: str) -> DataFrame:
    """(source, prompt) of every file under a path that holds a prompt, the first of each."""
    files = spark.read.option("recursiveFileLookup", True).text(modules, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")
    found = F.regexp_extract("value", r"(?s)prompt\s*=\s*f?(\x22{3}|\x27{3})(.*?)\1", 2)
    return files.select("source", F.trim(F.regexp_replace(found, r"^\s+|\s+$", "")).alias("prompt")).where(F.col("value").rlike(r"prompt\s*=\s*f?(\x22{3}|\x27{3})"))


def bundle(target: str, parts: dict[str, tuple[str, list[str]]]) -> dict[str, list[str]]:
    """Copies files and folders of each part (source folder, names) into an audit tree, made anew; returns what was there to copy, which the tree's manifest holds too."""
    root, copied = Path(target), {}
    for part, (source, names) in parts.items():
        shutil.rmtree(root / part, ignore_errors=True)
        (root / part).mkdir(parents=True)
        copied[part] = []
        for name in names:
            at = Path(source) / name
            if at.is_dir():
                shutil.copytree(at, root / part / name)
            elif at.exists():
                (root / part / name).parent.mkdir(parents=True, exist_ok=True)
                shutil.copy2(at, root / part / name)
            if at.exists():
                copied[part].append(name)
    write_json(str(root / "manifest.json"), copied)
    return copied


def write_html(path: str, rows: DataFrame, title: str, columns: list[str]) -> None:
    """Samples as one HTML page, each column's text as Markdown."""
    from html import escape

    from ..functions.render import markdown

    body = "".join(f"<article><h2>{escape(str(r[columns[0]]))}</h2>" + "".join(f"<h3>{escape(c)}</h3>{markdown(None if r[c] is None else str(r[c]))}" for c in columns[1:]) + "</article>" for r in collected(rows.select(*columns)))
    Path(path).write_text(f'<!doctype html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{body}</body></html>\n', encoding="utf-8")


def manifest_union(manifests: DataFrame) -> DataFrame:
    """One row over all manifests (output_dir, sample_indices, question_ids): folders, distinct indices in order, all question ids."""
    flat = lambda c: F.flatten(F.collect_list(F.coalesce(c, F.array().cast(dict(manifests.dtypes)[c]))))
    return manifests.agg(F.count("*").alias("batch_count"), F.array_sort(F.collect_list("output_dir")).alias("batch_output_dirs"), F.array_sort(F.array_distinct(flat("sample_indices"))).alias("sample_indices"), flat("question_ids").alias("question_ids"))


def recompute(manifests: DataFrame, samples: DataFrame, step, key: str = "Index") -> DataFrame:
    """``step`` over all samples that any manifest names: results that compare samples with one another can't be merged from batches."""
    named = manifests.select(F.explode("sample_indices").alias(key)).distinct()
    return step(samples.join(named, key, "left_semi"))


def snapshot(folder: str, rows: DataFrame, summary: DataFrame, manifest: dict, columns: list[str]) -> None:
    """A checkpoint for people: rows as CSV, the summary (name, evidence) as Markdown, the manifest as JSON."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    write_csv_file(whitelisted(rows, columns), f"{folder}/rows.csv")
    lines = ["# Snapshot", "", *(f"- {r['name']}: {r['evidence']}" for r in summary.collect())]
    Path(folder, "summary.md").write_text("\n".join(lines) + "\n", encoding="utf-8")
    write_json(f"{folder}/run_manifest.json", manifest)
