"""Caches, checkpoints and resumable batches as tables; reports as CSV, JSON lines and workbooks."""

from __future__ import annotations

import time
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a sheet, the header included: the format's own bound.
SHEET_ROWS = 1 << 20
_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
# Fills by the beginning of a cell.
FILLS = {"PASS": "FFC6EFCE", "FAIL": "FFFFC7CE", "PARTIAL": "FFFFEB9C", "Usable": "FFC6E0B4", "Needs Fixing": "FFFFF2CC", "Unusable": "FFF4CCCC"}


def fingerprint(*parts: Column, version: str = "1") -> Column:
    """SHA-256 over a version and all parts; nulls and empty texts differ."""
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("v"), *(p.alias(f"p{i}") for i, p in enumerate(parts))), {"ignoreNullFields": "false"}), 256)


def split_cached(requests: DataFrame, cache: DataFrame, on: tuple[str, ...] = ("request_id", "fingerprint")) -> tuple[DataFrame, DataFrame]:
    """Requests with their cached columns (hits), and those without (misses): id and fingerprint must both agree."""
    return requests.join(cache, list(on)), requests.join(cache, list(on), "left_anti")


def current(cache: DataFrame, version: str) -> DataFrame:
    """The entries of a cache (version, others) that this version wrote; an older cache counts as empty."""
    return cache.where(F.col("version") == version)


def attach_cached(rows: DataFrame, cache: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``rows`` (fingerprint, others) with their cached values, and the cache with what ``fetch`` made of the missing ones, each asked once."""
    missing = rows.join(cache, "fingerprint", "left_anti").dropDuplicates(["fingerprint"])
    known = cache.unionByName(fetch(missing).select(*cache.columns))
    return rows.join(known, "fingerprint", "left"), known


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new``, and those of ``old`` whose key it does not hold (null keys are equal)."""
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    kept = old.alias("o").join(new.select(*keys).distinct().alias("n"), same, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest ``order`` of each key: an aggregate, not a sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("last")).select(*keys, "last.*")


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def run_batches(spark: SparkSession, root: str, rows: DataFrame, key: str, size: int, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Applies ``step`` to ranges of ``size`` values of an integer key; ranges already written are skipped, so a stopped run goes on.

    A range counts once its ``_SUCCESS`` marker is there. Returns the rows of all ranges.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    paths = []
    for lo in range(low - low % size, high + 1, size) if low is not None else ():
        path = f"{root}/batch_{lo:012d}"
        fs, done = _fs(spark, f"{path}/_SUCCESS")
        if not fs.exists(done):
            step(rows.where((F.col(key) >= lo) & (F.col(key) < lo + size))).write.mode("overwrite").parquet(path)
        paths.append(path)
    return spark.read.parquet(*paths) if paths else step(rows)


def upsert_locked(df: DataFrame, path: str, keys: list[str]) -> None:
    """Upserts rows into a table that one writer at a time may change: a lock file beside it is made first, which fails where there is one."""
    spark = df.sparkSession
    fs, lock = _fs(spark, f"{path}.lock")
    fs.create(lock, False).close()  # not overwritten: a file system refuses the second writer
    try:
        there = fs.exists(_fs(spark, path)[1])
        replace_versioned(upsert(spark.read.parquet(path), df, keys) if there else df, path)
    finally:
        fs.delete(lock, False)


def run_checkpointed(todo: DataFrame, done: str, step: Callable[[DataFrame], DataFrame], key: str = "request_id", size: int = 100, most: int | None = None) -> int:
    """Appends ``step`` of batches of ``size`` requests to the checkpoint ``done`` (JSON lines), leaving out ids that it holds, for ``most`` batches at most; returns how many ran."""
    spark, n = todo.sparkSession, 0
    while most is None or n < most:
        fs, at = _fs(spark, done)
        left = todo.join(spark.read.json(done).select(key), key, "left_anti") if fs.exists(at) else todo
        batch = left.orderBy(key).limit(size)
        if batch.isEmpty():
            break
        append_rows(step(batch), done)
        n += 1
    return n


def replace_versioned(df: DataFrame, path: str, keep: int = 1) -> str | None:
    """Writes a table beside the old one, moves the old one to a stamped name and keeps the newest ``keep`` of those; returns that name."""
    spark, stamp = df.sparkSession, f"{time.time_ns():020d}"
    fresh, old = f"{path}.new-{stamp}", f"{path}.old-{stamp}"
    df.write.parquet(fresh)
    fs, at = _fs(spark, path)
    moved = fs.exists(at) and fs.rename(at, _fs(spark, old)[1])
    if not fs.rename(_fs(spark, fresh)[1], at):
        raise OSError(f"{fresh} could not be moved to {path}")
    inside = _fs(spark, f"{path}/{fresh.rsplit('/', 1)[-1]}")[1]
    if fs.exists(inside):  # some file systems move a folder into one that another writer made meanwhile
        fs.delete(inside, True)
        raise OSError(f"{path} was replaced by another writer at the same time")
    stamped = sorted(x.getPath().toString() for x in fs.listStatus(at.getParent()) if x.getPath().getName().startswith(at.getName() + ".old-"))
    for name in stamped[: max(0, len(stamped) - keep)]:
        fs.delete(_fs(spark, name)[1], True)
    return old if moved else None


def _letters(i: int) -> str:
    out = ""
    while True:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
        if i < 0:
            return out


def _sheet(names: list[str], rows: Iterator, styles: dict[str, int], percents: frozenset[int]) -> Iterator[str]:
    yield f'<worksheet xmlns="{_NS}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>'
    yield _row(1, names, styles)
    for n, row in enumerate(rows, 2):
        if n > SHEET_ROWS:
            raise ValueError(f"a sheet holds {SHEET_ROWS} rows at most")
        yield _row(n, row, styles, percents)
    yield "</sheetData></worksheet>"


def _row(n: int, row, styles: dict[str, int], percents: frozenset[int] = frozenset()) -> str:
    cells = []
    for i, v in enumerate(row):
        at = f"{_letters(i)}{n}"
        if v is None:
            continue
        if isinstance(v, int | float) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
            percent = f' s="{1 + len(FILLS)}"' if i in percents else ""
            cells.append(f'<c r="{at}"{percent}><v>{v!r}</v></c>')
            continue
        text = "".join(c for c in str(v) if c in "\t\n\r" or c >= " ")
        style = next((s for p, s in styles.items() if text.startswith(p)), 0)
        cells.append(f'<c r="{at}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
    return f'<row r="{n}">{"".join(cells)}</row>'


def write_workbook(path: str, sheets: dict[str, DataFrame], percent: tuple[str, ...] = ()) -> None:
    """A workbook on the driver with a frozen header, verdict colours and percentages in the columns ``percent``; rows stream through, and a table beyond a sheet's bound raises."""
    styles = {p: i for i, p in enumerate(FILLS, 1)}
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="{c}"/></patternFill></fill>' for c in FILLS.values())
    formats = "".join(f'<xf fillId="{i}" applyFill="1"/>' for i in range(2, 2 + len(FILLS))) + '<xf numFmtId="9" applyNumberFormat="1"/>'
    rel, kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    pack = "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_NS}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + f'<Relationship Id="s" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{_NS}"><fonts count="1"><font/></fonts><fills count="{2 + len(FILLS)}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills><borders count="1"><border/></borders><cellXfs count="{2 + len(FILLS)}"><xf/>{formats}</cellXfs></styleSheet>')
        for i, df in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                for text in _sheet(df.columns, df.toLocalIterator(), styles, frozenset(i for i, c in enumerate(df.columns) if c in percent)):
                    f.write(text.encode())


def read_workbook(path: str, sheet: str, keep_blank: bool = False) -> list[dict[str, str | None]]:
    """Rows of a sheet as texts by header; blank rows are skipped unless ``keep_blank``. A workbook is a driver-side file."""
    with zipfile.ZipFile(path) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        names = [x.get("name") for x in book.iter(f"{{{_NS}}}sheet")]
        shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        body = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{names.index(sheet) + 1}.xml"))
    rows = []
    for row in body.iter(f"{{{_NS}}}row"):
        cells = {}
        for c in row.iter(f"{{{_NS}}}c"):
            column = "".join(x for x in c.get("r") if x.isalpha())
            value = c.find(f"{{{_NS}}}v")
            text = "".join(t.text or "" for t in c.iter(f"{{{_NS}}}t")) if c.get("t") == "inlineStr" else value.text if value is not None else None
            cells[column] = shared[int(text)] if c.get("t") == "s" and text is not None else text
        rows.append(cells)
    if not rows:
        return []
    head = rows[0]
    out = [{name: r.get(column) for column, name in head.items()} for r in rows[1:]]
    return [r for r in out if keep_blank or any(v not in (None, "") for v in r.values())]


def append_rows(df: DataFrame, path: str) -> None:
    """Adds rows to a checkpoint of JSON lines; ``last_wins`` replays it."""
    df.write.mode("append").json(path)
