"""The patterns of the checks, matched in one pass over each text.

One automaton (Aho-Corasick) over the literals of all patterns reads the lower-cased text once; only the patterns of which a literal occurs are then searched, and those that no literal
stands for. It runs in Arrow batches, so every text crosses once and is matched once however many ladders ask for a count. Patterns follow
Python's rules: words, spaces, digits and cases are Unicode's.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .checks import CHECKS, PATTERNS

#: Bytes of text that are taken out of Arrow at once.
PIECE = 1 << 20
#: Letters outside ASCII that match i and s where case is ignored, beside what lower case gives.
FOLDS = str.maketrans("\u0130\u0131\u017f", "iis")
#: Literals of which a match holds one, in lower case, of patterns that are not alternatives of plain words.
LITERALS = {
    "inflated": ["microsecond", "nanosecond", "ultra-fast", "extreme load", "fault tolerance", "thread safety", "lock-free", "heavy-light decomposition", "segment tree", "trie", "abc", "distributed signal tracking", "real-time"],
    "input_word": ["input"], "output_word": ["output"], "constraint_word": ["constraint"], "random_word": ["random"],
    "limits": ["o(", "time complexity", "space complexity", "<", ">", "≤", "≥"],
    "edge": ["edge case", "empty", "invalid", "error", "return"],
    "signed": ["def"], "signed_starter": ["def"], "nested_def": ["def"],
    "conflict": ["minimi", "optimality", "latency", "scalability", "safest possible", "balance"],
    "number_keys": ["{"], "mutable": ["="], "constant": ["="],
    "random_prompt": ["random", "time.time", "datetime.now", "uuid"], "random_ideal": ["random", "time.time", "datetime.now", "uuid"],
    "arbitrary": ["max_iterations", "max_depth"], "main": ["__name__"], "mp": ["multiprocessing", "pool"], "with_pool": ["pool"],
    "parallel": ["threading", "multiprocessing", "threadpoolexecutor", "processpoolexecutor", "concurrent.futures"],
    "sequential": ["sequential", "fallback", "use_multiprocessing"], "future": ["__future__"],
    "third_party": ["import", "from"],
    "words": [], "headings": [], "docs": [], "code_lines": [],
}


def literals(name: str) -> list[str]:
    """Literals of a pattern; empty if it has to be searched in every text."""
    return LITERALS[name] if name in LITERALS else PATTERNS[name][1].removeprefix("(?i)").lower().split("|")


def used(names: Iterable[str]) -> dict[str, bool]:
    """Patterns of the named checks, and whether their matches are counted."""
    found: dict[str, bool] = {}
    for n in names:
        for rung in CHECKS[n][:-1]:
            for kind, p in re.findall("([#@])([a-z_]+)", rung[0]):
                found[p] = found.get(p, False) or kind == "#"
    return dict(sorted(found.items()))


def matcher(patterns: dict[str, bool]) -> Callable[[str], list[int]]:
    """A function from a text to its number of matches of each pattern, 0 or 1 for those that are not counted."""
    bits: dict[str, int] = {}
    always, search = 0, []
    for i, (name, counted) in enumerate(patterns.items()):
        # Python has no classes of letters and digits by property; what is neither, nor an underscore, is \W.
        search.append((re.compile(PATTERNS[name][1].replace(r"[^\p{L}\p{N}_]", r"\W")), counted))
        always |= 0 if literals(name) else 1 << i
        for x in literals(name):
            bits[x] = bits.get(x, 0) | 1 << i
    automaton = ahocorasick.Automaton()
    for x, b in bits.items():
        automaton.add_word(x, b)
    if bits:
        automaton.make_automaton()

    def count(text: str) -> list[int]:
        likely, out = always, [0] * len(search)
        if bits:
            for _, b in automaton.iter((text if text.isascii() else text.translate(FOLDS)).lower()):
                likely |= b
        while likely:
            i = (likely & -likely).bit_length() - 1
            likely &= likely - 1
            pattern, counted = search[i]
            out[i] = sum(1 for _ in pattern.finditer(text)) if counted else int(pattern.search(text) is not None)
        return out

    return count


def pieces(batch: pa.RecordBatch, columns: list[str], most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """A batch cut into slices whose texts in ``columns`` have ``most`` bytes together, or that have one row."""
    size = sum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(c))), 0).to_numpy(zero_copy_only=False).astype("int64") for c in columns)
    ends, low = size.cumsum(), 0
    while low < batch.num_rows:
        high = max(low + 1, int(ends.searchsorted((ends[low - 1] if low else 0) + most, "right")))
        yield batch.slice(low, high - low)
        low = high


def matched(rows: DataFrame, names: Iterable[str], where: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with a column ``m_<pattern>`` for each pattern of the named checks, null where the text is.

    ``where``: other columns for the texts prompt, ideal and starter. Columns of each name must not be there yet.
    """
    patterns, where = used(names), where or {}
    of_text: dict[str, dict[str, bool]] = {}
    for p, counted in patterns.items():
        column = where.get(PATTERNS[p][0], PATTERNS[p][0])
        of_text.setdefault(column, {})[p] = counted
    schema = T.StructType([*rows.schema.fields, *(T.StructField(f"m_{p}", T.IntegerType()) for p in patterns)])

    def run(batches):
        count = {c: matcher(ps) for c, ps in of_text.items()}
        for batch in (part for whole in batches for part in pieces(whole, list(of_text))):
            found = {}
            for c, ps in of_text.items():
                texts = batch.column(batch.schema.get_field_index(c)).to_pylist()
                table = [None if t is None else count[c](t) for t in texts]
                for i, p in enumerate(ps):
                    found[p] = pa.array([None if r is None else r[i] for r in table], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(found[p] for p in patterns)], names=[*batch.schema.names, *(f"m_{p}" for p in patterns)])

    return rows.mapInArrow(run, schema)
