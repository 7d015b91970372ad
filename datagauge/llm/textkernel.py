"""Byte-level text kernels over Arrow string columns.

Words are runs of bytes other than space and 0x09-0x0D; no word crosses a document. All functions work on
whole texts; a batch is cut into row ranges only, and every temporary array is bounded by one row range.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
#: Bytes of text handled at once (a longer single document is its own range).
SLICE_BYTES = 2 << 20
#: Most documents in a range, so that a document's place fits DOC_BITS.
SLICE_DOCS = 4096
DOC_BITS = 12

WORD = np.ones(256, bool)
WORD[[0x20, 9, 10, 11, 12, 13]] = False

_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & _MASK], U64))[0])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Spans up to this many bytes are hashed together, eight bytes at a time; longer ones one by one.
LONG = 64
#: Keeps the first 0 .. 8 bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_LENGTH, _NEXT = U64(0x9E3779B97F4A7C15), U64(0x9FB21C651E98DF25)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and each text's offset (one more than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[at[0] : at[-1]], at - at[0]


def ranges(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES, docs: int = SLICE_DOCS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of about ``size`` bytes with their bytes and offsets."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data, at = raw(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(at, at[lo] + size, "right")) - 1
            hi = min(max(hi, lo + 1), lo + docs, batch.num_rows)
            yield batch.slice(lo, hi - lo), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            lo = hi


def spans(data: np.ndarray, at: np.ndarray, inside: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of ``inside`` bytes, and the runs before each document (one more than documents)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    m = inside[data]
    first = m.copy()
    first[1:] &= ~m[:-1]
    cut = at[(at > 0) & (at < n)]
    first[cut] = m[cut]
    last = m.copy()
    last[:-1] &= ~m[1:]
    last[cut - 1] = m[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like spans, for the non-empty pieces between newlines."""
    inside = np.ones(256, bool)
    inside[10] = False
    return spans(data, at, inside)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number, zeros beyond the end."""
    wide = np.zeros(len(data) + 8, np.uint8)
    wide[: len(data)] = data
    return _eights(wide)


def _eights(wide: np.ndarray) -> np.ndarray:
    """The same without a copy, of bytes that go on for eight beyond the last position asked for."""
    return np.ndarray((len(wide) - 7,), "<u8", wide, 0, (1,))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each span's bytes, wherever it stands; A-Z as a-z if ``lower``.

    Up to ``LONG`` bytes: a chain of bijective mixes over the length and every eight bytes, so that of equal lengths up to eight no two
    collide. Longer spans: XXH3. Neither is an algebraic sum over the bytes, so no family of texts collides by its structure.
    """
    if lower:
        data = LOWER[data]
    size = ends - starts
    words = eights(data)
    out = mix((size.astype(U64) + U64(1)) * _LENGTH)
    for at in range(0, LONG, 8):
        on = np.flatnonzero((size > at) & (size <= LONG)) if at else np.flatnonzero(size <= LONG)
        if not len(on):
            break
        block = words[starts[on] + at] & _FIRST[np.minimum(size[on] - at, 8)]
        out[on] = mix((out[on] ^ block) * _NEXT)
    long = np.flatnonzero(size > LONG)
    if len(long):
        text = data.tobytes()
        out[long] = mix(np.array([xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)], U64))
    return out


def same(data: np.ndarray, starts: np.ndarray, size: np.ndarray, other: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each span's bytes are those of ``other`` from ``at`` on; ``other`` goes on for eight bytes beyond what is compared."""
    out = np.ones(len(starts), bool)
    one, two = eights(data), _eights(other)
    for k in range(0, LONG, 8):
        on = np.flatnonzero((size > k) & (size <= LONG))
        if not len(on):
            break
        out[on] &= (one[starts[on] + k] ^ two[at[on] + k]) & _FIRST[np.minimum(size[on] - k, 8)] == 0
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = np.array_equal(data[starts[i] : starts[i] + size[i]], other[at[i] : at[i] + size[i]])
    return out


def owners(before: np.ndarray) -> np.ndarray:
    """The document of each span."""
    return np.repeat(np.arange(len(before) - 1), np.diff(before))


def per_doc(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sum of the spans' values in each document."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind != "b" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[before[1:]] - total[before[:-1]]


def word_counts(column: pa.Array) -> np.ndarray:
    """Words of each text."""
    data, at = raw(column)
    out = np.zeros(len(at) - 1, np.int64)
    lo = 0
    while lo < len(out):
        hi = min(max(int(np.searchsorted(at, at[lo] + SLICE_BYTES, "right")) - 1, lo + 1), len(out))
        out[lo:hi] = np.diff(spans(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])[2])
        lo = hi
    return out
