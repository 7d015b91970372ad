"""SentencePiece encoding and decoding by a distinct-chunk table.

No piece of the model holds a marker after another sign, nor a line feed; so no merge crosses the place before a
run of spaces, or either side of a line feed. A text is cut there; each distinct chunk is segmented by the library
once in a worker (a table bounded by ``chunktable.ENTRIES``) and the ids are joined back by position. ``load`` checks the two
properties of the model and raises if they don't hold. Nothing is shuffled.

Null and empty texts give the begin and end ids only. Repeated rows each get their row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunktable, store, textkernel

MODEL = "piece_bpe_32k.model"
MARKER = "▁"
_LOADED: dict[str, PieceCodec] = {}


class PieceCodec:
    """A SentencePiece model with its distinct-chunk table."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if "\n" in piece or MARKER in piece.lstrip(MARKER):
                raise ValueError(f"piece {i} of {path} crosses a marker")
        self.space = self.model.piece_to_id(MARKER)
        self.table = chunktable.ChunkTable(self._encode)

    def _encode(self, chunks: list[bytes], kinds: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """kind 0: begins a text; 1: begins with a space; 2: follows a line feed or is one."""
        texts = []
        for chunk, kind in zip(chunks, kinds, strict=True):
            text = chunk.decode()
            texts.append(text if kind == 0 else text[1:] if kind == 1 else "\n" + text)
        parts = [([self.space] if kind == 1 and not text else ids[2:] if kind == 2 else ids) for kind, ids, text in zip(kinds, self.model.encode(texts, num_threads=1), texts, strict=True)]
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.fromiter(chain.from_iterable(parts), np.int32, int(length.sum())), length

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents with begin and end ids, and the ids before each document."""
        space, feed = data == 0x20, data == 0x0A
        first = feed.copy()
        first[1:] |= feed[:-1] | (space[1:] & ~space[:-1])
        if (data == 0xE2).any():  # a marker in the text itself joins with spaces that follow
            own = np.zeros(len(data), bool)
            own[2:] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
            first[1:] &= ~(own[:-1] & space[1:])
        s, e, before = chunktable.cuts(data, at, first)
        kind = np.where(space[s], 1, 2)
        kind[before[:-1][np.diff(before) > 0]] = 0
        h = textkernel.hashes(data, s, e, lower=False)
        h[kind == 0] = textkernel.mix(h[kind == 0])
        ids, length = self.table.ids(data, s, e, h, kind)
        inner = textkernel.per_doc(length, before) if len(s) else np.zeros(len(at) - 1, np.int64)
        bounds = np.concatenate(([0], np.cumsum(inner + 2)))
        out = np.empty(bounds[-1], np.int32)
        out[bounds[:-1]], out[bounds[1:] - 1] = self.model.bos_id(), self.model.eos_id()
        body = np.ones(len(out), bool)
        body[bounds[:-1]] = body[bounds[1:] - 1] = False
        out[body] = ids
        return out, bounds


def load(path: str | None = None) -> PieceCodec:
    """A worker's codec for a model file (by default the public one, found where this runs)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    if path not in _LOADED:
        _LOADED[path] = PieceCodec(path)
    return _LOADED[path]


def encode_rows(docs: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """The columns ``keep``, n_tokens, ids (array of int) and round_trip: whether they decode to the text (null: empty)."""
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.select(*keep).schema)

    def run(batches):
        codec = load(path)
        for batch, data, at in textkernel.ranges(batches, "__text"):
            ids, bounds = codec.encode(data, at)
            raw = data.tobytes()
            texts = codec.model.decode([ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
            same = [t.encode() == raw[a:b] for t, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids)), pa.array(same, pa.bool_())], names=[*keep, "n_tokens", "ids", "round_trip"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, f"{kinds}, n_tokens long, ids array<int>, round_trip boolean")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the same, digested where it is made."""

    def run(batches):
        codec = load(path)
        for batch, data, at in textkernel.ranges(batches):
            ids, bounds = codec.encode(data, at)
            pairs = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            texts = codec.model.decode([ids[a:b].tolist() for a, b in pairs])
            raw = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array([hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in pairs], pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(store.table(spark, sf_dir, "documents"))
