"""Token ids as wavelet matrices, one compressed file to a shard.

Documents are dealt into ranges of ascending id and encoded in that order; a file holds up to ``FILE_TOKENS`` ids (a longer
single document fills one alone). A file's matrix has one bit-plane for each bit of its largest id, the highest first; each
plane is cut into blocks of ``BLOCK`` bytes, compressed one by one, with the count of ones before every block. So one file answers access, rank
(counting) and select (occurrence) by reading a block or two of each plane, and gives back all ids.

Files are the payloads of a Parquet table in the shared folder, as executors can only write there through Spark. Null and empty
texts hold the end id alone. Null ids sort first; rows with the same id by a hash of their text, so that a range may end among them. Extra columns are ignored; an empty table gives no file.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import chunktable, store, textkernel

TOKENIZER = "word_bpe_49k.json"
END = 2
FILE_TOKENS = 1 << 21
BLOCK = 1 << 12
MAGIC = b"WMX1"
#: Bytes of input to a range of ids.
RANGE_BYTES = 32 << 20
_LOADED: dict[str, WordCodec] = {}
_SEPARATOR = "\x01"


class WordCodec:
    """A tokenizer that drops white space, with its distinct-chunk table.

    Chunks are runs without ASCII white space, cut again between an ASCII letter and an ASCII sign other than those
    of contractions and special tokens: there the pre-tokenizer cuts too. A-Z count as a-z but beside special tokens.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(_SEPARATOR, add_special_tokens=False).ids
        self.table = chunktable.ChunkTable(self._encode)
        #: 0: white space, 1: ASCII letter, 2: ASCII sign at which chunks are cut, 3: other; and by 4 x kind + next kind, whether there is a cut between.
        self.kinds = np.full(256, 3, np.uint8)
        self.kinds[~textkernel.WORD] = 0
        self.kinds[65:91] = self.kinds[97:123] = 1
        self.kinds[[ord(c) for c in '!"#$%&()*+,-./:;=?@[\\]^_`{}~']] = 2
        self.cuts = np.zeros(16, bool)
        self.cuts[[0, 1, 2, 3, 4 * 1 + 2, 4 * 2 + 1]] = True

    def _one(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts and the number of each's, in one call: a separator, which is a token of its own, stands between them."""
        ids = np.array(self.tokenizer.encode_batch_fast([f" {_SEPARATOR} ".join(texts)], add_special_tokens=False)[0].ids, np.int32)
        mark = ids == self.mark[0] if len(self.mark) == 1 else np.zeros(len(ids), bool)
        at = np.flatnonzero(mark)
        if len(at) == len(texts) - 1:
            return ids[~mark], np.diff(np.concatenate(([-1], at, [len(ids)]))) - 1
        parts = [self._one(t) for t in texts]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def _encode(self, chunks: list[bytes], kinds: list[int]) -> tuple[np.ndarray, np.ndarray]:
        texts = [c.decode() for c in chunks]
        plain = np.array([_SEPARATOR not in t and "<" not in t for t in texts], bool)
        alone = {i: self._one(texts[i]) for i in np.flatnonzero(~plain).tolist()}
        length = np.zeros(len(texts), np.int64)
        for i, ids in alone.items():
            length[i] = len(ids)
        where = np.flatnonzero(plain)
        groups = [self._group([texts[i] for i in where[lo : lo + 500].tolist()]) for lo in range(0, len(where), 500)]
        if groups:
            length[where] = np.concatenate([n for _, n in groups])
        start = np.cumsum(length) - length
        out = np.empty(int(length.sum()), np.int32)
        if alone:
            rest = np.ones(len(out), bool)
            for i, ids in alone.items():
                out[start[i] : start[i] + len(ids)], rest[start[i] : start[i] + len(ids)] = ids, False
            out[rest] = np.concatenate([g for g, _ in groups]) if groups else 0
        elif groups:
            out[:] = np.concatenate([g for g, _ in groups])
        return out, length

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, each with the end id, and the ids before each document."""
        kind = self.kinds[data]
        first = kind == 0
        if len(data) > 1:
            first[1:] |= self.cuts[4 * kind[:-1] + kind[1:]]
        s, e, before = chunktable.cuts(data, at, first)
        word = kind[s] != 0
        kept = np.concatenate(([0], np.cumsum(word)))
        s, e, before = s[word], e[word], kept[before]
        folded = textkernel.LOWER[data]
        open_ = np.flatnonzero(data == 0x3C)
        for i in np.unique(np.searchsorted(s, open_, "right") - 1).tolist():  # no chunk but a word holds the sign
            folded[s[i] : e[i]] = data[s[i] : e[i]]
        ids, length = self.table.ids(folded, s, e, textkernel.hashes(folded, s, e, lower=False), np.zeros(len(s), np.int8))
        inner = textkernel.per_doc(length, before) if len(s) else np.zeros(len(at) - 1, np.int64)
        bounds = np.concatenate(([0], np.cumsum(inner + 1)))
        out = np.empty(bounds[-1], np.int32)
        out[bounds[1:] - 1] = END
        body = np.ones(len(out), bool)
        body[bounds[1:] - 1] = False
        out[body] = ids
        return out, bounds


def load(path: str | None = None) -> WordCodec:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _LOADED:
        _LOADED[path] = WordCodec(path)
    return _LOADED[path]


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A file: header, documents, and the planes with their block directory."""
    press = zstandard.ZstdCompressor(level=1).compress
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    zeros, sizes, ones, body = [], [], [], []
    one = (1 << np.arange(bits)).astype(x.dtype)
    for level in range(bits - 1, -1, -1):
        bit = (x & one[level]).astype(bool)
        low = x[~bit]
        zeros.append(len(low))
        x = np.concatenate((low, x[bit]))
        plane = np.packbits(bit)
        counts = np.add.reduceat(np.bitwise_count(plane).astype(np.int64), np.arange(0, len(plane), BLOCK)) if len(plane) else np.zeros(0, np.int64)
        ones.append(np.cumsum(counts) - counts)
        blocks = [press(plane[i : i + BLOCK].tobytes()) for i in range(0, len(plane), BLOCK)]
        sizes += [len(b) for b in blocks]
        body += blocks
    known = np.array([d is not None for d in doc_ids], bool)
    head = [np.packbits(known).tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), lengths.astype("<i8").tobytes(), np.array(zeros, "<i8").tobytes(), np.array(sizes, "<i4").tobytes(), np.concatenate(ones).astype("<i8").tobytes()]
    packed = press(b"".join(head))
    return MAGIC + struct.pack("<qqii", len(ids), len(doc_ids), bits, len(packed)) + packed + b"".join(body)


class WaveletFile:
    """Reads a file; blocks are decompressed as they are needed."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.n, docs, self.bits, head = struct.unpack_from("<qqii", payload, 4)
        self._open = zstandard.ZstdDecompressor().decompress
        raw, at = self._open(payload[28 : 28 + head]), 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        known = np.unpackbits(take("u1", -(-docs // 8)))[:docs] != 0
        self.doc_ids = [d if k else None for d, k in zip(take("<i8", docs).tolist(), known, strict=True)]
        self.lengths, self.zeros = take("<i8", docs), take("<i8", self.bits)
        self.blocks = -(-(-(-self.n // 8)) // BLOCK)
        sizes = take("<i4", self.blocks * self.bits).astype(np.int64)
        self.place = 28 + head + np.concatenate(([0], np.cumsum(sizes)))
        self.ones = take("<i8", self.blocks * self.bits).reshape(self.bits, -1)
        self.payload, self._kept = payload, (-1, np.zeros(0, bool))

    def _block(self, level: int, b: int) -> np.ndarray:
        i = level * self.blocks + b
        if self._kept[0] != i:
            self._kept = (i, np.unpackbits(np.frombuffer(self._open(self.payload[self.place[i] : self.place[i + 1]]), np.uint8)))
        return self._kept[1]

    def _ones(self, level: int, i: int) -> int:
        """Ones before position ``i`` of a plane."""
        b, rest = divmod(i, 8 * BLOCK)
        if b >= self.blocks:
            return self.n - int(self.zeros[level])
        return int(self.ones[level, b]) + (int(self._block(level, b)[:rest].sum()) if rest else 0)

    def _find(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th ``bit`` of a plane, from 0: its block by the directory, then inside the block."""
        size = 8 * BLOCK
        before = self.ones[level] if bit else np.arange(self.blocks) * size - self.ones[level]
        b = int(np.searchsorted(before, k, "right")) - 1
        return b * size + int(np.flatnonzero(self._block(level, b) == bit)[k - int(before[b])])

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = int(self._block(level, i // (8 * BLOCK))[i % (8 * BLOCK)])
            before = self._ones(level, i)
            i = int(self.zeros[level]) + before if bit else i - before
            value = 2 * value + bit
        return value

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` before position ``i``."""
        if token >> self.bits:
            return 0
        lo, hi = 0, min(i, self.n)
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (int(self.zeros[level]) + a, int(self.zeros[level]) + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence of ``token``, from 0; -1 if there are fewer."""
        if not 0 <= k < self.count(token):
            return -1
        low = 0
        for level in range(self.bits):
            before = self._ones(level, low)
            low = int(self.zeros[level]) + before if token >> (self.bits - 1 - level) & 1 else low - before
        at = low + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._find(level, bit, at - int(self.zeros[level]) if bit else at)
        return at

    def ids(self) -> np.ndarray:
        """All ids in order, put together from the lowest plane upwards."""
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            bit = np.concatenate([self._block(level, b) for b in range(self.blocks)])[: self.n] != 0 if self.n else np.zeros(0, bool)
            above = np.empty_like(x)
            above[~bit], above[bit] = x[: self.zeros[level]], x[self.zeros[level] :] | (1 << (self.bits - 1 - level))
            x = above
        return x


FILES = "shard int, seq int, n_docs long, n_tokens long, payload binary"


def write(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes the files; the table of files, in ascending (shard, seq)."""

    def run(batches):
        codec, shard, seq = load(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def file() -> pa.RecordBatch:
            ids = np.concatenate([h[2] for h in held])
            doc_ids, lengths = [d for h in held for d in h[0]], np.concatenate([h[1] for h in held])
            arrays = [pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([pack(doc_ids, lengths, ids)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["shard", "seq", "n_docs", "n_tokens", "payload"])

        for batch, data, at in textkernel.ranges(batches):
            ids, bounds = codec.encode(data, at)
            if held and sum(len(h[2]) for h in held) + len(ids) > FILE_TOKENS:
                yield file()
                held, seq = [], seq + 1
            held.append((batch.column(0).to_pylist(), np.diff(bounds), ids.astype(np.uint16) if ids.max() < 1 << 16 else ids))
        if held:
            yield file()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    dealt = rows.repartitionByRange(store.parts_for(store.text_bytes(rows), RANGE_BYTES, 4), "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text")
    return store.materialize(dealt.select("doc_id", "text").mapInArrow(run, FILES), "wavelet")


def read(files: DataFrame, each) -> DataFrame:
    """Rows (shard, seq, doc_id, before, n_tokens, value) of every document in ``files``; ``each`` makes the value (long) of its ids."""
    schema = "shard int, seq int, doc_id long, before long, n_tokens long, value long"

    def run(batches):
        for batch in batches:
            for shard, seq, payload in zip(*(batch.column(i) for i in range(3)), strict=True):
                file = WaveletFile(payload.as_py())
                ids, end = file.ids(), np.cumsum(file.lengths)
                values = [each(ids[a:b]) for a, b in zip((end - file.lengths).tolist(), end.tolist(), strict=True)]
                n = len(values)
                arrays = [pa.array([shard.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int32()), pa.array(file.doc_ids, pa.int64()), pa.array(end - file.lengths), pa.array(file.lengths), pa.array(values, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])

    return files.select("shard", "seq", "payload").mapInArrow(run, schema)


def offsets(files: DataFrame) -> DataFrame:
    """shard, seq and the ids of all files before each."""
    of_shard = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = of_shard.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    within = files.select("shard", "seq", (F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("seq")) - F.col("n_tokens")).alias("file_start"))
    return within.join(before, "shard").select("shard", "seq", (F.col("shard_start") + F.col("file_start")).alias("file_start"))


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def op3_wavelet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write(store.table(spark, sf_dir, "documents"))
    rows = read(files, crc32)
    return rows.join(offsets(files), ["shard", "seq"]).select("doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", F.col("value").alias("ids_crc32"))
