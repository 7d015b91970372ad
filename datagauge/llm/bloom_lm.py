"""Language-model scoring with a log-frequency Bloom filter, broadcast to the workers.

N-grams of the learning documents are counted exactly (hashes, merged in buckets). An n-gram with count c is put into the filter once
for each quantised level 1 .. 1 + floor(log_b c); its count is read back by probing level after level until one
is absent. Probabilities are interpolated over the orders, p_n = (c(context, w) + k p_(n-1)) / (c(context) + k), each order's k set
so that the chance of an unseen n-gram is that of the n-grams seen once; below them stand known words with mass 1 - u in proportion to
their counts, and one unknown word with mass u, the share of words seen once.

The filter has a segment for each bucket, ``BITS`` bits an entry at any size. Up to ``MAX_FILTER_BYTES`` it is broadcast. A larger one stays
in its table: documents are dealt into chunks, a chunk's distinct n-grams go to the segments they fall in, and the levels read there come back to the
chunk, so that a task holds a chunk or a few segments, and the scores are those of the broadcast filter. The unigram baseline uses exact counts: those of
the most frequent words, ``HEAD`` at most, are broadcast, all others are joined.

Null and empty texts hold the end token alone. Without learning documents every known count is 0. Repeated rows each count
and each get their row; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, textkernel

ORDER = 2
BASE = 1.5
LEVELS = 80
BITS = 8.0
HASHES = 5
MAX_FILTER_BYTES = 128 << 20
HEAD = 1 << 20
#: Bytes of text to a bucket of n-grams or a chunk of documents, buckets that a task builds or probes together, and n-grams that a task holds before it hands them on.
BUCKET_BYTES = 4 << 20
SPAN = 4
HELD = 1 << 20

_U = np.uint64
_STEP = _U(0x9FB21C651E98DF25)
_LEVEL = _U(0xD6E8FEB86659FD93)
#: Bits of a key that probes leave out, so that keys that travel need six bytes.
_DROPPED = _U(16)
_BOS, _EOS = _U(textkernel.mix_int(0xB05)), _U(textkernel.mix_int(0xE05))


def _lows() -> np.ndarray:
    out, x = [1], BASE
    while len(out) < LEVELS:
        out.append(max(out[-1] + 1, math.ceil(x)))
        x *= BASE
    return np.array(out, np.float64)


#: Smallest count of each level, and the count that a level stands for.
LOWS = _lows()
MEANS = np.concatenate(([0.0], (LOWS[:-1] + LOWS[1:] - 1) / 2, LOWS[-1:]))


def levels(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LOWS, counts, "right")


def sequence(h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all documents, each ended by the end token, and the tokens before each document."""
    bounds = before + np.arange(len(before))
    out = np.empty(bounds[-1], _U)
    body = np.ones(len(out), bool)
    body[bounds[1:] - 1] = False
    out[body], out[bounds[1:] - 1] = h, _EOS
    return out, bounds


def ngrams(tokens: np.ndarray, bounds: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order from 2: keys of n-grams and contexts by position, and where there is one. A document begins with one start token."""
    out, first = [], bounds[:-1]
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[first] = _BOS
    there = np.ones(len(tokens), bool)
    for n in range(2, order + 1):
        key = textkernel.mix(context * _STEP + tokens)
        out.append((key, context, there))
        there = np.concatenate(([False], there[:-1]))
        there[first] = False
        context = np.concatenate((key[:1], key[:-1]))
    return out


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    return (((keys >> _U(32)) * _U(n)) >> _U(32)).astype(np.int64)


def _counter(order: int, n_buckets: int):
    """Per task: rows (bucket, order, keys, counts) of the n-grams it saw."""

    def flush(held: list[list[np.ndarray]]):
        for o, parts in enumerate(held, 1):
            if not parts:
                continue
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            at = np.searchsorted(_buckets(keys, n_buckets), np.arange(n_buckets + 1))
            some = np.flatnonzero(np.diff(at))
            counts = counts.astype(np.uint32)
            arrays = [pa.array(some, pa.int32()), pa.array(np.full(len(some), o), pa.int32()), pa.array([keys[at[b] : at[b + 1]].tobytes() for b in some], pa.binary()), pa.array([counts[at[b] : at[b + 1]].tobytes() for b in some], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "order", "keys", "counts"])

    def run(batches):
        held, size = [[] for _ in range(order)], 0
        for _, data, at in textkernel.ranges(batches):
            s, e, before = textkernel.spans(data, at)
            tokens, bounds = sequence(textkernel.hashes(data, s, e), before)
            held[0].append(np.concatenate((tokens, np.full(len(at) - 1, _BOS))))
            for o, (key, _, there) in enumerate(ngrams(tokens, bounds, order), 1):
                held[o].append(key[there])
            size += order * len(tokens)
            if size > HELD:
                yield from flush(held)
                held, size = [[] for _ in range(order)], 0
        yield from flush(held)

    return run


def _slots(keys: np.ndarray, level: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of an entry, by the upper 48 bits of its key; the others are sums of them."""
    h = textkernel.mix((keys >> _DROPPED) + _U(int(_LEVEL) * (level + LEVELS * order) & 0xFFFFFFFFFFFFFFFF))
    return h >> _U(32), (h & _U(0xFFFFFFFF)) | _U(1)


def _position(one: np.ndarray, two: np.ndarray, i: int, bits: np.ndarray | np.uint64) -> np.ndarray:
    return (((one + _U(i) * two) & _U(0xFFFFFFFF)) * bits) >> _U(32)


STATS = 2 + 2 * (LEVELS + 1)


def _builder(order: int, bits_each: float):
    """Per bucket: its filter segment, unigram counts, and for each order the n-grams, those seen once, the tokens and the n-grams by level."""

    def run(table: pa.Table) -> pa.Table:
        stats = np.zeros((order, STATS), np.int64)
        orders = table["order"].to_numpy()
        keys_in, counts_in = table["keys"].to_pylist(), table["counts"].to_pylist()
        found = []
        for o in range(1, order + 1):
            rows = np.flatnonzero(orders == o)
            keys = np.concatenate([np.frombuffer(keys_in[i], _U) for i in rows]) if len(rows) else np.zeros(0, _U)
            counts = np.concatenate([np.frombuffer(counts_in[i], np.uint32) for i in rows]) if len(rows) else np.zeros(0, np.uint32)
            keys, inverse = np.unique(keys, return_inverse=True)
            counts = np.bincount(inverse, counts, len(keys)).astype(np.int64)
            del inverse
            level = levels(counts).astype(np.uint8)
            found.append((keys, counts, level))
            real = keys != _BOS
            stats[o - 1, 0], stats[o - 1, 1] = real.sum(), (counts[real] == 1).sum()
            stats[o - 1, 2 : 3 + LEVELS] = np.bincount(level, counts, LEVELS + 1).astype(np.int64)
            stats[o - 1, 3 + LEVELS :] = np.bincount(level[real], minlength=LEVELS + 1)
        entries = sum(int(f[2].sum()) for f in found)
        bits = max(64, math.ceil(entries * bits_each / 64) * 64)
        plane = np.zeros(bits, bool)
        for o, (keys, _, level) in enumerate(found, 1):
            j = 1
            while len(keys):
                one, two = _slots(keys, j, o)
                for i in range(HASHES):
                    plane[_position(one, two, i, _U(bits)).astype(np.int64)] = True
                on = level > j
                keys, level, j = keys[on], level[on], j + 1
        keys, counts, _ = found[0]
        real = keys != _BOS
        cells = [[table["bucket"][0].as_py()], [np.packbits(plane, bitorder="little").tobytes()], [keys[real].tobytes()], [counts[real].tobytes()], [stats.reshape(-1).tolist()]]
        return pa.table([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["bucket", "segment", "keys", "counts", "stats"])

    return run


class Filter:
    """Segments in a row, those of all buckets or of the ones from ``first`` of ``of``; reads levels by repeated probes."""

    def __init__(self, segments: list[bytes], first: int = 0, of: int | None = None):
        self.first, self.of = first, of or len(segments)
        self.bits = np.array([8 * len(s) for s in segments], _U)
        self.start = np.concatenate(([0], np.cumsum(self.bits[:-1]))).astype(np.int64) if segments else np.zeros(0, np.int64)
        self.data = b"".join(segments)

    def levels(self, keys: np.ndarray, order: int) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        if not len(self.bits):
            return out
        plane = np.frombuffer(self.data, np.uint8)
        bucket = _buckets(keys, self.of) - self.first
        bits, start, where = self.bits[bucket], self.start[bucket], np.arange(len(keys))
        for level in range(1, LEVELS + 1):
            one, two = _slots(keys, level, order)
            for i in range(HASHES):
                at = start + _position(one, two, i, bits).astype(np.int64)
                on = (plane[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0
                if not on.all():
                    one, two, keys, bits, start, where = one[on], two[on], keys[on], bits[on], start[on], where[on]
            if not len(keys):
                break
            out[where] = level
        return out


class Answers:
    """Levels that were read elsewhere, of sorted keys by order."""

    def __init__(self, keys: list[np.ndarray], levels_: list[np.ndarray]):
        self.keys, self.read = keys, levels_

    def levels(self, keys: np.ndarray, order: int) -> np.ndarray:
        return self.read[order - 1][np.searchsorted(self.keys[order - 1], keys)]


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys without their dropped bits, a plane for each byte: the upper ones compress to nearly nothing."""
    planes = (keys >> _DROPPED).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_keys(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(6, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :6] = planes.T
    return wide.reshape(-1).view("<u8").astype(_U) << _DROPPED


def _distinct(batches, order: int) -> list[np.ndarray]:
    """Sorted keys by order of all that scoring the rows asks for."""
    held = [[np.array([_BOS])], *([np.zeros(0, _U)] for _ in range(1, order))]
    for _, data, at in textkernel.ranges(batches, "__text"):
        s, e, before = textkernel.spans(data, at)
        tokens, bounds = sequence(textkernel.hashes(data, s, e), before)
        held[0].append(np.unique(tokens))
        for o, (key, _, there) in enumerate(ngrams(tokens, bounds, order), 1):
            held[o].append(np.unique(key[there]))
    return [np.unique(np.concatenate(h)) for h in held]


def _asker(order: int, n_buckets: int):
    """Per chunk: its distinct keys, by the part of the buckets they fall in."""
    parts = -(-n_buckets // SPAN)

    def run(table: pa.Table) -> pa.Table:
        keys = _distinct(table.to_batches(), order)
        at = [np.searchsorted(_buckets(k, n_buckets) // SPAN, np.arange(parts + 1)) for k in keys]
        some = [i for i in range(parts) if any(a[i] < a[i + 1] for a in at)]
        cells = [[pack_keys(k[a[i] : a[i + 1]]) for k, a in zip(keys, at, strict=True)] for i in some]
        return pa.table([pa.array([table["chunk"][0].as_py()] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(cells, pa.list_(pa.binary()))], names=["chunk", "part", "keys"])

    return run


def _prober(n_buckets: int):
    """Per part: the levels of every chunk's keys, read from the part's segments."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out, press = [], zstandard.ZstdCompressor(level=1).compress
        if asked.num_rows:
            part = asked["part"][0].as_py()
            own: list[bytes] = [bytes(8)] * min(SPAN, n_buckets - part * SPAN)
            for bucket, segment in zip(held["bucket"].to_pylist(), held["segment"].to_pylist(), strict=True):
                own[bucket - part * SPAN] = segment
            filter_ = Filter(own, part * SPAN, n_buckets)
            for chunk, keys in zip(asked["chunk"].to_pylist(), asked["keys"], strict=True):
                out.append((chunk, part, [press(filter_.levels(unpack_keys(k.as_py()), o).astype(np.uint8).tobytes()) for o, k in enumerate(keys, 1)]))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.list_(pa.binary())), strict=True)], names=["chunk", "part", "levels"])

    return run


class BloomModel:
    """The filter (none where it is too large to broadcast), the table of its segments and of the words' exact counts, and the smoothing constants."""

    def __init__(self, filter_: Filter | None, words: DataFrame | None, tokens: int, stats: np.ndarray, order: int, n_buckets: int):
        self.filter, self.words, self.tokens, self.order, self.n_buckets = filter_, words, tokens, order, n_buckets
        self.types = int(stats[0, 0])
        self.unknown = min(max(stats[0, 1] / max(tokens, 1), 0.5 / (tokens + 1)), 0.5) if tokens else 1.0
        by_level = stats[:, 2 : 3 + LEVELS]
        self.mass = float((by_level[0] / np.maximum(MEANS, 1) * MEANS).sum()) if tokens else 1.0
        self.kappa = [self._pull(by_level[o - 1], stats[o, 1] / max(1, by_level[o].sum())) for o in range(1, order)]
        # The least count of the lowest level from which on there are at most HEAD words.
        above = np.cumsum(stats[0, 3 + LEVELS :][::-1])[::-1]
        fits = np.flatnonzero(above[1:] <= HEAD)
        self.least = int(LOWS[fits[0]]) if len(fits) else int(tokens) + 1

    @staticmethod
    def _pull(tokens: np.ndarray, novel: float) -> float:
        """k with mean k / (c + k) over the contexts' tokens equal to the share of n-grams seen once."""
        lo, hi = 1e-3, 1e12
        for _ in range(100):
            mid = math.sqrt(lo * hi)
            lo, hi = (lo, mid) if (tokens * mid / (MEANS + mid)).sum() > novel * tokens.sum() else (mid, hi)
        return lo

    @classmethod
    def fit(cls, docs: DataFrame, order: int = ORDER, max_bytes: int = MAX_FILTER_BYTES, bits: float = BITS) -> BloomModel:
        text = docs.select("text")

        def count(batches):
            for batch in batches:
                n = textkernel.word_counts(batch.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([int(n.sum()) + len(n)]), pa.array([len(textkernel.raw(batch.column(0))[0]) + 16 * len(n)])], names=["n", "bytes"])

        tokens, n_bytes = (x or 0 for x in text.mapInArrow(count, "n long, bytes long").agg(F.sum("n"), F.sum("bytes")).first())
        n_buckets = store.parts_for(n_bytes, BUCKET_BYTES, 16 * SPAN)
        rows = text.mapInArrow(_counter(order, n_buckets), "bucket int, order int, keys binary, counts binary")
        built = rows.repartition(-(-n_buckets // SPAN), "bucket").groupBy("bucket").applyInArrow(_builder(order, bits), "bucket int, segment binary, keys binary, counts binary, stats array<long>")
        built = store.materialize(built, "bloom")
        stats, size = np.zeros((order, STATS), np.int64), 0
        for r in built.select("stats", F.length("segment").alias("size")).toLocalIterator():
            stats += np.array(r["stats"], np.int64).reshape(order, STATS)
            size += r["size"]
        if size > max_bytes:
            return cls(None, built, tokens, stats, order, n_buckets)
        segments: list[bytes] = [bytes(8)] * n_buckets
        for r in built.select("bucket", "segment").toLocalIterator():
            segments[r["bucket"]] = bytes(r["segment"])
        return cls(Filter(segments), built, tokens, stats, order, n_buckets)

    def counted(self, least: int, most: int | None) -> DataFrame:
        """Rows (key, c) of the words counted at least ``least`` and less than ``most`` times."""

        def run(batches):
            for batch in batches:
                for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    k, c = np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)
                    on = (c >= least) & (c < most if most else True)
                    yield pa.RecordBatch.from_arrays([pa.array(k[on]), pa.array(c[on])], names=["key", "c"])

        return self.words.select("keys", "counts").mapInArrow(run, "key long, c long")


def log_probabilities(filter_: Filter | Answers, order: int, unknown: float, mass: float, kappa: list[float], tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log10 p of each token given those before it."""
    words, inverse = np.unique(np.append(tokens, _BOS), return_inverse=True)
    counts = MEANS[filter_.levels(words, 1)]
    p = np.where(counts > 0, (1 - unknown) * counts / mass, unknown)[inverse[:-1]]
    counts = counts[inverse]
    context = np.empty(len(tokens))
    context[1:] = counts[:-2]
    context[bounds[:-1]] = counts[-1]
    for o, (key, _, there) in enumerate(ngrams(tokens, bounds, order), 2):
        seen = np.zeros(len(tokens))
        look = np.flatnonzero(there & (context > 0))
        # Each once and in order, so that the probes of a segment stand together.
        asked, back = np.unique(key[look], return_inverse=True)
        seen[look] = np.minimum(MEANS[filter_.levels(asked, o)][back], context[look])
        k = kappa[o - 2]
        p = np.where(there & (context > 0), (seen + k * p) / (context + k), p)
        context = np.concatenate(([0.0], seen[:-1]))
        context[bounds[:-1]] = 0
    return np.log10(p)


def in_order(table: pa.Table, by: list[str]) -> pa.Table:
    """Rows in the order of their content, so that a repeated task numbers them alike; equal rows stand for one another."""
    return table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in by]))


def score(docs: DataFrame, model: BloomModel, keep: list[str]) -> DataFrame:
    """The columns ``keep``, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``."""
    spark = docs.sparkSession
    least = model.least
    head = model.counted(least, None).toArrow()
    keys, counts = head["key"].to_numpy().view(_U), head["c"].to_numpy()
    order_ = np.argsort(keys)
    shared = spark.sparkContext.broadcast((model.filter, keys[order_], counts[order_].astype(np.float64), model.order, model.unknown, model.mass, model.kappa))
    kinds = {x.name: x.dataType.simpleString() for x in docs.select(*keep).schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "n_tokens long", "n_known long", "base double", "score double", "rid long", "key long", "n long"])
    names = [*keep, "n_tokens", "n_known", "base", "score", "rid", "key", "n"]

    def scored(batches, filter_, next_rid):
        _, heads, times, order, unknown, mass, kappa = shared.value
        for batch, data, at in textkernel.ranges(batches, "__text"):
            s, e, before = textkernel.spans(data, at)
            tokens, bounds = sequence(textkernel.hashes(data, s, e), before)
            docs_here = len(at) - 1
            own = np.repeat(np.arange(docs_here), np.diff(bounds))
            value = textkernel.per_doc(log_probabilities(filter_, order, unknown, mass, kappa, tokens, bounds), bounds)
            c = np.zeros(len(tokens))
            if len(heads):
                at_head = np.minimum(np.searchsorted(heads, tokens), len(heads) - 1)
                c = np.where(heads[at_head] == tokens, times[at_head], 0.0)
            known = c > 0
            base = textkernel.per_doc(np.where(known, np.log10(c + 0.5), 0.0), bounds)
            rid = next_rid + np.arange(docs_here)
            next_rid += docs_here
            # A row for each document, its key its own; and one for each document and word that is not in the head.
            blank = [pa.nulls(docs_here, pa.int64())]
            arrays = [*batch.columns[: len(keep)], pa.array(np.diff(bounds)), pa.array(textkernel.per_doc(known, bounds)), pa.array(base), pa.array(value), pa.array(rid), pa.array(textkernel.mix(rid.astype(_U) + _U(1)).view(np.int64)), *blank]
            out = pa.RecordBatch.from_arrays(arrays, names=names)
            yield out
            rest = np.flatnonzero(~known)
            if len(rest):
                _, first, n = np.unique(tokens[rest] + textkernel.mix(own[rest].astype(_U)), return_index=True, return_counts=True)
                first = rest[first]
                nulls = [pa.nulls(len(first), t) for t in out.schema.types[: len(keep) + 4]]
                yield pa.RecordBatch.from_arrays([*nulls, pa.array(rid[own[first]]), pa.array(tokens[first].view(np.int64)), pa.array(n.astype(np.int64))], names=names)

    def run(batches):
        yield from scored(batches, shared.value[0], TaskContext.get().partitionId() << 40)

    texts, n_buckets = docs.select(*keep, F.col("text").alias("__text")), model.n_buckets
    if model.filter is not None:
        rows = texts.mapInArrow(run, schema)
    else:
        n_chunks, parts = store.parts_for(store.text_bytes(docs), BUCKET_BYTES), -(-n_buckets // SPAN)
        # By their content, so that a repeated task deals alike.
        dealt = texts.withColumn("chunk", F.pmod(F.xxhash64(*keep, "__text"), F.lit(n_chunks))).repartition(n_chunks, "chunk")
        order = model.order
        asked = dealt.groupBy("chunk").applyInArrow(_asker(order, n_buckets), "chunk long, part int, keys array<binary>").repartition(parts, "part")
        held = model.words.select(F.floor(F.col("bucket") / SPAN).cast("int").alias("part"), "bucket", "segment").repartition(parts, "part")
        read = asked.groupBy("part").cogroup(held.groupBy("part")).applyInArrow(_prober(n_buckets), "chunk long, part int, levels array<binary>").repartition(n_chunks, "chunk")

        def answered(table: pa.Table, got: pa.Table) -> pa.Table:
            cells = got.sort_by("part")["levels"].to_pylist()
            answers = Answers(_distinct(table.to_batches(), order), [np.frombuffer(b"".join(map(zstandard.ZstdDecompressor().decompress, (c[o] for c in cells))), np.uint8) for o in range(order)])
            return pa.Table.from_batches(scored(in_order(table, [*keep, "__text"]).to_batches(), answers, table["chunk"][0].as_py() << 32))

        rows = dealt.groupBy("chunk").cogroup(read.groupBy("chunk")).applyInArrow(answered, schema)
    joined = rows.join(model.counted(1, least), "key", "left")
    c, n = F.coalesce("c", F.lit(0)), F.col("n")
    whole = math.log10(model.tokens + 0.5 * (model.types + 1))
    total = joined.groupBy("rid").agg(
        *(F.max(k).alias(k) for k in [*keep, "n_tokens"]),
        F.sum(F.when(n.isNull(), F.col("n_known")).when(c > 0, n).otherwise(0)).alias("n_known"),
        F.sum(F.when(n.isNull(), F.col("base")).otherwise(n * F.log10(c + 0.5))).alias("sum_base"),
        F.max("score").alias("score"),
    )
    return total.select(*keep, "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("sum_base") - F.col("n_tokens") * whole).alias("base_score"), "score")


def op2_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = store.fold(F.col("doc_id"), 5) == 1
    model = BloomModel.fit(docs.where(~held))
    return score(docs.select("doc_id", held.alias("held_out"), "text"), model, ["doc_id", "held_out"])
