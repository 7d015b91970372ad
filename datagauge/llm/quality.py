"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Word uni- and bigrams are hashed to ``BUCKETS`` counters. The raw multinomial counts every document; the target
multinomial counts every second of all documents labelled as good (by a hash of its id), the others set the threshold; their ids are broadcast in classes of about ``TRUSTED``, a scan for each. A document's value is the mean over its
n-grams of log p_target / p_raw; it is kept if that reaches the threshold, which ``1 - LOSS`` of those others reach (to the width
of a bin of their histogram, which is summed over all of them).

Null and empty texts have no words: all counts 0, base_failed true, kept false, llr null. Without labels, or without good ones,
nothing is known of the target and the threshold admits every document. Repeated rows each get their row;
null ids are kept as null. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, textkernel, vectors

BUCKETS = 1 << 16
TRUSTED = 200_000
LOSS = 0.002
#: The histogram of values: ``BINS`` between -``REACH`` and ``REACH``, the outer ones open.
BINS, REACH = 1 << 15, 16.0
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50

_U = np.uint64
_BITS = _U(64 - textkernel.DOC_BITS)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def ngram_buckets(h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the unigrams and of the bigrams, and for either the n-grams before each document."""
    own = textkernel.owners(before)
    pair = own[1:] == own[:-1]
    two = textkernel.mix(h[:-1] * _U(0x9FB21C651E98DF25) + h[1:])[pair]
    with_words = np.concatenate(([0], np.cumsum(np.diff(before) > 0)))
    return (h >> _U(48)).astype(np.int64), (two >> _U(48)).astype(np.int64), before, before - with_words


def _count(batches):
    total = np.zeros(BUCKETS, np.int64)
    for _, data, at in textkernel.ranges(batches):
        s, e, before = textkernel.spans(data, at)
        one, two, _, _ = ngram_buckets(textkernel.hashes(data, s, e, lower=False), before)
        total += np.bincount(one, minlength=BUCKETS) + np.bincount(two, minlength=BUCKETS)
    yield from vectors.emit({"n": total})


def mean_ratio(ratio: np.ndarray, h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's length-normalised log-likelihood ratio, and its n-grams."""
    one, two, b1, b2 = ngram_buckets(h, before)
    n = np.diff(b1) + np.diff(b2)
    total = textkernel.per_doc(ratio[one], b1) + textkernel.per_doc(ratio[two], b2)
    return total / np.maximum(n, 1), n


def duplicates(keys: np.ndarray) -> np.ndarray:
    """True where a key stands twice or more."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    out = np.zeros(len(keys), bool)
    if len(twice):
        light = np.zeros(1 << 20, bool)
        low = _U((1 << 20) - 1)
        light[(twice & low).astype(np.int64)] = True
        maybe = np.flatnonzero(light[(keys & low).astype(np.int64)])
        at = np.searchsorted(twice, keys[maybe])
        out[maybe] = twice[np.minimum(at, len(twice) - 1)] == keys[maybe]
    return out


def in_doc(own: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Keys that are equal for equal hashes in one document."""
    return (own.astype(_U) << _BITS) | (h >> _U(textkernel.DOC_BITS))


def rules(data: np.ndarray, at: np.ndarray, s: np.ndarray, e: np.ndarray, before: np.ndarray, h: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each document."""
    docs = len(at) - 1
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    word_chars = textkernel.per_doc(lead[e] - lead[s], before)
    np.cumsum(_SYMBOL[data], out=lead[1:])
    symbols = lead[at[1:]] - lead[at[:-1]]
    ls, le, lbefore = textkernel.lines(data, at)
    filled = np.searchsorted(s, le) > np.searchsorted(s, ls)
    lown = textkernel.owners(lbefore)[filled]
    keys = np.sort(in_doc(lown, textkernel.hashes(data, ls[filled], le[filled], lower=False)))
    again = np.flatnonzero(keys[1:] == keys[:-1]) + 1
    dup_lines = np.bincount((keys[again] >> _BITS).astype(np.int64), minlength=docs)
    covered = np.zeros(len(s), bool)
    if len(s) > 2:
        own = textkernel.owners(before)
        whole = own[2:] == own[:-2]
        three = textkernel.mix((h[:-2] * _U(0x9FB21C651E98DF25) + h[1:-1]) * _U(0xD6E8FEB86659FD93) + h[2:])
        where = np.flatnonzero(whole)
        found = where[duplicates(in_doc(own[where], three[where]))]
        for k in range(3):
            covered[found + k] = True
    return {"n_words": np.diff(before), "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines.astype(np.int64), "n_repeat_words": textkernel.per_doc(covered, before)}


class QualityModel:
    """log p_target / p_raw by bucket, and the threshold."""

    def __init__(self, ratio: np.ndarray, threshold: float):
        self.ratio, self.threshold = ratio, threshold

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, trusted: int = TRUSTED, loss: float = LOSS) -> QualityModel:
        ids = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
        classes = max(1, -(-ids.count() // trusted))
        # Broadcast, about ``trusted`` ids at once: else the join would shuffle every text.
        good = []
        for k in range(classes):
            some = ids.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(classes)) == k)
            one = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id", "left_semi")
            one = store.materialize(one.withColumn("half", F.xxhash64("doc_id", F.lit(11)) % 2 == 0), "quality-trusted")
            good.append(one)
        rows = good[0]
        for one in good[1:]:
            rows = rows.unionByName(one)
        raw = vectors.summed(docs.select("text"), _count, BUCKETS).get("n", np.zeros(BUCKETS, np.int64))
        target = vectors.summed(rows.where("half").select("text"), _count, BUCKETS).get("n")
        if target is None:
            return cls(np.zeros(BUCKETS), -np.inf)
        ratio = np.log((target + 0.5) / (target.sum() + 0.5 * BUCKETS)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * BUCKETS))

        def values(batches):
            total = np.zeros(BINS, np.int64)
            for _, data, at in textkernel.ranges(batches):
                s, e, before = textkernel.spans(data, at)
                value, n = mean_ratio(ratio, textkernel.hashes(data, s, e, lower=False), before)
                total += np.bincount(np.clip(((value[n > 0] + REACH) * BINS / (2 * REACH)).astype(np.int64), 0, BINS - 1), minlength=BINS)
            yield from vectors.emit({"n": total})

        seen = vectors.summed(rows.where("not half").select("text"), values, BINS).get("n")
        for one in good:
            store.drop(one)
        if seen is None:
            return cls(ratio, -np.inf)
        # The lower edge of the bin that holds the value of that rank.
        bin_ = int(np.searchsorted(np.cumsum(seen), int(loss * seen.sum()), "right"))
        return cls(ratio, bin_ * 2 * REACH / BINS - REACH if bin_ else -np.inf)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, llr."""
    ratio = docs.sparkSession.sparkContext.broadcast(model.ratio)
    threshold = model.threshold
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch, data, at in textkernel.ranges(batches):
            s, e, before = textkernel.spans(data, at)
            h = textkernel.hashes(data, s, e, lower=False)
            base = rules(data, at, s, e, before, h)
            value, n = mean_ratio(ratio.value, h, before)
            failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
            kept = ~failed & (value >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, base.values()), pa.array(failed), pa.array(kept), pa.array(value, mask=n == 0)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op5_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    return score(docs, QualityModel.fit(docs, store.table(spark, sf_dir, "labels")))
