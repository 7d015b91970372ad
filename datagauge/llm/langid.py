"""Language identification by multilingual mixture inference.

Byte trigrams of letter runs (A-Z as a-z, any other ASCII byte a boundary) are hashed to ``BUCKETS`` counters a
language; every learning document counts. A document is cut into units of ``UNIT`` words; expectation-maximisation
over the units' likelihoods gives its language proportions. Sets of its 1, 2, ... likeliest languages are fitted in turn for as long as the
log-likelihood less ``PENALTY`` x log(units) a further language grows, up to all languages; the last set that made it grow
wins. The prediction is the language with the largest share in it (ties: the first by code point), the shares of the set come with it.

Null texts, texts without a letter and models without languages give ``und`` with score 0 and no shares. More than ``LANGUAGES``
distinct values of lang are an error: the model is broadcast, a row of ``BUCKETS`` for each. Repeated rows each get
their row; null ids pass through (fold 0); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, textkernel, vectors

BUCKETS = 1 << 16
UNIT = 8
LANGUAGES = 512
PENALTY = 3.0
ROUNDS = 6
SMOOTH = 0.5

_LETTER = np.zeros(256, np.uint32)
_LETTER[128:] = np.arange(128, 256)
_LETTER[97:123] = _LETTER[65:91] = np.arange(97, 123)
_IS_LETTER = _LETTER > 0


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of letters, and the bucket of the trigram around each; nothing crosses a document."""
    x = _LETTER[data]
    left, right = np.zeros_like(x), np.zeros_like(x)
    left[1:], right[:-1] = x[:-1], x[1:]
    cut = at[(at > 0) & (at < len(data))]
    left[cut] = 0
    right[cut - 1] = 0
    where = np.flatnonzero(x)
    code = (left[where] << np.uint32(16)) | (x[where] << np.uint32(8)) | right[where]
    return where, ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


def _count(batches):
    total: dict[str, np.ndarray] = {}
    for batch, data, at in textkernel.ranges(batches):
        langs = batch.column(0).to_pylist()
        where, code = trigrams(data, at)
        before = np.searchsorted(where, at)
        index = {x: i for i, x in enumerate(sorted(set(langs)))}
        of = np.repeat(np.array([index[x] for x in langs], np.int64), np.diff(before))
        counts = np.bincount(of * BUCKETS + code, minlength=len(index) * BUCKETS).reshape(-1, BUCKETS)
        for x, i in index.items():
            total[x] = total[x] + counts[i] if x in total else counts[i]
    yield from vectors.emit(total)


class LanguageModel:
    """Smoothed log-probabilities, a row for each language in ascending order."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table

    @classmethod
    def fit(cls, docs: DataFrame) -> LanguageModel:
        """Learns from all rows of ``docs`` (text, lang) with a language."""
        known = docs.where("lang is not null and text is not null").select("lang", "text")
        if (n := known.select("lang").distinct().count()) > LANGUAGES:
            raise ValueError(f"{n} languages, more than {LANGUAGES}")
        counts = vectors.summed(known, _count, BUCKETS)
        langs = sorted(counts)
        table = np.array([np.log((counts[x] + SMOOTH) / (counts[x].sum() + SMOOTH * BUCKETS)) for x in langs], np.float32).reshape(len(langs), BUCKETS)
        return cls(langs, table)


def _em(ll: np.ndarray, units: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares (documents x languages) and log-likelihood, each document over the languages allowed to it."""
    docs = len(units) - 1
    top = ll.max(axis=0)
    like = np.exp(ll - top)
    own = textkernel.owners(units)
    shares = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
    n = np.maximum(np.diff(units), 1)[:, None]
    for _ in range(ROUNDS):
        weighted = like * shares[own].T
        weighted /= np.maximum(weighted.sum(axis=0), 1e-300)
        shares = np.stack([textkernel.per_doc(w, units) for w in weighted], axis=1) / n
    total = np.log(np.maximum((like * shares[own].T).sum(axis=0), 1e-300)) + top
    return shares, textkernel.per_doc(total, units) if docs else np.zeros(0)


def _subset(units: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units of some documents, and those before each of them."""
    n = np.diff(units)[docs]
    before = np.concatenate(([0], np.cumsum(n)))
    return np.repeat(units[docs] - before[:-1], n) + np.arange(before[-1]), before


def infer(table: np.ndarray, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: the predicted row of ``table`` (-1: no letter), its score, and the shares of all rows."""
    docs, langs = len(at) - 1, len(table)
    where, code = trigrams(data, at)
    if not langs or not len(where):
        return np.full(docs, -1), np.zeros(docs), np.zeros((docs, langs))
    s, _, words = textkernel.spans(data, at, _IS_LETTER)
    of_word = np.arange(len(s)) - np.repeat(words[:-1], np.diff(words))
    starts = s[of_word % UNIT == 0]
    units = np.searchsorted(starts, at)
    first = np.searchsorted(where, starts)
    ll = np.stack([np.add.reduceat(row[code], first) for row in table]).astype(np.float64)
    alone = np.stack([textkernel.per_doc(x, units) for x in ll], axis=1)
    shares, _ = _em(ll, units, np.ones((docs, langs)))
    order = np.argsort(-(shares + (alone == alone.max(axis=1, keepdims=True)) * 2), axis=1, kind="stable")
    best, best_shares = np.take_along_axis(alone, order[:, :1], axis=1)[:, 0], np.zeros((docs, langs))
    np.put_along_axis(best_shares, order[:, :1], 1.0, axis=1)
    charge = PENALTY * np.log(np.diff(units) + 1.0)
    growing = np.flatnonzero(np.diff(units) > 1)  # one unit is in one language
    for size in range(2, langs + 1):
        if not len(growing):
            break
        allowed = np.zeros((len(growing), langs))
        np.put_along_axis(allowed, order[growing, :size], 1.0, axis=1)
        of, before = _subset(units, growing)
        fit, value = _em(ll[:, of], before, allowed)
        value = value - charge[growing] * (size - 1)
        better = value > best[growing]
        growing = growing[better]
        best[growing], best_shares[growing] = value[better], fit[better]
    pred = best_shares.argmax(axis=1)
    ranked = np.sort(alone, axis=1)
    margin = ranked[:, -1] - ranked[:, -2] if langs > 1 else np.full(docs, 50.0)
    score = best_shares.max(axis=1) * (1 - 0.5 * np.exp(-np.minimum(margin, 50)))
    some = np.diff(units) > 0
    return np.where(some, pred, -1), np.where(some, np.clip(score, 0, 1), 0.0), best_shares * some[:, None]


def predict(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns ``keep``), lang_pred, score, and the languages found with their shares (largest first)."""
    table, langs = docs.sparkSession.sparkContext.broadcast(model.table), np.array([*model.langs, "und"], object)
    keep = keep or ["doc_id"]
    # A letter outside ASCII is told from other signs by its Unicode class, which bytes don't show.
    rows = docs.select(*keep, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letter"), F.col("text").alias("__text"))
    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.select(*keep).schema), "lang_pred string", "score double", "languages array<string>", "shares array<double>"])

    def run(batches):
        for batch, data, at in textkernel.ranges(batches, "__text"):
            pred, score, shares = infer(table.value, data, at)
            letter = batch.column(len(keep)).to_numpy(zero_copy_only=False)
            pred, score = np.where(letter, pred, -1), np.where(letter & (pred >= 0), score, 0.0)
            ranked = np.argsort(-shares, axis=1, kind="stable")
            ordered = np.take_along_axis(shares, ranked, axis=1)
            found = (ordered > 0) & (pred >= 0)[:, None]
            ends = pa.array(np.concatenate(([0], np.cumsum(found.sum(axis=1)))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(langs[:-1][ranked[found]], pa.string()), pa.array(ordered[found]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs[pred], pa.string()), pa.array(score), *lists], names=[*keep, "lang_pred", "score", "languages", "shares"])

    return rows.mapInArrow(run, schema)


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    held = store.fold(F.col("doc_id"), 4) == 2
    model = LanguageModel.fit(docs.where(~held))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model, ["doc_id", "held_out"])
