"""Counterfactually regularised toxicity classifier.

A text's features are the hashed letter runs (A-Z as a-z) and their first 4, 5 and 6 bytes, each present or not, and again whether it
is there at least as often as each of ``TIMES``. A logistic model is fitted on a bounded sample of labelled ids (about ``LABELLED`` at most, a row each: of an id on several rows the text whose
hash is smallest). For every such document
that names an identity group, every term is swapped in turn for each other one of its line, and the loss holds ``FAIRNESS`` times
the squared change of the logit, averaged over a document's swaps, so that the mere naming of a group does not move the score.

Null and empty texts have no features and score by the bias alone; without labels, or with one class only, every score is the
smoothed share of toxic labels (a quarter without labels, so that nothing is predicted toxic). A repeated label row counts once (its largest value). Repeated documents each get their row; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, textkernel, vectors

BUCKETS = 1 << 18
LABELLED = 16_000
#: Least numbers of times, a feature each.
TIMES = (1, 2, 3, 5)
FEATURES = 8192
TASKS = 8
MIN_DOCS = 4
L2 = 2.0
FAIRNESS = 1.0
STEPS = 300
#: Identity terms, exchanged within a line.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("female", "male"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("deaf", "blind", "disabled", "paralyzed"),
    ("old", "young", "elderly", "teenage"),
)

_U = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[128:] = _LETTER[65:91] = _LETTER[97:123] = True
_SHIFT = _U(64 - 18)


def features(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
    """Buckets of each letter run: itself and, where longer, its first 4, 5 and 6 bytes (else itself again)."""
    out = [textkernel.hashes(data, s, e)]
    for n in (4, 5, 6):
        longer = np.flatnonzero(e - s > n)
        h = out[0].copy()
        h[longer] = textkernel.mix(textkernel.hashes(data, s[longer], s[longer] + n) + _U(n))
        out.append(h)
    return [(h >> _SHIFT).astype(np.int64) for h in out]


def _term(word: str) -> list[int]:
    data = np.frombuffer(word.encode(), np.uint8)
    return [int(x[0]) for x in features(data, np.array([0]), np.array([len(data)]))]


def levelled(buckets: np.ndarray) -> np.ndarray:
    """The features of a text whose words' buckets are given: bucket + BUCKETS x place in ``TIMES``."""
    x, n = np.unique(buckets, return_counts=True)
    return np.concatenate([x[n >= t] + i * BUCKETS for i, t in enumerate(TIMES)]).astype(np.int32)


def _count(batches):
    """Texts with each feature, by class."""
    total: dict[str, np.ndarray] = {}
    for batch, data, at in textkernel.ranges(batches):
        s, e, before = textkernel.spans(data, at, _LETTER)
        buckets = np.stack(features(data, s, e), axis=1) if len(s) else np.zeros((0, 4), np.int64)
        for d, label in enumerate(batch.column(0).to_pylist()):
            total.setdefault(label, np.zeros(len(TIMES) * BUCKETS, np.int64))[levelled(buckets[before[d] : before[d + 1]])] += 1
    yield from vectors.emit(total)


def choose(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """The features that tell the classes apart best, ascending, given the texts of either that hold each."""
    df, share = clean + toxic, n_toxic / (n_clean + n_toxic)
    expected = df * share
    strength = np.where(df >= MIN_DOCS, (toxic - expected) ** 2 / np.maximum(expected * (1 - share), 1e-9), -1)
    chosen = np.sort(np.argsort(-strength, kind="stable")[:FEATURES])
    return chosen[strength[chosen] > 0]


def _examples(chosen: np.ndarray):
    """The places in ``chosen`` of each labelled text's features, and those of its counterfactuals where it names a group: all terms moved on by so many places in their lines."""

    def run(batches):
        index = np.full(len(TIMES) * BUCKETS, -1, np.int32)
        index[chosen] = np.arange(len(chosen))

        def held(buckets: np.ndarray) -> bytes:
            at = index[levelled(buckets)]
            return at[at >= 0].tobytes()

        places = {w: (line, i) for line in IDENTITY_TERMS for i, w in enumerate(line)}
        known = {int(textkernel.hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]): at for w, at in places.items()}
        terms = {w: _term(w) for w in places}
        keys = np.sort(np.array(list(known), _U))
        for batch, data, at in textkernel.ranges(batches):
            s, e, before = textkernel.spans(data, at, _LETTER)
            h = textkernel.hashes(data, s, e)
            buckets = np.stack(features(data, s, e), axis=1) if len(s) else np.zeros((0, 4), np.int64)
            named = keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h
            own, others = [], []
            for d in range(len(at) - 1):
                x = buckets[before[d] : before[d + 1]]
                own.append(held(x))
                found = [(i, *known[int(h[before[d] + i])]) for i in np.flatnonzero(named[before[d] : before[d + 1]]).tolist()]
                swaps = []
                for step in range(1, max((len(line) for _, line, _ in found), default=1)):
                    y = x.copy()
                    for i, line, k in found:
                        y[i] = terms[line[(k + step) % len(line)]]
                    swaps.append(held(y))
                others.append(swaps)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary()), pa.array(others, pa.list_(pa.binary()))], names=["toxic", "own", "others"])

    return run


def _flat(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all rows in a row, and the row of each."""
    parts = [np.frombuffer(b, np.int32) for b in blobs]
    rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), rows


def train(y: np.ndarray, own: list[bytes], others: list[list[bytes]], k: int, fairness: float = FAIRNESS) -> tuple[np.ndarray, float]:
    """A weight for each of ``k`` features, and the bias."""
    order = sorted(range(len(y)), key=lambda i: (y[i], own[i]))  # the rows' order of arrival doesn't matter
    y, own, others = y[order], [own[i] for i in order], [others[i] for i in order]
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    bias = b0 = float(np.log(share / (1 - share)))
    x, xr = _flat(own)
    pairs = [(i, o) for i, swaps in enumerate(others) for o in swaps]
    a, ar = _flat([own[i] for i, _ in pairs])
    c, cr = _flat([o for _, o in pairs])
    weigh = np.array([1 / len(others[i]) for i, _ in pairs])
    w, m, v, mb, vb = np.zeros(k), np.zeros(k), np.zeros(k), 0.0, 0.0
    for t in range(1, STEPS + 1):
        z = np.bincount(xr, w[x], len(y)) + bias
        off = 1 / (1 + np.exp(-z)) - y
        grad = np.bincount(x, off[xr], k) + L2 * w
        if pairs:
            change = weigh * (np.bincount(ar, w[a], len(pairs)) - np.bincount(cr, w[c], len(pairs)))
            grad += 2 * fairness * (np.bincount(a, change[ar], k) - np.bincount(c, change[cr], k))
        gb = off.sum() + 0.01 * (bias - b0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.1 * min(1.0, 2 * (1 - t / (STEPS + 1)))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return np.where(np.abs(w) > 1e-3, w, 0.0), float(bias)


class ToxicityModel:
    """A weight for each feature, and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, fairness: float = FAIRNESS) -> ToxicityModel:
        """``labels``: doc_id and toxic; ``docs``: doc_id and text."""
        known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        sample = vectors.bounded(known, "doc_id", labelled)
        # A row an id, however many rows repeat it: the bound of ids is one of rows.
        first = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"]
        rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), first.alias("text")).select("toxic", "text")
        # At most about ``labelled`` texts: few tasks, so that few count vectors are summed.
        rows = store.materialize(rows, "toxicity-labelled").coalesce(TASKS)
        n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        weights, total = np.zeros(len(TIMES) * BUCKETS), sum(n.values())
        toxic = sum(v for k, v in n.items() if k > 0)
        if not 0 < toxic < total:
            share = (toxic + 0.5) / (total + 2.0)
            return cls(weights, float(np.log(share / (1 - share))))
        rows = rows.select((F.col("toxic") > 0).cast("int").alias("toxic"), "text")
        counts = vectors.summed(rows.select(F.col("toxic").cast("string").alias("slot"), "text"), _count, len(weights), few=True)
        none = np.zeros(len(weights), np.int64)
        chosen = choose(counts.get("0", none), counts.get("1", none), total - toxic, toxic)
        del counts
        sample = rows.mapInArrow(_examples(chosen.astype(np.int32)), "toxic int, own binary, others array<binary>").toArrow()
        weights[chosen], bias = train(sample["toxic"].to_numpy().astype(float), sample["own"].to_pylist(), sample["others"].to_pylist(), len(chosen), fairness)
        return cls(weights, bias)


def document_logits(weights: np.ndarray, bias: float, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each document's logit: the bias and the weights of its features."""
    s, e, before = textkernel.spans(data, at, _LETTER)
    own = textkernel.owners(before)
    levels = weights.reshape(len(TIMES), BUCKETS)
    used = (levels != 0).any(axis=0)
    keys = []
    for x in features(data, s, e):
        w = np.flatnonzero(used[x])
        keys.append((own[w] << 18) | x[w])
    pairs, n = np.unique(np.concatenate(keys), return_counts=True)
    value = sum(np.where(n >= t, row[pairs & (BUCKETS - 1)], 0.0) for t, row in zip(TIMES, levels, strict=True))
    return bias + np.bincount(pairs >> 18, value, len(at) - 1)


def score(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns ``keep``), score, predicted."""
    weights, bias, keep = docs.sparkSession.sparkContext.broadcast(model.weights), model.bias, keep or ["doc_id"]
    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.select(*keep).schema), "score double", "predicted int"])

    def run(batches):
        for batch, data, at in textkernel.ranges(batches, "__text"):
            z = document_logits(weights.value, bias, data, at)
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = store.table(spark, sf_dir, "labels").where(store.fold(F.col("doc_id"), 5) != 0)
    model = ToxicityModel.fit(docs, labels)
    return score(docs.select("doc_id", (store.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text"), model, ["doc_id", "held_out"])
