"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds its distinct word shingles (A-Z as a-z). Two collections of ``HALVES`` half-keys are made, each the
hash of ``ROWS`` minhashes; a table key joins one half-key of either, so that HALVES^2 tables of 2 x ROWS minhashes
need only 2 x HALVES x ROWS minhash functions. At Jaccard 0.8 a pair shares a key with probability (1 - (1 - 0.8^ROWS)^HALVES)^2, 0.998 here. Only half-keys that two sets share are joined to keys.

Documents with equal sets are one class from the start. Links are confirmed on the full sets, in two rounds: first every member
of a key with the key's most typical member; then, in clusters of members that share keys, those that are not in the cluster's largest
class with all members of other classes, each with its likeliest partners first. Left out are pairs that other links have joined already, which
changes no component, and in the second round pairs whose sketches (16 bits of ``SKETCH`` mixed minhashes) put them under ``LIKELY``, which
loses a pair at 0.8 with a chance under 1 in 5,000, whatever the length of the texts. Large keys and clusters are split into blocks, and only links leave a block.

Documents without words are linked with nothing and are their own component; a document with fewer words than a shingle has its whole
sequence as its only member. Null texts are empty. Rows with a null id are returned with a null component and kept false; rows that repeat an id
share its component, also where their texts differ (ids from 2^62 on are not told from the names that such texts get). Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, textkernel
from .components import connected_components

WIDTH = 2
PERCENT = 80
ROWS = 3
HALVES = 10
SKETCH = 128
LIKELY = 0.66
#: Members, and shingles of all of them, in a block.
MEMBERS = 512
ITEMS = 1 << 19

_U = np.uint64
_BITS = 64 - textkernel.DOC_BITS
_SEEDS = textkernel.mix(np.arange(1, 2 * SKETCH + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)).reshape(2, SKETCH)
_SEEDS[1] |= _U(1)


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (hashes of 52 bits, ascending) of all documents, and those before each document."""
    s, e, before = textkernel.spans(data, at)
    h = textkernel.hashes(data, s, e)
    own = textkernel.owners(before)
    x = h.copy()
    for k in range(1, width):
        x[: len(x) - k] = textkernel.mix(x[: len(x) - k] * _U(0x9FB21C651E98DF25) + h[k:])
    whole = np.zeros(len(h), bool)
    if len(h) >= width:
        whole[: len(h) - width + 1] = own[width - 1 :] == own[: len(h) - width + 1]
    n = np.diff(before)
    for d in np.flatnonzero((n > 0) & (n < width)):  # the whole sequence as one
        v = h[before[d]]
        for k in range(1, n[d]):
            v = textkernel.mix(np.array([v * _U(0x9FB21C651E98DF25) + h[before[d] + k]], _U))[0]
        x[before[d]], whole[before[d]] = v, True
    keys = np.sort((own[whole].astype(_U) << _U(_BITS)) | (x[whole] >> _U(textkernel.DOC_BITS)))
    if len(keys):
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    return keys & _U((1 << _BITS) - 1), np.searchsorted(keys >> _U(_BITS), np.arange(len(at)).astype(_U))


def minhashes(values: np.ndarray, before: np.ndarray, functions: int = SKETCH) -> np.ndarray:
    """Documents x functions; documents without values have the largest number everywhere."""
    out = np.full((len(before) - 1, functions), ~_U(0), _U)
    some = np.flatnonzero(np.diff(before) > 0)
    if len(some):
        x = textkernel.mix(values)
        for f in range(functions):
            out[some, f] = np.minimum.reduceat((x ^ _SEEDS[0, f]) * _SEEDS[1, f], before[some])
    return out


def half_keys(m: np.ndarray) -> np.ndarray:
    """Documents x (2 x HALVES): each the hash of ROWS minhashes and of its place."""
    out = np.empty((len(m), 2 * HALVES), _U)
    for i in range(2 * HALVES):
        h = np.full(len(m), textkernel.mix_int(i + 1), _U)
        for r in range(ROWS):
            h = textkernel.mix(h * _U(0x9FB21C651E98DF25) + m[:, i * ROWS + r])
        out[:, i] = h
    return out


SIGNED = "doc_id long, n_shingles long, f1 long, f2 long, halves array<long>, sketch binary"


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, the set's fingerprint (128 bits), its half-keys and sketch."""

    def run(batches):
        for batch, data, at in textkernel.ranges(batches):
            values, before = shingle_sets(data, at, width)
            n = np.diff(before)
            f1, f2 = fingerprints(values, before)
            m = minhashes(values, before)
            halves = half_keys(m)
            # Minima go to zero as sets grow; mixed, their bits stay even.
            sketch = (textkernel.mix(m) >> _U(48)).astype(np.uint16)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * 2 * HALVES, pa.int32()), pa.array(halves.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(f1), pa.array(f2), lists, pa.array([r.tobytes() for r in sketch], pa.binary())], names=["doc_id", "n_shingles", "f1", "f2", "halves", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def fingerprints(values: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, in two columns."""
    x = textkernel.mix(values)
    f1 = textkernel.per_doc(x, before) + np.diff(before).astype(_U)
    return f1.view(np.int64), textkernel.per_doc(textkernel.mix(x ^ _U(0x5BD1E995)), before).view(np.int64)


def sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """rep (the row's id), the fingerprint and the shingles of each row."""

    def run(batches):
        for batch, data, at in textkernel.ranges(batches):
            values, before = shingle_sets(data, at, width)
            f1, f2 = fingerprints(values, before)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f1), pa.array(f2), pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(values.view(np.int64)))], names=["rep", "f1", "f2", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, "rep long, f1 long, f2 long, items array<long>")


def _alike(sketch: np.ndarray, x: np.ndarray, y: np.ndarray):
    """Pieces (rows of x, their likeness to all of y)."""
    step = max(1, (32 << 20) // max(1, len(y) * SKETCH))
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        yield part, (sketch[part][:, None, :] == sketch[y][None, :, :]).mean(axis=2)


def _star(table: pa.Table) -> pa.Table:
    """Pairs of a block's most typical member with every other that may be alike."""
    rep, n = table["rep"].to_numpy(), table["n"].to_numpy()
    sketch = np.stack([np.frombuffer(b.as_py(), np.uint16) for b in table["sketch"]])
    typical = np.empty(SKETCH, np.uint16)
    for c in range(SKETCH):
        v, times = np.unique(sketch[:, c], return_counts=True)
        typical[c] = v[times.argmax()]
    agree = (sketch == typical).sum(axis=1)
    centre = min(np.flatnonzero(agree == agree.max()), key=lambda k: rep[k])
    fits = (PERCENT * np.maximum(n, n[centre]) <= 100 * np.minimum(n, n[centre])) & (rep != rep[centre])
    other = rep[fits]
    return pa.table([pa.array(np.minimum(other, rep[centre]), pa.int64()), pa.array(np.maximum(other, rep[centre]), pa.int64())], names=["a", "b"])


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Items of both of two ascending arrays."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def _exact(table: pa.Table) -> pa.Table:
    """Confirmed links of a block's ``asking`` members with its others that join their classes (``label``), the likeliest tried first."""
    rep, label, n, asking = (table[c].to_numpy() for c in ("rep", "label", "n", "asking"))
    mine, others = np.flatnonzero(asking), np.flatnonzero(~asking)
    found: list[tuple[int, int]] = []
    if len(mine) and len(others):
        sketch = np.stack([np.frombuffer(b.as_py(), np.uint16) for b in table["sketch"]])
        items = [np.asarray(v, np.int64) for v in table["items"].to_numpy()]
        root = {v: v for v in label.tolist()}

        def top(v: int) -> int:
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        for part, like in _alike(sketch, mine, others):
            fits = (label[part][:, None] != label[others][None]) & (PERCENT * np.maximum(n[part][:, None], n[others][None]) <= 100 * np.minimum(n[part][:, None], n[others][None])) & (like >= LIKELY)
            for k in np.flatnonzero(fits.any(axis=1)).tolist():
                x = int(part[k])
                maybe = np.flatnonzero(fits[k])
                for y in others[maybe[np.argsort(-like[k][maybe], kind="stable")]].tolist():
                    p, q = top(int(label[x])), top(int(label[y]))
                    if p == q:
                        continue
                    both = _common(items[x], items[y])
                    if 100 * both >= PERCENT * (len(items[x]) + len(items[y]) - both):
                        root[max(p, q)] = min(p, q)
                        found.append((int(rep[x]), int(rep[y])))
    return pa.table([pa.array([min(f) for f in found], pa.int64()), pa.array([max(f) for f in found], pa.int64())], names=["a", "b"])


def _rest(left: DataFrame, full: DataFrame) -> DataFrame:
    """Confirmed links among members of open keys (rep, lo, n, sketch, label) whose classes differ.

    In a cluster, members outside its largest class ask all members of other classes; so a block holds ``MEMBERS`` (or ``ITEMS``) of
    those that ask and as many of the asked, and a row is copied once for each block of the other side.
    """
    cluster = connected_components(left.select(F.col("rep").alias("a"), F.col("lo").alias("b"))).withColumnRenamed("node", "rep").withColumnRenamed("component", "cluster")
    rows = left.groupBy("rep").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("label").alias("label")).join(cluster, "rep")
    rows = store.materialize(rows, "minhash-clusters")
    size = rows.groupBy("cluster", "label").agg(F.count("*").alias("members"), F.sum("n").alias("items"))
    blocks = lambda m, i: F.greatest(F.lit(1), F.ceil(m / MEMBERS), F.ceil(i / ITEMS)).cast("int")
    largest = size.groupBy("cluster").agg(F.max_by(F.struct("label", "members", "items"), F.struct("members", "label")).alias("top"), F.sum("members").alias("m"), F.sum("items").alias("i"))
    largest = largest.select("cluster", F.col("top.label").alias("major"), blocks(F.col("m"), F.col("i")).alias("asked_parts"), blocks(F.col("m") - F.col("top.members"), F.col("i") - F.col("top.items")).alias("asking_parts"))
    # By merge at every size: the sets of near copies are small as files and large in memory.
    rows = rows.join(largest, "cluster").join(full.hint("merge"), "rep")
    part = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = ["cluster", "i", "j", "rep", "label", "n", "sketch", "items", "asking"]
    asking = rows.where("label <> major").withColumn("asking", F.lit(True)).withColumn("i", part("asking_parts")).withColumn("j", every("asked_parts"))
    asked = rows.withColumn("asking", F.lit(False)).withColumn("j", part("asked_parts")).withColumn("i", every("asking_parts"))
    return asking.select(*columns).unionByName(asked.select(*columns)).groupBy("cluster", "i", "j").applyInArrow(_exact, "a long, b long")


#: Names of further texts of an id stand above all ids.
_ABOVE = 1 << 62


def _classes(several: DataFrame, real: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``reps`` with an own ``rep`` for each class, and the edges between classes that hold rows of one of the ids in ``several``."""
    first = reps.groupBy("rep").agg(F.count("*").alias("c"), F.min(F.struct("f1", "f2")).alias("first")).where("c > 1").select("rep", "first")
    further = F.coalesce(F.struct("f1", "f2") != F.col("first"), F.lit(False))
    own = reps.join(first, "rep", "left").withColumn("rep", F.when(further, F.lit(_ABOVE) + F.shiftrightunsigned(F.xxhash64("f1", "f2"), 2)).otherwise(F.col("rep"))).drop("first")
    own = store.materialize(own, "minhash-own")
    rows = real.join(several, "doc_id", "left_semi").join(own.select("f1", "f2", "rep"), ["f1", "f2"]).groupBy("doc_id", "rep").count()
    least = rows.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return own, store.materialize(rows.join(least, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b").distinct(), "minhash-same")


def link(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with store.scope() as keep:
        whole = store.materialize(signatures(docs, width), "minhash-signatures")
        signed = keep(store.materialize(whole.select("doc_id", "n_shingles", "f1", "f2"), "minhash-rows"))
        real = signed.where("n_shingles > 0 and doc_id is not null")
        # A class has equal sets, so the half-keys and the sketch of any of its rows are those of all.
        first = [F.first(c).alias(c) for c in ("halves", "sketch")]
        reps = store.materialize(whole.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), *first), "minhash-classes")
        # Ids on several rows, and whether their texts differ: mostly none.
        repeats = real.groupBy("doc_id").agg(F.count("*").alias("c"), F.min(F.struct("f1", "f2")).alias("x"), F.max(F.struct("f1", "f2")).alias("y")).where("c > 1")
        repeats = store.materialize(repeats.select("doc_id", (F.col("x") != F.col("y")).alias("differ")), "minhash-repeats")
        several = repeats.where("differ").select("doc_id")
        repeated, differ = not repeats.isEmpty(), not several.isEmpty()
        if differ:
            reps, same_id = _classes(several, real, reps)
        store.drop(whole)
        halves = reps.select("rep", "n", F.posexplode("halves").alias("at", "half"))
        shared = halves.groupBy("at", "half").agg(F.count("*").alias("c")).where("c > 1").drop("c")
        busy = halves.join(shared, ["at", "half"]).groupBy("rep", "n").agg(F.collect_list(F.when(F.col("at") < HALVES, F.struct("at", "half"))).alias("u"), F.collect_list(F.when(F.col("at") >= HALVES, F.struct("at", "half"))).alias("v"))
        keys = busy.select("rep", "n", "v", F.explode("u").alias("u")).select("rep", "n", "u", F.explode("v").alias("v")).select("rep", "n", F.xxhash64("u.at", "u.half", "v.at", "v.half").alias("key"))
        keys = store.materialize(keys, "minhash-keys")
        classes = keep(store.materialize(reps.select("f1", "f2", "rep"), "minhash-classes"))
        groups = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.min("n").alias("few"), F.max("n").alias("many"), F.bit_xor(F.xxhash64("rep")).alias("x")).where("lo < hi")
        # Keys with the same members count once.
        groups = store.materialize(groups.groupBy("size", "lo", "hi", "few", "many", "x").agg(F.min("key").alias("key")), "minhash-groups")
        alike = F.col("few") * 100 >= F.col("many") * PERCENT
        larger = groups.where("size > 2").select("key", "size", "lo")
        members = store.materialize(keys.join(larger, "key").join(reps.select("rep", "sketch"), "rep"), "minhash-members")
        store.drop(keys, reps)
        twos = groups.where((F.col("size") == 2) & alike).select(F.col("lo").alias("a"), F.col("hi").alias("b"))
        ends = twos.select(F.col("a").alias("rep")).unionByName(twos.select(F.col("b").alias("rep"))).unionByName(members.select("rep")).distinct()
        # The same plan at every size: a broadcast of what grows with the input would only move the growth elsewhere.
        named = classes.join(ends.hint("merge"), "rep", "left_semi")
        texts = docs.join(named.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
        full = sets(texts, width)
        if differ:
            again = docs.join(real.join(named.where(F.col("rep") >= _ABOVE), ["f1", "f2"], "left_semi").select("doc_id").distinct(), "doc_id", "left_semi")
            full = full.unionByName(sets(again, width)).withColumnRenamed("rep", "row").join(named, ["f1", "f2"])
        full = full.select("rep", "items")
        full = store.materialize(full.dropDuplicates(["rep"]) if repeated else full, "minhash-sets")
        dealt = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / MEMBERS)).cast("int"))
        star = dealt.select("key", "block", "rep", "n", "sketch").groupBy("key", "block").applyInArrow(_star, "a long, b long")
        hubs = members.where((F.col("size") > MEMBERS) & (F.col("rep") != F.col("lo"))).select(F.least("rep", "lo").alias("a"), F.greatest("rep", "lo").alias("b"))
        pairs = store.materialize(star.unionByName(hubs).unionByName(twos).distinct(), "minhash-pairs")
        of = [full.select(F.col("rep").alias(x), F.col("items").alias("s" + x)) for x in "ab"]
        both = F.size(F.array_intersect("sa", "sb"))
        confirmed = pairs.join(of[0].hint("merge"), "a").join(of[1].hint("merge"), "b").where(100 * both >= PERCENT * (F.size("sa") + F.size("sb") - both))
        links = store.materialize(confirmed.select("a", "b").distinct().unionByName(same_id) if differ else confirmed.select("a", "b").distinct(), "minhash-links")
        labels = connected_components(links).withColumnRenamed("node", "rep")
        labelled = members.join(labels, "rep", "left").select("key", "lo", "rep", "n", "sketch", F.coalesce("component", "rep").alias("label"))
        open_ = labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("key")
        left = store.materialize(labelled.join(open_, "key"), "minhash-open")
        store.drop(members)
        if not left.isEmpty():
            more = store.materialize(_rest(left, full), "minhash-links")
            labels = connected_components(links.unionByName(more)).withColumnRenamed("node", "rep")
        labels = keep(store.materialize(labels, "minhash-labels"))
    known = classes.join(labels, "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    linked = real.select("doc_id", "n_shingles", "f1", "f2").join(known, ["f1", "f2"]).select("doc_id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op9_minhash_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(store.table(spark, sf_dir, "documents"))
