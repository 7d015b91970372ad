"""Near-duplicate embeddings by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its nearest corner of the cross-polytope is the
largest coordinate with its sign. A table's key joins the corners of several rotations, so many that a key holds a few
vectors of random data whatever their number; besides its own key a vector probes those with its second corner in one rotation
each. Vectors that share a key are compared in double precision, in blocks; a block hands on a spanning forest of its links,
never all pairs. The components of these links are then compared within themselves, again in blocks, which counts
every vector's links exactly: the two ends of a link always meet there. Equal vectors are one class from the start and count as links of one another.

Vectors of different lengths link with nothing of the other length; each length is hashed for the number of its vectors. Vectors that are null, empty,
zero, or hold null or non-finite components link with nothing: n_links 0, their own component. Rows with a null id come back with a null component and kept false. Repeated rows of one id share its
component, and count as links of one another. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, textkernel
from .components import connected_components

COSINE = 0.95
TABLES = 16
#: Vectors that a key holds of random data, at most.
CROWD = 1 / 64
BLOCK = 512
SEED = 29

_U = np.uint64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows (a power of two long), unscaled."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x


def corners(x: np.ndarray, rotation: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and second nearest corner of each row under a rotation: 2 x coordinate + sign."""
    wide = 1 << max(1, math.ceil(math.log2(max(2, x.shape[1]))))
    y = np.zeros((len(x), wide))
    y[:, : x.shape[1]] = x
    for k in range(3):
        signs = textkernel.mix(np.arange(wide, dtype=_U) + _U((seed << 40) + (rotation << 20) + (k << 12)))
        y = hadamard(y * np.where(signs & _U(1), 1.0, -1.0))
    size = np.abs(y)
    rows = np.arange(len(y))
    first = size.argmax(axis=1)
    negative = y < 0
    size[rows, first] = -1
    second = size.argmax(axis=1)
    return 2 * first + negative[rows, first], 2 * second + negative[rows, second]


def keys(x: np.ndarray, tables: int, rotations: int, seed: int = SEED) -> np.ndarray:
    """Rows x (tables x (1 + rotations)): each table's own key and its probes."""
    out = np.empty((len(x), tables * (1 + rotations)), np.int64)
    for t in range(tables):
        pairs = [corners(x, t * rotations + r, seed) for r in range(rotations)]
        for probe in range(1 + rotations):
            h = np.full(len(x), textkernel.mix_int(t + 1), _U)
            for r, (one, two) in enumerate(pairs):
                h = textkernel.mix(h * _U(0x9FB21C651E98DF25) + (two if probe == r + 1 else one).astype(_U))
            out[:, t * (1 + rotations) + probe] = h.view(np.int64)
    return out


def rotations(n: int, dim: int) -> int:
    """So many that a key holds at most ``CROWD`` of ``n`` random vectors on average."""
    return max(1, math.ceil(math.log(max(2, n / CROWD)) / math.log(2 << max(1, math.ceil(math.log2(max(2, dim)))))))


def _vectors(column: pa.Array) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column.to_numpy(zero_copy_only=False)]) if len(column) else np.zeros((0, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keyed(tables: int):
    """Rows (rep, dim, key) of vectors (rep, embedding, dim, the vectors of that length)."""

    def run(batches):
        for batch in batches:
            dims, many = (batch.column(i).to_numpy() for i in (2, 3))
            for dim in np.unique(dims):
                where = np.flatnonzero(dims == dim)
                for lo in range(0, len(where), 4096):
                    part = batch.take(pa.array(where[lo : lo + 4096]))
                    k = keys(_vectors(part.column(1)), tables, rotations(int(many[where[0]]), int(dim)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), k.shape[1])), pa.array(np.full(k.size, dim, np.int32)), pa.array(k.reshape(-1))], names=["rep", "dim", "key"])

    return run


def _forest(at_least: float):
    """A spanning forest of the links in a block."""

    def run(table: pa.Table) -> pa.Table:
        rep, x = table["rep"].to_numpy(), _vectors(table["embedding"].combine_chunks())
        pairs = []
        near = (x @ x.T) >= at_least
        todo = np.ones(len(rep), bool)
        for start in range(len(rep)):
            if not todo[start]:
                continue
            wave = [start]
            todo[start] = False
            while wave:
                u = wave.pop()
                for v in np.flatnonzero(near[u] & todo).tolist():
                    todo[v] = False
                    pairs.append((rep[u], rep[v]))
                    wave.append(v)
        return pa.table([pa.array([int(min(p)) for p in pairs], pa.int64()), pa.array([int(max(p)) for p in pairs], pa.int64())], names=["a", "b"])

    return run


def _links(at_least: float):
    """For each vector of a pair of blocks of one component: the links to vectors of the other block (of its own: the others)."""

    def run(table: pa.Table) -> pa.Table:
        rep, times, blk = (table[c].to_numpy() for c in ("rep", "times", "blk"))
        x = _vectors(table["embedding"].combine_chunks())
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        a, b = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
        near = (x[a] @ x[b].T) >= at_least
        if i == j:
            near[np.arange(len(a)), np.arange(len(a))] = False
            n = [near @ times[b]]
            who = [a]
        else:
            n, who = [near @ times[b], times[a] @ near], [a, b]
        return pa.table([pa.array(rep[np.concatenate(who)]), pa.array(np.concatenate(n).astype(np.int64))], names=["rep", "n"])

    return run


def _blocks(rows: DataFrame, size: str) -> DataFrame:
    """Each row for every pair of blocks (of about BLOCK rows) of its group that holds it."""
    rows = rows.withColumn("parts", F.ceil(F.col(size) / BLOCK).cast("int")).withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("i", F.least("blk", "other")).withColumn("j", F.greatest("blk", "other"))


def link(vectors: DataFrame, at_least: float = COSINE, tables: int = TABLES) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = F.size("embedding") > 0
    good = good & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    good = F.coalesce(good, F.lit(False)) & F.col("vec_id").isNotNull()
    real = rows.where(good)
    with store.scope() as keep:
        classes = keep(store.materialize(real.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times")).withColumn("dim", F.size("embedding")), "vectors"))
        # A row for each length that occurs: no more than components of the longest vector.
        many = classes.groupBy("dim").agg(F.count("*").alias("many"))
        keyed = classes.join(F.broadcast(many), "dim").select("rep", "embedding", "dim", "many").mapInArrow(_keyed(tables), "rep long, dim int, key long")
        keyed = store.materialize(keyed, "vector-keys")
        groups = keyed.groupBy("dim", "key").agg(F.count("*").alias("size"), F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.bit_xor(F.xxhash64("rep")).alias("x")).where("lo < hi")
        groups = groups.groupBy("dim", "size", "lo", "hi", "x").agg(F.min("key").alias("key")).select("dim", "key", "size")
        members = keyed.join(groups, ["dim", "key"]).distinct().join(classes.select("rep", "embedding"), "rep")
        by = ["dim", "key", "i", "j"]
        edges = _blocks(members, "size").select(*by, "rep", "embedding").groupBy(*by).applyInArrow(_forest(at_least), "a long, b long")
        found = keep(store.materialize(connected_components(edges), "vector-components")).withColumnRenamed("node", "rep")
        sizes = found.groupBy("component").agg(F.count("*").alias("size"))
        inside = found.join(sizes, "component").join(classes.select("rep", "times", "embedding"), "rep")
        by = ["component", "i", "j"]
        counted = _blocks(inside, "size").select(*by, "rep", "times", "blk", "embedding").groupBy(*by).applyInArrow(_links(at_least), "rep long, n long")
        counted = keep(store.materialize(counted.groupBy("rep").agg(F.sum("n").alias("n")), "vector-links"))
    of_class = found.join(counted, "rep")
    own = real.join(classes.select("embedding", "rep", "times"), "embedding").select("vec_id", "rep", "times")
    linked = own.join(of_class, "rep", "left").select("vec_id", (F.col("times") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(store.table(spark, sf_dir, "embeddings"))
