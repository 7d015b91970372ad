"""Mixing overlapping sources to target weights by minimum-cost flow.

Sources overlap where they hold equal texts. Documents are summed by the membership pattern of their text (the set of all sources that hold
it) and by their own sources. A pattern offers the words of its distinct texts once at cost 0, again at cost 1, twice as many at cost 2 and so on:
repetition costs are convex, and a copy in another source is a repetition as much as a second pass is. A class of
documents (pattern and own sources) passes on up to ``COPIES`` times its size, to its own sources only, and these ask for their targets. The cheapest flow that
fills the targets says how many words each class gives; whole passes over the class's documents come first, then documents in the order of
a seeded hash until the rest is reached. The network has a node for each pattern, class and source, never for a document; of more than
``PATTERNS`` patterns with several sources the smaller ones count as their documents' own sources only, which changes costs, not targets.

Null and empty texts have size 0 and are never taken. A null or empty list of sources is the source null.
Repeated rows are separate documents, but copies of one another. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import store, textkernel

WEIGHTS = (5, 2, 1)
COPIES = 3
SEED = 17
#: Patterns with several sources that the network tells apart, the largest.
PATTERNS = 4096
#: Hash bins of a class, twice: the bin where the rest ends is split into as many again.
BINS = 1 << 12


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, copies: int = COPIES) -> dict[str | None, float]:
    """Shares of the whole size by weight (sources by code point, null last); none above ``copies`` times its size, the excess shared anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), list(names), {}
    while open_:
        total = sum(weigh[s] for s in open_)
        full = [s for s in open_ if left * weigh[s] / total > copies * sizes[s]]
        if not full:
            return out | {s: left * weigh[s] / total for s in open_}
        for s in full:
            out[s] = float(copies * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in full]
    return out


def min_cost_flow(arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost), the cheapest of the largest.

    Primal-dual: shortest distances give potentials, then blocking flows fill all paths of reduced cost 0 before distances are taken anew; so the
    rounds are as many as path costs that differ, not as paths.
    """
    to, cap, cost, at = [], [], [], defaultdict(list)
    for u, v, c, w in arcs:
        for a, b, x, y in ((u, v, c, w), (v, u, 0, -w)):
            at[a].append(len(to))
            to.append(b)
            cap.append(x)
            cost.append(y)
    height: dict[int, int] = defaultdict(int)
    while True:
        dist, heap = {source: 0}, [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for i in at[u]:
                if cap[i] and (n := d + cost[i] + height[u] - height[to[i]]) < dist.get(to[i], 1 << 60):
                    dist[to[i]] = n
                    heapq.heappush(heap, (n, to[i]))
        if sink not in dist:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        far = max(dist.values())
        for u in list(at):
            height[u] += dist.get(u, far)
        free = lambda i, u: cap[i] and cost[i] + height[u] - height[to[i]] == 0
        while True:
            # Steps from the source over free arcs, then one path after another over arcs that lead one step on.
            level, wave = {source: 0}, [source]
            while wave and sink not in level:
                wave = [level.setdefault(to[i], level[u] + 1) and to[i] for u in wave for i in at[u] if to[i] not in level and free(i, u)]
            if sink not in level:
                break
            tried: dict[int, int] = defaultdict(int)
            path: list[int] = []
            u = source
            while True:
                if u == sink:
                    much = min(cap[i] for i in path)
                    for i in path:
                        cap[i] -= much
                        cap[i ^ 1] += much
                    cut = next(k for k, i in enumerate(path) if not cap[i])
                    u, path = to[path[cut] ^ 1], path[:cut]
                    continue
                own = at[u]
                while tried[u] < len(own) and not (level.get(to[own[tried[u]]]) == level[u] + 1 and free(own[tried[u]], u)):
                    tried[u] += 1
                if tried[u] < len(own):
                    path.append(own[tried[u]])
                    u = to[path[-1]]
                elif path:
                    u = to[path.pop() ^ 1]
                    tried[u] += 1
                else:
                    break


Class = tuple[tuple, tuple]


def route(classes: dict[Class, int], distinct: dict[tuple, int], wanted: dict[str | None, float], copies: int = COPIES) -> dict[Class, int]:
    """Words that each class (pattern, own sources) gives. ``classes``: their sizes; ``distinct``: the words of each pattern's distinct texts."""
    by = lambda p: [(s is None, s or "") for s in p]
    names, patterns = sorted(wanted, key=lambda s: (s is None, s or "")), sorted(distinct, key=by)
    keys = sorted(classes, key=lambda c: (by(c[0]), by(c[1])))
    of_pattern = {p: 2 + i for i, p in enumerate(patterns)}
    of_class = {c: 2 + len(patterns) + i for i, c in enumerate(keys)}
    of_source = {s: 2 + len(patterns) + len(keys) + i for i, s in enumerate(names)}
    most: dict[tuple, int] = defaultdict(int)
    for c in keys:
        most[c[0]] += copies * classes[c]
    arcs = []
    for p in patterns:
        left, step, cost = most[p], distinct[p], 0
        while left > 0 and step > 0:
            arcs.append((0, of_pattern[p], min(step, left), cost))
            left, step, cost = left - step, step * (2 if cost else 1), cost + 1
    first = len(arcs)
    arcs += [(of_pattern[c[0]], of_class[c], copies * classes[c], 0) for c in keys]
    arcs += [(of_class[c], of_source[s], copies * classes[c], 0) for c in keys for s in c[1] if s in of_source]
    arcs += [(of_source[s], 1, round(wanted[s]), 0) for s in names]
    flow = min_cost_flow(arcs, 0, 1)
    return {c: flow[first + i] for i, c in enumerate(keys)}


def _sized(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the words of each text."""
    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.select(*keep).schema), "__size long"])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(textkernel.word_counts(batch.column(batch.num_columns - 1)))], names=[*keep, "__size"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def _names(sources: Column) -> Column:
    return F.when(sources.isNull() | (F.size(sources) < 1), F.array(F.lit(None).cast("string"))).otherwise(F.array_sort(F.array_distinct(sources)))


def _patterned(sized: DataFrame) -> tuple[DataFrame, dict[tuple, int]]:
    """``sized`` with the pattern of each row's text, and the words of every pattern's distinct texts."""
    mark, n = ["m1", "m2"], sized.count()
    texts = sized.groupBy(*mark, "own").agg(F.max("size").alias("size"), F.count("*").alias("rows")).groupBy(*mark).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("own")))).alias("pattern"), F.max("size").alias("size"), F.sum("rows").alias("rows"))
    texts = store.materialize(texts, "mix-texts")
    several = F.size("pattern") > 1
    largest = [r["pattern"] for r in texts.where(several).groupBy("pattern").agg(F.sum("size").alias("n")).orderBy(F.desc("n"), "pattern").limit(PATTERNS).collect()]
    spark = sized.sparkSession
    known = spark.createDataFrame([(p, True) for p in largest], T.StructType([T.StructField("pattern", T.ArrayType(T.StringType())), T.StructField("known", T.BooleanType())]))
    key = F.to_json(F.struct("pattern"))
    shared = texts.where(several).withColumn("__k", key).join(F.broadcast(known.withColumn("__k", key).select("__k")), "__k").select(*mark, "pattern", "rows")
    # Texts on more than a thousandth of all rows, fewer than a thousand, are broadcast; so no task of the join holds the rows of one of them.
    hot = shared.where(F.col("rows") * 1000 > n)
    rows = sized.join(F.broadcast(hot.select(*mark, F.col("pattern").alias("hot"))), mark, "left").withColumn("spread", F.when(F.col("hot").isNotNull(), F.xxhash64("uid")).otherwise(F.lit(0)))
    rest = shared.where(F.col("rows") * 1000 <= n).select(*mark, F.lit(0).cast("long").alias("spread"), F.col("pattern").alias("cold"))
    rows = rows.join(rest, [*mark, "spread"], "left").withColumn("pattern", F.coalesce("hot", "cold", "own")).drop("hot", "cold", "spread")
    rows = store.materialize(rows, "mix-rows")
    own = rows.groupBy(*mark, "pattern").agg(F.max("size").alias("size")).groupBy("pattern").agg(F.sum("size").alias("size"))
    distinct = {tuple(r["pattern"]): r["size"] for r in own.collect()}
    store.drop(texts)
    return rows, distinct


def mix(docs: DataFrame, sources: Column, weights: tuple[int, ...] = WEIGHTS, copies: int = COPIES, seed: int = SEED) -> tuple[DataFrame, dict, dict]:
    """doc_id, own, pattern, mark (xxhash64 of the text, null as empty), size and taken_copies of every document; the sources' sizes; their targets.

    ``docs``: doc_id, text, and what ``sources`` (an array of names: a document's own sources) needs.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "text", _names(sources).alias("own"), F.xxhash64(text).alias("m1"), F.xxhash64(text, F.lit(1)).alias("m2"))
    sized = _sized(rows, ["doc_id", "own", "m1", "m2"]).withColumnRenamed("__size", "size")
    sized = store.materialize(sized.withColumn("uid", F.monotonically_increasing_id()), "mix-sizes")
    planned, distinct = _patterned(sized)
    store.drop(sized)
    planned = planned.withColumn("h", F.xxhash64("own", "doc_id", "m1", F.lit(seed)))
    planned = planned.withColumn("bin", F.col("h").bitwiseAND(BINS - 1)).withColumn("sub", F.shiftrightunsigned("h", 12).bitwiseAND(BINS - 1))
    classes = {(tuple(r["pattern"]), tuple(r["own"])): r["size"] for r in planned.groupBy("pattern", "own").agg(F.sum("size").alias("size")).collect()}
    held: dict[str | None, int] = defaultdict(int)
    for (_, own), n in classes.items():
        for s in own:
            held[s] += n
    total = sum(classes.values())
    scale = total / max(1, sum(held.values()))
    wanted = targets({s: round(n * scale) for s, n in held.items()}, weights, copies) if any(len(c[1]) > 1 for c in classes) else targets(dict(held), weights, copies)
    gives = route(classes, distinct, wanted, copies)
    plan = [(list(c[0]), list(c[1]), i, gives[c] // n if n else 0, gives[c] % n if n else 0) for i, (c, n) in enumerate(sorted(classes.items(), key=lambda x: [[(s is None, s or "") for s in p] for p in x[0]]))]
    names = T.ArrayType(T.StringType())
    schema = T.StructType([T.StructField("pattern", names), T.StructField("own", names), T.StructField("pid", T.IntegerType()), T.StructField("whole", T.LongType()), T.StructField("rest", T.LongType())])
    # One row for each class: the classes are on the driver already.
    key = F.to_json(F.struct("pattern", "own"))
    planned = planned.withColumn("__k", key).join(F.broadcast(spark.createDataFrame(plan, schema).withColumn("__k", key).drop("pattern", "own")), "__k").drop("__k")
    placed = planned.join(F.broadcast(_cuts(planned)), "pid", "left")
    under = (F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & (F.col("sub") < F.col("cut_sub")))
    edge = (F.col("bin") == F.col("cut_bin")) & (F.col("sub") == F.col("cut_sub"))
    placed = placed.withColumn("extra", F.when(F.coalesce(under, F.lit(False)), 1).otherwise(0)).withColumn("edge", F.coalesce(edge, F.lit(False)))
    # The last bins hold 1 / BINS^2 of a class; there the documents that bring the sum nearest are taken in order.
    w = Window.partitionBy("pid").orderBy("h", F.col("doc_id").asc_nulls_first(), "size", "uid")
    at_edge = placed.where("edge").withColumn("upto", F.sum("size").over(w))
    at_edge = at_edge.withColumn("extra", F.when(F.col("upto") - F.col("size") / 2 <= F.col("cut_left"), 1).otherwise(0)).drop("upto")
    every = placed.where("not edge").unionByName(at_edge)
    return every.select("doc_id", "own", "pattern", F.col("m1").alias("mark"), "size", F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0).cast("long").alias("taken_copies")), dict(held), wanted


def _first_beyond(sums: DataFrame, at: str) -> DataFrame:
    """For each class the first place where the running sum of ``n`` exceeds ``left``, and what is left there."""
    running = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("pid").orderBy(at))).where("upto > left")
    return running.groupBy("pid").agg(F.min_by(F.struct(at, (F.col("left") - F.col("upto") + F.col("n")).alias("left")), at).alias("x")).select("pid", F.col(f"x.{at}").alias(f"cut_{at}"), F.col("x.left").alias("cut_left"))


def _cuts(planned: DataFrame) -> DataFrame:
    """For each class the bin and sub-bin where its rest ends, and the words still to take there: a row each, as many as classes."""
    first = _first_beyond(planned.groupBy("pid", "bin").agg(F.sum("size").alias("n"), F.max("rest").alias("left")), "bin")
    inside = planned.join(F.broadcast(first), "pid").where(F.col("bin") == F.col("cut_bin"))
    second = _first_beyond(inside.groupBy("pid", "sub").agg(F.sum("size").alias("n"), F.max("cut_left").alias("left")), "sub")
    return first.drop("cut_left").join(second, "pid")


def op6_mixing_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    mixed, held, wanted = mix(docs, F.array("source"))
    of = spark.createDataFrame([(s, held[s], wanted[s]) for s in held], "source string, source_size long, target double")
    rows = mixed.withColumn("source", F.col("own")[0]).alias("m")
    return rows.join(F.broadcast(of.alias("t")), F.col("m.source").eqNullSafe(F.col("t.source"))).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("taken_copies")).alias("taken"))
