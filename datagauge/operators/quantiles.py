"""Exact quantiles of columns of any number of distinct values, in a few passes and without a sort.

A quantile is one or two order statistics. Each of them has an open interval that holds it, at first everything. A pass asks a sketch for two values close
to the wanted rank on both sides, then counts how many values lie below, at, between and above them, exactly: the rank falls into one
of these, and the interval shrinks to a few ten-thousandths of its values. The sketch only makes this fast; whatever it answers, the counts decide. Once
an interval holds no more than ``MOST`` distinct values these are counted one by one. All columns and ranks share the passes; the
driver holds a few numbers for each, and ``MOST`` counts at a time. Ten passes reach any number of values that a table can have.

Nulls don't count; a column without values has null quantiles. NaN is the largest value, as Spark orders it. Quantiles lie between order statistics in proportion, as
``percentile`` has them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

#: Distinct values that are counted one by one.
MOST = 1 << 16
#: Of the sketch; its rank is off by no more than one part in so many.
ACCURACY = 10000


@dataclass
class _Rank:
    """The order statistic ``at`` (from 0) of a column: in the open interval (low, high), of which ``below`` values lie under and ``n`` within."""

    column: str
    at: int
    n: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def inside(self) -> Column:
        c = F.col(f"`{self.column}`")
        on = c.isNotNull()
        on = on if self.low is None else on & (c > self.low)
        return on if self.high is None else on & (c < self.high)


def _narrow(rows: DataFrame, ranks: list[_Rank]) -> None:
    """One pass: shrinks the interval of every rank, or finds its value."""
    wanted = []
    for i, r in enumerate(ranks):
        p, far = (r.at - r.below + 0.5) / r.n, 2.0 / ACCURACY
        wanted.append(F.percentile_approx(F.when(r.inside(), F.col(f"`{r.column}`")), F.array(F.lit(max(0.0, p - far)), F.lit(min(1.0, p + far))), ACCURACY).alias(f"q{i}"))
    marks = rows.agg(*wanted).collect()[0]
    counts = []
    for i, r in enumerate(ranks):
        (a, b), c = marks[f"q{i}"], F.col(f"`{r.column}`")
        within = r.inside()
        counts += [F.count_if(within & on).alias(f"c{i}_{k}") for k, on in enumerate((c < a, c == a, (c > a) & (c < b), (c == b) & F.lit(a < b or (b != b and a == a))))]
    found = rows.agg(*counts).collect()[0]
    for i, r in enumerate(ranks):
        a, b = marks[f"q{i}"]
        parts = [found[f"c{i}_{k}"] for k in range(4)]
        bounds = [(r.low, a, None), (a, a, a), (a, b, None), (b, b, b), (b, r.high, None)]
        for n, (low, high, value) in zip([*parts, r.n - sum(parts)], bounds, strict=True):
            if r.at < r.below + n:
                r.low, r.high, r.value, r.n = low, high, value, n
                break
            r.below += n


def _few(rows: DataFrame, ranks: list[_Rank], most: int) -> list[_Rank]:
    """The ranks whose interval holds no more than ``most`` distinct values, as an estimate has it."""
    found = rows.agg(*(F.approx_count_distinct(F.when(r.inside(), F.col(f"`{r.column}`"))).alias(f"d{i}") for i, r in enumerate(ranks))).collect()[0]
    return [r for i, r in enumerate(ranks) if r.n <= most or found[f"d{i}"] <= most]


def _count(rows: DataFrame, ranks: list[_Rank]) -> None:
    """Finds the values of ranks of one column and interval by counting the interval's distinct values."""
    name = f"`{ranks[0].column}`"
    counted = rows.where(ranks[0].inside()).groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n")).toArrow()
    values = sorted(zip(counted["v"].to_pylist(), counted["n"].to_pylist(), strict=True), key=lambda x: (x[0] != x[0], x[0]))
    for r in ranks:
        upto = r.below
        for value, n in values:
            upto += n
            if r.at < upto:
                r.value = value
                break


def quantiles(rows: DataFrame, columns: list[str], probs: tuple[float, ...], most: int = MOST) -> dict[str, list[float | None]]:
    """The exact quantiles ``probs`` of each of ``columns`` (numbers). ``rows`` is read once a pass: write or cache what is dear to compute."""
    rows = rows.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in columns))
    sizes = rows.agg(*(F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(columns))).collect()[0]
    places = {c: [p * (sizes[f"n{i}"] - 1) for p in probs] if sizes[f"n{i}"] else None for i, c in enumerate(columns)}
    n = {c: sizes[f"n{i}"] for i, c in enumerate(columns)}
    ranks = {(c, k): _Rank(c, k, n[c]) for c, at in places.items() if at for x in at for k in (math.floor(x), math.ceil(x))}
    open_ = list(ranks.values())
    while open_:
        ready = _few(rows, open_, most)
        same: dict[tuple, list[_Rank]] = {}
        for r in ready:
            same.setdefault((r.column, r.low, r.high), []).append(r)
        for group in same.values():
            _count(rows, group)
        open_ = [r for r in open_ if r.value is None]
        if open_:
            _narrow(rows, open_)
            open_ = [r for r in open_ if r.value is None]
    out: dict[str, list[float | None]] = {}
    for c, at in places.items():
        between = lambda x, c=c: ranks[c, math.floor(x)].value if x == math.floor(x) else (math.ceil(x) - x) * ranks[c, math.floor(x)].value + (x - math.floor(x)) * ranks[c, math.ceil(x)].value
        out[c] = [between(x) for x in at] if at else [None] * len(probs)
    return out


#: Columns of amounts, most of whose values are distinct.
AMOUNTS = {"orders": "o_totalprice", "lineitem": "l_extendedprice", "events": "value", "customer": "c_acctbal"}


def profile(rows: DataFrame, columns: list[str], most: int = MOST) -> DataFrame:
    """metric, n, mean, least, most, q1, median, q3 of each column."""
    found = quantiles(rows, columns, (0.25, 0.5, 0.75), most)
    spark = rows.sparkSession
    known = spark.createDataFrame([(c, *found[c]) for c in columns], "metric string, q1 double, median double, q3 double")
    one = rows.agg(*(F.struct(F.count(f"`{c}`").alias("n"), F.avg(f"`{c}`").alias("mean"), F.min(f"`{c}`").cast("double").alias("least"), F.max(f"`{c}`").cast("double").alias("most")).alias(f"m{i}") for i, c in enumerate(columns)))
    parts = one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), *(F.col(f"m{i}.{k}").alias(k) for k in ("n", "mean", "least", "most"))) for i, c in enumerate(columns)))))
    return parts.join(F.broadcast(known), "metric")


def outliers(rows: DataFrame, key: str, column: str, most: int = MOST) -> DataFrame:
    """key and value outside q1 - 1.5 iqr .. q3 + 1.5 iqr; none of fewer than four values or without a spread."""
    values = rows.select(key, F.col(f"`{column}`").cast("double").alias("value"))
    q1, q3 = quantiles(values, ["value"], (0.25, 0.75), most)["value"]
    if q1 is None or q1 == q3:
        return values.limit(0)
    far = (F.col("value") < q1 - 1.5 * (q3 - q1)) | (F.col("value") > q3 + 1.5 * (q3 - q1))
    return values.where(far & F.lit(values.where("value IS NOT NULL").limit(4).count() == 4))


def q_value_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of amounts."""
    out = None
    for name, column in AMOUNTS.items():
        one = profile(table(spark, sf_dir, name).select(F.col(column).alias(f"{name}.{column}")), [f"{name}.{column}"])
        out = one if out is None else out.unionByName(one)
    return out.select("metric", "n", *(F.round(c, 2).alias(c) for c in ("mean", "least", "most", "q1", "median", "q3")))


def q_value_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose value lies outside the fences of their quartiles, and orders by their total price."""
    rows = [outliers(table(spark, sf_dir, n), k, AMOUNTS[n]).select(F.lit(n).alias("rows_of"), F.col(k).cast("long").alias("id"), F.round("value", 2).alias("value")) for n, k in (("events", "event_id"), ("orders", "o_orderkey"))]
    return rows[0].unionByName(rows[1])


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}


def _fenced(name: str, key: str, column: str) -> str:
    return f"SELECT '{name}' rows_of, {key}::BIGINT id, round(v, 2) \"value\" FROM (SELECT {key}, \"{column}\"::DOUBLE v FROM {name}), (SELECT count(\"{column}\") n, quantile_cont(\"{column}\"::DOUBLE, 0.25) a, quantile_cont(\"{column}\"::DOUBLE, 0.75) b FROM {name}) WHERE n >= 4 AND a <> b AND (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a))"


ORACLE = {
    "value_profile": " UNION ALL ".join(
        f"SELECT '{t}.{c}' metric, count(\"{c}\") n, round(avg(\"{c}\"), 2) mean, round(min(\"{c}\")::DOUBLE, 2) least, round(max(\"{c}\")::DOUBLE, 2) most, " + ", ".join(f'round(quantile_cont("{c}"::DOUBLE, {p}), 2) {q}' for p, q in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))) + f" FROM {t}" for t, c in AMOUNTS.items()
    ),
    "value_outliers": _fenced("events", "event_id", "value") + " UNION ALL " + _fenced("orders", "o_orderkey", "o_totalprice"),
}
