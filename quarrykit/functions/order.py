"""Ranks, quantiles and cumulative sums over whole tables, without sending all rows to one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

#: Distinct values whose quantiles cut the order into ranges, and ranges at most.
CUT_SAMPLE, MOST_RANGES = 4096, 1024
#: Rows up to which exact percentiles are one aggregate, whose state holds the distinct values.
EXACT_ROWS = 2_000_000
#: Groups whose quantiles are found one by one.
MOST_GROUPS = 200


def cuts(df: DataFrame, order: str, ranges: int) -> list:
    """Values that cut distinct ``order`` values into about equal ranges: quantiles of a sample in hash order."""
    if ranges < 2:
        return []
    drawn = sorted(r[0] for r in df.where(F.col(order).isNotNull()).select(order).orderBy(F.xxhash64(order), order).limit(CUT_SAMPLE).collect())
    return sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []


def range_of(value: Column, bounds: list) -> Column:
    """The number of bounds up to a value, by a binary tree of comparisons: it depends on the value only."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value < F.lit(bounds[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(bounds))


def cumulative(df: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """``df`` (distinct ``order`` values) with running sums {new: column} in that order.

    Rows are dealt into ranges by fixed bounds, so that every use of the plan, and every
    task that runs again, deals them alike; each range is summed on its own and moved by
    the totals of the ranges before it, of which there are at most ``MOST_RANGES``.
    """
    n = min(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.withColumn("_range", range_of(F.col(order), cuts(df, order, n)))
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    moved = totals.select("_range", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = ranged.withColumns({k: F.sum(c).over(inside) for k, c in sums.items()}).join(F.broadcast(moved), "_range")  # a row a range
    return out.withColumns({k: F.col(k) + F.col(f"_b_{k}") for k in sums}).drop("_range", *[f"_b_{k}" for k in sums])


def average_ranks(df: DataFrame, value: str, rank: str) -> DataFrame:
    """``df`` with the mean rank of ``value`` among its non-null rows (ties share it), ranked over distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranks = cumulative(counts, "_v", {"_upto": "_n"}).select("_v", (F.col("_upto") - (F.col("_n") - 1) / 2).alias(rank))
    return df.join(ranks, F.col(value) == F.col("_v"), "left").drop("_v")


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """(value, cum_count, ecdf) of each distinct non-null value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("_n"))
    n = df.where(F.col(value).isNotNull()).agg(F.count("*").alias("_total"))
    out = cumulative(counts, "value", {"cum_count": "_n"}).crossJoin(F.broadcast(n))  # one row
    return out.select("value", "cum_count", (F.col("cum_count") / F.col("_total")).alias("ecdf"))


def quantiles(df: DataFrame, columns: dict[str, Column], probabilities: list[float]) -> dict[str, list[float] | None]:
    """Exact linear quantiles of each column's non-null values, in ascending order of probability; None without values.

    Small tables take one aggregate. In others values are counted, the running counts tell
    which values stand at the ranks wanted, and only those reach the driver.
    """
    if df.limit(EXACT_ROWS + 1).count() <= EXACT_ROWS:
        at = F.array(*[F.lit(float(p)) for p in probabilities])
        row = df.agg(*[F.percentile(x, at).alias(c) for c, x in columns.items()]).first()
        return {c: row[c] for c in columns}
    return {c: _at_ranks(df, x, probabilities) for c, x in columns.items()}


def grouped_quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float], name: str = "q") -> DataFrame:
    """(by, name): an array of exact quantiles of each group. Large tables of few groups are counted group by group as in ``quantiles``."""
    at = F.array(*[F.lit(float(p)) for p in probabilities])
    simple = df.groupBy(*by).agg(F.percentile(value, at).alias(name))
    if df.limit(EXACT_ROWS + 1).count() <= EXACT_ROWS:
        return simple
    groups = df.select(*by).distinct().limit(MOST_GROUPS + 1).collect()
    if len(groups) > MOST_GROUPS:
        return simple  # many groups: each holds a part of the values only
    rows = []
    for g in groups:
        own = F.lit(True)
        for c in by:
            own = own & F.col(c).eqNullSafe(F.lit(g[c]))
        rows.append((*g, _at_ranks(df.where(own), F.col(value), probabilities)))
    fields = [df.schema[c] for c in by] + [T.StructField(name, T.ArrayType(T.DoubleType()))]
    return df.sparkSession.createDataFrame(rows, T.StructType(fields))


def _at_ranks(df: DataFrame, x: Column, probabilities: list[float]) -> list[float] | None:
    counts = df.select(x.cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return None
    places = np.array(probabilities) * (total - 1)
    ranks = np.unique(np.concatenate([np.floor(places), np.ceil(places)]).astype(np.int64)).tolist()
    placed = cumulative(counts, "v", {"upto": "n"})
    # the number of wanted ranks below a count, told by the same tree of comparisons
    wanted = range_of(F.col("upto") - 1, ranks) > range_of(F.col("upto") - F.col("n") - 1, ranks)
    rows = sorted((r["upto"], r["v"]) for r in placed.where(wanted).select("v", "upto").collect())  # a row for a rank at most
    upto, values = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    low, high = (values[np.searchsorted(upto, f(places).astype(np.int64), side="right")] for f in (np.floor, np.ceil))
    part = places - np.floor(places)
    return [float(a if a == b else a + (b - a) * t) for a, b, t in zip(low, high, part)]


def median(df: DataFrame, columns: dict[str, Column]) -> dict[str, float | None]:
    return {c: v[0] if v else None for c, v in quantiles(df, columns, [0.5]).items()}


def codes_of(df: DataFrame, value: str) -> DataFrame:
    """(value, code): distinct non-null values numbered from 0 in their order."""
    distinct = df.where(F.col(value).isNotNull()).select(value).distinct().withColumn("_one", F.lit(1).cast("long"))
    return cumulative(distinct, value, {"_upto": "_one"}).select(value, (F.col("_upto") - 1).alias("code"))
