"""Profiles of tables: size and missing values, correlations, class counts, distributions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import numeric_columns
from ..functions.order import average_ranks, grouped_quantiles


def _rows(cells: list[Column]) -> Column:
    return F.inline(F.array(*cells))


def table_info(df: DataFrame, time_col: str | None = None) -> DataFrame:
    """n_rows, n_columns and the percentage of missing cells; with a time column its range."""
    nulls = sum(F.count("*") - F.count(c) for c in df.columns)
    extra = [F.min(time_col).alias("min_time"), F.max(time_col).alias("max_time")] if time_col else []
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"), (nulls / (F.count("*") * len(df.columns)) * 100).alias("missing_pct"), *extra)


def missing_by_column(df: DataFrame, severe: float = 40.0) -> DataFrame:
    """(column, n_missing, pct, level): level is severe, low or none."""
    one = df.agg(F.count("*").alias("_n"), *[(F.count("*") - F.count(c)).alias(c) for c in df.columns])
    out = one.select("_n", _rows([F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in df.columns]))
    pct = F.when(F.col("_n") > 0, F.col("n_missing") / F.col("_n") * 100).otherwise(F.lit(0.0))
    return out.withColumn("pct", pct).withColumn("level", F.when(F.col("pct") > severe, "severe").when(F.col("pct") > 0, "low").otherwise("none")).drop("_n")


def missing_by_row(df: DataFrame) -> DataFrame:
    """(max_missing, n_half): most missing cells of a row, and rows with more than half missing."""
    k = sum(F.col(c).isNull().cast("long") for c in df.columns)
    return df.agg(F.max(k).alias("max_missing"), F.sum((k > len(df.columns) / 2).cast("long")).alias("n_half"))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    full = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if full[c]])


def pair_correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col_a, col_b, r) of each unordered pair, rows complete in both: one aggregate."""
    pairs = list(combinations(columns or numeric_columns(df), 2))
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(_rows([F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)]))


def missing_correlations(df: DataFrame) -> DataFrame | None:
    """Correlations of the columns' missingness; None with fewer than two columns that miss values."""
    some = df.agg(*[(F.count("*") - F.count(c)).alias(c) for c in df.columns]).first()
    holes = [c for c in df.columns if some[c]]
    if len(holes) < 2:
        return None
    return pair_correlations(df.select(*[F.col(c).isNull().cast("int").alias(c) for c in holes]), holes)


def spearman(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pair correlations of average ranks. Columns with NULLs are ranked pair by pair on complete rows."""
    columns = columns or numeric_columns(df)
    holes = df.agg(*[(F.count("*") - F.count(c)).alias(c) for c in columns]).first()
    whole = [c for c in columns if not holes[c]]
    ranked = df.select(*columns)
    for c in whole:
        ranked = average_ranks(ranked, c, f"_r_{c}")
    out = None
    if len(whole) > 1:
        out = pair_correlations(ranked.select(*[F.col(f"_r_{c}").alias(c) for c in whole]), whole)
    for a, b in combinations(columns, 2):
        if holes[a] or holes[b]:
            both = df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
            one = average_ranks(average_ranks(both, a, "_ra"), b, "_rb").agg(F.corr("_ra", "_rb").alias("r")).select(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), "r")
            out = one if out is None else out.unionByName(one)
    return out


def strong_pairs(pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    return pairs.where(F.abs("r") >= threshold).orderBy(F.desc(F.abs("r")), "col_a", "col_b")


def weak_pairs(pairs: DataFrame, k: int = 5) -> DataFrame:
    return pairs.orderBy(F.abs("r").asc_nulls_last(), "col_a", "col_b").limit(k)


def class_counts(df: DataFrame, c: str) -> DataFrame:
    """(class, n, pct, ratio_to_smallest, imbalanced): imbalanced where the largest exceeds three times the smallest."""
    g = df.groupBy(F.col(c).alias("class")).agg(F.count("*").alias("n"))
    t = g.agg(F.sum("n").alias("_t"), F.min("n").alias("_lo"), F.max("n").alias("_hi"))
    j = g.crossJoin(F.broadcast(t))  # one row
    return j.select("class", "n", (F.col("n") / F.col("_t") * 100).alias("pct"), (F.col("n") / F.col("_lo")).alias("ratio"), (F.col("_hi") > 3 * F.col("_lo")).alias("imbalanced"))


def ratio_bands(counts: DataFrame) -> DataFrame:
    """``class_counts`` with the band of each class's ratio to the smallest: 1-9, 10-100 or >100."""
    r = F.col("ratio")
    return counts.withColumn("band", F.when(r < 10, "1-9").when(r <= 100, "10-100").otherwise(">100"))


def five_numbers(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, minimum, quartiles, maximum and outliers beyond 1.5 interquartile ranges of each group."""
    q = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max")).join(grouped_quantiles(df, by, value, [0.25, 0.5, 0.75]), by)
    q = q.select(*by, "n", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    out = df.join(F.broadcast(q), by).groupBy(*by).agg(F.sum(((F.col(value) < F.col("q1") - reach) | (F.col(value) > F.col("q3") + reach)).cast("long")).alias("n_outliers"))
    return q.join(out, by)


def histogram(df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, n, density) of the bins that hold values; the last bin includes its upper edge."""
    if low is None or high is None:
        low, high = df.agg(F.min(value), F.max(value)).first()
    width = (high - low) / bins or 1.0
    x = F.col(value).cast("double")
    at = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("long")
    g = df.where(x.isNotNull() & (x >= low) & (x <= high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    t = g.agg(F.sum("n").alias("_t"))
    return g.crossJoin(F.broadcast(t)).select("bin", "n", (F.col("n") / F.col("_t") / F.lit(width)).alias("density"))  # one row


def kde(df: DataFrame, value: str, points: int = 200, bins: int = 2000) -> DataFrame:
    """Gaussian density on a grid, with Scott's bandwidth, over a fine histogram of all values."""
    s = df.agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd"), F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    spark = df.sparkSession
    if not s["n"] or not s["sd"]:
        return spark.createDataFrame([], "x double, density double")
    h = s["sd"] * s["n"] ** -0.2
    low, high = s["lo"] - 3 * h, s["hi"] + 3 * h
    width = (s["hi"] - s["lo"]) / bins
    cells = histogram(df, value, bins, s["lo"], s["hi"]).select((F.lit(s["lo"]) + (F.col("bin") + 0.5) * width).alias("c"), "n")
    grid = spark.range(points).select((F.lit(low) + F.col("id") * ((high - low) / (points - 1))).alias("x"))
    z = (F.col("x") - F.col("c")) / h
    return F.broadcast(grid).crossJoin(cells).groupBy("x").agg((F.sum(F.col("n") * F.exp(-z * z / 2)) / (s["n"] * h * (2 * 3.141592653589793) ** 0.5)).alias("density"))
