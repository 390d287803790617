"""Hypothesis tests: each gathers its sufficient statistics in Spark and finishes on the driver.

Decisions keep the published conventions: reject iff p <= alpha for KS and Levene,
significant iff p < alpha for ANOVA, normal or random iff p > alpha.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import finite, numeric_columns, sample_exact
from .distributions import chi2_sf, f_sf, ks_p, normal_cdf, normal_ppf
from .order import cumulative, grouped_quantiles


def _one(spark: SparkSession, **values) -> DataFrame:
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    schema = ", ".join(f"{k} {kinds[type(v)] if v is not None else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema)


def stack_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All numeric values as rows (column, value), NULL and NaN left out."""
    columns = columns or numeric_columns(df)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).where(F.col("value").isNotNull() & ~F.isnan("value"))


def ks_statistic(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov D of ``value`` columns, with both sizes: (n1, n2, d)."""
    both = a.select("value", F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select("value", F.lit(0).alias("x"), F.lit(1).alias("y")))
    counts = both.groupBy("value").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    total = counts.agg(F.sum("x").alias("n1"), F.sum("y").alias("n2"))
    steps = cumulative(counts, "value", {"cx": "x", "cy": "y"}).crossJoin(F.broadcast(total))  # one row
    return steps.groupBy("n1", "n2").agg(F.max(F.abs(F.col("cx") / F.col("n1") - F.col("cy") / F.col("n2"))).alias("d"))


def ks_test(a: DataFrame, b: DataFrame, alpha: float = 0.05) -> DataFrame:
    row = ks_statistic(a, b).first()
    p = ks_p(row["d"], row["n1"], row["n2"])
    return _one(a.sparkSession, n1=row["n1"], n2=row["n2"], d=row["d"], p_value=p, rejected=p <= alpha)


def _f_from_groups(groups: DataFrame, by: list[str]) -> DataFrame:
    """F statistic of groups with n, s (sum) and q (sum of squares): rolled up by ``by``."""
    g = groups.where("n > 0")
    roll = g.groupBy(*by) if by else g.groupBy()
    t = roll.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    within = (F.col("q") - F.col("b")) / (F.col("n") - F.col("k"))
    return t.select(*by, F.col("k").cast("long").alias("k"), F.col("n").cast("long").alias("n"), (between / within).alias("statistic"))


def anova_f(df: DataFrame, value: str, group: str, by: list[str] | None = None) -> DataFrame:
    """One-way F of ``value`` over ``group``, for each ``by``: (by, k, n, statistic)."""
    by = by or []
    x = finite(value)
    g = df.where(x.isNotNull()).groupBy(*by, group).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    return _f_from_groups(g, by)


def with_f_p(stats: DataFrame, alpha: float, strict: bool) -> DataFrame:
    """Adds p_value and the decision to a small table of F statistics."""
    rows = [(*r, f_sf(r["statistic"], r["k"] - 1, r["n"] - r["k"]) if r["statistic"] is not None else None) for r in stats.collect()]
    decided = [(*r, None if r[-1] is None else (r[-1] < alpha if strict else r[-1] <= alpha)) for r in rows]
    kinds = ", ".join(f"{c} {t}" for c, t in stats.dtypes)
    return stats.sparkSession.createDataFrame(decided, f"{kinds}, p_value double, significant boolean")


def levene_w(df: DataFrame, value: str, group: str, center: str = "median", by: list[str] | None = None, trim: float = 0.05) -> DataFrame:
    """Levene's W on absolute deviations from each group's median, mean or trimmed mean."""
    by = by or []
    rows = df.where(finite(value).isNotNull()).select(*by, group, finite(value).alias("_x"))
    keys = [*by, group]
    if center == "median":
        centers = grouped_quantiles(rows, keys, "_x", [0.5]).select(*keys, F.col("q")[0].alias("_c"))
    elif center == "mean":
        centers = rows.groupBy(*keys).agg(F.avg("_x").alias("_c"))
    elif center == "trimmed":
        ends = grouped_quantiles(rows, keys, "_x", [trim, 1 - trim], "_e")
        near = rows.join(F.broadcast(ends), keys).where((F.col("_x") >= F.col("_e")[0]) & (F.col("_x") <= F.col("_e")[1]))
        centers = near.groupBy(*keys).agg(F.avg("_x").alias("_c"))
    else:
        raise ValueError("center is median, mean or trimmed")
    z = F.abs(F.col("_x") - F.col("_c"))
    g = rows.join(centers, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(z).alias("s"), F.sum(z * z).alias("q"))
    return _f_from_groups(g, by)


def dagostino_k2(df: DataFrame, column: str) -> DataFrame:
    """(n, z_skew, z_kurt, k2, p_value) of D'Agostino and Pearson, as expressions over one aggregate."""
    m = df.where(finite(column).isNotNull()).agg(F.count(column).cast("double").alias("n"), F.skewness(column).alias("g1"), (F.kurtosis(column) + 3).alias("b2"))
    n, g1, b2 = F.col("n"), F.col("g1"), F.col("b2")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta2 - 1))
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))
    mean, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - mean) / F.sqrt(var)
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + F.sqrt(1 + 4 / (s * s)))
    z2 = (1 - 2 / (9 * a) - F.cbrt((1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4))))) / F.sqrt(2 / (9 * a))
    out = m.select("n", z1.alias("z_skew"), z2.alias("z_kurt")).withColumn("k2", F.col("z_skew") ** 2 + F.col("z_kurt") ** 2)
    return out.withColumn("n", F.col("n").cast("long")).withColumn("p_value", F.exp(-F.col("k2") / 2))


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and p of Royston's 1995 algorithm for 3 to 5000 values."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return float("nan"), float("nan")
    m = np.array([normal_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, mm = 1 / math.sqrt(n), float(m @ m)
    a = m / math.sqrt(mm)
    if n > 3:
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, a[-1]], u)
        if n > 5:
            next_ = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, a[-2]], u)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * next_**2)
            a = m / math.sqrt(phi)
            a[-1], a[-2], a[0], a[1] = last, next_, -last, -next_
        else:
            a = m / math.sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * last**2))
            a[-1], a[0] = last, -last
    else:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    ln = math.log(n)
    if n <= 11:
        g = -2.273 + 0.459 * n
        y = -math.log(g - math.log(1 - w)) if g > math.log(1 - w) else math.inf
        mu, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y = math.log(1 - w) if w < 1 else -math.inf
        mu, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, 1 - normal_cdf((y - mu) / sd)


SHAPIRO_ROWS = 5000


def shapiro_test(df: DataFrame, column: str, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Shapiro-Wilk on at most 5000 hash-chosen values, as the test is defined for no more."""
    rows = sample_exact(df.where(finite(column).isNotNull()).select(*dict.fromkeys([*keys, column])), SHAPIRO_ROWS, keys).select(F.col(column).cast("double").alias("x")).collect()
    w, p = shapiro_wilk(np.array([r["x"] for r in rows]))
    return _one(df.sparkSession, n=len(rows), statistic=w, p_value=p, normal=bool(p > alpha))


def normality(df: DataFrame, columns: list[str] | None, keys: list[str], ignore: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """(column, test, n, p_value, normal) of each numeric column: Shapiro-Wilk below 5000 values, else D'Agostino; fewer than 3 values are left out."""
    names = [c for c in columns or numeric_columns(df) if c not in {*keys, *(ignore or [])}]
    counts = df.agg(*[F.count(finite(c)).alias(c) for c in names]).first() if names else {}
    rows = []
    for c in names:
        if counts[c] >= 3:
            small = counts[c] < SHAPIRO_ROWS
            p = (shapiro_test(df, c, keys) if small else dagostino_k2(df, c)).first()["p_value"]
            rows.append((c, "shapiro" if small else "dagostino", counts[c], p, p is not None and p > alpha))
    return df.sparkSession.createDataFrame(rows, "column string, test string, n long, p_value double, normal boolean")


def ks_by_channel(before: DataFrame, after: DataFrame) -> DataFrame:
    """(channel, n1, n2, d) of the samples of rasters before and after a change: rows (channel, value)."""
    out = None
    for c in sorted(r[0] for r in before.select("channel").distinct().collect()):
        one = ks_statistic(before.where(F.col("channel") == c).select("value"), after.where(F.col("channel") == c).select("value"))
        one = one.select(F.lit(c).cast("long").alias("channel"), "n1", "n2", "d")
        out = one if out is None else out.unionByName(one)
    return out


def mcar_patterns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(pattern, n, missing): rows by which columns are null, written 0 and 1 in column order."""
    pattern = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns])
    return df.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n")).withColumn("missing", (F.length("pattern") - F.length(F.replace("pattern", F.lit("1"), F.lit("")))).cast("long"))


def mcar_test(df: DataFrame, columns: list[str], alpha: float = 0.05, variant: str = "blocks") -> DataFrame:
    """Little's test of missing completely at random.

    ``blocks`` takes each pattern's block of the inverse covariance and leaves out complete
    patterns; ``little`` inverts each pattern's own block and counts all patterns.
    """
    spark, p = df.sparkSession, len(columns)
    x = [finite(c).alias(c) for c in columns]
    base = df.select(*x)
    pattern = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns])
    covs = base.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.covar_samp(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j], F.sum(sum(F.col(c).isNull().cast("int") for c in columns)).alias("nulls")).first()
    groups = base.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns]).collect()
    if not covs["nulls"]:
        return _one(spark, status="no missing values", d2=None, dof=None, p_value=None, mcar=None)
    cov = np.array([[covs[f"c_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)], dtype=float)
    mean = np.array([covs[f"m_{c}"] if covs[f"m_{c}"] is not None else 0.0 for c in columns])
    if np.linalg.det(cov) == 0:
        return _one(spark, status="singular covariance", d2=None, dof=None, p_value=None, mcar=None)
    inverse, d2, observed = np.linalg.pinv(cov), 0.0, 0
    for g in groups:
        seen = [i for i, c in enumerate(g["pattern"]) if c == "0"]
        if not seen or (variant == "blocks" and len(seen) == p):
            continue
        gap = np.array([g[columns[i]] for i in seen]) - mean[seen]
        part = inverse[np.ix_(seen, seen)] if variant == "blocks" else np.linalg.pinv(cov[np.ix_(seen, seen)])
        d2 += g["n"] * float(gap @ part @ gap)
        observed += len(seen)
    dof = max(1, observed - p)
    p_value = chi2_sf(d2, dof)
    return _one(spark, status="done", d2=d2, dof=dof, p_value=p_value, mcar=bool(p_value > alpha))
