"""Encoders of categorical columns, and the collinearity that they cause.

Missing categories are a category of their own, ``__MISSING__``. All columns and folds
of target encoding share one aggregate: sums over all folds less those of a row's own.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import broadcast_if_small, numeric_columns, require
from ..functions.order import codes_of, median

MISSING = "__MISSING__"
MOST_COLUMNS = 10_000


def category(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING))


def _mapped(df: DataFrame, c: str, mapping: DataFrame, columns: list[str], default: dict[str, Column]) -> DataFrame:
    """Left join of ``mapping(_cat, ...)`` on the category of ``c``; unseen ones take the defaults."""
    out = df.withColumn("_key", category(c)).join(broadcast_if_small(mapping.withColumnRenamed("_cat", "_key")), "_key", "left").drop("_key")
    return out.withColumns({k: F.coalesce(F.col(k), v) for k, v in default.items()}).select(*df.columns, *[k for k in columns if k not in df.columns])


def target_stats(df: DataFrame, c: str, y: str) -> DataFrame:
    require(df, c, y)
    return df.where(F.col(y).isNotNull()).groupBy(category(c).alias("_cat")).agg(F.sum(F.col(y).cast("double")).alias("_s"), F.count("*").alias("_n"))


def target_encode(df: DataFrame, columns: list[str], y: str, smoothing: float = 10.0, suffix: str = "_target", fitted_on: DataFrame | None = None) -> DataFrame:
    """(sum + mean * smoothing) / (n + smoothing) of all fitted rows; unseen categories take the mean."""
    fit = fitted_on if fitted_on is not None else df
    if smoothing < 0:
        raise ValueError("smoothing is not negative")
    mean = fit.agg(F.avg(y)).first()[0]
    if mean is None:  # no target at all: no value either
        return df.withColumns({f"{c}{suffix}": F.lit(None).cast("double") for c in columns})
    for c in columns:
        name = f"{c}{suffix}"
        mapping = target_stats(fit, c, y).select("_cat", ((F.col("_s") + F.lit(mean * smoothing)) / (F.col("_n") + F.lit(smoothing))).alias(name))
        df = _mapped(df, c, mapping, [name], {name: F.lit(mean)})
    return df


def target_encode_oof(df: DataFrame, columns: list[str], y: str, fold: Column, smoothing: float = 10.0, suffix: str = "_target") -> DataFrame:
    """Each row is encoded by the rows of the other folds only."""
    df = df.withColumn("_fold", fold)
    y_ = F.col(y).cast("double")
    totals = {r["_fold"]: (r["s"], r["n"]) for r in df.groupBy("_fold").agg(F.sum(y_).alias("s"), F.count(y_).alias("n")).collect()}
    s, n = sum(v[0] or 0.0 for v in totals.values()), sum(v[1] for v in totals.values())
    mean = F.lit(None).cast("double")
    for k, (fs, fn) in totals.items():
        mean = F.when(F.col("_fold") == k, F.lit((s - (fs or 0.0)) / (n - fn) if n > fn else None)).otherwise(mean)
    pairs = F.array(*[F.struct(F.lit(c).alias("_col"), category(c).alias("_cat")) for c in columns])
    own = df.where(y_.isNotNull()).select("_fold", y_.alias("_y"), F.inline(pairs)).groupBy("_col", "_cat", "_fold").agg(F.sum("_y").alias("_fs"), F.count("*").alias("_fn"))
    whole = own.groupBy("_col", "_cat").agg(F.sum("_fs").alias("_s"), F.sum("_fn").alias("_n"))
    names = df.columns
    for c in columns:
        w = whole.where(F.col("_col") == c).select(F.col("_cat").alias("_key"), "_s", "_n")
        o = own.where(F.col("_col") == c).select(F.col("_cat").alias("_key"), "_fold", "_fs", "_fn")
        j = df.withColumn("_key", category(c)).join(broadcast_if_small(w), "_key", "left").join(broadcast_if_small(o), ["_key", "_fold"], "left")
        rest_s, rest_n = F.coalesce("_s", F.lit(0.0)) - F.coalesce("_fs", F.lit(0.0)), F.coalesce("_n", F.lit(0)) - F.coalesce("_fn", F.lit(0))
        value = F.when(rest_n > 0, (rest_s + mean * smoothing) / (rest_n + smoothing)).otherwise(mean)
        names = [*names, f"{c}{suffix}"]
        df = j.withColumn(f"{c}{suffix}", value).select(*names)
    return df.drop("_fold")


def codes(df: DataFrame, c: str) -> list[str]:
    """Sorted categories of a column, ``MOST_COLUMNS`` at most, as each becomes a column."""
    found = [r[0] for r in df.select(category(c).alias("v")).distinct().limit(MOST_COLUMNS + 1).collect()]
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"{c} has more than {MOST_COLUMNS} categories")
    return sorted(found)


def ordinal_encode(df: DataFrame, columns: list[str], suffix: str = "_ord", fitted_on: DataFrame | None = None, unknown: int = -1) -> DataFrame:
    """Lexicographic codes from 0."""
    for c in columns:
        fit = fitted_on if fitted_on is not None else df
        mapping = codes_of(fit.select(category(c).alias("_cat")), "_cat").withColumnRenamed("code", f"{c}{suffix}")
        df = _mapped(df, c, mapping, [f"{c}{suffix}"], {f"{c}{suffix}": F.lit(unknown).cast("long")})
    return df


def binary_encode(df: DataFrame, columns: list[str], min_cardinality: int = 20, fitted_on: DataFrame | None = None) -> DataFrame:
    """Bits of codes 1..K for columns with more than ``min_cardinality`` categories; unseen ones are 0."""
    for c in columns:
        cats = (fitted_on if fitted_on is not None else df).select(category(c).alias("_cat"))
        n = cats.distinct().count()
        if n <= min_cardinality:
            continue
        bits = max(1, math.ceil(math.log2(n + 1)))
        mapping = codes_of(cats, "_cat").select("_cat", (F.col("code") + 1).cast("int").alias("_code"))
        keep = df.columns
        out = _mapped(df, c, mapping, ["_code"], {"_code": F.lit(0)})
        made = {f"{c}_bin_{i + 1}": F.shiftright("_code", bits - 1 - i).bitwiseAND(F.lit(1)) for i in range(bits)}
        df = out.withColumns(made).select(*[k for k in keep if k != c], *made)
    return df


def frequency_encode(df: DataFrame, columns: list[str], suffix: str = "_freq", fitted_on: DataFrame | None = None) -> DataFrame:
    fit = fitted_on if fitted_on is not None else df
    n = fit.count()
    for c in columns:
        mapping = fit.groupBy(category(c).alias("_cat")).agg((F.count("*") / F.lit(float(n))).alias(f"{c}{suffix}"))
        df = _mapped(df, c, mapping, [f"{c}{suffix}"], {f"{c}{suffix}": F.lit(0.0)})
    return df


def onehot_encode(df: DataFrame, columns: list[str], drop_first: bool = False, sep: str = "_", fitted_on: DataFrame | None = None) -> DataFrame:
    """A 0/1 column for each category, right after its source column."""
    fit = fitted_on if fitted_on is not None else df
    out: list[Column] = []
    for name in df.columns:
        out.append(F.col(name))
        if name in columns:
            out += [(category(name) == F.lit(v)).cast("int").alias(f"{name}{sep}{v}") for v in codes(fit, name)[int(drop_first) :]]
    return df.select(*out)


def group_rare(df: DataFrame, c: str, top: int, other: str = "__OTHER__", missing: str = "__NONE__") -> DataFrame:
    """Keeps the ``top`` most frequent categories (ties alphabetically)."""
    best = [r[0] for r in df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(top).collect()]
    return df.withColumn(c, F.when(F.col(c).isNull(), missing).when(F.col(c).isin(best), F.col(c)).otherwise(other))


def correlation_matrix(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, dict[str, float]]:
    """Pearson correlations and population variances by one aggregate."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    x = [F.col(c).cast("double") for c in columns]
    row = df.agg(*[F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i, j in pairs], *[F.var_pop(v).alias(f"v{i}") for i, v in enumerate(x)]).first()
    var = np.array([row[f"v{i}"] if row[f"v{i}"] is not None else np.nan for i in range(len(columns))])
    out = np.eye(len(columns))
    for i, j in pairs:
        scale = math.sqrt(var[i] * var[j])
        out[i, j] = out[j, i] = row[f"c{i}_{j}"] / scale if scale else np.nan
    return out, dict(zip(columns, var.tolist()))


def vif(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature, vif) sorted down: the diagonal of the inverse correlation matrix; infinite for constant or dependent columns."""
    columns = columns or numeric_columns(df)
    spark = df.sparkSession
    if len(columns) < 2:
        return spark.createDataFrame([], "feature string, vif double")
    x = {c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double")) for c in columns}
    holes = df.agg(*[(F.count("*") - F.count(x[c])).alias(c) for c in columns]).first()
    medians = median(df, {c: x[c] for c in columns if holes[c]}) if any(holes) else {}
    filled = df.select(*[F.coalesce(x[c], F.lit(medians.get(c)), F.lit(0.0)).alias(c) for c in columns])
    whole, variances = correlation_matrix(filled, columns)
    live = [c for c in columns if variances[c] and variances[c] > 1e-12]
    out = {c: math.inf for c in columns}
    if live:
        at = [columns.index(c) for c in live]
        r = np.nan_to_num(whole[np.ix_(at, at)])
        for i, c in enumerate(live):
            others = [j for j in range(len(live)) if j != i]
            r2 = float(r[i, others] @ np.linalg.pinv(r[np.ix_(others, others)]) @ r[others, i]) if others else 0.0
            out[c] = math.inf if r2 >= 1 - 1e-12 else 1 / (1 - r2)
    return spark.createDataFrame(sorted(out.items(), key=lambda t: (-t[1], t[0])), "feature string, vif double")


def compare(encoded: dict[str, DataFrame], threshold: float = 10.0) -> DataFrame:
    """Per encoder: features, largest and mean finite VIF, and how many reach the threshold (infinite ones count)."""
    out = None
    for name, df in encoded.items():
        v = vif(df)
        ok = F.when(F.col("vif") < float("inf"), F.col("vif"))
        row = v.agg(F.lit(name).alias("encoder"), F.count("*").alias("n_features"), F.max(ok).alias("max_vif"), F.avg(ok).alias("mean_vif"), F.sum((F.col("vif") >= threshold).cast("long")).alias("n_high"))
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("max_vif"), "encoder")


def explained_ratio(vif_table: DataFrame) -> DataFrame:
    return vif_table.withColumn("explained", F.when(F.col("vif") == float("inf"), 1.0).otherwise(1 - 1 / F.col("vif")))


def vif_summary(vif_table: DataFrame) -> DataFrame:
    """How many features there are, reach 5, reach 10 (infinite ones count) and are infinite."""
    v = F.col("vif")
    return vif_table.agg(F.count("*").alias("n_features"), *[F.coalesce(F.sum((v >= k).cast("long")), F.lit(0)).alias(f"n_{k}") for k in (5, 10)], F.coalesce(F.sum((v == float("inf")).cast("long")), F.lit(0)).alias("n_infinite"))
