"""Time series: a table is summed to one row a day and entity first, then windows run by entity.

Windows are always over (entity, time); a series without an entity is one small group
after its aggregation. Kernels that SQL cannot express run by entity in numpy.
"""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..core import require
from ..functions import kernels
from .outlier import IsolationForest

AGGREGATES = {"sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "median": F.median, "count": F.count, "first": F.first, "last": F.last, "std": F.stddev_samp}


def daily(df: DataFrame, time: str, value: str, entity: str | None = None, only: str | None = None, how: str = "sum") -> DataFrame:
    """(entity, d, y): a row a day; an unreadable time or missing value is left out, all-missing sums are 0."""
    require(df, time, value, *([entity] if entity else []))
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregate {how}")
    if only is not None and entity and only.lower() != "world":
        df = df.where(F.col(entity) == only)
    d = F.to_date(time)
    g = df.where(d.isNotNull()).groupBy(*([entity] if entity else []), d.alias("d")).agg(AGGREGATES[how](F.col(value).cast("double")).alias("y"))
    return g.withColumn("y", F.coalesce("y", F.lit(0.0))) if how == "sum" else g


def over(entity: str | None = None, time: str = "d") -> W:
    return (W.partitionBy(entity) if entity else W.partitionBy(F.lit(0))).orderBy(time)


def difference(w, y: str = "y", order: int = 1) -> Column:
    x = F.col(y) - F.lag(y).over(w)
    return x if order == 1 else F.col(y) - 2 * F.lag(y, 1).over(w) + F.lag(y, 2).over(w)


def new_counts(w, y: str = "y", keep_first: bool = True) -> Column:
    """Daily news of a cumulative series; corrections count as 0, and so does the first day if kept."""
    x = F.greatest(difference(w, y), F.lit(0.0))
    return F.coalesce(x, F.lit(0.0)) if keep_first else x


def log_offset(df: DataFrame, y: str) -> float:
    low = df.agg(F.min(y)).first()[0]
    return abs(low) + 1 if low is not None and low <= 0 else 0.0


#: Points of one series that the driver takes.
MOST_POINTS = 1_000_000


def _points(df: DataFrame) -> DataFrame:
    if df.limit(MOST_POINTS + 1).count() > MOST_POINTS:
        raise ValueError(f"a series has more than {MOST_POINTS} points: aggregate it first")
    return df


def transform_stationary(df: DataFrame, y: str, method: str, w) -> DataFrame:
    """Adds {y}_diff_1, {y}_diff_2, {y}_log or {y}_boxcox."""
    name = f"{y}_{method}"
    if method in ("diff_1", "diff_2"):
        return df.withColumn(name, difference(w, y, int(method[-1])))
    offset = log_offset(df, y)
    x = F.col(y) + F.lit(offset)
    if method == "log":
        return df.withColumn(name, F.log(x))
    if method == "boxcox":
        lam = kernels.boxcox_lambda(np.array([r[0] for r in _points(df.where(F.col(y).isNotNull()).select(x)).collect()]))
        return df.withColumn(name, F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / F.lit(lam))
    raise ValueError(f"unknown method {method}")


def rolling(w, y: str, days: int, stat: str = "mean") -> Column:
    """Trailing window that is shorter at the head; the deviation of one value is 0."""
    f = w.rowsBetween(-(days - 1), 0)
    return F.avg(y).over(f) if stat == "mean" else F.coalesce(F.stddev_samp(y).over(f), F.lit(0.0))


def lagged_rolling(w, y: str, days: int) -> dict[str, Column]:
    """Window over the days before today; the deviation needs two of them."""
    f = w.rowsBetween(-days, -1)
    n = F.count(y).over(f)
    return {f"roll_mean_{days}": F.avg(y).over(f), f"roll_std_{days}": F.when(n > 1, F.stddev_samp(y).over(f)), f"roll_min_{days}": F.min(y).over(f), f"roll_max_{days}": F.max(y).over(f)}


def filled(w, y: str) -> Column:
    """Missing values take the next value, those at the end the last."""
    ahead = F.first(y, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    return F.coalesce(ahead, F.last(y, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))


def position(df: DataFrame, w) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(w) - 1)


def temporal_split(df: DataFrame, w, ratio: float = 0.8) -> DataFrame:
    """Adds ``is_train``: the first floor(n * ratio) rows by time of each entity."""
    n = F.count("*").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return df.withColumn("is_train", F.row_number().over(w) <= F.floor(n * ratio))


def calendar(d: str = "d") -> dict[str, Column]:
    c = F.col(d)
    month, dow = F.month(c), F.weekday(c)
    turn = 2 * math.pi
    return {"year": F.year(c), "month": month, "day": F.day(c), "dow": dow, "doy": F.dayofyear(c), "week": F.weekofyear(c), "quarter": F.quarter(c), "is_month_start": (F.day(c) == 1).cast("int"), "is_month_end": (c == F.last_day(c)).cast("int"), "is_weekend": dow.isin(5, 6).cast("int"), "month_sin": F.sin(turn * month / 12), "month_cos": F.cos(turn * month / 12), "dow_sin": F.sin(turn * dow / 7), "dow_cos": F.cos(turn * dow / 7)}


def acf(df: DataFrame, w, y: str = "y", lags: int = 40) -> DataFrame:
    """(lag, acf, band): biased autocovariances over gamma_0 and Bartlett's half width, in one aggregate."""
    m = df.agg(F.avg(y)).first()[0] or 0.0
    c = df.withColumn("_c", F.col(y) - F.lit(m))
    lagged = c.select("_c", *[F.lag("_c", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)])
    one = lagged.agg(F.count("_c").alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("g"), *[F.sum(F.col("_c") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, lags + 1)])
    cells = [F.struct(F.lit(0).alias("lag"), F.lit(1.0).alias("acf"), F.col("n").alias("n"))] + [F.struct(F.lit(k).alias("lag"), F.coalesce(F.col(f"s{k}") / F.col("g"), F.lit(0.0)).alias("acf"), F.col("n").alias("n")) for k in range(1, lags + 1)]
    out = one.select(F.inline(F.array(*cells)))
    before = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf") ** 2)).over(W.orderBy("lag").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))  # a row a lag
    return out.withColumn("band", F.when(F.col("lag") == 0, 0.0).otherwise(1.959963984540054 * F.sqrt((1 + 2 * before) / F.col("n")))).drop("n")


def pacf(df: DataFrame, w, y: str = "y", lags: int = 40) -> DataFrame:
    """(lag, pacf, band) by Yule and Walker on the biased autocorrelations."""
    r = [x["acf"] for x in acf(df, w, y, lags).orderBy("lag").collect()]
    band = 1.96 / math.sqrt(max(1, df.count()))
    return df.sparkSession.createDataFrame([(k, float(v), band) for k, v in enumerate(kernels.pacf_from_acf(np.array(r)))], "lag long, pacf double, band double")


def lag_order(df: DataFrame, w, y: str = "y", most: int = 14, rule: str = "largest") -> int:
    """``largest``: the largest significant lag; ``run``: significant lags in a row from 1."""
    n = df.count()
    if n < 5:
        return 1
    p = [r for r in pacf(df, w, y, max(1, min(most, n // 2 - 1))).orderBy("lag").collect() if r["lag"] > 0]
    hit = [abs(r["pacf"]) > r["band"] for r in p]
    if rule == "largest":
        return max((i + 1 for i, h in enumerate(hit) if h), default=1)
    return max(1, next((i for i, h in enumerate(hit) if not h), len(hit)))


def centred_average(w, y: str, period: int) -> Column:
    """The classical trend filter, NULL at both edges."""
    h = period // 2
    f = w.rowsBetween(-h, h)
    if period % 2:
        return F.when(F.count(y).over(f) == period, F.avg(y).over(f))
    ends = F.lag(y, h).over(w) + F.lead(y, h).over(w)
    return F.when(F.count(y).over(f) == period + 1, (F.sum(y).over(f) - ends / 2) / period)


def decompose(df: DataFrame, period: int, y: str = "y", time: str = "d", entity: str | None = None, model: str = "additive") -> DataFrame:
    """trend, seasonal, resid, detrended and deseasonalized by windows and phase means.

    ``multiplicative`` works on y + 1 with ratios; its ``resid_additive`` is y - (trend * seasonal - 1).
    """
    w, keys = over(entity, time), ([entity] if entity else [])
    mult = model == "multiplicative"
    out = position(df, w).withColumn("_y", F.col(y) + (1 if mult else 0)).withColumn("trend", centred_average(w, "_y", period)).withColumn("phase", F.col("pos") % period)
    out = out.withColumn("detrended", F.col("_y") / F.col("trend") if mult else F.col("_y") - F.col("trend"))
    phase = out.groupBy(*keys, "phase").agg(F.avg("detrended").alias("_p"))
    mean = phase.groupBy(*keys).agg(F.avg("_p").alias("_m"))
    phase = phase.join(mean, keys) if keys else phase.crossJoin(mean)  # one row
    phase = phase.select(*keys, "phase", (F.col("_p") / F.col("_m") if mult else F.col("_p") - F.col("_m")).alias("seasonal"))
    out = out.join(F.broadcast(phase) if not keys else phase, [*keys, "phase"])  # period rows
    t, s = F.col("trend"), F.col("seasonal")
    out = out.withColumn("resid", F.col("_y") / (t * s) if mult else F.col("_y") - t - s).withColumn("deseasonalized", F.col("_y") / s if mult else F.col("_y") - s)
    if mult:
        out = out.withColumn("resid_additive", F.col(y) - (t * s - 1))
    return out.drop("_y", "phase")


def residual_ratio(decomposed: DataFrame, y: str = "y", resid: str = "resid", entity: str | None = None) -> DataFrame:
    """Population variance of the residual over that of the observed; 0 for a constant series."""
    g = decomposed.groupBy(*([entity] if entity else []))
    v = F.var_pop(y)
    return g.agg(F.when(v > 0, F.var_pop(resid) / v).otherwise(F.lit(0.0)).alias("rvr"))


def _by_entity(df: DataFrame, entity: str | None, run, schema: str) -> DataFrame:
    return df.groupBy(*([entity] if entity else [F.lit("all")])).applyInPandas(run, schema)


def stl(df: DataFrame, period: int, y: str = "y", time: str = "d", entity: str | None = None) -> DataFrame:
    """(entity, time, y, trend, seasonal, resid) by robust loess, one entity a group."""
    cols = [*([entity] if entity else []), time, y]
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time).reset_index(drop=True)
        pdf["trend"], pdf["seasonal"], pdf["resid"] = kernels.stl(pdf[y].to_numpy(dtype=float), period)
        return pdf

    return _by_entity(df.select(*cols), entity, run, ", ".join(f"{c} {kinds[c]}" for c in cols) + ", trend double, seasonal double, resid double")


def search_decomposition(df: DataFrame, y: str = "y", time: str = "d", periods: tuple[int, ...] = (7, 14, 30), models: tuple[str, ...] = ("additive", "multiplicative", "stl")) -> DataFrame:
    """(model, period, rvr) of all combinations; the least noisy comes first."""
    out = None
    for model in models:
        for p in periods:
            parts = stl(df, p, y, time) if model == "stl" else decompose(df, p, y, time, model=model)
            row = residual_ratio(parts, y, "resid_additive" if model == "multiplicative" else "resid").select(F.lit(model).alias("model"), F.lit(p).alias("period"), "rvr")
            out = row if out is None else out.unionByName(row)
    return out.orderBy("rvr", "model", "period")


_TESTS = {"adf": kernels.adf, "kpss": kernels.kpss, "pp": kernels.phillips_perron}


def stationarity(df: DataFrame, test: str, y: str = "y", time: str = "d", entity: str | None = None, alpha: float = 0.05) -> DataFrame:
    """(entity, test, n, statistic, p_value, lags, stationary): ADF and PP reject a unit root, KPSS keeps its null."""
    require(df, y, time)
    f = _TESTS[test]
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(time)[y].dropna().to_numpy(dtype=float)
        if len(x) < 10 or x.min() == x.max():
            row = [test, len(x), None, None, None, None]
        else:
            s, p, lags = f(x)
            row = [test, len(x), s, p, lags, bool(p >= alpha if test == "kpss" else p < alpha)]
        return pd.DataFrame([([pdf[entity].iloc[0]] if entity else []) + row], columns=([entity] if entity else []) + ["test", "n", "statistic", "p_value", "lags", "stationary"])

    cols = [*([entity] if entity else []), time, y]
    return _by_entity(df.select(*cols), entity, run, (f"{entity} {kinds[entity]}, " if entity else "") + "test string, n long, statistic double, p_value double, lags long, stationary boolean")


def granger_matrix(df: DataFrame, variables: list[str], time: str = "d", max_lag: int = 5, alpha: float = 0.05, stat: str = "ssr_chi2test") -> DataFrame:
    """(cause, effect, best_lag, p_value, significant) of every ordered pair, a pair a task."""
    rows = [tuple(r) for r in _points(df.select(time, *variables).dropna()).orderBy(time).collect()]
    data = {v: np.array([r[i + 1] for r in rows], dtype=float) for i, v in enumerate(variables)}
    spark = df.sparkSession
    pairs = spark.createDataFrame(list(permutations(variables, 2)), "cause string, effect string")
    if len(rows) <= max_lag + 1:
        return pairs.limit(0).selectExpr("cause", "effect", "0L AS best_lag", "0D AS p_value", "false AS significant")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for c, e in zip(pdf["cause"], pdf["effect"]):
            p = {k: kernels.granger(data[c], data[e], k)[stat] for k in range(1, max_lag + 1)}
            k = min(p, key=p.get)
            out.append((c, e, k, p[k], bool(p[k] < alpha)))
        return pd.DataFrame(out, columns=["cause", "effect", "best_lag", "p_value", "significant"])

    return pairs.groupBy("cause", "effect").applyInPandas(run, "cause string, effect string, best_lag long, p_value double, significant boolean")


def granger_forms(matrix: DataFrame, variables: list[str], value: str) -> DataFrame:
    """A matrix of causes (rows) by effects (columns) of p_value, best_lag or significant; the diagonal is NULL, or 0 for significant."""
    x = F.col(value).cast("int") if value == "significant" else F.col(value)
    named = matrix.select("cause", "effect", x.alias("x"))
    whole = matrix.sparkSession.createDataFrame([(v,) for v in variables], "cause string")
    cells = named.groupBy("cause").agg(*[F.max(F.when(F.col("effect") == v, F.col("x"))).alias(v) for v in variables])
    out = whole.join(cells, "cause", "left")
    return out.withColumns({v: F.coalesce(F.col(v), F.lit(0)) for v in variables}) if value == "significant" else out


def guarded(df: DataFrame, test: str, y: str, time: str = "d", alpha: float = 0.05) -> DataFrame:
    """``stationarity`` with a status instead of an error: ok, missing column, too short or constant."""
    missing = [c for c in (y, time) if c not in df.columns]
    if missing:
        rows = [(test, None, None, None, None, None, f"missing column {missing[0]}")]
        return df.sparkSession.createDataFrame(rows, "test string, n long, statistic double, p_value double, lags long, stationary boolean, status string")
    out = stationarity(df, test, y, time, alpha=alpha)
    return out.withColumn("status", F.when(F.col("statistic").isNotNull(), "ok").when(F.col("n") < 10, "too short").otherwise("constant"))


def flagged_by_feature(features: dict[str, DataFrame], methods: tuple[str, ...] = ("z-score", "iforest", "stl"), **settings) -> DataFrame:
    """(feature, method, n): flagged days of each series by each method, for a heat map."""
    out = None
    for name, df in features.items():
        for m in methods:
            one = anomalies(df, m, **settings).agg(F.lit(name).alias("feature"), F.lit(m).alias("method"), F.coalesce(F.sum(F.col("is_anomaly").cast("long")), F.lit(0)).alias("n"))
            out = one if out is None else out.unionByName(one)
    return out


def top_days(df: DataFrame, score: str = "score", k: int = 5, time: str = "d") -> DataFrame:
    """The k rows of the largest absolute score, with the name of the day."""
    return df.withColumn("day_name", F.date_format(time, "EEEE")).orderBy(F.desc(F.abs(score)), time).limit(k)


def significant_pairs(matrix: DataFrame) -> DataFrame:
    return matrix.where("significant").orderBy("p_value", "cause", "effect")


def causality_edges(matrix: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Edges with strength clip((alpha - p) / alpha, 0, 1) and whether the reverse edge exists."""
    e = matrix.where("significant").select("cause", "effect", "p_value", "best_lag")
    r = e.select(F.col("cause").alias("effect"), F.col("effect").alias("cause"), F.lit(True).alias("has_reverse"))
    strength = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(alpha) - F.col("p_value")) / F.lit(alpha)))
    return e.withColumn("strength", strength).join(r, ["cause", "effect"], "left").withColumn("has_reverse", F.coalesce("has_reverse", F.lit(False)))


def anomalies(df: DataFrame, method: str, window: int = 7, threshold: float = 3.0, contamination: float | None = 0.05, y: str = "y", time: str = "d", entity: str | None = None) -> DataFrame:
    """(entity, time, y, score, is_anomaly) by z-score of the deseasonalised series, isolation forest of lags, or STL residual fences."""
    if method not in ("z-score", "iforest", "stl"):
        raise ValueError(f"unknown method {method}")
    kinds = dict(df.dtypes)
    cols = [*([entity] if entity else []), time, y]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time).reset_index(drop=True)
        s = pdf[y].astype(float).bfill().ffill()
        x = s.to_numpy()
        if method == "iforest":
            lags = pd.concat([s.shift(i) for i in range(window)], axis=1).bfill().ffill().to_numpy()
            score = IsolationForest(lags).score(lags)
            limit = 0.5 if contamination is None else np.quantile(score, 1 - contamination)
            flag = score > limit
        elif len(x) < 2 * window:
            score, flag = np.zeros(len(x)), np.zeros(len(x), dtype=bool)
        else:
            _, season, resid = kernels.stl(x, window)
            if method == "z-score":
                v = x - season
                score = (v - v.mean()) / (v.std(ddof=1) + 1e-8)
                flag = np.abs(score) > threshold
            else:
                score = resid
                q1, q3 = np.quantile(resid, [0.25, 0.75])
                flag = (resid < q1 - 1.5 * (q3 - q1)) | (resid > q3 + 1.5 * (q3 - q1))
        return pdf.assign(score=score, is_anomaly=flag)

    return _by_entity(df.select(*cols), entity, run, ", ".join(f"{c} {kinds[c]}" for c in cols) + ", score double, is_anomaly boolean")


def overlap(df: DataFrame, flags: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows flagged by all methods, by each pair only, and by one method only."""
    total = sum(F.col(f).cast("int") for f in flags)
    out = [F.sum((total == len(flags)).cast("long")).alias("all_methods")]
    out += [F.sum((F.col(a) & F.col(b) & (total == 2)).cast("long")).alias(f"only_{a}_{b}") for i, a in enumerate(flags) for b in flags[i + 1 :]]
    out += [F.sum((F.col(a) & (total == 1)).cast("long")).alias(f"only_{a}") for a in flags]
    return df.groupBy(*(by or [])).agg(*out)


def feature_matrix(df: DataFrame, y: str = "y", time: str = "d", entity: str | None = None, lags: int = 7, windows: tuple[int, ...] = (3, 7, 14, 30), horizon: int = 1, use_calendar: bool = True, trend_period: int | None = 7) -> DataFrame:
    """Lags, lagged windows, calendar, yesterday's trend, and ``target`` h days ahead; rows complete in all."""
    w = over(entity, time)
    cols: dict[str, Column] = {f"lag_{k}": F.lag(y, k).over(w) for k in range(1, lags + 1)}
    for d in windows:
        cols |= lagged_rolling(w, y, d)
    if use_calendar:
        cols |= calendar(time)
    if trend_period:
        trailing = F.avg(y).over(w.rowsBetween(-trend_period, -1))
        cols |= {"trend_lag_1": trailing, "cycle_lag_1": F.lag(y, 1).over(w) - trailing}
    cols[f"target_t_plus_{horizon}"] = F.lead(y, horizon).over(w)
    return df.withColumns(cols).dropna()


def forecast(matrix: DataFrame, horizon: int = 1, y: str = "y", time: str = "d", ratio: float = 0.8, trees: int = 100, seed: int = 42, max_depth: int = 8, min_samples_leaf: int = 1, model_kwargs: dict | None = None, features: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Random-forest regression on the first share of the days: (scores, predictions of the rest)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    from .metrics import regression_scores

    target = f"target_t_plus_{horizon}"
    if features is None:
        features = [c for c, k in matrix.dtypes if c not in (target, time) and k in ("double", "int", "bigint", "float")]
    require(matrix, target, time, *features)
    data = temporal_split(matrix, over(None, time), ratio)
    data = VectorAssembler(inputCols=features, outputCol="features").transform(data).select(time, F.col(target).alias("label"), "features", "is_train")
    train, test = data.where("is_train"), data.where("not is_train")
    if train.isEmpty() or test.isEmpty():
        raise ValueError("both sides of the split need rows")
    settings = {"numTrees": trees, "maxDepth": max_depth, "minInstancesPerNode": min_samples_leaf, "seed": seed, **(model_kwargs or {})}
    predicted = RandomForestRegressor(**settings).fit(train).transform(test).select(time, "label", "prediction")
    return regression_scores(predicted, "label", "prediction"), predicted


def forecast_series(df: DataFrame, target: str, time: str, entity: str | None = None, entity_value: str | None = None, aggregation: str = "sum", horizon: int = 1, ratio: float = 0.8, max_lags: int = 40, windows: tuple[int, ...] = (3, 7, 14, 30), period: int = 7, seed: int = 42, trees: int = 300, max_depth: int | None = None, min_samples_leaf: int = 1, model_kwargs: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From a raw table to a forecast: (matrix, scores, predictions). Lags reach to the largest significant partial autocorrelation."""
    y = daily(df, time, target, entity, entity_value, aggregation)
    y = y.groupBy("d").agg(AGGREGATES[aggregation]("y").alias("y")) if entity else y
    lags = lag_order(y, over(), most=max_lags)
    matrix = feature_matrix(y, lags=lags, windows=windows, horizon=horizon, trend_period=period)
    scores, predicted = forecast(matrix, horizon, ratio=ratio, trees=trees, seed=seed, max_depth=30 if max_depth is None else max_depth, min_samples_leaf=min_samples_leaf, model_kwargs=model_kwargs)
    return matrix, scores, predicted
