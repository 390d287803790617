"""Queries over daily series: windows, decomposition, stationarity, anomalies, forecasting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import table
from ..operators import series
from .catalogue import register
from .table_queries import rounded

DAY = "WITH s AS (SELECT o_orderdate::date AS d, sum(o_totalprice) AS y FROM orders GROUP BY 1)\n"
ORDERED = "(ORDER BY d)"


def orders_daily(spark, sf):
    return series.daily(table(spark, sf, "orders").select("o_orderdate", "o_totalprice"), "o_orderdate", "o_totalprice")


def _nations(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows by definition
    return table(spark, sf, "orders").select("o_orderdate", "o_totalprice", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))


_NATIONS = "WITH s AS (SELECT n_name, o_orderdate::date AS d, sum(o_totalprice) AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)\n"


@register("region_daily_sum", _NATIONS + ", f AS (SELECT d, y FROM s WHERE n_name = (SELECT min(n_name) FROM nation)) SELECT d, round(y, 4) AS y, round(avg(y) OVER (ORDER BY d ROWS 6 PRECEDING), 4) AS ma7 FROM f")
def region_daily(spark, sf):
    first = table(spark, sf, "nation").agg(F.min("n_name")).first()[0]
    s = series.daily(_nations(spark, sf), "o_orderdate", "o_totalprice", entity="n_name", only=first).drop("n_name")
    return rounded(s.withColumn("ma7", series.rolling(series.over(), "y", 7)), "y", "ma7", digits=4)


@register("world_daily_sum", DAY + "SELECT d, round(y, 4) AS y, round(avg(y) OVER (ORDER BY d ROWS 6 PRECEDING), 4) AS ma7 FROM s")
def world_daily(spark, sf):
    return rounded(orders_daily(spark, sf).withColumn("ma7", series.rolling(series.over(), "y", 7)), "y", "ma7", digits=4)


@register("temporal_split_80_20", DAY + "SELECT d, row_number() OVER (ORDER BY d) <= floor(count(*) OVER () * 0.8::double) AS is_train FROM s")
def temporal_split(spark, sf):
    return series.temporal_split(orders_daily(spark, sf), series.over()).select("d", "is_train")


@register("series_info", DAY + "SELECT count(*)::bigint AS n_rows, min(d) AS min_time, max(d) AS max_time FROM s")
def series_info(spark, sf):
    return orders_daily(spark, sf).agg(F.count("*").alias("n_rows"), F.min("d").alias("min_time"), F.max("d").alias("max_time"))


@register("diff1", DAY + "SELECT d, round(y - lag(y) OVER (ORDER BY d), 2) AS y_diff_1 FROM s")
def diff1(spark, sf):
    return rounded(series.transform_stationary(orders_daily(spark, sf), "y", "diff_1", series.over()).select("d", "y_diff_1"), "y_diff_1", digits=2)


@register("diff2", DAY + "SELECT d, round(y - 2 * lag(y, 1) OVER (ORDER BY d) + lag(y, 2) OVER (ORDER BY d), 2) AS y_diff_2 FROM s")
def diff2(spark, sf):
    return rounded(series.transform_stationary(orders_daily(spark, sf), "y", "diff_2", series.over()).select("d", "y_diff_2"), "y_diff_2", digits=2)


@register("log_offset", DAY + "SELECT d, round(ln(y - 1e5 + (SELECT CASE WHEN min(y - 1e5) <= 0 THEN abs(min(y - 1e5)) + 1 ELSE 0 END FROM s)), 6) AS z_log FROM s")
def log_offset(spark, sf):
    df = orders_daily(spark, sf).withColumn("z", F.col("y") - 1e5)
    return rounded(series.transform_stationary(df, "z", "log", series.over()).select("d", "z_log"), "z_log")


@register("boxcox_transform")
def boxcox_transform(spark, sf):
    return series.transform_stationary(orders_daily(spark, sf), "y", "boxcox", series.over())


_EVENTS = "WITH s AS (SELECT event_type AS e, ts::date AS d, sum(value) AS y FROM events GROUP BY 1, 2)\n"


def _events(spark, sf):
    return series.daily(table(spark, sf, "events").select("ts", "value", F.col("event_type").alias("e")), "ts", "value", entity="e")


@register("new_counts_clip", _EVENTS + "SELECT e, d, round(greatest(coalesce(y - lag(y) OVER (PARTITION BY e ORDER BY d), 0), 0), 4) AS fresh FROM s")
def new_counts(spark, sf):
    w = series.over("e")
    return rounded(_events(spark, sf).withColumn("fresh", series.new_counts(w)).select("e", "d", "fresh"), "fresh", digits=4)


@register("new_counts_drop_first", _EVENTS + ", q AS (SELECT e, d, y - lag(y) OVER (PARTITION BY e ORDER BY d) AS x FROM s) SELECT e, d, round(greatest(x, 0), 4) AS fresh FROM q WHERE x IS NOT NULL")
def new_counts_drop(spark, sf):
    w = series.over("e")
    out = _events(spark, sf).withColumn("x", series.difference(w)).withColumn("fresh", series.new_counts(w, keep_first=False)).where("x is not null")
    return rounded(out.select("e", "d", "fresh"), "fresh", digits=4)


@register("rolling_mean_7_30_90", DAY + "SELECT d, " + ", ".join(f"round(avg(y) OVER (ORDER BY d ROWS {k - 1} PRECEDING), 4) AS mean_{k}" for k in (7, 30, 90)) + " FROM s")
def rolling_mean(spark, sf):
    w = series.over()
    cols = {f"mean_{k}": series.rolling(w, "y", k) for k in (7, 30, 90)}
    return rounded(orders_daily(spark, sf).withColumns(cols).select("d", *cols), *cols, digits=4)


@register("rolling_std_7_30_90", DAY + "SELECT d, " + ", ".join(f"round(coalesce(stddev_samp(y) OVER (ORDER BY d ROWS {k - 1} PRECEDING), 0), 0) AS std_{k}" for k in (7, 30, 90)) + " FROM s")
def rolling_std(spark, sf):
    w = series.over()
    cols = {f"std_{k}": series.rolling(w, "y", k, "std") for k in (7, 30, 90)}
    return rounded(orders_daily(spark, sf).withColumns(cols).select("d", *cols), *cols, digits=0)


def _lagged_sql(k):
    f = f"(ORDER BY d ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    return f"round(avg(y) OVER {f}, 4) AS roll_mean_{k}, round(CASE WHEN count(y) OVER {f} > 1 THEN stddev_samp(y) OVER {f} END, 0) AS roll_std_{k}, round(min(y) OVER {f}, 2) AS roll_min_{k}, round(max(y) OVER {f}, 2) AS roll_max_{k}"


@register("lagged_rolling", DAY + "SELECT d, " + ", ".join(map(_lagged_sql, (3, 7, 14, 30))) + " FROM s")
def lagged_rolling(spark, sf):
    cols = {}
    for k in (3, 7, 14, 30):
        cols |= series.lagged_rolling(series.over(), "y", k)
    out = orders_daily(spark, sf).withColumns(cols).select("d", *cols)
    for part, digits in (("mean", 4), ("std", 0), ("min", 2), ("max", 2)):
        out = rounded(out, *[c for c in cols if part in c], digits=digits)
    return out


@register("bfill_ffill", DAY + ", g AS (SELECT d, CASE WHEN dayofyear(d) % 3 = 0 THEN NULL ELSE y END AS y FROM s) SELECT d, round(coalesce(first_value(y IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(y IGNORE NULLS) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 2) AS y FROM g")
def bfill_ffill(spark, sf):
    df = orders_daily(spark, sf).withColumn("y", F.when(F.dayofyear("d") % 3 != 0, F.col("y")))
    return rounded(df.withColumn("y", series.filled(series.over(), "y")), "y", digits=2)


_ACF = DAY + ", c AS (SELECT row_number() OVER (ORDER BY d) AS i, y - avg(y) OVER () AS c FROM s), a AS (SELECT k, sum(x.c * z.c) / (SELECT sum(c * c) FROM c) AS acf FROM range(0, 41) t(k) JOIN c x ON true JOIN c z ON z.i = x.i - k GROUP BY k)\n"


@register("acf_40", _ACF + "SELECT k::bigint AS lag, round(acf, 6) AS acf, round(CASE WHEN k = 0 THEN 0 ELSE 1.959963984540054 * sqrt((1 + 2 * coalesce(sum(CASE WHEN k > 0 THEN acf * acf END) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (SELECT count(*) FROM s)) END, 6) AS band FROM a")
def acf_40(spark, sf):
    return rounded(series.acf(orders_daily(spark, sf), series.over()).withColumn("lag", F.col("lag").cast("long")), "acf", "band")


@register("pacf_40")
def pacf_40(spark, sf):
    return series.pacf(orders_daily(spark, sf), series.over())


@register("lag_order")
def lag_order(spark, sf):
    s, w = orders_daily(spark, sf), series.over()
    diffed = s.withColumn("y", series.difference(w)).where("y is not null")
    return spark.createDataFrame([("largest", series.lag_order(s, w)), ("run", series.lag_order(diffed, w, rule="run"))], "rule string, lag_order long")


def _classical(mult, p=7):
    y = "y + 1" if mult else "y"
    h = p // 2
    op = "/" if mult else "-"
    resid = "y1 / (trend * seasonal)" if mult else "y1 - trend - seasonal"
    return DAY + f""", n AS (SELECT d, y, {y} AS y1, row_number() OVER (ORDER BY d) - 1 AS pos FROM s),
t AS (SELECT *, CASE WHEN count(y1) OVER w = {p} THEN avg(y1) OVER w END AS trend FROM n WINDOW w AS (ORDER BY d ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)),
p AS (SELECT pos % {p} AS ph, avg(y1 {op} trend) AS m FROM t GROUP BY 1), q AS (SELECT ph, m {op} (SELECT avg(m) FROM p) AS seasonal FROM p),
r AS (SELECT d, y, y1, trend, seasonal, {resid} AS resid FROM t JOIN q ON ph = pos % {p})
"""


@register("decompose_additive_7", _classical(False) + "SELECT d, round(trend, 2) AS trend, round(seasonal, 2) AS seasonal, round(resid, 2) AS resid FROM r")
def decompose_additive(spark, sf):
    out = series.decompose(orders_daily(spark, sf), 7).select("d", "trend", "seasonal", "resid")
    return rounded(out, "trend", "seasonal", "resid", digits=2)


@register("decompose_multiplicative_7", _classical(True) + "SELECT d, round(trend, 2) AS trend, round(seasonal, 6) AS seasonal, round(resid, 6) AS resid FROM r")
def decompose_multiplicative(spark, sf):
    out = series.decompose(orders_daily(spark, sf), 7, model="multiplicative").select("d", "trend", "seasonal", "resid")
    return rounded(rounded(out, "trend", digits=2), "seasonal", "resid")


@register("residual_variance_ratio", _classical(False) + "SELECT round(var_pop(resid) / var_pop(y), 6) AS rvr FROM r")
def rvr(spark, sf):
    return rounded(series.residual_ratio(series.decompose(orders_daily(spark, sf), 7)), "rvr")


@register("rvr_search")
def rvr_search(spark, sf):
    return series.search_decomposition(orders_daily(spark, sf))


def _priority(spark, sf):
    return series.daily(table(spark, sf, "orders").select("o_orderdate", "o_totalprice", "o_orderpriority"), "o_orderdate", "o_totalprice", entity="o_orderpriority")


@register("stl_7")
def stl_7(spark, sf):
    return series.stl(_priority(spark, sf), 7, entity="o_orderpriority")


def _anomaly(name, method):
    @register(name)
    def query(spark, sf):
        return series.anomalies(_priority(spark, sf), method, entity="o_orderpriority").where("is_anomaly")

    return query


_anomaly("ts_outlier_z", "z-score")
_anomaly("ts_outlier_iforest", "iforest")
_anomaly("ts_outlier_stl", "stl")


@register("ts_overlap")
def ts_overlap(spark, sf):
    s, out = _priority(spark, sf), None
    for name, method in (("z", "z-score"), ("forest", "iforest"), ("stl", "stl")):
        one = series.anomalies(s, method, entity="o_orderpriority").select("o_orderpriority", "d", F.col("is_anomaly").alias(name))
        out = one if out is None else out.join(one, ["o_orderpriority", "d"])
    return series.overlap(out, ["z", "forest", "stl"], ["o_orderpriority"])


@register("ts_window_tuning")
def ts_windows(spark, sf):
    s, out = _priority(spark, sf), None
    for k in (3, 7, 14, 30):
        one = series.anomalies(s, "z-score", window=k, entity="o_orderpriority").groupBy("o_orderpriority").agg(F.sum(F.col("is_anomaly").cast("long")).alias("n")).select("o_orderpriority", F.lit(k).alias("window"), "n")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("o_orderpriority").pivot("window", [3, 7, 14, 30]).agg(F.first("n"))


@register("ts_top5_days")
def ts_top5(spark, sf):
    a = series.anomalies(_priority(spark, sf), "z-score", entity="o_orderpriority")
    return a.orderBy(F.desc(F.abs("score")), "d", "o_orderpriority").limit(5).select("o_orderpriority", "d", F.date_format("d", "EEEE").alias("day_name"), "y", "score")


@register("calendar_features", DAY + "SELECT d, year(d)::bigint AS year, month(d)::bigint AS month, day(d)::bigint AS day, (isodow(d) - 1)::bigint AS dow, dayofyear(d)::bigint AS doy, weekofyear(d)::bigint AS week, quarter(d)::bigint AS quarter, (day(d) = 1)::int::bigint AS is_month_start, (d = last_day(d))::int::bigint AS is_month_end, (isodow(d) >= 6)::int::bigint AS is_weekend, round(sin(2 * pi() * month(d) / 12), 6) AS month_sin, round(cos(2 * pi() * month(d) / 12), 6) AS month_cos, round(sin(2 * pi() * (isodow(d) - 1) / 7), 6) AS dow_sin, round(cos(2 * pi() * (isodow(d) - 1) / 7), 6) AS dow_cos FROM s")
def calendar(spark, sf):
    c = series.calendar("d")
    out = orders_daily(spark, sf).withColumns(c).select("d", *c)
    whole = [k for k, t in out.dtypes if t == "int"]
    return rounded(out.withColumns({k: F.col(k).cast("long") for k in whole}), "month_sin", "month_cos", "dow_sin", "dow_cos")


@register("feature_matrix", DAY + ", f AS (SELECT d, y, lag(y, 1) OVER w AS lag_1, lag(y, 7) OVER w AS lag_7, avg(y) OVER (ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS roll_mean_30, lead(y, 1) OVER w AS target FROM s WINDOW w AS (ORDER BY d)) SELECT d, round(lag_1, 2) AS lag_1, round(lag_7, 2) AS lag_7, round(roll_mean_30, 4) AS roll_mean_30, round(target, 2) AS target_t_plus_1 FROM f WHERE lag_7 IS NOT NULL AND target IS NOT NULL")
def feature_matrix(spark, sf):
    m = series.feature_matrix(orders_daily(spark, sf))
    return rounded(rounded(m.select("d", "lag_1", "lag_7", "roll_mean_30", "target_t_plus_1"), "lag_1", "lag_7", "target_t_plus_1", digits=2), "roll_mean_30", digits=4)


@register("rf_forecast")
def rf_forecast(spark, sf):
    return series.forecast(series.feature_matrix(orders_daily(spark, sf)), trees=20)[0]


def _stationary(name, test):
    @register(name)
    def query(spark, sf):
        s = orders_daily(spark, sf)
        raw = series.stationarity(s, test).withColumn("series", F.lit("raw"))
        diffed = s.withColumn("y", series.difference(series.over()))
        return raw.unionByName(series.stationarity(diffed, test).withColumn("series", F.lit("diff_1")))

    return query


_stationary("adf", "adf")
_stationary("kpss", "kpss")
_stationary("pp", "pp")


def _event_variables(spark, sf):
    e = table(spark, sf, "events").where(F.col("ts").isNotNull())
    return e.groupBy(F.to_date("ts").alias("d")).agg(F.sum("value").alias("total"), F.count("*").cast("double").alias("n"), F.max("value").alias("top"))


@register("granger_pairs")
def granger_pairs(spark, sf):
    return series.granger_matrix(_event_variables(spark, sf), ["total", "n", "top"], max_lag=3)


@register("granger_edges")
def granger_edges(spark, sf):
    return series.causality_edges(series.granger_matrix(_event_variables(spark, sf), ["total", "n", "top"], max_lag=3, alpha=0.5), alpha=0.5)
