"""Queries of experiments and dispatchers, which train models or draw samples: held against plain versions in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import table
from ..functions import hypothesis
from ..operators import images, select, series
from .catalogue import register
from .image_queries import bytes_of
from .series_queries import _event_variables, orders_daily
from .table_queries import _DIMS, _vectors


def _parts(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", (F.col("p_type") == "STANDARD").cast("int").alias("y"), F.col("p_size").cast("double").alias("p_size"), "p_retailprice", F.length("p_name").cast("double").alias("name_length"), (F.col("p_partkey") % 97).cast("double").alias("k"))


_PART_FEATURES = ["p_size", "p_retailprice", "name_length", "k"]


@register("select_k_sweep")
def k_sweep(spark, sf):
    return select.k_sweep(_parts(spark, sf), _PART_FEATURES, "y", ["p_partkey"], folds=3, trees=10)


@register("select_best_k")
def best_k(spark, sf):
    return select.best_k(select.k_sweep(_parts(spark, sf), _PART_FEATURES, "y", ["p_partkey"], methods=("anova", "mi"), folds=3, trees=10))


@register("img_resize_ablation")
def resize_ablation(spark, sf):
    return images.resize_ablation(bytes_of(spark, sf), "vec_id", "label")


@register("img_normalization_curves")
def normalization_curves(spark, sf):
    return images.normalization_curves(bytes_of(spark, sf), "vec_id", "label")


@register("img_normalization_scores")
def normalization_scores(spark, sf):
    return images.normalization_scores(images.normalization_curves(bytes_of(spark, sf), "vec_id", "label"))


@register("img_feature_space")
def feature_space(spark, sf):
    return select.feature_space(_vectors(spark, sf), "vec_id", _DIMS, "label")[2]


@register("normality_columns")
def normality_columns(spark, sf):
    return hypothesis.normality(table(spark, sf, "orders"), None, ["o_orderkey"], ignore=["o_custkey"])


_VARIABLES = ["total", "n", "top"]


@register("granger_p_matrix")
def granger_p_matrix(spark, sf):
    return series.granger_forms(series.granger_matrix(_event_variables(spark, sf), _VARIABLES, max_lag=3), _VARIABLES, "p_value")


@register("granger_lag_matrix")
def granger_lag_matrix(spark, sf):
    return series.granger_forms(series.granger_matrix(_event_variables(spark, sf), _VARIABLES, max_lag=3), _VARIABLES, "best_lag")


@register("granger_binary_matrix")
def granger_binary_matrix(spark, sf):
    return series.granger_forms(series.granger_matrix(_event_variables(spark, sf), _VARIABLES, max_lag=3), _VARIABLES, "significant")


@register("stationarity_guard")
def stationarity_guard(spark, sf):
    s = orders_daily(spark, sf)
    return series.guarded(s, "adf", "y").unionByName(series.guarded(s, "kpss", "absent")).unionByName(series.guarded(s.withColumn("y", F.lit(1.0)), "pp", "y"))


@register("ts_flag_heatmap")
def ts_flag_heatmap(spark, sf):
    v = _event_variables(spark, sf)
    return series.flagged_by_feature({c: v.select("d", F.col(c).alias("y")) for c in _VARIABLES})


@register("forecast_series")
def forecast_series(spark, sf):
    return series.forecast_series(table(spark, sf, "orders"), "o_totalprice", "o_orderdate", max_lags=14, trees=20, max_depth=8)[1]
