"""Queries that return the relations behind plots, and the streaming twins over a bounded stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..core import table
from ..operators import outlier, profile, series
from ..streaming import daily
from . import frames
from .catalogue import register
from .image_queries import HASHED, bytes_of
from .series_queries import DAY, orders_daily
from .table_queries import NUMBERS, lines, rounded


@register("viz_class_distribution", "WITH g AS (SELECT label AS class, count(*)::bigint AS n FROM embeddings GROUP BY 1) SELECT class, n, round(n * 100.0::double / (SELECT sum(n) FROM g), 6) AS pct, n = (SELECT max(n) FROM g) AS is_max, n = (SELECT min(n) FROM g) AS is_min FROM g")
def class_distribution(spark, sf):
    return rounded(frames.class_distribution_frame(table(spark, sf, "embeddings"), "label").select("class", "n", "pct", "is_max", "is_min"), "pct")


@register("viz_heatmap", "WITH li AS (SELECT l_quantity, l_extendedprice, l_discount FROM lineitem) SELECT 'l_quantity' AS row, 'l_extendedprice' AS col, round(corr(l_quantity, l_extendedprice), 6) AS r FROM li UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM li UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM li")
def heatmap(spark, sf):
    return rounded(frames.heatmap_frame(profile.pair_correlations(lines(spark, sf).select(*NUMBERS[:3]), NUMBERS[:3])), "r")


@register("viz_decomposition", DAY + "SELECT 'observed' AS part, count(y)::bigint AS n, round(sum(y), 2) AS total FROM s")
def decomposition(spark, sf):
    f = frames.decomposition_frame(series.decompose(orders_daily(spark, sf), 7)).where("part = 'observed'")
    return rounded(f.groupBy("part").agg(F.count("value").alias("n"), F.sum("value").alias("total")), "total", digits=2)


@register("viz_ecdf_gap", "WITH v AS (SELECT DISTINCT l_quantity AS value FROM lineitem WHERE l_returnflag IN ('A', 'R')), a AS (SELECT l_quantity AS q FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT l_quantity AS q FROM lineitem WHERE l_returnflag = 'R') SELECT value, round((SELECT count(*) FROM a WHERE q <= value)::double / (SELECT count(*) FROM a), 6) AS ecdf_a, round((SELECT count(*) FROM r WHERE q <= value)::double / (SELECT count(*) FROM r), 6) AS ecdf_b FROM v")
def ecdf_gap(spark, sf):
    one = lambda flag: table(spark, sf, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_quantity").alias("value"))
    return rounded(frames.ks_frame(one("A"), one("R")).drop("gap"), "ecdf_a", "ecdf_b")


@register("viz_hash_flags", HASHED + "SELECT sum((d <= 18)::int)::bigint AS n_duplicates FROM (SELECT list_sum(list_transform(range(1, 65), lambda i: (x.b[i] <> y.b[i])::int)) AS d FROM h x JOIN h y ON x.vec_id < y.vec_id)")
def hash_flags(spark, sf):
    from ..operators import images

    h = table(spark, sf, "embeddings").select("vec_id", images.sign_hash(F.transform("embedding", lambda v: v.cast("double"))).alias("h"))
    return frames.phash_frame(images.hamming_pairs(h, "vec_id", "h", 20), 18).agg(F.sum(F.col("is_duplicate").cast("long")).alias("n_duplicates"))


@register("viz_column_distribution")
def column_distribution(spark, sf):
    return frames.column_distribution_frame(table(spark, sf, "events"), "value")


@register("viz_density_by_class")
def density_by_class(spark, sf):
    return frames.density_frame(table(spark, sf, "events"), "value", "event_type")


@register("viz_pixel_histogram")
def pixel_histogram(spark, sf):
    return frames.histogram_frame(bytes_of(spark, sf), ["vec_id"])


@register("viz_normalization")
def normalization(spark, sf):
    return frames.normalization_frame(bytes_of(spark, sf))


@register("viz_violin")
def violin(spark, sf):
    e = table(spark, sf, "events")
    return frames.violin_frame(e, e.where(~outlier.iqr_mask(outlier.fit_iqr(e, ["value"]))), "value", ["event_id"])


@register("viz_anomalies")
def anomalies(spark, sf):
    return frames.anomaly_frame(orders_daily(spark, sf))


@register("viz_ssim_curve")
def ssim_curve(spark, sf):
    return frames.ssim_frame(bytes_of(spark, sf))


@register("viz_pca_scatter")
def pca_scatter(spark, sf):
    e = table(spark, sf, "embeddings")
    return frames.component_frame(e.select("label", *[F.element_at("embedding", i + 1).cast("double").alias(f"d{i}") for i in range(64)]), [f"d{i}" for i in range(64)], "label", 3)


def _stream(spark, sf):
    return spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")


@register("stream_running_moments", "SELECT event_type, count(value)::bigint AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd_pop FROM events GROUP BY 1")
def running_moments(spark, sf):
    return rounded(daily.run_to_table(daily.running_moments(_stream(spark, sf), "value", "event_type"), f"moments_{uuid.uuid4().hex}", "complete"), "mean", "sd_pop")


@register("stream_daily_sum", "SELECT event_type, ts::date AS d, round(sum(value), 4) AS y, count(*)::bigint AS n FROM events GROUP BY 1, 2")
def daily_sum(spark, sf):
    return rounded(daily.run_to_table(daily.daily_stream(_stream(spark, sf), "ts", "value", "event_type"), f"daily_{uuid.uuid4().hex}", "complete"), "y", digits=4)


@register("stream_outlier_flags", "SELECT count(*)::bigint AS n_rows, sum((abs((value - m) / s) > 3)::int)::bigint AS n_outliers FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)")
def outlier_flags(spark, sf):
    fit = outlier.fit_zscore(table(spark, sf, "events"), ["value"])
    out = daily.run_to_table(daily.flag_stream(_stream(spark, sf), fit), f"flags_{uuid.uuid4().hex}")
    return out.agg(F.count("*").alias("n_rows"), F.sum(F.col("is_outlier").cast("long")).alias("n_outliers"))
