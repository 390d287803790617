"""Queries of single relational operators: projections, joins by key, strings, maps, formats, sorts, chosen aggregates, masks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..core import aligned, categorical_columns, numeric_columns, side_by_side, table
from ..functions import hypothesis
from ..operators import encode, images, outlier, profile, select, series
from .catalogue import register
from .image_queries import BYTES, bytes_of
from .series_queries import DAY, orders_daily
from .table_queries import _FEATURES, _FLAGS, LINES, _flags, lines, rounded

_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("numeric_projection", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c})::bigint AS n, round(sum({c})::double, 2) AS total FROM lineitem" for c in _NUMERIC))
def numeric_projection(spark, sf):
    df = table(spark, sf, "lineitem")
    df = df.select(*numeric_columns(df))
    one = df.agg(*[x for c in df.columns for x in (F.count(c).alias(f"n_{c}"), F.sum(F.col(c).cast("double")).alias(f"s_{c}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n"), F.round(f"s_{c}", 2).alias("total")) for c in df.columns])))


@register("categorical_projection", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c})::bigint AS n_distinct, min({c}) AS first, max({c}) AS last FROM orders" for c in ("o_orderstatus", "o_orderpriority")))
def categorical_projection(spark, sf):
    df = table(spark, sf, "orders")
    df = df.select(*categorical_columns(df))
    one = df.agg(*[x for c in df.columns for x in (F.count_distinct(c).alias(f"n_{c}"), F.min(c).alias(f"a_{c}"), F.max(c).alias(f"z_{c}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n_distinct"), F.col(f"a_{c}").alias("first"), F.col(f"z_{c}").alias("last")) for c in df.columns])))


@register("columns_side_by_side", "SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_totalprice, coalesce(b.o_orderpriority, 'none') AS o_orderpriority FROM (SELECT * FROM orders WHERE o_orderkey % 2 = 0) a FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 3 = 0) b ON a.o_orderkey = b.o_orderkey")
def columns_side_by_side(spark, sf):
    o = table(spark, sf, "orders")
    both = side_by_side(o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice"), o.where("o_orderkey % 3 = 0").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    return both.withColumn("o_orderpriority", F.coalesce("o_orderpriority", F.lit("none")))


@register("rows_aligned", "SELECT a.o_orderkey, b.o_totalprice FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) a LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 = 0) b ON a.o_orderkey = b.o_orderkey")
def rows_aligned(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return aligned(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"), "o_orderkey")


@register("string_functions", """SELECT p_partkey, upper(p_type) AS up, lower(p_brand) AS low, length(p_name)::bigint AS n, substr(p_name, 2, 3) AS part, replace(p_brand, '#', '-') AS swapped, lpad(p_partkey::varchar, 8, '0') AS padded,
 string_split(p_type, ' ')[1] AS word, regexp_extract(p_brand, '[0-9]+', 0) AS digits, trim('  ' || p_type || ' ') AS trimmed, contains(p_type, 'A') AS has_a, p_brand LIKE 'Brand%' AS branded, concat_ws('|', p_brand, p_type) AS both FROM part""")
def string_functions(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey", F.upper("p_type").alias("up"), F.lower("p_brand").alias("low"), F.length("p_name").cast("long").alias("n"), F.substring("p_name", 2, 3).alias("part"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("swapped"),
        F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("padded"), F.split("p_type", " ")[0].alias("word"), F.regexp_extract("p_brand", "[0-9]+", 0).alias("digits"), F.trim(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("trimmed"),
        F.contains("p_type", F.lit("A")).alias("has_a"), F.col("p_brand").like("Brand%").alias("branded"), F.concat_ws("|", "p_brand", "p_type").alias("both"),
    )


_LEVELS = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3}


@register("map_lookup", "SELECT o_orderkey, coalesce(MAP {" + ", ".join(f"'{k}': {v}" for k, v in _LEVELS.items()) + "}[o_orderpriority], 0)::bigint AS level FROM orders")
def map_lookup(spark, sf):
    levels = F.create_map(*[F.lit(x) for kv in _LEVELS.items() for x in kv])
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(F.try_element_at(levels, F.col("o_orderpriority")), F.lit(0)).cast("long").alias("level"))


@register("format_functions", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%d.%m.%Y') AS day, dayname(o_orderdate) AS day_name, printf('%08d', o_custkey) AS customer, printf('%x', o_custkey) AS hex FROM orders")
def format_functions(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(d, "yyyy-MM").alias("month"), F.date_format(d, "dd.MM.yyyy").alias("day"), F.date_format(d, "EEEE").alias("day_name"), F.format_string("%08d", "o_custkey").alias("customer"), F.format_string("%x", "o_custkey").alias("hex"))


@register("sorted_rows", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY 3 LIMIT 100")
def sorted_rows(spark, sf):
    top = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long"))  # a hundred rows


_HOW = {"mean": "avg(o_totalprice)", "min": "min(o_totalprice)", "max": "max(o_totalprice)", "median": "median(o_totalprice)", "count": "count(o_totalprice)::double", "std": "stddev_samp(o_totalprice)"}


@register("chosen_aggregates", "SELECT o_orderdate::date AS d, " + ", ".join(f"round({sql}, 4) AS y_{how}" for how, sql in _HOW.items()) + " FROM orders GROUP BY 1")
def chosen_aggregates(spark, sf):
    o, out = table(spark, sf, "orders"), None
    for how in _HOW:
        one = series.daily(o, "o_orderdate", "o_totalprice", how=how).select("d", F.round(F.col("y").cast("double"), 4).alias(f"y_{how}"))
        out = one if out is None else out.join(one, "d")
    return out


@register("features_by_score", "WITH v AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, l_returnflag AS y, {f} AS x FROM lineitem" for f in _FEATURES) + """), g AS (SELECT feature, y, count(*) AS n, avg(x) AS m, sum(x) AS s, sum(x * x) AS q FROM v GROUP BY 1, 2), t AS (SELECT feature, count(*) AS k, sum(n) AS n, sum(s) / sum(n) AS m FROM g GROUP BY 1),
f AS (SELECT t.feature, (sum(g.n * (g.m - t.m) ^ 2) / (any_value(t.k) - 1)) / (sum(g.q - g.s * g.s / g.n) / (any_value(t.n) - any_value(t.k))) AS score FROM g JOIN t ON g.feature = t.feature GROUP BY 1) SELECT feature, row_number() OVER (ORDER BY score DESC, feature) AS place FROM f""")
def features_by_score(spark, sf):
    ranked = select.ranking(table(spark, sf, "lineitem"), _FEATURES, "l_returnflag", "anova", ["l_orderkey"])
    return spark.createDataFrame([(f, i + 1) for i, f in enumerate(ranked)], "feature string, place long")


_UNIT = ", ".join(f"(SELECT min({f}) FROM lineitem) AS lo_{f}, (SELECT max({f}) FROM lineitem) AS hi_{f}" for f in _FEATURES)


@register("select_score_table", "WITH e AS (SELECT " + _UNIT + "), a AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, l_returnflag AS y, {f} AS x, ({f} - lo_{f}) / (hi_{f} - lo_{f}) AS u FROM lineitem, e" for f in _FEATURES) + """), g AS (SELECT feature, y, count(*) AS n, avg(x) AS m, sum(x) AS s, sum(x * x) AS q, sum(u) AS o FROM a GROUP BY 1, 2), t AS (SELECT feature, count(*) AS k, sum(n) AS n, sum(s) / sum(n) AS m, sum(o) AS t FROM g GROUP BY 1)
SELECT t.feature, round((sum(g.n * (g.m - t.m) ^ 2) / (any_value(t.k) - 1)) / (sum(g.q - g.s * g.s / g.n) / (any_value(t.n) - any_value(t.k))), 4) AS anova, round(sum((o - t.t * g.n / t.n) ^ 2 / (t.t * g.n / t.n)), 4) AS chi2 FROM g JOIN t ON g.feature = t.feature GROUP BY 1""")
def select_score_table(spark, sf):
    return rounded(select.score_table(table(spark, sf, "lineitem"), _FEATURES, "l_returnflag"), "anova", "chi2", digits=4)


@register("count_in_group", "SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings")
def count_in_group(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("n"))


@register("mask_overlap", _FLAGS + "SELECT sum((iqr_15 + z_2 + z_3 = 3)::int)::bigint AS all_methods, sum((iqr_15 = 1 AND z_2 = 1 AND z_3 = 0)::int)::bigint AS only_iqr_15_z_2, sum((iqr_15 = 1 AND z_2 = 0 AND z_3 = 1)::int)::bigint AS only_iqr_15_z_3, sum((iqr_15 = 0 AND z_2 = 1 AND z_3 = 1)::int)::bigint AS only_z_2_z_3, sum((iqr_15 = 1 AND z_2 + z_3 = 0)::int)::bigint AS only_iqr_15, sum((z_2 = 1 AND iqr_15 + z_3 = 0)::int)::bigint AS only_z_2, sum((z_3 = 1 AND iqr_15 + z_2 = 0)::int)::bigint AS only_z_3 FROM f")
def mask_overlap(spark, sf):
    return series.overlap(_flags(spark, sf), ["iqr_15", "z_2", "z_3"])


@register("class_ratio_bands", "WITH g AS (SELECT CASE WHEN n_chars < 300 THEN 'short' WHEN n_chars < 20000 THEN 'middle' ELSE 'long' END AS class, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT class, n::double / (SELECT min(n) FROM g) AS ratio FROM g) SELECT class, round(ratio, 6) AS ratio, CASE WHEN ratio < 10 THEN '1-9' WHEN ratio <= 100 THEN '10-100' ELSE '>100' END AS band FROM r")
def class_ratio_bands(spark, sf):
    n = F.col("n_chars")
    df = table(spark, sf, "documents").select(F.when(n < 300, "short").when(n < 20000, "middle").otherwise("long").alias("c"))
    return rounded(profile.ratio_bands(profile.class_counts(df, "c")).select("class", "ratio", "band"), "ratio")


_THREE = ["l_quantity", "l_extendedprice", "charge"]
_VIF3 = LINES + ", r AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, charge) AS ac, corr(l_extendedprice, charge) AS bc FROM li), v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, 1 / (1 - ({x} * {x} + {y} * {y} - 2 * {x} * {y} * {z}) / (1 - {z} * {z})) AS vif FROM r" for c, x, y, z in (("l_quantity", "ab", "ac", "bc"), ("l_extendedprice", "ab", "bc", "ac"), ("charge", "ac", "bc", "ab"))) + ")"


@register("vif_three_columns", _VIF3 + " SELECT feature, round(vif, 3) AS vif, round(1 - 1 / vif, 6) AS explained FROM v")
def vif_three(spark, sf):
    return rounded(rounded(encode.explained_ratio(encode.vif(lines(spark, sf).select(*_THREE))), "vif", digits=3), "explained")


@register("vif_summary", _VIF3 + " SELECT count(*)::bigint AS n_features, sum((vif >= 5)::int)::bigint AS n_5, sum((vif >= 10)::int)::bigint AS n_10, 0::bigint AS n_infinite FROM v")
def vif_summary(spark, sf):
    return encode.vif_summary(encode.vif(lines(spark, sf).select(*_THREE)))


@register("levene_trimmed_w", """WITH e AS (SELECT l_returnflag AS g, quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi FROM lineitem GROUP BY 1), c AS (SELECT g, avg(l_extendedprice) AS c FROM lineitem JOIN e ON l_returnflag = g WHERE l_extendedprice BETWEEN lo AND hi GROUP BY 1),
z AS (SELECT g, abs(l_extendedprice - c) AS z FROM lineitem JOIN c ON l_returnflag = g), s AS (SELECT g, count(*) AS n, sum(z) AS s, sum(z * z) AS q FROM z GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS n, sum(s) / sum(n) AS m FROM s)
SELECT t.k::bigint AS k, t.n::bigint AS n, round(((SELECT sum(s.n * (s.s / s.n - t.m) ^ 2) FROM s) / (t.k - 1)) / ((SELECT sum(q - s * s / n) FROM s) / (t.n - t.k)), 4) AS statistic FROM t""")
def levene_trimmed_w(spark, sf):
    return rounded(hypothesis.levene_w(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", "trimmed"), "statistic", digits=4)


@register("ts_top_changes", DAY + ", x AS (SELECT d, y - lag(y) OVER (ORDER BY d) AS score FROM s) SELECT d, round(score, 2) AS score, dayname(d) AS day_name FROM x WHERE score IS NOT NULL ORDER BY abs(x.score) DESC, d LIMIT 5")
def ts_top_changes(spark, sf):
    s = orders_daily(spark, sf).withColumn("score", series.difference(series.over())).where("score is not null")
    return rounded(series.top_days(s).select("d", "score", "day_name"), "score", digits=2)


@register("img_pixel_ks", BYTES + """, v AS (SELECT unnest(p) AS value, 1 AS x, 0 AS y FROM e UNION ALL SELECT unnest(list_transform(p, lambda x: least(255, abs(round(1.2::double * x - 20))))), 0, 1 FROM e), s AS (SELECT value, sum(sum(x)) OVER (ORDER BY value) AS cx, sum(sum(y)) OVER (ORDER BY value) AS cy FROM v GROUP BY value)
SELECT 0::bigint AS channel, (SELECT sum(x) FROM v)::bigint AS n1, (SELECT sum(y) FROM v)::bigint AS n2, round(max(abs(cx::double / (SELECT sum(x) FROM v) - cy::double / (SELECT sum(y) FROM v))), 9) AS d FROM s""")
def pixel_ks(spark, sf):
    before = bytes_of(spark, sf)
    after = before.withColumn("pixels", images.adjust(F.col("pixels"), 1.2, -20))
    return rounded(hypothesis.ks_by_channel(images.pixel_rows(before, []), images.pixel_rows(after, [])), "d", digits=9)


@register("outlier_clean_table", _FLAGS.replace("FROM events, q)", ", event_id, value FROM events, q)") + "SELECT event_id, round(value, 6) AS value, (iqr_15 + iqr_30 + z_2 + z_3)::bigint AS votes FROM f WHERE iqr_15 + iqr_30 + z_2 + z_3 < 2")
def outlier_clean_table(spark, sf):
    names = ["iqr_15", "iqr_30", "z_2", "z_3"]
    voted = _flags(spark, sf).withColumn("votes", sum(F.col(c).cast("long") for c in names))
    return rounded(voted.where("votes < 2").select("event_id", "value", "votes"), "value")


def _kde(where: str, group: str = "") -> str:
    """The density curve in SQL: Scott's bandwidth over a histogram of 2000 cells on a grid of 200 points."""
    return f"""WITH v AS (SELECT value AS v{', event_type AS g' if group else ", 'all' AS g"} FROM events {where}), s AS (SELECT g, count(v) AS n, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi, stddev_samp(v) * count(v) ** (-0.2::double) AS h FROM v GROUP BY 1),
c AS (SELECT v.g, least(floor((v - lo) / ((hi - lo) / 2000)), 1999) AS b, count(*) AS k FROM v JOIN s ON v.g = s.g GROUP BY 1, 2), x AS (SELECT g, n, h, lo, (hi - lo) / 2000 AS w, (lo - 3 * h) + i * ((hi + 3 * h) - (lo - 3 * h)) / 199 AS x FROM s, range(0, 200) t(i))
, k AS (SELECT x.g, x.x, sum(c.k * exp(-(((x.x - (lo + (b + 0.5::double) * w)) / h) ** 2) / 2)) / any_value(n * h * sqrt(2 * pi())) AS density FROM x JOIN c ON c.g = x.g GROUP BY 1, 2)"""


@register("kde_curve_table", _kde("") + " SELECT round(x, 6) AS x, round(density, 9) AS density FROM k")
def kde_curve_table(spark, sf):
    return rounded(rounded(profile.kde(table(spark, sf, "events"), "value"), "x"), "density", digits=9)


@register("kde_by_class_table", _kde("", "event_type") + " SELECT g AS event_type, round(x, 6) AS x, round(density, 9) AS density FROM k")
def kde_by_class_table(spark, sf):
    from . import frames

    return rounded(rounded(frames.density_frame(table(spark, sf, "events"), "value", "event_type"), "x"), "density", digits=9)


@register("column_distribution_table", _kde("") + ", h AS (SELECT least(floor((v - lo) / ((hi - lo) / 30)), 29) AS b, count(*) AS k, any_value(lo) AS lo, any_value((hi - lo) / 30) AS w, any_value(n) AS n FROM v, s GROUP BY 1) SELECT 'kde' AS kind, round(x, 6) AS x, round(density, 9) AS y FROM k UNION ALL SELECT 'bin', round(lo + (b + 0.5::double) * w, 6), round(k::double / n / w, 9) FROM h")
def column_distribution_table(spark, sf):
    from . import frames

    return rounded(rounded(frames.column_distribution_frame(table(spark, sf, "events"), "value"), "x"), "y", digits=9)


@register("pixel_histogram_table", BYTES + ", v AS (SELECT unnest(p) AS v FROM e) SELECT 0::bigint AS channel, least(floor(v / 2.55::double), 99)::bigint AS bin, count(*)::bigint AS n, round(count(*)::double / (SELECT count(*) FROM v) / 2.55::double, 9) AS density FROM v GROUP BY 2")
def pixel_histogram_table(spark, sf):
    from . import frames

    out = frames.histogram_frame(bytes_of(spark, sf), ["vec_id"]).withColumn("channel", F.col("channel").cast("long"))
    return rounded(out, "density", digits=9)


@register("decomposition_table", DAY + """, n AS (SELECT d, y, row_number() OVER (ORDER BY d) - 1 AS pos FROM s), t AS (SELECT *, CASE WHEN count(y) OVER w = 7 THEN avg(y) OVER w END AS trend FROM n WINDOW w AS (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
p AS (SELECT pos % 7 AS ph, avg(y - trend) AS m FROM t GROUP BY 1), q AS (SELECT ph, m - (SELECT avg(m) FROM p) AS seasonal FROM p), r AS (SELECT d, y, trend, seasonal, y - trend - seasonal AS resid FROM t JOIN q ON ph = pos % 7)
SELECT d, part, round(value, 2) AS value FROM (SELECT d, 'observed' AS part, y AS value FROM r UNION ALL SELECT d, 'trend', trend FROM r UNION ALL SELECT d, 'seasonal', seasonal FROM r UNION ALL SELECT d, 'resid', resid FROM r)""")
def decomposition_table(spark, sf):
    from . import frames

    return rounded(frames.decomposition_frame(series.decompose(orders_daily(spark, sf), 7)), "value", digits=2)
