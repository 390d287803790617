"""Queries over tables: profiles, relational layer, tests, outliers, scaling, encoding, selection, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..core import broadcast_if_small, fold_of, settled, table
from ..functions import hypothesis
from ..functions.order import ecdf, quantiles
from ..operators import encode, metrics, outlier, profile, resample, scale, select
from .catalogue import register


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def lines(spark, sf):
    """Line items with deterministic gaps and two derived amounts."""
    df = table(spark, sf, "lineitem")
    gaps = {"tax_n": F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax")), "disc_n": F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 5 != 0, F.col("l_discount"))}
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return df.withColumns(gaps).withColumn("revenue", revenue).withColumn("charge", F.col("revenue") * (1 + F.col("l_tax")))


LINES = """WITH li AS (SELECT *, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS tax_n,
 CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN NULL ELSE l_discount END AS disc_n,
 l_extendedprice * (1 - l_discount) AS revenue, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem)
"""
GAPS = ["l_quantity", "l_extendedprice", "disc_n", "tax_n"]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "revenue", "charge"]

# -- profiles ---------------------------------------------------------------


@register("table_info_missing_rate", LINES + "SELECT count(*)::bigint AS n_rows, 4::bigint AS n_columns, round(sum((disc_n IS NULL)::int + (tax_n IS NULL)::int) * 100.0::double / (4 * count(*)), 6) AS missing_pct FROM li")
def table_info(spark, sf):
    return rounded(profile.table_info(lines(spark, sf).select(*GAPS)), "missing_pct")


@register("target_feature_split", "SELECT l_returnflag AS target, count(*)::bigint AS n, round(sum(l_quantity + l_tax), 4) AS features_sum FROM lineitem GROUP BY 1")
def target_split(spark, sf):
    df = lines(spark, sf).select("l_quantity", "l_tax", "l_returnflag")
    return rounded(df.groupBy(F.col("l_returnflag").alias("target")).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity") + F.col("l_tax")).alias("features_sum")), "features_sum", digits=4)


_PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]
_PEARSON = LINES + ", p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM li" for a, b in _PAIRS) + ")\n"


def _pearson(spark, sf):
    return profile.pair_correlations(lines(spark, sf).select(*NUMBERS), NUMBERS)


@register("pearson_pairs", _PEARSON + "SELECT col_a, col_b, round(r, 6) AS r FROM p")
def pearson_pairs(spark, sf):
    return rounded(_pearson(spark, sf), "r")


@register("pearson_strong", _PEARSON + "SELECT col_a, col_b, round(r, 6) AS r FROM p WHERE abs(r) >= 0.7")
def pearson_strong(spark, sf):
    return rounded(profile.strong_pairs(_pearson(spark, sf)), "r")


@register("pearson_weak5", _PEARSON + "SELECT col_a, col_b, round(r, 6) AS r FROM p ORDER BY abs(p.r), col_a, col_b LIMIT 5")
def pearson_weak(spark, sf):
    return rounded(profile.weak_pairs(_pearson(spark, sf)), "r")


_RANKED = ["l_quantity", "l_extendedprice", "revenue"]
_SPEARMAN = LINES + ", k AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::double AS {c}" for c in _RANKED) + " FROM li)\n"


@register("spearman_pairs", _SPEARMAN + " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS r FROM k" for i, a in enumerate(_RANKED) for b in _RANKED[i + 1 :]))
def spearman_pairs(spark, sf):
    return rounded(profile.spearman(lines(spark, sf).select(*_RANKED), _RANKED), "r")


@register("wait_time_features", """SELECT weekday::bigint AS order_dow, count(*)::bigint AS n, sum(w)::bigint AS total_wait_days FROM (
 SELECT (isodow(o_orderdate) - 1) AS weekday, date_diff('day', o_orderdate::date, l_shipdate::date) AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY 1""")
def wait_time(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    j = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.weekday("o_orderdate").cast("long").alias("order_dow")).agg(F.count("*").alias("n"), F.sum(F.datediff("l_shipdate", "o_orderdate").cast("long")).alias("total_wait_days"))


@register("missing_by_column", LINES + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", (count(*) - count({c}))::bigint AS n_missing, round((count(*) - count({c})) * 100.0::double / count(*), 6) AS pct, CASE WHEN (count(*) - count({c})) * 100.0 / count(*) > 40 THEN 'severe' WHEN count(*) > count({c}) THEN 'low' ELSE 'none' END AS level FROM li" for c in GAPS))
def missing_by_column(spark, sf):
    return rounded(profile.missing_by_column(lines(spark, sf).select(*GAPS)), "pct")


@register("missing_by_row", LINES + "SELECT max(k)::bigint AS max_missing, sum((k > 2)::int)::bigint AS n_half FROM (SELECT (disc_n IS NULL)::int + (tax_n IS NULL)::int AS k FROM li)")
def missing_by_row(spark, sf):
    return profile.missing_by_row(lines(spark, sf).select(*GAPS))


@register("missing_corr", LINES + "SELECT 'disc_n' AS col_a, 'tax_n' AS col_b, round(corr((disc_n IS NULL)::int, (tax_n IS NULL)::int), 6) AS r FROM li")
def missing_corr(spark, sf):
    return rounded(profile.missing_correlations(lines(spark, sf).select(*GAPS)), "r")


@register("drop_empty_columns", "SELECT count(*)::bigint AS n, sum(l_linenumber)::bigint AS s FROM lineitem")
def drop_empty(spark, sf):
    df = profile.drop_empty_columns(table(spark, sf, "lineitem").select("l_linenumber").withColumn("nothing", F.lit(None).cast("double")))
    assert df.columns == ["l_linenumber"]
    return df.agg(F.count("*").alias("n"), F.sum("l_linenumber").cast("long").alias("s"))


@register("class_imbalance", """WITH g AS (SELECT event_type AS class, count(*) AS n FROM events GROUP BY 1)
SELECT class, n::bigint AS n, round(n * 100.0::double / (SELECT sum(n) FROM g), 6) AS pct, round(n::double / (SELECT min(n) FROM g), 6) AS ratio, (SELECT max(n) > 3 * min(n) FROM g) AS imbalanced FROM g""")
def class_imbalance(spark, sf):
    return rounded(profile.class_counts(table(spark, sf, "events"), "event_type"), "pct", "ratio")


@register("image_class_imbalance", """WITH g AS (SELECT label AS class, count(*) AS n FROM embeddings GROUP BY 1)
SELECT class, n::bigint AS n, round(n * 100.0::double / (SELECT sum(n) FROM g), 6) AS pct, round(n::double / (SELECT min(n) FROM g), 6) AS ratio, (SELECT max(n) > 3 * min(n) FROM g) AS imbalanced FROM g""")
def image_class_imbalance(spark, sf):
    return rounded(profile.class_counts(table(spark, sf, "embeddings"), "label"), "pct", "ratio")


@register("five_number_summary", """WITH q AS (SELECT event_type, count(value) AS n, min(value) AS lo, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS md, quantile_cont(value, 0.75) AS q3, max(value) AS hi FROM events GROUP BY 1)
SELECT q.event_type, any_value(n)::bigint AS n, round(any_value(lo), 6) AS min, round(any_value(q1), 6) AS q1, round(any_value(md), 6) AS median, round(any_value(q3), 6) AS q3, round(any_value(hi), 6) AS max,
 sum((e.value < q1 - 1.5 * (q3 - q1) OR e.value > q3 + 1.5 * (q3 - q1))::int)::bigint AS n_outliers FROM events e JOIN q ON e.event_type = q.event_type GROUP BY 1""")
def five_numbers(spark, sf):
    return rounded(profile.five_numbers(table(spark, sf, "events"), "value", ["event_type"]), "min", "q1", "median", "q3", "max")


@register("hist_100", """WITH b AS (SELECT least(floor((l_extendedprice - lo) / w), 99)::bigint AS bin, w FROM lineitem, (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 100 AS w FROM lineitem))
SELECT bin, count(*)::bigint AS n, round(count(*)::double / (SELECT count(*) FROM lineitem) / any_value(w), 9) AS density FROM b GROUP BY 1""")
def hist_100(spark, sf):
    return rounded(profile.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 100), "density", digits=9)


@register("ecdf", "SELECT l_quantity AS value, n::bigint AS cum_count, round(n::double / (SELECT count(*) FROM lineitem), 9) AS ecdf FROM (SELECT DISTINCT l_quantity, count(*) OVER (ORDER BY l_quantity) AS n FROM lineitem)")
def ecdf_query(spark, sf):
    return rounded(ecdf(table(spark, sf, "lineitem"), "l_quantity"), "ecdf", digits=9)


@register("kde_curve")
def kde_curve(spark, sf):
    return profile.kde(table(spark, sf, "events"), "value")


# -- relational layer ---------------------------------------------------------


@register("filter_in_null_range", "SELECT o_orderstatus, count(*)::bigint AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate IS NOT NULL AND o_orderdate BETWEEN '1996-01-01' AND '1997-12-31' GROUP BY 1")
def filters(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).na.drop(subset=["o_orderdate"]).where(F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz")))
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("lookup_join_default", "SELECT coalesce(r_name, 'none') AS region, count(*)::bigint AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0 LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def lookup_join(spark, sf):
    n = broadcast_if_small(table(spark, sf, "nation").where("n_nationkey % 2 = 0").select("n_nationkey", "n_regionkey"))
    r = broadcast_if_small(table(spark, sf, "region").select("r_regionkey", "r_name"))
    j = table(spark, sf, "customer").select("c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.groupBy(F.coalesce("r_name", F.lit("none")).alias("region")).agg(F.count("*").alias("n"))


@register("semi_anti_join", "SELECT (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))::bigint AS n_semi, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))::bigint AS n_anti")
def semi_anti(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").agg(F.count("*").alias("n_semi")).crossJoin(c.join(o, "c_custkey", "left_anti").agg(F.count("*").alias("n_anti")))  # one row each


@register("set_operations", "WITH a AS (SELECT DISTINCT p_size FROM part WHERE p_retailprice > 1500), b AS (SELECT DISTINCT p_size FROM part WHERE p_retailprice < 1200) SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b))::bigint AS n_both, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b))::bigint AS n_any, (SELECT count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b))::bigint AS n_all")
def set_operations(spark, sf):
    p = table(spark, sf, "part")
    a, b = p.where("p_retailprice > 1500").select("p_size").distinct(), p.where("p_retailprice < 1200").select("p_size").distinct()
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(a.intersect(b), "n_both").crossJoin(count(a.union(b).distinct(), "n_any")).crossJoin(count(a.unionAll(b), "n_all"))  # one row each


@register("topk_categories", "SELECT p_brand, count(*)::bigint AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def topk(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(5)


@register("value_counts_normalized", "SELECT o_orderpriority, count(*)::bigint AS n, round(count(*)::double / sum(count(*)) OVER (), 9) AS share FROM orders GROUP BY 1")
def value_counts(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    t = g.agg(F.sum("n").alias("t"))
    return g.crossJoin(t).select("o_orderpriority", "n", F.round(F.col("n") / F.col("t"), 9).alias("share"))  # one row


@register("group_stats", "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS var, round(stddev_pop(l_quantity), 6) AS sd_pop, round(median(l_quantity), 6) AS median, count(DISTINCT l_linenumber)::bigint AS n_distinct, max_by(l_orderkey, l_orderkey)::bigint AS last_order FROM lineitem GROUP BY 1")
def group_stats(spark, sf):
    q = "l_quantity"
    g = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.avg(q).alias("mean"), F.var_samp(q).alias("var"), F.stddev_pop(q).alias("sd_pop"), F.percentile(q, F.lit(0.5)).alias("median"), F.count_distinct("l_linenumber").alias("n_distinct"), F.max_by("l_orderkey", "l_orderkey").alias("last_order"))
    return rounded(g, "mean", "var", "sd_pop", "median")


@register("pivot_unpivot", "SELECT l_returnflag, sum((l_linestatus = 'F')::int)::bigint AS n_F, sum((l_linestatus = 'O')::int)::bigint AS n_O FROM lineitem GROUP BY 1")
def pivot(spark, sf):
    p = table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))
    back = p.unpivot(["l_returnflag"], ["F", "O"], "status", "n")
    return back.groupBy("l_returnflag").pivot("status", ["F", "O"]).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long")).select("l_returnflag", F.col("F").alias("n_F"), F.col("O").alias("n_O"))


@register("fold_assignment", "SELECT ((('0x' || substr(md5(o_orderkey::varchar), 1, 8))::bigint) % 5)::bigint AS fold, count(*)::bigint AS n FROM orders GROUP BY 1")
def folds(spark, sf):
    return table(spark, sf, "orders").groupBy(fold_of(["o_orderkey"], 5).cast("long").alias("fold")).agg(F.count("*").alias("n"))


@register("explained_cumulative", "SELECT line, round(sum(q) OVER (ORDER BY line), 4) AS running FROM (SELECT l_linenumber::bigint AS line, sum(l_quantity) AS q FROM lineitem GROUP BY 1)")
def cumulative_sum(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("line")).agg(F.sum("l_quantity").alias("q"))
    return rounded(g.select("line", F.sum("q").over(W.orderBy("line").rowsBetween(W.unboundedPreceding, 0)).alias("running")), "running", digits=4)  # a row a line number


# -- tests --------------------------------------------------------------------


@register("mcar_patterns", LINES + "SELECT concat('0', '0', (disc_n IS NULL)::int::varchar, (tax_n IS NULL)::int::varchar) AS pattern, count(*)::bigint AS n, ((any_value(disc_n IS NULL))::int + (any_value(tax_n IS NULL))::int)::bigint AS missing FROM li GROUP BY 1")
def mcar_patterns(spark, sf):
    return hypothesis.mcar_patterns(lines(spark, sf), GAPS)


@register("mcar_test")
def mcar_test(spark, sf):
    return hypothesis.mcar_test(lines(spark, sf), GAPS)


def _flag(spark, sf, flag):
    return table(spark, sf, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_quantity").alias("value"))


_KS = """, s AS (SELECT value, sum(sum(x)) OVER (ORDER BY value) AS cx, sum(sum(y)) OVER (ORDER BY value) AS cy FROM v GROUP BY value)
SELECT (SELECT sum(x) FROM v)::bigint AS n1, (SELECT sum(y) FROM v)::bigint AS n2, round(max(abs(cx::double / (SELECT sum(x) FROM v) - cy::double / (SELECT sum(y) FROM v))), 9) AS d FROM s"""


@register("ks_two_sample", "WITH v AS (SELECT l_quantity AS value, (l_returnflag = 'A')::int AS x, (l_returnflag = 'R')::int AS y FROM lineitem WHERE l_returnflag IN ('A', 'R'))" + _KS)
def ks_two_sample(spark, sf):
    return rounded(hypothesis.ks_statistic(_flag(spark, sf, "A"), _flag(spark, sf, "R")), "d", digits=9)


@register("ks_two_sample_p")
def ks_p(spark, sf):
    return hypothesis.ks_test(_flag(spark, sf, "A"), _flag(spark, sf, "R"))


@register("ks_after_outlier_removal", "WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events), v AS (SELECT value, 1 AS x, 0 AS y FROM events UNION ALL SELECT value, 0, 1 FROM events, q WHERE NOT (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)))" + _KS)
def ks_after(spark, sf):
    e = table(spark, sf, "events").select("value")
    return rounded(hypothesis.ks_statistic(e, e.where(~outlier.iqr_mask(outlier.fit_iqr(e, ["value"])))), "d", digits=9)


def _levene(center, digits=6):
    return f"""WITH c AS (SELECT l_returnflag AS g, {center}(l_extendedprice) AS c FROM lineitem GROUP BY 1), z AS (SELECT g, abs(l_extendedprice - c) AS z FROM lineitem JOIN c ON l_returnflag = g),
s AS (SELECT g, count(*) AS n, avg(z) AS m, sum(z) AS s, sum(z * z) AS q FROM z GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS n, sum(s) / sum(n) AS m FROM s)
SELECT t.k::bigint AS k, t.n::bigint AS n, round(((SELECT sum(s.n * (s.m - t.m) ^ 2) FROM s) / (t.k - 1)) / ((SELECT sum(q - s * s / n) FROM s) / (t.n - t.k)), {digits}) AS statistic FROM t"""


@register("levene_median", _levene("median", 4))
def levene_median(spark, sf):
    return rounded(hypothesis.levene_w(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag"), "statistic", digits=4)


@register("levene_mean", _levene("avg", 4))
def levene_mean(spark, sf):
    return rounded(hypothesis.levene_w(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", "mean"), "statistic", digits=4)


@register("levene_per_column")
def levene_per_column(spark, sf):
    df = table(spark, sf, "part").select("p_size", "p_retailprice")
    scaled = scale.minmax(df).transform(df)
    both = hypothesis.stack_numeric(df).withColumn("when_", F.lit("before")).unionByName(hypothesis.stack_numeric(scaled).withColumn("when_", F.lit("after")))
    var = both.groupBy("column").agg(F.var_samp(F.when(F.col("when_") == "before", F.col("value"))).alias("var_before"), F.var_samp(F.when(F.col("when_") == "after", F.col("value"))).alias("var_after"))
    w = hypothesis.with_f_p(hypothesis.levene_w(both, "value", "when_", by=["column"]), 0.05, strict=False)
    return w.withColumnRenamed("significant", "rejected").join(var, "column").withColumn("ratio", F.col("var_after") / F.col("var_before"))


@register("levene_trimmed_p")
def levene_trimmed(spark, sf):
    return hypothesis.with_f_p(hypothesis.levene_w(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", "trimmed"), 0.05, strict=False)


_ANOVA = """WITH v AS (SELECT i AS dim, label, embedding[i + 1]::double AS x FROM embeddings, range(0, 8) t(i)), g AS (SELECT dim, label, count(*) AS n, avg(x) AS m, sum(x) AS s, sum(x * x) AS q FROM v GROUP BY 1, 2),
t AS (SELECT dim, count(*) AS k, sum(n) AS n, sum(s) / sum(n) AS m FROM g GROUP BY 1)
SELECT t.dim::bigint AS dim, any_value(t.k)::bigint AS k, any_value(t.n)::bigint AS n, round((sum(g.n * (g.m - t.m) ^ 2) / (any_value(t.k) - 1)) / (sum(g.q - g.s * g.s / g.n) / (any_value(t.n) - any_value(t.k))), 6) AS statistic FROM g JOIN t ON g.dim = t.dim GROUP BY 1"""


def _dims(spark, sf, n=64):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", F.posexplode(F.slice("embedding", 1, n)).alias("dim", "x")).withColumn("dim", F.col("dim").cast("long")).withColumn("x", F.col("x").cast("double"))


@register("anova_by_class", _ANOVA)
def anova_by_class(spark, sf):
    return rounded(hypothesis.anova_f(_dims(spark, sf, 8), "x", "label", by=["dim"]), "statistic")


@register("anova_p_values")
def anova_p(spark, sf):
    return hypothesis.with_f_p(hypothesis.anova_f(_dims(spark, sf), "x", "label", by=["dim"]), 0.05, strict=True)


@register("dagostino_k2", """WITH m AS (SELECT count(o_totalprice)::double AS n, avg(o_totalprice) AS m FROM orders), c AS (SELECT avg((o_totalprice - m) ^ 2) AS m2, avg((o_totalprice - m) ^ 3) AS m3, avg((o_totalprice - m) ^ 4) AS m4, any_value(n) AS n FROM orders, m),
a AS (SELECT n, m3 / m2 ^ 1.5::double AS g1, m4 / (m2 * m2) AS b2, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2, 3 * (n - 1) / (n + 1) AS e, 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)) AS v, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS s FROM c),
b AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, -1 + sqrt(2 * (beta2 - 1)) AS w2, (b2 - e) / sqrt(v) AS x, 6 + 8 / s * (2 / s + sqrt(1 + 4 / (s * s))) AS a FROM a),
z AS (SELECT n, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5::double * ln(w2)) AS z1, ((1 - 2 / (9 * a)) - CASE WHEN (1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))) < 0 THEN -cbrt(-(1 - 2 / a) / (1 + x * sqrt(2 / (a - 4)))) ELSE cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4)))) END) / sqrt(2 / (9 * a)) AS z2 FROM b)
SELECT n::bigint AS n, round(z1, 5) AS z_skew, round(z2, 5) AS z_kurt, round(z1 * z1 + z2 * z2, 4) AS k2, round(exp(-(z1 * z1 + z2 * z2) / 2), 6) AS p_value FROM z""")
def dagostino(spark, sf):
    out = hypothesis.dagostino_k2(table(spark, sf, "orders"), "o_totalprice")
    return rounded(rounded(rounded(out, "z_skew", "z_kurt", digits=5), "k2", digits=4), "p_value")


@register("shapiro")
def shapiro(spark, sf):
    return hypothesis.shapiro_test(table(spark, sf, "orders"), "o_totalprice", ["o_orderkey"])


@register("normality_dispatch")
def normality(spark, sf):
    df = table(spark, sf, "part")
    out = None
    n = df.count()
    for c in ("p_size", "p_retailprice"):
        row = hypothesis.shapiro_test(df, c, ["p_partkey"]).select(F.lit(c).alias("column"), F.lit("shapiro").alias("test"), "p_value") if n < 5000 else hypothesis.dagostino_k2(df, c).select(F.lit(c).alias("column"), F.lit("dagostino").alias("test"), "p_value")
        out = row if out is None else out.unionByName(row)
    return out


# -- outliers -------------------------------------------------------------------

_FENCE = "value < q1 - {m} * (q3 - q1) OR value > q3 + {m} * (q3 - q1)"
_Q = "q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS m, stddev_pop(value) AS s FROM events)"
_SUMMARY = "SELECT count(*)::bigint AS n_rows, sum(o::int)::bigint AS n_outliers, round(sum(o::int) * 100.0::double / count(*), 6) AS rate_pct FROM f"


@register("outlier_iqr", f"WITH {_Q}, f AS (SELECT {_FENCE.format(m=1.5)} AS o FROM events, q) {_SUMMARY}")
def outlier_iqr(spark, sf):
    df = table(spark, sf, "events").select("value")
    return rounded(outlier.summary(df.withColumn("o", outlier.iqr_mask(outlier.fit_iqr(df, ["value"]))), "o"), "rate_pct")


@register("outlier_zscore", f"WITH {_Q}, f AS (SELECT abs((value - m) / s) > 3 AS o FROM events, q) {_SUMMARY}")
def outlier_zscore(spark, sf):
    df = table(spark, sf, "events").select("value")
    return rounded(outlier.summary(df.withColumn("o", outlier.zscore_mask(outlier.fit_zscore(df, ["value"]))), "o"), "rate_pct")


@register("outlier_iqr_documents", "WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents), f AS (SELECT n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1) AS o FROM documents, q) " + _SUMMARY)
def outlier_documents(spark, sf):
    df = table(spark, sf, "documents").select("n_chars")
    return rounded(outlier.summary(df.withColumn("o", outlier.iqr_mask(outlier.fit_iqr(df, ["n_chars"]))), "o"), "rate_pct")


@register("outlier_iqr_clean_rows", f"WITH {_Q} SELECT event_id, round(value, 6) AS value FROM events, q WHERE NOT ({_FENCE.format(m=1.5)})")
def outlier_clean(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return rounded(df.where(~outlier.iqr_mask(outlier.fit_iqr(df, ["value"]))), "value")


def _flags(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    q, z = outlier.fit_iqr(df, ["value"]), outlier.fit_zscore(df, ["value"])
    return df.withColumns({"iqr_15": outlier.iqr_mask(q, 1.5), "iqr_30": outlier.iqr_mask(q, 3.0), "z_2": outlier.zscore_mask(z, 2.0), "z_3": outlier.zscore_mask(z, 3.0)})


_METHODS = ["iqr_15", "iqr_30", "z_2", "z_3"]
_FLAGS = f"WITH {_Q}, f AS (SELECT ({_FENCE.format(m=1.5)})::int AS iqr_15, ({_FENCE.format(m=3.0)})::int AS iqr_30, (abs((value - m) / s) > 2)::int AS z_2, (abs((value - m) / s) > 3)::int AS z_3 FROM events, q)\n"


@register("outlier_jaccard", _FLAGS + " UNION ALL ".join(f"SELECT '{a}' AS method_a, '{b}' AS method_b, sum({a} & {b})::bigint AS n_both, sum({a} | {b})::bigint AS n_any, round(CASE WHEN sum({a} | {b}) > 0 THEN sum({a} & {b})::double / sum({a} | {b}) ELSE 0 END, 9) AS jaccard FROM f" for i, a in enumerate(_METHODS) for b in _METHODS[i + 1 :]))
def outlier_jaccard(spark, sf):
    return rounded(outlier.jaccard(_flags(spark, sf), _METHODS), "jaccard", digits=9)


@register("outlier_consensus", _FLAGS + "SELECT (iqr_15 + iqr_30 + z_2 + z_3)::bigint AS votes, count(*)::bigint AS n_rows FROM f GROUP BY 1")
def outlier_consensus(spark, sf):
    return outlier.votes(_flags(spark, sf), _METHODS).withColumn("votes", F.col("votes").cast("long"))


_PART_Z = "p AS (SELECT p_partkey AS id, (p_size - ms) / ss AS a, (p_retailprice - mr) / sr AS b FROM part, (SELECT avg(p_size) AS ms, stddev_pop(p_size) AS ss, avg(p_retailprice) AS mr, stddev_pop(p_retailprice) AS sr FROM part))"


def _part_z(spark, sf):
    return outlier.standardized(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])


@register("outlier_lof", f"""WITH {_PART_Z}, n AS (SELECT * FROM (SELECT x.id AS id, y.id AS mate, sqrt(round((x.a - y.a) ^ 2 + (x.b - y.b) ^ 2, 9)) AS d, row_number() OVER (PARTITION BY x.id ORDER BY round((x.a - y.a) ^ 2 + (x.b - y.b) ^ 2, 9), y.id) AS r FROM p x JOIN p y ON x.id <> y.id) WHERE r <= 20),
k AS (SELECT id, max(d) AS kd FROM n GROUP BY 1), l AS (SELECT n.id, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM n JOIN k ON k.id = n.mate GROUP BY 1)
SELECT n.id AS "key", round(avg(m.lrd) / any_value(l.lrd), 4) AS lof FROM n JOIN l m ON m.id = n.mate JOIN l ON l.id = n.id GROUP BY 1""")
def outlier_lof(spark, sf):
    return rounded(outlier.lof(_part_z(spark, sf), "p_partkey", ["p_size", "p_retailprice"], k=20), "lof", digits=4)


@register("outlier_dbscan", f"""WITH {_PART_Z}, c AS (SELECT x.id, count(*) AS n FROM p x JOIN p y ON (x.a - y.a) ^ 2 + (x.b - y.b) ^ 2 <= 0.01::double GROUP BY 1),
o AS (SELECT DISTINCT x.id FROM p x JOIN p y ON (x.a - y.a) ^ 2 + (x.b - y.b) ^ 2 <= 0.01::double JOIN c ON c.id = y.id AND c.n >= 6)
SELECT c.id AS p_partkey, c.n::bigint AS n_near, c.id NOT IN (SELECT id FROM o) AS is_outlier FROM c""")
def outlier_dbscan(spark, sf):
    return outlier.dbscan_outliers(table(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice"], eps=0.1, min_samples=6)


@register("outlier_iforest")
def outlier_iforest(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return outlier.summary(outlier.iforest(df, ["event_id"], ["value"]), "iforest_outlier")


@register("outlier_nine_methods")
def outlier_nine(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    cols = ["p_size", "p_retailprice"]
    scored = settled(outlier.iforest(df, ["p_partkey"], cols, None).select(*df.columns, "iforest_score"))  # one forest; its limits differ
    limits = quantiles(scored, {"s": F.col("iforest_score")}, [0.99, 0.95, 0.90])["s"]
    forests = {f"iforest_{c}": F.col("iforest_score") > F.lit(limit) for c, limit in zip(("01", "05", "10"), limits)}
    flagged = scored.withColumns({"iqr": outlier.iqr_mask(outlier.fit_iqr(df, cols)), "zscore": outlier.zscore_mask(outlier.fit_zscore(df, cols)), **forests}).drop("iforest_score")
    near = _part_z(spark, sf)
    for k in (10, 20, 50):
        flagged = flagged.join(outlier.lof(near, "p_partkey", cols, k).select(F.col("key").alias("p_partkey"), (F.col("lof") > outlier.LOF_LIMIT).alias(f"lof_{k}")).hint("merge"), "p_partkey", "left")
    flagged = flagged.join(outlier.dbscan_outliers(df, "p_partkey", cols, 0.1, 6).select("p_partkey", F.col("is_outlier").alias("dbscan")).hint("merge"), "p_partkey")
    names = [c for c in flagged.columns if c not in df.columns]
    return outlier.jaccard(flagged.na.fill(False, names), names)


# -- scaling --------------------------------------------------------------------

_SCALED = ["l_quantity", "l_extendedprice"]


def _scaled(name, sql, make):
    body = ", ".join(f"round({sql.format(c=c)}, 6) AS {c}" for c in _SCALED)

    @register(name, f"SELECT l_orderkey, l_linenumber::bigint AS l_linenumber, {body} FROM lineitem, (SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}, avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, quantile_cont({c}, 0.5) AS q2_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr_{c}" for c in _SCALED) + " FROM lineitem)")
    def query(spark, sf):
        df = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), *_SCALED)
        return rounded(make(df).transform(df), *_SCALED)

    return query


_scaled("scale_minmax", "({c} - lo_{c}) / (hi_{c} - lo_{c})", lambda df: scale.minmax(df, _SCALED))
_scaled("scale_zscore", "({c} - m_{c}) / s_{c}", lambda df: scale.zscore(df, _SCALED))
_scaled("scale_robust", "({c} - q2_{c}) / iqr_{c}", lambda df: scale.robust(df, _SCALED))


@register("scale_quantile_uniform")
def quantile_uniform(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return scale.quantile(df, ["p_retailprice"]).transform(df)


@register("scale_quantile_normal")
def quantile_normal(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return scale.quantile(df, ["p_retailprice"], output="normal").transform(df)


# -- encoding ---------------------------------------------------------------------


def _orders_segments(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment", "o_totalprice")


_SEG = "WITH o AS (SELECT o_orderkey, c_mktsegment, o_totalprice, o_orderkey % 5 AS f FROM orders JOIN customer ON o_custkey = c_custkey)"


@register("enc_target_oof", _SEG + """, m AS (SELECT f, ((SELECT sum(o_totalprice) FROM o) - sum(o_totalprice)) / ((SELECT count(*) FROM o) - count(*)) AS m FROM o GROUP BY 1),
w AS (SELECT c_mktsegment AS c, sum(o_totalprice) AS s, count(*) AS n FROM o GROUP BY 1), p AS (SELECT c_mktsegment AS c, f, sum(o_totalprice) AS s, count(*) AS n FROM o GROUP BY 1, 2)
SELECT o_orderkey, round((w.s - p.s + m * 10) / (w.n - p.n + 10), 4) AS c_mktsegment_target FROM o JOIN m ON m.f = o.f JOIN w ON w.c = c_mktsegment JOIN p ON p.c = c_mktsegment AND p.f = o.f""")
def enc_target_oof(spark, sf):
    out = encode.target_encode_oof(_orders_segments(spark, sf), ["c_mktsegment"], "o_totalprice", F.col("o_orderkey") % 5)
    return rounded(out.select("o_orderkey", "c_mktsegment_target"), "c_mktsegment_target", digits=4)


@register("enc_target_full", _SEG + ", w AS (SELECT c_mktsegment AS c, sum(o_totalprice) AS s, count(*) AS n FROM o GROUP BY 1) SELECT o_orderkey, round((s + (SELECT avg(o_totalprice) FROM o) * 10) / (n + 10), 4) AS c_mktsegment_target FROM o JOIN w ON w.c = c_mktsegment")
def enc_target_full(spark, sf):
    out = encode.target_encode(_orders_segments(spark, sf), ["c_mktsegment"], "o_totalprice")
    return rounded(out.select("o_orderkey", "c_mktsegment_target"), "c_mktsegment_target", digits=4)


@register("enc_binary", "WITH k AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS c FROM (SELECT DISTINCT p_brand FROM part)) SELECT p_partkey, " + ", ".join(f"((c >> {4 - i}) & 1)::bigint AS p_brand_bin_{i + 1}" for i in range(5)) + " FROM part JOIN k ON part.p_brand = k.p_brand")
def enc_binary(spark, sf):
    out = encode.binary_encode(table(spark, sf, "part").select("p_partkey", "p_brand"), ["p_brand"])
    return out.select("p_partkey", *[F.col(c).cast("long").alias(c) for c in out.columns if "_bin_" in c])


@register("enc_frequency", "SELECT p_partkey, round(count(*) OVER (PARTITION BY p_type)::double / count(*) OVER (), 9) AS p_type_freq FROM part")
def enc_frequency(spark, sf):
    return rounded(encode.frequency_encode(table(spark, sf, "part").select("p_partkey", "p_type"), ["p_type"]).select("p_partkey", "p_type_freq"), "p_type_freq", digits=9)


_STATUS = ("F", "O", "P")


@register("enc_onehot", "SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{s}')::int::bigint AS \"o_orderstatus_{s}\"" for s in _STATUS) + " FROM orders")
def enc_onehot(spark, sf):
    out = encode.onehot_encode(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])
    return out.select("o_orderkey", *[F.col(f"o_orderstatus_{s}").cast("long").alias(f"o_orderstatus_{s}") for s in _STATUS])


@register("enc_ordinal", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment_ord FROM customer")
def enc_ordinal(spark, sf):
    return encode.ordinal_encode(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"]).select("c_custkey", "c_mktsegment_ord")


@register("enc_rare_group", "WITH b AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5) SELECT CASE WHEN p_brand IN (SELECT p_brand FROM b) THEN p_brand ELSE '__OTHER__' END AS p_brand, count(*)::bigint AS n FROM part GROUP BY 1")
def enc_rare(spark, sf):
    return encode.group_rare(table(spark, sf, "part").select("p_brand"), "p_brand", 5).groupBy("p_brand").agg(F.count("*").alias("n"))


@register("vif_report", LINES + "SELECT c AS feature, round(1 / (1 - r2), 4) AS vif FROM (SELECT unnest(['l_quantity', 'revenue']) AS c, (SELECT corr(l_quantity, revenue) ^ 2 FROM li) AS r2)")
def vif_report(spark, sf):
    return rounded(encode.vif(lines(spark, sf).select("l_quantity", "revenue")), "vif", digits=4)


@register("vif_many_columns")
def vif_many(spark, sf):
    return encode.explained_ratio(encode.vif(lines(spark, sf).select(*NUMBERS)))


@register("enc_comparison")
def enc_comparison(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    cols = ["o_orderstatus", "o_orderpriority"]
    num = lambda d: d.drop("o_orderkey", *cols)
    return encode.compare({"frequency": num(encode.frequency_encode(df, cols)), "ordinal": num(encode.ordinal_encode(df, cols)), "onehot": num(encode.onehot_encode(df, cols)), "target": num(encode.target_encode(df, cols, "o_totalprice"))})


# -- selection ---------------------------------------------------------------------

_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("select_anova", "WITH v AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, l_returnflag AS y, {f} AS x FROM lineitem" for f in _FEATURES) + """), g AS (SELECT feature, y, count(*) AS n, avg(x) AS m, sum(x) AS s, sum(x * x) AS q FROM v GROUP BY 1, 2), t AS (SELECT feature, count(*) AS k, sum(n) AS n, sum(s) / sum(n) AS m FROM g GROUP BY 1)
SELECT t.feature, round((sum(g.n * (g.m - t.m) ^ 2) / (any_value(t.k) - 1)) / (sum(g.q - g.s * g.s / g.n) / (any_value(t.n) - any_value(t.k))), 4) AS score FROM g JOIN t ON g.feature = t.feature GROUP BY 1""")
def select_anova(spark, sf):
    return rounded(select.anova_scores(table(spark, sf, "lineitem"), _FEATURES, "l_returnflag"), "score", digits=4)


@register("select_chi2", "WITH v AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, l_returnflag AS y, {f} - least((SELECT min({f}) FROM lineitem), 0) AS x FROM lineitem" for f in _FEATURES) + """), g AS (SELECT feature, y, sum(x) AS o, count(*) AS n FROM v GROUP BY 1, 2), t AS (SELECT feature, sum(o) AS t, sum(n) AS n FROM g GROUP BY 1)
SELECT g.feature, round(sum((o - t * g.n / t.n) ^ 2 / (t * g.n / t.n)), 4) AS score FROM g JOIN t ON g.feature = t.feature GROUP BY 1""")
def select_chi2(spark, sf):
    return rounded(select.chi2_scores(table(spark, sf, "lineitem"), _FEATURES, "l_returnflag"), "score", digits=4)


def _vectors(spark, sf, n=64):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", *[F.element_at("embedding", i + 1).cast("double").alias(f"d{i}") for i in range(n)])


_DIMS = [f"d{i}" for i in range(64)]


@register("select_mi")
def select_mi(spark, sf):
    return select.mutual_information(_vectors(spark, sf), _DIMS, "label", ["vec_id"])


@register("select_rf")
def select_rf(spark, sf):
    return select.model_scores(_vectors(spark, sf), _DIMS, "label", "rf", trees=30)


@register("select_gbt")
def select_gbt(spark, sf):
    return select.model_scores(_vectors(spark, sf).withColumn("y", (F.col("label") > 4).cast("int")), _DIMS, "y", "gb", trees=10)


@register("select_rfecv")
def select_rfecv(spark, sf):
    return select.rfecv(_vectors(spark, sf).withColumn("y", (F.col("label") > 4).cast("int")), _DIMS, "y", ["vec_id"])


@register("pca_variance")
def pca_variance(spark, sf):
    return select.pca(_vectors(spark, sf), _DIMS, 0.95)[1]


@register("pca_scree")
def pca_scree(spark, sf):
    return select.scree(select.pca(_vectors(spark, sf), _DIMS, len(_DIMS))[1])


@register("tsne_embedding")
def tsne_embedding(spark, sf):
    return select.embed_2d(_vectors(spark, sf), "vec_id", _DIMS)


# -- scores and resampling ------------------------------------------------------------


def _ruled(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return table(spark, sf, "labels").join(d, "doc_id").withColumn("guess", (F.col("n_chars") > 500).cast("int"))


_RULE = "WITH r AS (SELECT quality::int AS t, toxic::int AS x, (n_chars > 500)::int AS g, n_chars FROM labels JOIN documents USING (doc_id)), c AS (SELECT k, sum((t = k AND g = k)::int)::double AS tp, sum((t = k)::int)::double AS sup, sum((g = k)::int)::double AS said FROM r, (VALUES (0), (1)) v(k) GROUP BY k), s AS (SELECT *, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS p, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS rc FROM c), f AS (SELECT *, CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END AS f1 FROM s)\n"


@register("metrics_macro_f1", _RULE + "SELECT round(sum(tp) / sum(sup), 6) AS accuracy, round(avg(p), 6) AS macro_precision, round(sum(p * sup) / sum(sup), 6) AS weighted_precision, round(avg(rc), 6) AS macro_recall, round(sum(rc * sup) / sum(sup), 6) AS weighted_recall, round(avg(f1), 6) AS macro_f1, round(sum(f1 * sup) / sum(sup), 6) AS weighted_f1 FROM f")
def metrics_f1(spark, sf):
    s = metrics.classification_scores(_ruled(spark, sf), "quality", "guess")
    return rounded(s, *s.columns)


@register("metrics_auc", "WITH r AS (SELECT toxic AS t, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::double AS k FROM labels JOIN documents USING (doc_id)) SELECT sum(t)::bigint AS n_pos, sum(1 - t)::bigint AS n_neg, round((sum(t * k) - sum(t) * (sum(t) + 1) / 2.0::double) / (sum(t) * sum(1 - t)), 6) AS auc FROM r")
def metrics_auc(spark, sf):
    return rounded(metrics.auc(_ruled(spark, sf), F.col("toxic") == 1, "n_chars"), "auc")


@register("metrics_mae_rmse", "SELECT round(avg(abs(l_extendedprice - l_quantity * 1000)), 4) AS mae, round(sqrt(avg((l_extendedprice - l_quantity * 1000) ^ 2)), 4) AS rmse, round(corr(l_extendedprice, l_quantity * 1000), 6) AS corr FROM lineitem")
def metrics_mae(spark, sf):
    s = metrics.regression_scores(table(spark, sf, "lineitem").withColumn("g", F.col("l_quantity") * 1000), "l_extendedprice", "g")
    return rounded(rounded(s, "mae", "rmse", digits=4), "corr")


def _labelled(spark, sf):
    return _ruled(spark, sf).select("doc_id", "toxic", F.col("n_chars").cast("double").alias("n_chars"), (F.col("doc_id") % 97).cast("double").alias("k"))


@register("resample_rus", "SELECT k AS toxic, (SELECT min(n) FROM (SELECT count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY toxic))::bigint AS n FROM (SELECT DISTINCT toxic::bigint AS k FROM labels)")
def resample_rus(spark, sf):
    return resample.undersample(_labelled(spark, sf), "toxic", ["doc_id"]).groupBy(F.col("toxic").cast("long").alias("toxic")).agg(F.count("*").alias("n"))


@register("resample_smote")
def resample_smote(spark, sf):
    return resample.smote(_labelled(spark, sf), "doc_id", ["n_chars", "k"], "toxic").groupBy("toxic", "synthetic").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean"))


@register("resample_adasyn")
def resample_adasyn(spark, sf):
    return resample.adasyn(_labelled(spark, sf), "doc_id", ["n_chars", "k"], "toxic").groupBy("toxic", "synthetic").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean"))


@register("resample_comparison")
def resample_comparison(spark, sf):
    return resample.compare(_labelled(spark, sf), "doc_id", ["n_chars", "k"], "toxic", trees=10)
