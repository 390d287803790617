"""The relations behind the usual plots, as small frames ready to draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import sample_exact
from ..functions import hypothesis
from ..functions.order import ecdf
from ..operators import images, profile, select, series


def class_distribution_frame(df: DataFrame, label: str) -> DataFrame:
    """Counts with marks of the largest and smallest class."""
    c = profile.class_counts(df, label)
    m = c.agg(F.max("n").alias("_hi"), F.min("n").alias("_lo"))
    return c.crossJoin(m).select(*c.columns, (F.col("n") == F.col("_hi")).alias("is_max"), (F.col("n") == F.col("_lo")).alias("is_min"))  # a row a class


def histogram_frame(df: DataFrame, keys: list[str], bins: int = 100) -> DataFrame:
    """(channel, bin, n, density) of raster samples over 0..255."""
    rows, out = images.pixel_rows(df, keys).cache(), None
    for c in [r[0] for r in rows.select("channel").distinct().collect()]:
        one = profile.histogram(rows.where(F.col("channel") == c), "value", bins, 0.0, 255.0).withColumn("channel", F.lit(c))
        out = one if out is None else out.unionByName(one)
    return out


def density_frame(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """(by, x, density)."""
    if by is None:
        return profile.kde(df, value)
    out = None
    for k in [r[0] for r in df.select(by).distinct().orderBy(by).collect()]:
        one = profile.kde(df.where(F.col(by) == k), value).withColumn(by, F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def column_distribution_frame(df: DataFrame, value: str) -> DataFrame:
    """(kind, x, y): a 30-bin density and the density curve."""
    low, high = df.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    h = profile.histogram(df, value, 30, low, high).select(F.lit("bin").alias("kind"), (F.lit(low) + (F.col("bin") + 0.5) * ((high - low) / 30)).alias("x"), F.col("density").alias("y"))
    return h.unionByName(profile.kde(df, value).select(F.lit("kde").alias("kind"), "x", F.col("density").alias("y")))


def ks_frame(a: DataFrame, b: DataFrame) -> DataFrame:
    """(sample, value, ecdf, gap): both step curves over all values, and their gap."""
    x, y = ecdf(a, "value").select("value", F.col("ecdf").alias("fa")), ecdf(b, "value").select("value", F.col("ecdf").alias("fb"))
    from pyspark.sql import Window as W

    both = x.join(y, "value", "full")
    w = W.orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    f = both.select("value", F.coalesce(F.last("fa", True).over(w), F.lit(0.0)).alias("ecdf_a"), F.coalesce(F.last("fb", True).over(w), F.lit(0.0)).alias("ecdf_b"))
    return f.withColumn("gap", F.abs(F.col("ecdf_a") - F.col("ecdf_b")))


def ks_summary_frame(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """D, p floored at 1e-300, its logarithm, the decision, and whether p needs a log scale."""
    p = F.greatest("p_value", F.lit(1e-300))
    t = tests.withColumn("p_shown", p).withColumn("log10_p", F.log10(p)).withColumn("rejected", F.col("p_value") <= alpha)
    m = t.agg((F.max("p_shown") / F.min("p_shown") > 100).alias("log_scale"))
    return t.crossJoin(m)  # one row


def violin_frame(before: DataFrame, after: DataFrame, value: str, keys: list[str], rows: int = 3000) -> DataFrame:
    """(stage, value) of a bounded hash sample of each side."""
    one = lambda d, s: sample_exact(d.select(*keys, value), rows, keys).select(F.lit(s).alias("stage"), value)
    return one(before, "before").unionByName(one(after, "after"))


acf_frame, pacf_frame = series.acf, series.pacf


def dedupe_frame(total: int, removed: DataFrame) -> DataFrame:
    """(stage, n) before and after."""
    r = removed.agg(F.count("*").alias("r"))
    return r.select(F.inline(F.array(F.struct(F.lit("before").alias("stage"), F.lit(total).cast("long").alias("n")), F.struct(F.lit("after").alias("stage"), (F.lit(total).cast("long") - F.col("r")).alias("n")))))


def phash_frame(pairs: DataFrame, limit: int = 10) -> DataFrame:
    return pairs.withColumn("is_duplicate", F.col("distance") <= limit)


def normalization_frame(df: DataFrame, methods: tuple[str, ...] = ("minmax_01", "minmax_m11", "zscore_global"), bins: int = 100) -> DataFrame:
    """(method, bin, n, density) of the samples after each normalisation."""
    out = None
    for m in methods:
        rows = images.pixel_rows(images.normalize(df, m), [])
        one = profile.histogram(rows, "value", bins).withColumn("method", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


def selection_frame(scores: dict[str, DataFrame]) -> DataFrame:
    """(method, feature, score) in long form."""
    out = None
    for m, s in scores.items():
        one = s.select(F.lit(m).alias("method"), "feature", "score")
        out = one if out is None else out.unionByName(one)
    return out


def series_frame(df: DataFrame, days: int = 7) -> DataFrame:
    return df.withColumn(f"ma_{days}", series.rolling(series.over(), "y", days))


def rolling_frame(df: DataFrame, stat: str = "mean", windows: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    w = series.over()
    return df.withColumns({f"{stat}_{k}": series.rolling(w, "y", k, stat) for k in windows})


def anomaly_frame(df: DataFrame, methods: tuple[str, ...] = ("z-score", "iforest", "stl")) -> DataFrame:
    """(method, d, y) of all flagged points."""
    out = None
    for m in methods:
        one = series.anomalies(df, m).where("is_anomaly").select(F.lit(m).alias("method"), "d", "y")
        out = one if out is None else out.unionByName(one)
    return out


def box_frame(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return profile.five_numbers(df, value, by)


def scree_frame(table: DataFrame) -> DataFrame:
    return select.scree(table)


def component_frame(df: DataFrame, features: list[str], label: str, n: int = 2) -> DataFrame:
    """The first two or three components and the label."""
    return select.pca(df, features, n)[0].select(label, *[f"component_{i + 1}" for i in range(n)])


def ssim_frame(df: DataFrame, sizes: tuple[int, ...] = (32, 64)) -> DataFrame:
    """(size, psnr, ssim) averaged over rasters, by size."""
    out = None
    for s in sizes:
        one = images.quality(df, s).agg(F.lit(s).alias("size"), F.avg("psnr").alias("psnr"), F.avg("ssim").alias("ssim"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy("size")


def heatmap_frame(pairs: DataFrame) -> DataFrame:
    """The lower triangle of a correlation matrix in long form."""
    return pairs.select(F.greatest("col_a", "col_b").alias("row"), F.least("col_a", "col_b").alias("col"), "r")


embedding_frame, causality_frame = select.embed_2d, series.causality_edges


def decomposition_frame(decomposed: DataFrame) -> DataFrame:
    """(d, part, value) of observed, trend, seasonal and residual."""
    return decomposed.select("d", F.col("y").alias("observed"), "trend", "seasonal", "resid").unpivot(["d"], ["observed", "trend", "seasonal", "resid"], "part", "value")


def levene_frame(before: DataFrame, after: DataFrame) -> DataFrame:
    both = hypothesis.stack_numeric(before).withColumn("stage", F.lit("before")).unionByName(hypothesis.stack_numeric(after).withColumn("stage", F.lit("after")))
    return hypothesis.with_f_p(hypothesis.levene_w(both, "value", "stage", by=["column"]), 0.05, strict=False)
