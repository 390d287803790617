"""Rasters as rows: (key, height, width, channels, pixels ARRAY<DOUBLE> in row, column, channel order).

What array functions can say stays in SQL; transforms of whole rasters run as Arrow-fed
pandas functions. Every random choice depends on the row's key and a seed only.
"""

from __future__ import annotations

import math
import time
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import SEED, hash_rank, settled
from ..functions import rasters

#: Block tables of a Hamming search at most.
MOST_TABLES = 300


def array_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def array_sd(a: Column, mean: Column) -> Column:
    """Population deviation."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / F.size(a))


def luma(pixels: Column, channels: Column) -> Column:
    """The grey raster of an RGB one; a single channel as it is."""
    n = (F.size(pixels) / channels).cast("int")
    at = lambda i, c: F.element_at(pixels, (i * channels + c + 1).cast("int"))
    mixed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(i, 0) * 0.299 + at(i, 1) * 0.587 + at(i, 2) * 0.114)
    return F.when(channels >= 3, mixed).otherwise(pixels)


def brightness_contrast(df: DataFrame, pixels: str = "pixels", channels: Column | None = None) -> DataFrame:
    """Adds brightness (mean) and contrast (population deviation) of the luma."""
    g = luma(F.col(pixels), channels) if channels is not None else F.col(pixels)
    return df.withColumn("_g", g).withColumn("brightness", array_mean(F.col("_g"))).withColumn("contrast", array_sd(F.col("_g"), F.col("brightness"))).drop("_g")


def brightness_report(df: DataFrame, group: str, value: str = "brightness") -> DataFrame:
    """Per class: mean, sample variance, median, interquartile range and outliers, rounded to 2 places, extremes and the classes above the median of means."""
    q = df.groupBy(group).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("var"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    out = df.join(F.broadcast(q), group).groupBy(group).agg(F.sum(((F.col(value) < F.col("q")[0] - reach) | (F.col(value) > F.col("q")[2] + reach)).cast("long")).alias("n_outliers"))
    s = q.join(out, group).select(group, F.round("mean", 2).alias("mean"), F.round("var", 2).alias("var"), F.round(F.col("q")[1], 2).alias("median"), F.round(F.col("q")[2] - F.col("q")[0], 2).alias("iqr"), "n_outliers")
    marks = s.agg(F.max_by(group, "mean").alias("_hi"), F.min_by(group, "mean").alias("_lo"), F.percentile("mean", F.lit(0.5)).alias("_m"))
    return s.crossJoin(marks).select(*s.columns, (F.col(group) == F.col("_hi")).alias("brightest"), (F.col(group) == F.col("_lo")).alias("darkest"), (F.col("mean") > F.col("_m")).alias("above_median"))  # a row a class


def channel_stats(df: DataFrame, pixels: str = "pixels", channels: int = 1) -> list[tuple[float, float, float, float]]:
    """(low, high, mean, population deviation) of each channel over all rasters: arrays are folded in place, then summed about the overall mean."""

    def of(i: int):
        return F.filter(pixels, lambda v, k: k % channels == i) if channels > 1 else F.col(pixels)

    folded = [(F.array_min(of(i)), F.array_max(of(i)), F.aggregate(of(i), F.lit(0.0), lambda s, v: s + v), F.size(of(i))) for i in range(channels)]
    one = df.agg(*[x for i, (lo, hi, s, n) in enumerate(folded) for x in (F.min(lo).alias(f"lo{i}"), F.max(hi).alias(f"hi{i}"), F.sum(s).alias(f"s{i}"), F.sum(n).alias(f"n{i}"))]).first()
    mean = [one[f"s{i}"] / one[f"n{i}"] if one[f"n{i}"] else None for i in range(channels)]

    def squares(i: int):
        return F.sum(F.aggregate(of(i), F.lit(0.0), lambda s, v: s + (v - F.lit(mean[i])) * (v - F.lit(mean[i])))).alias(f"q{i}")

    q = df.agg(*[squares(i) for i in range(channels)]).first()
    return [(one[f"lo{i}"], one[f"hi{i}"], mean[i], math.sqrt(q[f"q{i}"] / one[f"n{i}"]) if mean[i] is not None else None) for i in range(channels)]


def normalize(df: DataFrame, method: str, pixels: str = "pixels", channels: int = 1, eps: float = 1e-8) -> DataFrame:
    """minmax_01, minmax_m11, zscore_global or zscore_channel with statistics of all rasters; an empty table stays empty."""
    if method not in ("minmax_01", "minmax_m11", "zscore_global", "zscore_channel"):
        raise ValueError(f"unknown method {method}")
    stats = channel_stats(df, pixels, channels if method == "zscore_channel" else 1)
    if stats[0][2] is None:
        return df
    low, high, mean, sd = stats[0]
    if method.startswith("minmax"):
        unit = lambda v: (v - F.lit(low)) / F.lit(high - low + eps)
        return df.withColumn(pixels, F.transform(pixels, unit if method == "minmax_01" else lambda v: 2 * unit(v) - 1))
    if method == "zscore_global":
        return df.withColumn(pixels, F.transform(pixels, lambda v: (v - F.lit(mean)) / F.lit(sd + eps)))
    m, s = (F.array(*[F.lit(x[k]) for x in stats]) for k in (2, 3))
    return df.withColumn(pixels, F.transform(pixels, lambda v, i: (v - F.get(m, i % channels)) / (F.get(s, i % channels) + F.lit(eps))))


def flip(pixels: Column, width: int, channels: int = 1) -> Column:
    """Each row of the raster reversed."""
    n = F.size(pixels)
    w = width * channels

    def source(i: Column) -> Column:
        row, col, ch = F.floor(i / w), F.floor((i % w) / channels), i % channels
        return (row * w + (width - 1 - col) * channels + ch + 1).cast("int")

    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(pixels, source(i)))


def adjust(pixels: Column, alpha: float, beta: float) -> Column:
    """Saturated |alpha * x + beta|."""
    return F.transform(pixels, lambda v: F.least(F.lit(255.0), F.abs(F.round(F.lit(alpha) * v + F.lit(beta)))))


def mse_psnr(a: Column, b: Column) -> tuple[Column, Column]:
    mse = array_mean(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
    return mse, F.when(mse > 0, 20 * F.log10(F.lit(255.0) / F.sqrt(mse)))


def ssim(a: Column, b: Column) -> Column:
    """Structural similarity of two equal-sized grey rasters over one window."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ma, mb = array_mean(a), array_mean(b)
    va = array_mean(F.transform(a, lambda v: v * v)) - ma * ma
    vb = array_mean(F.transform(b, lambda v: v * v)) - mb * mb
    cov = array_mean(F.zip_with(a, b, lambda x, y: x * y)) - ma * mb
    return (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


def sign_hash(pixels: Column) -> Column:
    """64 bits, the first value's highest: 1 where a value is positive."""
    return F.aggregate(pixels, F.lit(0).cast("long"), lambda h, v: F.shiftleft(h, 1).bitwiseOR(F.when(v > 0, 1).otherwise(0).cast("long")))


def _block_masks(n: int) -> list[int]:
    edges = [64 * i // n for i in range(n + 1)]
    return [sum(1 << k for k in range(i, j)) for i, j in zip(edges, edges[1:])]


def block_tables(most: int, n: float, tables: int = MOST_TABLES) -> list[int]:
    """Masks such that two hashes within ``most`` bits agree under one of them at least.

    They are all choices of k of most + k blocks; of the k that ``tables`` allow the one is
    taken that makes the fewest rows and, of ``n`` even hashes, candidates.
    """
    ways = [(k, math.comb(most + k, k)) for k in range(1, 65 - most) if k == 1 or math.comb(most + k, k) <= tables]
    k, _ = min(ways, key=lambda w: w[1] * (n + n * n / 2.0 ** (64 * w[0] / (most + w[0]))))
    return [sum(x) for x in combinations(_block_masks(most + k), k)]


#: Tables up to which a pair is told from its first common one, instead of by removing repeats.
FEW_TABLES = 32


def near_hashes(hashes: DataFrame, most: int = 10) -> DataFrame:
    """(h, g, distance) of all pairs h < g of the distinct ``hashes(h)`` within ``most`` bits, each once, by permuted block tables."""
    signed = [m - (1 << 64) if m >> 63 else m for m in block_tables(most, hashes.count())]
    cells = F.array(*[F.struct(F.lit(i).alias("t"), F.col("h").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(signed)])
    rows = hashes.select("h", F.inline(cells))
    x = F.col("h").bitwiseXOR(F.col("g"))
    both = rows.join(rows.withColumnRenamed("h", "g"), ["t", "part"]).where((F.col("h") < F.col("g")) & (F.bit_count(x) <= most))
    if len(signed) <= FEW_TABLES:
        first = F.lit(-1)
        for i in range(len(signed) - 1, -1, -1):
            first = F.when(x.bitwiseAND(F.lit(signed[i])) == 0, F.lit(i)).otherwise(first)
        return both.where(first == F.col("t")).select("h", "g", F.bit_count(x).cast("int").alias("distance"))
    return both.select("h", "g", F.bit_count(x).cast("int").alias("distance")).distinct()


def hamming_pairs(df: DataFrame, key: str, bits: str, most: int = 10) -> DataFrame:
    """(a, b, distance) of all pairs a < b within ``most`` bits. Distinct hashes are searched; only pairs that are asked for are written out."""
    rows = df.where(F.col(bits).isNotNull()).select(F.col(key).alias("k"), F.col(bits).alias("h"))
    near = near_hashes(rows.select("h").distinct(), most)
    a, b = rows.select(F.col("k").alias("a"), "h"), rows.select(F.col("k").alias("b"), F.col("h").alias("g"))
    apart = near.join(a, "h").join(b, "g").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")
    equal = a.join(b, F.col("h") == F.col("g")).where("a < b").select("a", "b", F.lit(0).alias("distance"))
    return apart.unionByName(equal)


def greedy_duplicates(pairs: DataFrame) -> DataFrame:
    """(key, kept_by): rows removed by the rule that a kept row removes all later ones near it, in order of key; the first kept row near each.

    In each round the open rows without an open earlier partner are kept and those near
    them go, so the order of decisions is the greedy one without visiting rows one by one.
    Every round is a checkpoint of the pairs that are still open.
    """
    whole = settled(pairs.select("a", "b").distinct())
    open_, gone = whole, None
    while not open_.isEmpty():
        kept = open_.select(F.col("a").alias("k")).distinct().join(open_.select(F.col("b").alias("k")), "k", "left_anti")
        out = settled(open_.join(kept.withColumnRenamed("k", "a"), "a", "left_semi").select(F.col("b").alias("key")).distinct())
        gone = out if gone is None else gone.unionByName(out)
        left = open_.join(kept.withColumnRenamed("k", "a"), "a", "left_anti")
        for side in ("a", "b"):
            left = left.join(out.withColumnRenamed("key", side), side, "left_anti")
        open_ = settled(left.select("a", "b"))
    if gone is None:
        return whole.select(F.col("b").alias("key"), F.col("a").alias("kept_by"))
    by_kept = whole.join(gone.withColumnRenamed("key", "a"), "a", "left_anti")
    return by_kept.join(gone.withColumnRenamed("key", "b"), "b", "left_semi").groupBy(F.col("b").alias("key")).agg(F.min("a").alias("kept_by"))


def hash_duplicates(df: DataFrame, key: str, bits: str, most: int = 10) -> DataFrame:
    """``greedy_duplicates`` of ``hamming_pairs`` without the pairs: of rows with one hash the first decides.

    Later ones lie near whatever removed it, or near it if it is kept. Rows are hashed once.
    """
    rows = settled(df.where(F.col(bits).isNotNull()).select(F.col(key).alias("k"), F.col(bits).alias("h")))
    firsts = settled(rows.groupBy("h").agg(F.min("k").alias("first")))
    a, b = firsts.withColumnRenamed("first", "a").hint("merge"), firsts.select(F.col("h").alias("g"), F.col("first").alias("b")).hint("merge")
    gone = greedy_duplicates(near_hashes(firsts.select("h"), most).join(a, "h").join(b, "g").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    judged = firsts.join(gone.withColumnRenamed("key", "first").hint("merge"), "first", "left")
    later = rows.join(judged.hint("merge"), "h").where((F.col("k") != F.col("first")) | F.col("kept_by").isNotNull())
    return later.select(F.col("k").alias("key"), F.coalesce("kept_by", "first").alias("kept_by"))


def _shape(row) -> np.ndarray:
    h, w, c, px = row
    x = np.asarray(px, dtype=float)
    return x.reshape(h, w) if c == 1 else x.reshape(h, w, c)


def _shaped(h: pd.Series, w: pd.Series, c: pd.Series, px: pd.Series):
    return map(_shape, zip(h, w, c, px))


_RASTER = ["height", "width", "channels", "pixels"]
_OUT = "height int, width int, channels int, pixels array<double>"


def _boxed(xs) -> pd.DataFrame:
    return pd.DataFrame([(x.shape[0], x.shape[1], 1 if x.ndim == 2 else x.shape[2], np.asarray(x, dtype=float).ravel()) for x in xs], columns=_RASTER)


#: Values of made rasters that one Arrow batch holds, or one raster.
BATCH_VALUES = 1 << 18


def apply_raster(df: DataFrame, f, name: str = "raster") -> DataFrame:
    """Replaces the raster columns by f(raster), in batches of at most ``BATCH_VALUES`` made values, as rasters may grow."""
    made = T._parse_datatype_string(_OUT)
    schema = T.StructType([made[x.name] if x.name in _RASTER else x for x in df.schema])

    def run(batches):
        for batch in batches:
            at = {c: batch.schema.get_field_index(c) for c in _RASTER}
            rows = zip(*(batch.column(at[c]).to_pylist() for c in _RASTER[:3]), batch.column(at["pixels"]))
            first, xs, held = 0, [], 0
            for i, (h, w, c, px) in enumerate(rows):
                xs.append(f(_shape((h, w, c, px.values.to_numpy(zero_copy_only=False)))))
                held += xs[-1].size
                if held >= BATCH_VALUES or i == batch.num_rows - 1:
                    part = batch.slice(first, len(xs)).columns
                    for k, one in zip(_RASTER, zip(*_boxed(xs).itertuples(index=False))):
                        part[at[k]] = pa.array(one, pa.list_(pa.float64()) if k == "pixels" else pa.int32())
                    yield pa.RecordBatch.from_arrays(part, batch.schema.names)
                    first, xs, held = i + 1, [], 0

    return df.mapInArrow(run, schema)


def resize(df: DataFrame, size: int) -> DataFrame:
    if size not in (32, 64, 128):
        raise ValueError("size is 32, 64 or 128")
    return apply_raster(df, lambda x: rasters.resize(x, size, size))


def convert_color(df: DataFrame, space: str) -> DataFrame:
    return apply_raster(df, lambda x: rasters.convert(x, space))


def quality(df: DataFrame, size: int) -> DataFrame:
    """Adds psnr and ssim of each raster against its version of the given size."""

    @F.pandas_udf("psnr double, ssim double")
    def run(h: pd.Series, w: pd.Series, c: pd.Series, px: pd.Series) -> pd.DataFrame:
        out = []
        for x in _shaped(h, w, c, px):
            small = rasters.resize(x, size, size)
            out.append((rasters.psnr(x, small), rasters.ssim(x, small)))
        return pd.DataFrame(out, columns=["psnr", "ssim"])

    return df.withColumn("_q", run(*_RASTER)).withColumns({"psnr": F.col("_q.psnr"), "ssim": F.col("_q.ssim")}).drop("_q")


def phash(df: DataFrame) -> DataFrame:
    """Adds ``phash``."""

    @F.pandas_udf("long")
    def run(h: pd.Series, w: pd.Series, c: pd.Series, px: pd.Series) -> pd.Series:
        return pd.Series([rasters.phash(x) for x in _shaped(h, w, c, px)], dtype="int64")

    return df.withColumn("phash", run(*_RASTER))


def edge_densities(df: DataFrame, keys: list[str], size: int = 128) -> DataFrame:
    """(keys, method, edge_density) in long form."""

    @F.pandas_udf("array<struct<method:string,edge_density:double>>")
    def run(h: pd.Series, w: pd.Series, c: pd.Series, px: pd.Series) -> pd.Series:
        return pd.Series([[{"method": k, "edge_density": float(v)} for k, v in rasters.edge_densities(x, size).items()] for x in _shaped(h, w, c, px)])

    return df.select(*keys, F.inline(run(*_RASTER)))


OPERATIONS = ("flip", "rotate", "crop", "noise", "adjust")


#: An operation by name, or a tuple of its name and fixed parameters.
Step = str | tuple


def _one(x: np.ndarray, step: Step, rng: np.random.Generator) -> np.ndarray:
    name, *given = (step,) if isinstance(step, str) else step
    if name == "flip":
        return rasters.flip(x)
    if name == "rotate":
        return rasters.rotate(x, *(given or [float(rng.uniform(-180, 180))]))
    if name == "crop":
        return rasters.crop(x, *(given or [0.8]), rng)
    if name == "noise":
        return rasters.noise(x, *(given or [0, float(rng.uniform(10, 30))]), rng)
    return rasters.adjust(x, *(given or [float(rng.uniform(0.8, 1.2)), float(rng.uniform(-30, 30))]))


def run_pipeline(x: np.ndarray, names: list[Step] | tuple[Step, ...], seed: int) -> np.ndarray:
    """Operations in order; a seed makes them reproducible."""
    rng = np.random.default_rng(abs(seed))
    for n in names:
        x = _one(x, n, rng)
    return np.ascontiguousarray(x)


def _augmented(df: DataFrame, names: tuple[Step, ...] | None) -> DataFrame:
    """Rasters after the named operations, or after one to three of all of them chosen by ``_seed``."""

    @F.pandas_udf(_OUT)
    def run(h: pd.Series, w: pd.Series, c: pd.Series, px: pd.Series, seed: pd.Series) -> pd.DataFrame:
        out = []
        for x, s in zip(_shaped(h, w, c, px), seed):
            rng = np.random.default_rng(abs(int(s)))
            chosen = names or [OPERATIONS[i] for i in rng.choice(len(OPERATIONS), int(rng.integers(1, 4)), replace=False)]
            out.append(run_pipeline(x, chosen, int(s)))
        return _boxed(out)

    return df.withColumn("_r", run(*_RASTER, "_seed")).withColumns({k: F.col(f"_r.{k}") for k in _RASTER}).drop("_r")


def augment(df: DataFrame, key: str, label: str, target: int | None = None, keep_original: bool = True, names: tuple[Step, ...] | None = None, seed: int = SEED) -> DataFrame:
    """Classes below ``target`` (the largest by default) are filled up by sources taken in turn; adds copy (0: original)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    high = target or counts.agg(F.max("_n")).first()[0] or 0
    placed = hash_rank(df, label, [key], seed, "_at").drop("_at_of").join(F.broadcast(counts), label)  # a row a class
    need = F.greatest(F.lit(0), F.lit(high) - F.col("_n"))
    times = F.floor(need / F.col("_n")).cast("int") + (F.col("_at") < need % F.col("_n")).cast("int")
    copies = placed.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times))).withColumn("_seed", F.xxhash64(key, "copy", F.lit(seed)))
    made = _augmented(copies, names).select(*df.columns, "copy")
    return df.withColumn("copy", F.lit(0)).unionByName(made) if keep_original else made


LEADS = ("flip", "rotate", "crop", "noise", "adjust")
SINGLE = [(x,) for x in LEADS]
THREE = [tuple(x) for x in combinations(LEADS, 3)]
#: Five steps each: two settings of a leading operation, then the others at fixed settings.
VARIANTS: dict[str, tuple[Step, ...]] = {
    **{f"lead_rotate_{v:+}": (("rotate", v), ("adjust", 1.1, 10), ("crop", 0.85), ("noise", 0, 15), "flip") for v in (20, -20)},
    **{f"lead_crop_{v:.2f}": (("crop", v), ("adjust", 1.1, 10), ("rotate", 10), ("noise", 0, 15), "flip") for v in (0.9, 0.6)},
    **{f"lead_noise_{v}": (("noise", 0, v), ("adjust", 1.1, 10), ("rotate", 10), ("crop", 0.85), "flip") for v in (10, 30)},
    **{f"lead_adjust_{a}": (("adjust", a, b), ("rotate", 10), ("crop", 0.85), ("noise", 0, 15), "flip") for a, b in ((1.3, 20), (0.7, -20))},
}
PIPELINES: dict[str, tuple[Step, ...]] = {"+".join(x): x for x in SINGLE + THREE} | VARIANTS


def augmentation_experiment(df: DataFrame, key: str, label: str, pipelines: dict[str, tuple[Step, ...]] = PIPELINES, seed: int = SEED) -> DataFrame:
    """(pipeline, accuracy, macro_precision, macro_recall, macro_f1) of logistic regression on pixels after each pipeline balanced the training classes."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    from ..core import stratified_fraction
    from .metrics import classification_scores

    split = stratified_fraction(df, label, 0.2, [key], seed).cache()
    test = split.where("in_sample").select(F.col(label).cast("double").alias("label"), array_to_vector("pixels").alias("features"))
    rows = []
    for name, names in pipelines.items():
        train = augment(split.where("not in_sample").drop("in_sample"), key, label, names=names, seed=seed)
        model = LogisticRegression(maxIter=30, regParam=0.01).fit(train.select(F.col(label).cast("double").alias("label"), array_to_vector("pixels").alias("features")))
        s = classification_scores(model.transform(test), "label", "prediction").first()
        rows.append((name, s["accuracy"], s["macro_precision"], s["macro_recall"], s["macro_f1"]))
    split.unpersist()
    return df.sparkSession.createDataFrame(rows, "pipeline string, accuracy double, macro_precision double, macro_recall double, macro_f1 double")


def color_space_scores(df: DataFrame, key: str, label: str, spaces: tuple[str, ...] = ("RGB", "HSV", "LAB", "Grayscale"), components: int = 50, size: int = 16, seed: int = SEED) -> DataFrame:
    """(space, variance_ratio, weighted precision, recall, f1) of logistic regression on principal components of each colour space."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    from ..core import stratified_fraction
    from .metrics import classification_scores

    rows = []
    for space in spaces:
        data = apply_raster(df, lambda x, s=space: rasters.resize(rasters.convert(x, s), size, size))
        data = stratified_fraction(data.select(key, F.col(label).cast("double").alias("label"), array_to_vector("pixels").alias("raw")), "label", 0.2, [key], seed).cache()
        width = len(data.first()["raw"])
        scaled = StandardScaler(withMean=True, withStd=True, inputCol="raw", outputCol="z").fit(data).transform(data)
        model = PCA(k=min(components, width), inputCol="z", outputCol="features").fit(scaled)
        scored = model.transform(scaled)
        lr = LogisticRegression(maxIter=30, regParam=0.01).fit(scored.where("not in_sample"))
        s = classification_scores(lr.transform(scored.where("in_sample")), "label", "prediction").first()
        rows.append((space, float(sum(model.explainedVariance)), s["weighted_precision"], s["weighted_recall"], s["weighted_f1"]))
        data.unpersist()
    return df.sparkSession.createDataFrame(rows, "space string, variance_ratio double, weighted_precision double, weighted_recall double, weighted_f1 double")


def resize_ablation(df: DataFrame, key: str, label: str, sizes: tuple[int, ...] = (128, 64, 32), folds: int = 3, iterations: int = 20, seed: int = SEED) -> DataFrame:
    """(size, psnr, ssim, accuracy, macro_precision, macro_recall, macro_f1, seconds): quality and cross-validated logistic regression on the pixels at each size."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    from ..core import stratified_folds
    from .metrics import classification_scores

    # folds are dealt before rasters grow, and no grown raster is shuffled
    data = settled(stratified_folds(df.select(key, F.col(label).cast("double").alias("label"), *_RASTER), "label", folds, [key], seed))

    def grown(part: Column, size: int) -> DataFrame:
        return resize(data.where(part).select("label", *_RASTER), size).select("label", array_to_vector(F.transform("pixels", lambda v: v / 255)).alias("features"))

    rows = []
    for size in sizes:
        began = time.monotonic()
        q = quality(df, size).agg(F.avg("psnr"), F.avg("ssim")).first()
        scores = []
        for i in range(folds):
            model = LogisticRegression(maxIter=iterations, regParam=0.0001).fit(grown(F.col("fold") != i, size))
            s = classification_scores(model.transform(grown(F.col("fold") == i, size)), "label", "prediction").first()
            scores.append([s[k] for k in ("accuracy", "macro_precision", "macro_recall", "macro_f1")])
        rows.append((size, q[0], q[1], *(float(v) for v in np.mean(scores, axis=0)), time.monotonic() - began))
    return df.sparkSession.createDataFrame(rows, "size int, psnr double, ssim double, accuracy double, macro_precision double, macro_recall double, macro_f1 double, seconds double")


METHODS = ("minmax_01", "minmax_m11", "zscore_global", "zscore_channel")
EVALUATED_ROWS = 20_000


def normalization_curves(df: DataFrame, key: str, label: str, methods: tuple[str, ...] = METHODS, channels: int = 1, components: int = 50, epochs: int = 30, repeats: int = 3, rate: float = 0.01, rows: int = EVALUATED_ROWS, seed: int = SEED) -> DataFrame:
    """(method, repeat, epoch, accuracy, weighted_precision, weighted_recall, weighted_f1) on a held-out fifth, after each epoch.

    Rasters are normalised and projected to principal components in Spark; each repeat of
    each method then trains softmax regression by stochastic gradients, one bounded task
    each, on at most ``rows`` rasters chosen by hash.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from ..core import sample_exact

    chosen = sample_exact(df.select(key, label, "pixels"), rows, [key], seed)
    data = None
    for m in methods:
        normal = normalize(chosen, m, channels=channels).select(key, label, array_to_vector("pixels").alias("raw"))
        width = len(normal.first()["raw"])
        scored = PCA(k=min(components, width), inputCol="raw", outputCol="pc").fit(normal).transform(normal)
        one = scored.select(F.lit(m).alias("method"), F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), vector_to_array("pc").alias("x"))
        data = one if data is None else data.unionByName(one)
    data = data.withColumn("repeat", F.explode(F.array(*[F.lit(i) for i in range(repeats)])))
    names = ["method", "repeat", "epoch", "accuracy", "weighted_precision", "weighted_recall", "weighted_f1"]

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        method, repeat = pdf["method"].iloc[0], int(pdf["repeat"].iloc[0])
        x, (classes, y) = np.stack(pdf["x"]), np.unique(pdf["label"], return_inverse=True)
        rng = np.random.default_rng(seed + repeat)
        order = rng.permutation(len(x))
        cut = max(1, len(x) // 5)
        scores = rasters.softmax_epochs(x, y, len(classes), order[cut:], order[:cut], epochs, rate, rng)
        return pd.DataFrame([(method, repeat, i + 1, *s) for i, s in enumerate(scores)], columns=names)

    return data.groupBy("method", "repeat").applyInPandas(train, "method string, repeat int, epoch int, accuracy double, weighted_precision double, weighted_recall double, weighted_f1 double")


def normalization_scores(curves: DataFrame) -> DataFrame:
    """Means over repeats after the last epoch, by method."""
    last = curves.groupBy("method", "repeat").agg(F.max_by(F.struct("accuracy", "weighted_precision", "weighted_recall", "weighted_f1"), "epoch").alias("s"))
    return last.groupBy("method").agg(*[F.avg(f"s.{c}").alias(c) for c in ("accuracy", "weighted_precision", "weighted_recall", "weighted_f1")])


def pixel_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, channel, value): one row for each sample."""
    return df.select(*keys, "channels", F.posexplode("pixels").alias("_p", "value")).select(*keys, (F.col("_p") % F.col("channels")).alias("channel"), "value")
