"""Feature scores, selection by models, and principal components."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..core import SEED, sample_exact, stratified_folds, stratified_fraction
from ..functions.hypothesis import anova_f
from .metrics import classification_scores


def _long(df: DataFrame, features: list[str], y: str, key: Column | None = None) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    return df.select(F.col(y).alias("_y"), F.inline(cells))


def anova_scores(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """(feature, score): one-way F of every feature over the classes, in one aggregate."""
    return anova_f(_long(df, features, y), "x", "_y", by=["feature"]).select("feature", F.col("statistic").alias("score"))


def chi2_scores(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """(feature, score): chi-square of per-class sums against class shares; negative features are shifted to 0."""
    lows = df.agg(*[F.least(F.min(f).cast("double"), F.lit(0.0)).alias(f) for f in features]).first()
    shifted = df.select(y, *[(F.col(f).cast("double") - F.lit(lows[f])).alias(f) for f in features])
    g = _long(shifted, features, y).groupBy("feature", "_y").agg(F.sum("x").alias("o"), F.count("*").alias("n"))
    t = g.groupBy("feature").agg(F.sum("o").alias("t"), F.sum("n").alias("all"))
    e = F.col("t") * F.col("n") / F.col("all")
    return g.join(t, "feature").groupBy("feature").agg(F.sum((F.col("o") - e) ** 2 / e).alias("score"))


def mutual_information(df: DataFrame, features: list[str], y: str, keys: list[str], k: int = 3) -> DataFrame:
    """(feature, score): Ross's nearest-neighbour estimate for a continuous feature and classes.

    In one dimension the k nearest of a row's class are among the k rows either side of it
    in order, and the rows within that radius are counted by rank; both come from windows
    over (feature, class) and (feature). Ties are broken by a tiny hashed jitter.
    """
    sd = df.agg(*[F.stddev_pop(f).alias(f) for f in features]).first()
    jitter = (F.pmod(F.xxhash64(*keys, F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30)) - 0.5) * 1e-10
    scaled = df.select(y, *[(F.col(f).cast("double") / F.lit(sd[f] or 1.0) + jitter).alias(f) for f in features])
    rows = _long(scaled, features, y)
    own = W.partitionBy("feature", "_y").orderBy("x")
    gaps = [F.abs(F.col("x") - F.lag("x", i).over(own)) for i in range(1, k + 1)] + [F.abs(F.lead("x", i).over(own) - F.col("x")) for i in range(1, k + 1)]
    near = F.array_sort(F.filter(F.array(*gaps), lambda g: g.isNotNull()))
    kk = F.least(F.size(near), F.lit(k))
    rows = rows.withColumn("_n", F.count("*").over(W.partitionBy("feature", "_y"))).withColumn("_g", near).withColumn("_k", F.least(kk, F.col("_n") - 1))
    rows = rows.where("_n > 1").withColumn("_r", F.element_at("_g", F.col("_k").cast("int")) * (1 - 1e-6))
    # rows within the radius: positions of x - r and x + r among all x of the feature
    marks = rows.select("feature", F.explode(F.array(F.struct(F.col("x").alias("v"), F.lit(1).alias("row"), F.lit(1).alias("side")), F.struct((F.col("x") - F.col("_r")).alias("v"), F.lit(0).alias("row"), F.lit(0).alias("side")), F.struct((F.col("x") + F.col("_r")).alias("v"), F.lit(0).alias("row"), F.lit(2).alias("side")))).alias("m"), "_n", "_k").select("feature", "m.*", "_n", "_k")
    placed = marks.withColumn("_upto", F.sum("row").over(W.partitionBy("feature").orderBy("v", "side").rowsBetween(W.unboundedPreceding, 0)))
    # digamma needs each row's own count: pair the two marks of a row by its interval
    both = rows.withColumn("_lo", F.col("x") - F.col("_r")).withColumn("_hi", F.col("x") + F.col("_r"))
    ranks = placed.where("side <> 1").groupBy("feature", "side", "v").agg(F.max("_upto").alias("_upto"))
    low = ranks.where("side = 0").select("feature", F.col("v").alias("_lo"), F.col("_upto").alias("_a"))
    high = ranks.where("side = 2").select("feature", F.col("v").alias("_hi"), F.col("_upto").alias("_b"))
    m = both.join(low, ["feature", "_lo"]).join(high, ["feature", "_hi"]).select("feature", "_n", "_k", (F.col("_b") - F.col("_a")).alias("m"))
    psi = _digamma
    out = m.groupBy("feature").agg(F.count("*").alias("n"), F.avg(psi(F.col("_k"))).alias("k"), F.avg(psi(F.col("_n"))).alias("c"), F.avg(psi(F.greatest(F.col("m"), F.lit(1)))).alias("m"))
    return out.select("feature", F.greatest(F.lit(0.0), psi(F.col("n")) + F.col("k") - F.col("c") - F.col("m")).alias("score"))


def _digamma(x: Column) -> Column:
    """The digamma function of counts: recurrence to 6, then its asymptotic series."""
    x = x.cast("double")
    shift = F.aggregate(F.sequence(F.lit(0), F.lit(5)), F.lit(0.0), lambda a, i: a + F.when(x + i < 6, -1 / (x + i)).otherwise(0.0))
    z = F.when(x < 6, F.lit(6.0) + (x - F.floor(x))).otherwise(x)
    f = 1 / (z * z)
    return shift + F.log(z) - 0.5 / z - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def assembled(df: DataFrame, features: list[str], y: str | None = None) -> DataFrame:
    """``df`` with a vector ``features`` and, for a class column, its index ``label``."""
    out = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df.drop("features"))
    if y:
        out = out.withColumn("_y", F.col(y).cast("string")).drop("label")
        out = StringIndexer(inputCol="_y", outputCol="label", stringOrderType="alphabetAsc").fit(out).transform(out).drop("_y")
    return out


def _importances(df: DataFrame, features: list[str], y: str, model: str, trees: int, seed: int) -> np.ndarray:
    data = assembled(df, features, y)
    if model == "rf":
        return RandomForestClassifier(numTrees=trees, maxDepth=8, seed=seed).fit(data).featureImportances.toArray()
    gbt = GBTClassifier(maxIter=trees, maxDepth=3, seed=seed)
    if data.agg(F.max("label")).first()[0] <= 1:
        return gbt.fit(data).featureImportances.toArray()
    return np.mean([m.featureImportances.toArray() for m in OneVsRest(classifier=gbt).fit(data).models], axis=0)


def model_scores(df: DataFrame, features: list[str], y: str, model: str = "rf", trees: int = 100, seed: int = SEED) -> DataFrame:
    """(feature, score): impurity importances of a random forest (rf) or boosted trees (gb)."""
    values = _importances(df, features, y, model, trees, seed)
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, score double")


STATISTICAL = {"anova": anova_scores, "chi2": chi2_scores}


def select(df: DataFrame, features: list[str], y: str, method: str, k: int, keys: list[str] | None = None) -> list[str]:
    """The k best features, in their original order; method: anova, chi2, mutual_info (mi), rf, gb."""
    if k <= 0:
        raise ValueError("k is positive")
    if method in STATISTICAL:
        scores = STATISTICAL[method](df, features, y)
    elif method in ("mutual_info", "mi"):
        scores = mutual_information(df, features, y, keys or features)
    elif method in ("rf", "gb"):
        scores = model_scores(df, features, y, method)
    else:
        raise ValueError(f"unknown method {method}")
    best = {r["feature"] for r in scores.orderBy(F.desc_nulls_last("score"), "feature").limit(k).collect()}
    return [f for f in features if f in best]


def cross_validated_f1(df: DataFrame, features: list[str], y: str, keys: list[str], folds: int = 5, trees: int = 100, seed: int = SEED) -> float:
    """Mean macro-F1 of random forests over stratified folds."""
    data = assembled(stratified_folds(df, y, folds, keys, seed), features, y).select("fold", "features", "label").cache()

    def score(i: int) -> float:
        model = RandomForestClassifier(numTrees=trees, maxDepth=8, seed=seed).fit(data.where(F.col("fold") != i))
        scored = model.transform(data.where(F.col("fold") == i))
        return classification_scores(scored, "label", "prediction").first()["macro_f1"]

    with ThreadPoolExecutor(folds) as pool:  # the folds' jobs are small and wait for the driver
        out = list(pool.map(score, range(folds)))
    data.unpersist()
    return float(np.mean(out))


def rfecv(df: DataFrame, features: list[str], y: str, keys: list[str], folds: int = 5, trees: int = 20, seed: int = SEED) -> DataFrame:
    """(n_features, features, score) of recursive elimination, one feature a step."""
    left, rows = list(features), []
    while left:
        rows.append((len(left), list(left), cross_validated_f1(df, left, y, keys, folds, trees, seed)))
        if len(left) == 1:
            break
        worst = int(np.argmin(_importances(df, left, y, "rf", trees, seed)))
        left.pop(worst)
    return df.sparkSession.createDataFrame(rows, "n_features long, features array<string>, score double")


def pca(df: DataFrame, features: list[str], n_components: int | float) -> tuple[DataFrame, DataFrame]:
    """Centred principal components: ``df`` with component_i, and (component, variance_ratio, cumulative).

    A fraction keeps the fewest components whose ratios reach it. The largest loading of each is positive.
    """
    data = assembled(df, features)
    centred = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred").fit(data).transform(data)
    model = PCA(k=len(features), inputCol="centred", outputCol="scores").fit(centred)
    ratio = model.explainedVariance.toArray()
    total = np.cumsum(ratio)
    k = int(np.searchsorted(total, n_components - 1e-12) + 1) if isinstance(n_components, float) else min(n_components, len(features))
    loadings = model.pc.toArray()
    sign = np.where(np.take_along_axis(loadings, np.abs(loadings).argmax(axis=0)[None, :], axis=0)[0] < 0, -1.0, 1.0)
    scores = vector_to_array("scores")
    out = model.transform(centred).withColumns({f"component_{i + 1}": scores[i] * F.lit(float(sign[i])) for i in range(k)}).drop("features", "centred", "scores")
    table = df.sparkSession.createDataFrame([(i + 1, float(ratio[i]), float(total[i])) for i in range(k)], "component long, variance_ratio double, cumulative double")
    return out, table


def scree(table: DataFrame, thresholds: tuple[float, ...] = (0.90, 0.95, 0.99)) -> DataFrame:
    """(threshold, n_components): the fewest components that reach each share of variance."""
    out = None
    for t in thresholds:
        row = table.where(F.col("cumulative") >= t).agg(F.lit(t).alias("threshold"), F.min("component").alias("n_components"))
        out = row if out is None else out.unionByName(row)
    return out


RANKERS = ("anova", "chi2", "mi", "rf", "gb")


def k_sweep(df: DataFrame, features: list[str], y: str, keys: list[str], methods: tuple[str, ...] = RANKERS, least: int = 2, folds: int = 5, trees: int = 100) -> DataFrame:
    """(method, k, features, f1): cross-validated macro-F1 of the k best features of each method, all features as ``baseline``. Equal choices are scored once."""
    known: dict[tuple[str, ...], float] = {}

    def score(chosen: list[str]) -> float:
        if tuple(chosen) not in known:
            known[tuple(chosen)] = cross_validated_f1(df, chosen, y, keys, folds, trees)
        return known[tuple(chosen)]

    rows = [("baseline", len(features), list(features), score(list(features)))]
    for m in methods:
        ranked = ranking(df, features, y, m, keys, trees)
        for k in range(least, len(features) + 1):
            chosen = [f for f in features if f in ranked[:k]]
            rows.append((m, k, chosen, score(chosen)))
    return df.sparkSession.createDataFrame(rows, "method string, k long, features array<string>, f1 double")


def ranking(df: DataFrame, features: list[str], y: str, method: str, keys: list[str], trees: int = 100) -> list[str]:
    """All features by falling score of one method."""
    if method in ("rf", "gb"):
        scores = model_scores(df, features, y, method, trees=trees)
    else:
        scores = mutual_information(df, features, y, keys) if method == "mi" else STATISTICAL[method](df, features, y)
    return [r["feature"] for r in scores.orderBy(F.desc_nulls_last("score"), "feature").collect()]


def best_k(sweep: DataFrame) -> DataFrame:
    """(method, best_k, f1): the smallest k of the best score of each method."""
    top = F.max(F.struct("f1", (-F.col("k")).alias("k")))
    return sweep.groupBy("method").agg(top.alias("t")).select("method", (-F.col("t.k")).alias("best_k"), F.col("t.f1").alias("f1"))


def score_table(df: DataFrame, features: list[str], y: str, methods: tuple[str, ...] = ("anova", "chi2")) -> DataFrame:
    """(feature, one column a statistical score); chi-square sees features scaled to 0..1."""
    ends = df.agg(*[x for f in features for x in (F.min(f).cast("double").alias(f"lo_{f}"), F.max(f).cast("double").alias(f"hi_{f}"))]).first()
    unit = df.select(y, *[((F.col(f).cast("double") - F.lit(ends[f"lo_{f}"])) / F.lit((ends[f"hi_{f}"] - ends[f"lo_{f}"]) or 1.0)).alias(f) for f in features])
    out = None
    for m in methods:
        one = STATISTICAL[m](unit if m == "chi2" else df, features, y).withColumnRenamed("score", m)
        out = one if out is None else out.join(one, "feature")
    return out


def feature_space(df: DataFrame, key: str, features: list[str], label: str, rows: int = 2000, components: int = 50, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(components with labels, scree, t-SNE of the leading components) of standardised features, over a sample of ``rows`` in shares of the classes."""
    n = df.count()
    if n > rows:
        df = stratified_fraction(df, label, rows / n, [key], seed).where("in_sample").drop("in_sample")
    s = df.agg(*[x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]).first()
    z = df.select(key, label, *[((F.col(f) - F.lit(s[f"m_{f}"])) / F.lit(s[f"s_{f}"] or 1.0)).alias(f) for f in features])
    scores, table = pca(z, features, min(components, len(features)))
    names = [c for c in scores.columns if c.startswith("component_")]
    return scores.select(key, label, *names), scree(pca(z, features, len(features))[1]), embed_2d(scores, key, names, seed=seed)


TSNE_ROWS = 1000


def tsne(x: np.ndarray, perplexity: float = 30.0, steps: int = 500, seed: int = SEED) -> np.ndarray:
    """Two-dimensional t-SNE (van der Maaten & Hinton, 2008) of at most a thousand rows."""
    if len(x) > TSNE_ROWS:
        raise ValueError("t-SNE takes at most 1000 rows; sample first")
    n = len(x)
    if n < 3:
        return np.zeros((n, 2))
    perplexity = min(perplexity, n - 1)
    d = np.array([((x - row) ** 2).sum(-1) for row in x])  # one row at a time: all pairs by features would take hundreds of MB
    p = np.zeros((n, n))
    for i in range(n):
        low, high, beta = 0.0, np.inf, 1.0
        others = np.delete(d[i], i) - np.delete(d[i], i).min()
        for _ in range(60):
            e = np.exp(-others * beta)
            q = e / e.sum()
            entropy = -(q * np.log(q + 1e-300)).sum()
            if entropy > np.log(perplexity):
                low, beta = beta, beta * 2 if high == np.inf else (beta + high) / 2
            else:
                high, beta = beta, (beta + low) / 2
        p[i, np.arange(n) != i] = q
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, 2))
    move, gain = np.zeros_like(y), np.ones_like(y)
    for t in range(steps):
        inv = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(-1))
        np.fill_diagonal(inv, 0)
        q = np.maximum(inv / inv.sum(), 1e-12)
        w = ((12.0 if t < 100 else 1.0) * p - q) * inv
        grad = 4 * (w.sum(1)[:, None] * y - w @ y)
        gain = np.maximum(np.where(np.sign(grad) != np.sign(move), gain + 0.2, gain * 0.8), 0.01)
        move = (0.5 if t < 250 else 0.8) * move - max(n / 12 / 4, 50) * gain * grad
        y = y + move
        y -= y.mean(0)
    return y


def embed_2d(df: DataFrame, key: str, features: list[str], method: str = "tsne", seed: int = SEED) -> DataFrame:
    """(key, x, y) of a t-SNE embedding of all rows, or of a hash-ordered sample of ``TSNE_ROWS``, in one bounded task."""
    if method != "tsne":
        raise NotImplementedError(f"{method} is not available")

    def run(pdf):
        pdf = pdf.sort_values(key)
        xy = tsne(pdf[features].to_numpy(dtype=float), seed=seed)
        pdf = pdf[[key]].copy()
        pdf["x"], pdf["y"] = xy[:, 0], xy[:, 1]
        return pdf

    bounded = sample_exact(df.select(key, *features), TSNE_ROWS, [key], seed)
    return bounded.groupBy(F.lit("all")).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, x double, y double")
