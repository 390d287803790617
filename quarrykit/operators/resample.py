"""Resampling of imbalanced classes: under-sampling, SMOTE and ADASYN, and their comparison."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import SEED, hash_rank, stratified_fraction
from .metrics import auc, classification_scores
from .outlier import nearest
from .select import assembled


def undersample(df: DataFrame, y: str, keys: list[str], seed: int = SEED) -> DataFrame:
    """Every class at the size of the smallest, the first rows in hash order."""
    low = df.groupBy(y).count().agg(F.min("count")).first()[0]
    return hash_rank(df, y, keys, seed, "_at").where(F.col("_at") < F.lit(low or 0)).drop("_at", "_at_of")


def _placed(points: DataFrame, mates: DataFrame, k: int, seed: int) -> DataFrame:
    """``points`` (key, copy) get a neighbour by hash and a place on the segment to it."""
    pick = points.withColumn("rank", (F.pmod(F.xxhash64("key", "copy", F.lit(seed)), F.least(F.col("n_mates"), F.lit(k))) + 1).cast("int"))
    pairs = pick.join(mates.select("key", "rank", "mate"), ["key", "rank"])
    u = F.pmod(F.xxhash64("key", "copy", F.lit(seed + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return pairs.withColumn("u", u)


def _between(pairs: DataFrame, df: DataFrame, key: str, features: list[str], y: str) -> DataFrame:
    a = df.select(F.col(key).alias("key"), F.col(y), *[F.col(f).cast("double").alias(f"_a_{f}") for f in features])
    b = df.select(F.col(key).alias("mate"), *[F.col(f).cast("double").alias(f"_b_{f}") for f in features])
    j = pairs.join(a, "key").join(b, "mate")
    return j.select(F.lit(None).cast(dict(df.dtypes)[key]).alias(key), y, *[(F.col(f"_a_{f}") + F.col("u") * (F.col(f"_b_{f}") - F.col(f"_a_{f}"))).alias(f) for f in features], F.lit(True).alias("synthetic"))


def _original(df: DataFrame, key: str, features: list[str], y: str) -> DataFrame:
    return df.select(key, y, *[F.col(f).cast("double").alias(f) for f in features], F.lit(False).alias("synthetic"))


def smote(df: DataFrame, key: str, features: list[str], y: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """All classes up to the largest, by points between a row and one of its k nearest of its class."""
    counts = {r[0]: r[1] for r in df.groupBy(y).count().collect()}
    high, out = max(counts.values(), default=0), _original(df, key, features, y)
    for c, n in sorted(counts.items(), key=lambda t: str(t[0])):
        if n in (high, 1):
            continue
        own = df.where(F.col(y) == F.lit(c))
        mates = nearest(own, key, features, k)
        have = mates.groupBy("key").agg(F.count("*").alias("n_mates"))
        base, odd = divmod(high - n, n)
        numbered = hash_rank(have, None, ["key"], seed, "_at")
        copies = numbered.withColumn("n_new", F.lit(base) + (F.col("_at") < odd).cast("int")).where("n_new > 0")
        points = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_new")))).select("key", "copy", "n_mates")
        out = out.unionByName(_between(_placed(points, mates, k, seed), df, key, features, y))
    return out


def adasyn(df: DataFrame, key: str, features: list[str], y: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """As SMOTE, but rows with more neighbours of other classes get more new points (He et al., 2008)."""
    counts = {r[0]: r[1] for r in df.groupBy(y).count().collect()}
    high, out = max(counts.values(), default=0), _original(df, key, features, y)
    for c, n in sorted(counts.items(), key=lambda t: str(t[0])):
        if n in (high, 1):
            continue
        own = df.where(F.col(y) == F.lit(c))
        around = nearest(own, key, features, k, other=df).join(df.select(F.col(key).alias("mate"), F.col(y).alias("_c")), "mate")
        hard = around.groupBy("key").agg(F.avg((F.col("_c") != F.lit(c)).cast("double")).alias("r"))
        total = hard.agg(F.sum("r")).first()[0] or 0.0
        weight = F.col("r") / F.lit(total) if total else F.lit(1.0 / n)
        mates = nearest(own, key, features, k)
        have = mates.groupBy("key").agg(F.count("*").alias("n_mates"))
        copies = hard.join(have, "key").withColumn("n_new", F.round(weight * (high - n)).cast("int")).where("n_new > 0")
        points = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_new")))).select("key", "copy", "n_mates")
        out = out.unionByName(_between(_placed(points, mates, k, seed), df, key, features, y))
    return out


def compare(df: DataFrame, key: str, features: list[str], y: str, test_share: float = 0.2, trees: int = 50, seed: int = SEED) -> DataFrame:
    """(strategy, n_train, macro_precision, macro_recall, macro_f1, auc): the split is made before resampling."""
    split = stratified_fraction(df.select(key, y, *features), y, test_share, [key], seed)
    train, test = split.where(~F.col("in_sample")).drop("in_sample"), split.where("in_sample").drop("in_sample")
    ways = {"Baseline": _original(train, key, features, y), "RUS": _original(undersample(train, y, [key], seed), key, features, y), "SMOTE": smote(train, key, features, y, seed=seed), "ADASYN": adasyn(train, key, features, y, seed=seed)}
    rows = []
    classes = sorted(r[0] for r in df.select(y).distinct().collect())
    for name, data in ways.items():
        data = assembled(data, features, y).select("features", "label").cache()
        scored = RandomForestClassifier(numTrees=trees, maxDepth=8, seed=seed).fit(data).transform(assembled(test, features, y))
        s = classification_scores(scored, "label", "prediction").first()
        p = scored.select("label", vector_to_array("probability").alias("p"))
        wanted = [1] if len(classes) == 2 else range(len(classes))
        areas = [auc(p.withColumn("s", F.col("p")[i]), F.col("label") == i, "s").first()["auc"] for i in wanted]
        rows.append((name, data.count(), s["macro_precision"], s["macro_recall"], s["macro_f1"], float(sum(a for a in areas if a is not None) / max(1, len(areas)))))
        data.unpersist()
    return df.sparkSession.createDataFrame(rows, "strategy string, n_train long, macro_precision double, macro_recall double, macro_f1 double, auc double")
