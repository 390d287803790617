"""Scores of predictions from a confusion matrix, ranks or residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import average_ranks


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def class_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(class, support, precision, recall, f1); 0 where a ratio is undefined."""
    m = df.groupBy(F.col(truth).cast("string").alias("t"), F.col(guess).cast(dict(df.dtypes)[truth]).cast("string").alias("g")).agg(F.count("*").alias("n"))
    cells = m.select(F.inline(F.array(F.struct(F.col("t").alias("class"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(F.lit(0).cast("long")).alias("tp"), F.col("n").alias("sup"), F.lit(0).cast("long").alias("said")), F.struct(F.col("g").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("sup"), F.col("n").alias("said")))))
    s = cells.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("sup").alias("support"), F.sum("said").alias("said"))
    s = s.withColumn("precision", _ratio(F.col("tp"), F.col("said"))).withColumn("recall", _ratio(F.col("tp"), F.col("support")))
    return s.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def classification_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """accuracy, and macro and weighted precision, recall and F1."""
    s = class_scores(df, truth, guess)
    n = F.sum("support")
    out = [(F.sum("tp") / n).alias("accuracy")]
    for name in ("precision", "recall", "f1"):
        out += [F.avg(name).alias(f"macro_{name}"), (F.sum(F.col(name) * F.col("support")) / n).alias(f"weighted_{name}")]
    return s.agg(*out)


def auc(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """Area under the ROC curve by average ranks: (n_pos, n_neg, auc)."""
    r = average_ranks(df.withColumn("_p", positive.cast("long")).where(F.col(score).isNotNull()), score, "_rank")
    s = r.agg(F.sum("_p").alias("n_pos"), F.sum(1 - F.col("_p")).alias("n_neg"), F.sum(F.col("_p") * F.col("_rank")).alias("_s"))
    u = F.col("_s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2
    return s.select("n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), u / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def regression_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    e = F.col(truth) - F.col(guess)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.corr(truth, guess).alias("corr"))
