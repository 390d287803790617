"""Queries over vectors use all 64 dimensions; plain versions on the same table."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from quarrykit.core import stratified_folds
from quarrykit.operators import select
from quarrykit.operators.metrics import classification_scores
from quarrykit.plans import catalogue

ALL = [f"d{i}" for i in range(64)]


@pytest.fixture(scope="module")
def vectors(sf):
    e = pd.read_parquet(f"{sf}/embeddings.parquet")
    return np.stack(e["embedding"]).astype(float), e["label"].to_numpy()


def test_components_of_all_dimensions(spark, sf, vectors):
    x = vectors[0] - vectors[0].mean(0)
    w = np.linalg.svd(x, compute_uv=False) ** 2
    ratio = w / w.sum()
    got = sorted((r["component"], r["variance_ratio"]) for r in catalogue.queries()["pca_variance"](spark, sf).collect())
    np.testing.assert_allclose([v for _, v in got], ratio[: len(got)], rtol=1e-6)
    assert len(got) == int(np.searchsorted(np.cumsum(ratio), 0.95) + 1) > 8
    scree = {r["threshold"]: r["n_components"] for r in catalogue.queries()["pca_scree"](spark, sf).collect()}
    assert scree == {t: int(np.searchsorted(np.cumsum(ratio), t) + 1) for t in (0.9, 0.95, 0.99)}
    scatter = catalogue.queries()["viz_pca_scatter"](spark, sf).toPandas()
    np.testing.assert_allclose(scatter["component_1"].var(ddof=0) * len(x), w[0], rtol=1e-6)


def test_anova_of_all_dimensions(spark, sf, vectors):
    x, y = vectors
    groups = [x[y == k] for k in np.unique(y)]
    between = sum(len(g) * (g.mean(0) - x.mean(0)) ** 2 for g in groups) / (len(groups) - 1)
    within = sum(((g - g.mean(0)) ** 2).sum(0) for g in groups) / (len(x) - len(groups))
    got = sorted((r["dim"], r["statistic"]) for r in catalogue.queries()["anova_p_values"](spark, sf).collect())
    assert [d for d, _ in got] == list(range(64))
    np.testing.assert_allclose([v for _, v in got], between / within, rtol=1e-6)


def test_selections_see_all_dimensions(spark, sf, monkeypatch):
    seen = {}
    for name in ("mutual_information", "rfecv"):
        monkeypatch.setattr(select, name, lambda df, features, *a, name=name, **b: seen.update({name: (df.columns, features, b)}))
    monkeypatch.setattr(select, "model_scores", lambda df, features, y, model, **b: seen.update({model: (df.columns, features, {})}))
    for name in ("select_mi", "select_rf", "select_gbt", "select_rfecv"):
        catalogue.queries()[name](spark, sf)
    assert sorted(seen) == ["gb", "mutual_information", "rf", "rfecv"]
    assert all(features == ALL and set(ALL) <= set(columns) for columns, features, _ in seen.values())
    assert not seen["rfecv"][2]  # the operator's five folds


def test_rfecv_equals_plain_loops(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, i % 2, float(i % 2 + rng.normal(0, 0.6)), float(rng.normal()), float(rng.normal())) for i in range(60)], "k long, y int, a double, b double, c double").cache()
    got = select.rfecv(df, ["a", "b", "c"], "y", ["k"], folds=5, trees=3).collect()
    left = ["a", "b", "c"]
    for r in got:
        assert (r["n_features"], r["features"]) == (len(left), left)
        data = select.assembled(stratified_folds(df, "y", 5, ["k"]), left, "y").select("fold", "features", "label").cache()
        scores = []
        for i in range(5):
            model = RandomForestClassifier(numTrees=3, maxDepth=8, seed=42).fit(data.where(F.col("fold") != i))
            scores.append(classification_scores(model.transform(data.where(F.col("fold") == i)), "label", "prediction").first()["macro_f1"])
        assert r["score"] == pytest.approx(np.mean(scores), abs=1e-12)
        if len(left) > 1:
            left.pop(int(np.argmin(select._importances(df, left, "y", "rf", 3, 42))))
    assert got[-1]["features"] == ["a"]
