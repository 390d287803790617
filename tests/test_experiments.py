"""Experiments, dispatchers and matrices: plain versions on small fixtures, and registration over whole tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.core import aligned, side_by_side
from quarrykit.functions import hypothesis, rasters
from quarrykit.operators import images, outlier, select, series
from quarrykit.operators.encode import vif_summary
from quarrykit.plans import catalogue


@pytest.fixture(scope="module")
def classed(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, float(i % 2 + rng.normal(0, 0.5)), float(rng.normal()), float((i % 2) * 0.6 + rng.normal())) for i in range(80)]
    return spark.createDataFrame(rows, "k long, y int, a double, b double, c double").cache()


def test_k_sweep_scores_the_best_features_of_each_method(classed):
    names = ["a", "b", "c"]
    out = select.k_sweep(classed, names, "y", ["k"], methods=("anova", "mi"), least=1, folds=3, trees=3)
    rows = {(r["method"], r["k"]): r for r in out.collect()}
    assert sorted(rows) == sorted([("baseline", 3)] + [(m, k) for m in ("anova", "mi") for k in (1, 2, 3)])
    for m in ("anova", "mi"):
        for k in (1, 2, 3):
            assert rows[m, k]["features"] == select.select(classed, names, "y", m, k, ["k"])
            assert rows[m, k]["f1"] == pytest.approx(select.cross_validated_f1(classed, rows[m, k]["features"], "y", ["k"], 3, 3))
    best = {r["method"]: (r["best_k"], r["f1"]) for r in select.best_k(out).collect()}
    for m in ("anova", "mi"):
        top = max(rows[m, k]["f1"] for k in (1, 2, 3))
        assert best[m] == (min(k for k in (1, 2, 3) if rows[m, k]["f1"] == top), top)


def test_softmax_learns_and_scores_by_the_formulas():
    rng = np.random.default_rng(1)
    y = np.arange(300) % 3
    x = np.eye(3)[y] * 4 + rng.normal(0, 0.5, (300, 3))
    order = rng.permutation(300)
    curve = rasters.softmax_epochs(x, y, 3, order[60:], order[:60], 12, 0.05, np.random.default_rng(2))
    assert len(curve) == 12 and curve[-1][0] > 0.95 and all(s[2] == pytest.approx(s[0]) for s in curve)  # weighted recall is accuracy
    assert rasters.softmax_epochs(x, y, 3, order[60:], order[:60], 12, 0.05, np.random.default_rng(2)) == curve


def _rasters(spark, n=60):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, [float(v) for v in np.clip(120 * (i % 2) + 40 + rng.normal(0, 6, 64), 0, 255).round()], 8, 8, 1) for i in range(n)]
    return spark.createDataFrame(rows, "k long, y int, pixels array<double>, height int, width int, channels int")


def test_normalization_curves(spark):
    curves = images.normalization_curves(_rasters(spark), "k", "y", epochs=5, repeats=2)
    rows = curves.collect()
    assert sorted((r["method"], r["repeat"], r["epoch"]) for r in rows) == sorted((m, i, e) for m in images.METHODS for i in range(2) for e in range(1, 6))
    scores = {r["method"]: r["accuracy"] for r in images.normalization_scores(curves).collect()}
    assert scores == {m: pytest.approx(np.mean([r["accuracy"] for r in rows if r["method"] == m and r["epoch"] == 5])) for m in images.METHODS}
    assert min(scores.values()) > 0.9


def test_resize_ablation(spark):
    out = images.resize_ablation(_rasters(spark, 30), "k", "y", sizes=(64, 32)).collect()
    assert [r["size"] for r in out] == [64, 32] and all(r["accuracy"] == 1.0 and r["seconds"] > 0 for r in out)
    px = [np.array(r["pixels"]).reshape(8, 8) for r in _rasters(spark, 30).collect()]
    for r in out:
        want = np.mean([(rasters.psnr(x, s), rasters.ssim(x, s)) for x in px for s in (rasters.resize(x, r["size"], r["size"]),)], axis=0)
        np.testing.assert_allclose((r["psnr"], r["ssim"]), want, rtol=1e-9)


def test_random_settings_cover_the_stated_ranges():
    seen = {"angle": [], "sd": [], "beta": []}

    class Spy(np.random.Generator):
        def uniform(self, low, high):
            seen["angle" if high == 180 else "sd" if low == 10 else "beta" if high == 30 else "alpha"] = seen.get("angle" if high == 180 else "sd" if low == 10 else "beta" if high == 30 else "alpha", []) + [(low, high)]
            return (low + high) / 2

    x = np.full((8, 8), 100.0)
    for step in ("rotate", "noise", "adjust"):
        images._one(x, step, Spy(np.random.PCG64(1)))
    assert seen == {"angle": [(-180, 180)], "sd": [(10, 30)], "alpha": [(0.8, 1.2)], "beta": [(-30, 30)]}
    noisy = rasters.noise(x, 0, 20, np.random.default_rng(1))
    assert (noisy == np.floor(noisy)).all()


def test_normality_dispatch(spark):
    df = spark.range(6000).select(F.col("id").alias("k"), (F.col("id") % 89).cast("double").alias("many"), F.when(F.col("id") < 4000, F.col("id").cast("double")).alias("some"), F.when(F.col("id") < 2, F.lit(1.0)).alias("few"), F.lit(3).alias("ignored"))
    out = {r["column"]: r for r in hypothesis.normality(df, None, ["k"], ignore=["ignored"]).collect()}
    assert {c: (r["test"], r["n"]) for c, r in out.items()} == {"many": ("dagostino", 6000), "some": ("shapiro", 4000)}
    assert out["some"]["p_value"] == hypothesis.shapiro_test(df, "some", ["k"]).first()["p_value"] and not out["many"]["normal"]


def test_granger_forms(spark):
    rows = [("a", "b", 2, 0.01, True), ("b", "a", 1, 0.7, False), ("a", "c", 3, 0.2, False), ("c", "a", 1, 0.04, True), ("b", "c", 1, 0.9, False), ("c", "b", 1, 0.8, False)]
    m = spark.createDataFrame(rows, "cause string, effect string, best_lag long, p_value double, significant boolean")
    p = {r["cause"]: r for r in series.granger_forms(m, ["a", "b", "c"], "p_value").collect()}
    assert p["a"]["a"] is None and p["a"]["b"] == 0.01 and p["c"]["a"] == 0.04
    flag = {r["cause"]: (r["a"], r["b"], r["c"]) for r in series.granger_forms(m, ["a", "b", "c"], "significant").collect()}
    assert flag == {"a": (0, 1, 0), "b": (0, 0, 0), "c": (1, 0, 0)}


def test_guard_names_what_is_wrong(spark):
    df = spark.createDataFrame([(i, float(i * i % 17), 1.0) for i in range(30)], "d int, y double, flat double")
    status = [series.guarded(*a).first()["status"] for a in ((df, "adf", "y"), (df, "adf", "none"), (df, "kpss", "flat"), (df.where("d < 5"), "pp", "y"))]
    assert status == ["ok", "missing column none", "constant", "too short"]


def test_series_beyond_the_bound_raise(spark, monkeypatch):
    monkeypatch.setattr(series, "MOST_POINTS", 20)
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(30)], "d int, a double, b double")
    with pytest.raises(ValueError, match="aggregate"):
        series.granger_matrix(df, ["a", "b"])


def test_joins_by_key(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, a string"), spark.createDataFrame([(2, "z"), (3, "w")], "k long, b string")
    assert {tuple(r) for r in side_by_side(a, b, "k").collect()} == {(1, "x", None), (2, "y", "z"), (3, None, "w")}
    assert {tuple(r) for r in aligned(a, b, "k").collect()} == {(1, None), (2, "z")}
    with pytest.raises(ValueError, match="both"):
        side_by_side(a, a, "k")


def test_dbscan_on_a_sample(spark):
    df = spark.createDataFrame([(i, float(i % 10), float(i % 7)) for i in range(300)], "k long, a double, b double")
    assert outlier.dbscan_outliers(df, "k", ["a", "b"], 0.5, 3, sample_size=100).count() == 100


def test_vif_summary_counts(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 5.0), ("c", 12.0), ("d", float("inf"))], "feature string, vif double")
    assert tuple(vif_summary(df).first()) == (4, 3, 2, 1)


def test_forecast_passes_its_parameters(spark, sf):
    from quarrykit.core import table

    o = table(spark, sf, "orders")
    matrix, scores, predicted = series.forecast_series(o, "o_totalprice", "o_orderdate", "o_orderpriority", "2-HIGH", horizon=2, max_lags=3, windows=(3,), period=5, trees=5, max_depth=4, min_samples_leaf=3, model_kwargs={"subsamplingRate": 0.8})
    assert {"target_t_plus_2", "roll_mean_3", "lag_1"} <= set(matrix.columns) and "roll_mean_7" not in matrix.columns
    rows = predicted.collect()
    assert scores.first()["mae"] == pytest.approx(np.mean([abs(r["label"] - r["prediction"]) for r in rows]))


@pytest.mark.parametrize("query, operator", [("select_k_sweep", "k_sweep"), ("img_resize_ablation", "resize_ablation"), ("img_normalization_curves", "normalization_curves")])
def test_registered_whole(spark, sf, monkeypatch, query, operator):
    seen = []
    monkeypatch.setattr(select if operator == "k_sweep" else images, operator, lambda df, *a, **b: seen.append(df))
    catalogue.queries()[query](spark, sf)
    assert seen[0].count() == spark.read.parquet(f"{sf}/{'part' if operator == 'k_sweep' else 'embeddings'}.parquet").count()
