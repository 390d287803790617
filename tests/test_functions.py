"""Closed forms and invariants of what SQL can't express."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.functions import distributions as dist
from quarrykit.functions import hypothesis, kernels, rasters
from quarrykit.functions.order import average_ranks, cumulative
from quarrykit.operators import encode, images, metrics, outlier, profile, resample, scale, select, series


def test_distribution_values(spark):
    jvm = spark._jvm.org.apache.commons.math3.distribution
    for f, a, b in ((0.5, 2, 10), (3.2, 4, 50), (19.15, 9, 990)):
        assert dist.f_sf(f, a, b) == pytest.approx(1 - jvm.FDistribution(float(a), float(b)).cumulativeProbability(f), abs=1e-9)
    for x, k in ((0.3, 1), (5.0, 3), (40.0, 20)):
        assert dist.chi2_sf(x, k) == pytest.approx(1 - jvm.ChiSquaredDistribution(float(k)).cumulativeProbability(x), abs=1e-9)
    assert dist.normal_ppf(1e-7) == pytest.approx(-5.199337582187473, abs=1e-9) and dist.normal_ppf(0.975) == pytest.approx(1.959963984540054, abs=1e-12)
    assert dist.digamma(1) == pytest.approx(-0.5772156649015329) and dist.digamma(10) == pytest.approx(2.2517525890667211)


def test_cumulative_does_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), F.lit(1).alias("n"))
    for p in (1, 7):
        out = cumulative(df.repartition(p), "v", {"c": "n"})
        assert out.where("c <> v + 1").count() == 0


def test_average_ranks(spark):
    df = spark.createDataFrame([(v,) for v in (3.0, 1.0, 3.0, None, 2.0, 3.0)], "v double")
    assert sorted((r["v"], r["r"]) for r in average_ranks(df, "v", "r").collect() if r["v"] is not None) == [(1.0, 1.0), (2.0, 2.0), (3.0, 4.0), (3.0, 4.0), (3.0, 4.0)]


def test_shapiro_wilk():
    rng = np.random.default_rng(0)
    w, p = hypothesis.shapiro_wilk(rng.normal(size=500))
    assert w > 0.99 and p > 0.01
    assert hypothesis.shapiro_wilk(rng.exponential(size=500))[1] < 1e-10
    w, p = hypothesis.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))  # the worked example of the 1965 paper
    assert w == pytest.approx(0.79, abs=0.01) and p < 0.02


def test_unit_root_tests():
    rng = np.random.default_rng(1)
    noise = rng.normal(size=400)
    walk = np.cumsum(noise)
    assert kernels.adf(noise)[1] < 0.01 < 0.1 < kernels.adf(walk)[1]
    assert kernels.phillips_perron(noise)[1] < 0.01 < 0.1 < kernels.phillips_perron(walk)[1]
    assert kernels.kpss(noise)[1] == pytest.approx(0.1) and kernels.kpss(walk)[1] == pytest.approx(0.01)


def test_stl_parts():
    t = np.arange(140)
    y = 0.1 * t + 5 * np.sin(2 * np.pi * t / 7) + np.where(t == 60, 40, 0) + np.random.default_rng(8).normal(0, 0.3, 140)
    trend, season, resid = kernels.stl(y, 7)
    np.testing.assert_allclose(trend + season + resid, y, atol=1e-9)
    assert np.abs(resid).argmax() == 60 and resid[60] > 35
    assert np.abs(season[14:126] - 5 * np.sin(2 * np.pi * t[14:126] / 7)).max() < 1.0


def test_granger_direction():
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    y = np.concatenate(([0.0], x[:-1])) + 0.1 * rng.normal(size=300)
    assert kernels.granger(x, y, 1)["ssr_chi2test"] < 1e-6 < 0.001 < kernels.granger(y, x, 1)["ssr_chi2test"]


def test_boxcox_lambda():
    x = np.random.default_rng(3).lognormal(size=3000)
    assert abs(kernels.boxcox_lambda(x)) < 0.1


def test_pacf_of_autoregression():
    assert kernels.pacf_from_acf(0.5 ** np.arange(6)) == pytest.approx([1, 0.5, 0, 0, 0, 0], abs=1e-12)


def test_scalers(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, None, 5.0), (4, 10.0, 5.0)], "k long, a double, c double")
    s = scale.minmax(df, ["a", "c"])
    out = {r["k"]: r for r in s.transform(df).collect()}
    assert out[4]["a"] == 1 and out[3]["a"] is None and out[1]["c"] == 0
    back = {r["k"]: r["a"] for r in s.inverse(s.transform(df)).collect()}
    assert back == {1: 1.0, 2: 2.0, 3: None, 4: 10.0}
    with pytest.raises(ValueError):
        scale.minmax(df.select(F.lit("x").alias("s")))
    with pytest.raises(ValueError):
        s.transform(df.drop("a"))


def test_quantile_scaler(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    out = {r["x"]: r["u"] for r in scale.quantile(df).transform(df.withColumn("u", F.col("x"))).select("x").withColumn("u", F.col("x")).collect()}
    assert min(out) == 0 and max(out) == 1
    normal = [r["x"] for r in scale.quantile(df, output="normal").transform(df).orderBy("x").collect()]
    assert normal[0] == pytest.approx(-5.199337582187473) and normal[50] == pytest.approx(0, abs=1e-9)


def test_encoders_unseen_and_missing(spark):
    fit = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0), ("a", 3.0)], "c string, y double")
    new = spark.createDataFrame([("a", 0.0), ("z", 0.0), (None, 0.0)], "c string, y double")
    assert [r["c_ord"] for r in encode.ordinal_encode(new, ["c"], fitted_on=fit).orderBy(F.col("c").desc_nulls_last()).collect()] == [-1, 1, 0]
    assert {r["c"]: r["c_freq"] for r in encode.frequency_encode(new, ["c"], fitted_on=fit).collect()} == {"a": 0.5, "z": 0.0, None: 0.25}
    assert {r["c"]: r["c_target"] for r in encode.target_encode(new, ["c"], "y", 0.0, fitted_on=fit).collect()} == {"a": 2.0, "z": 2.25, None: 3.0}
    hot = encode.onehot_encode(fit, ["c"])
    assert hot.columns == ["c", "c___MISSING__", "c_a", "c_b", "y"] and hot.where("c___MISSING__ + c_a + c_b <> 1").count() == 0
    assert encode.binary_encode(fit, ["c"]).columns == ["c", "y"]
    wide = spark.createDataFrame([(f"v{i:02d}",) for i in range(21)], "c string")
    assert encode.binary_encode(wide, ["c"]).columns == [f"c_bin_{i}" for i in range(1, 6)]


def test_out_of_fold_ignores_own_fold(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", float(i)) for i in range(20)], "k long, c string, y double")
    out = encode.target_encode_oof(df, ["c"], "y", F.col("k") % 4, smoothing=2.0).collect()
    for r in out:
        rest = [x for x in range(20) if x % 4 != r["k"] % 4]
        own = [x for x in rest if ("a" if x % 2 else "b") == r["c"]]
        mean = sum(rest) / len(rest)
        assert r["c_target"] == pytest.approx((sum(own) + 2 * mean) / (len(own) + 2) if own else mean)


def test_vif_of_dependent_columns(spark):
    df = spark.range(50).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"), F.lit(1).alias("k"), (F.col("id") % 7).alias("m"))
    out = {r["feature"]: r["vif"] for r in encode.vif(df).collect()}
    assert out["a"] == out["b"] == out["k"] == math.inf and 1 <= out["m"] < 1.1


def _points(spark, n=120):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(n - 3, 2)), [[9, 9], [-8, 8], [10, -9]]])
    return x, spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "k long, a double, b double")


def test_nearest_equals_brute_force(spark):
    x, df = _points(spark)
    out = outlier.nearest(df, "k", ["a", "b"], 3, block_rows=17).orderBy("key", "rank").collect()
    d = np.round(((x[:, None] - x[None]) ** 2).sum(-1), 9)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert [r["mate"] for r in out] == want.ravel().tolist()


def _plain_lof(x, ids, k):
    d = np.sqrt(np.round(((x[:, None] - x[None]) ** 2).sum(-1), 9))
    np.fill_diagonal(d, np.inf)
    near = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
    own = np.take_along_axis(d, near, 1)
    lrd = 1 / (np.maximum(own, own.max(1)[near]).mean(1) + 1e-10)
    return lrd[near].mean(1) / lrd


@pytest.mark.parametrize("k", [3, 10])
def test_lof_of_copies(spark, monkeypatch, k):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.integers(0, 7, (60, 2)), np.full((25, 2), 3), np.full((k, 2), 20), np.full((k + 1, 2), 30), [[3e-5, 0], [0, 0], [50, 50]]]).astype(float)
    ids = rng.permutation(len(x)) * 3
    df = spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in zip(ids, x)] + [(1000, None, 1.0), (1001, float("nan"), 2.0), (1002, float("nan"), 2.0)], "k long, a double, b double")
    sizes, nearest = [], outlier.nearest
    monkeypatch.setattr(outlier, "nearest", lambda points, *a, **b: sizes.append(points.count()) or nearest(points, *a, **b))
    got = {r["key"]: r["lof"] for r in outlier.lof(df, "k", ["a", "b"], k).collect()}
    assert set(got) == set(ids.tolist())
    np.testing.assert_allclose([got[i] for i in ids.tolist()], _plain_lof(x, ids, k), rtol=1e-6)
    assert sizes == [len(np.unique(x, axis=0))]
    assert outlier.lof(df.where("k = 1000 or k = 0"), "k", ["a", "b"], k).count() == 0


def test_detectors_find_planted_points(spark):
    _, df = _points(spark)
    lof = {r["key"] for r in outlier.lof(df, "k", ["a", "b"], 10).where(f"lof > {outlier.LOF_LIMIT}").collect()}
    forest = {r["k"] for r in outlier.iforest(df, ["k"], ["a", "b"], 0.03).where("iforest_outlier").collect()}
    dense = {r["k"] for r in outlier.dbscan_outliers(df, "k", ["a", "b"], 0.8, 5).where("is_outlier").collect()}
    assert {117, 118, 119} <= lof and {117, 118, 119} <= forest and {117, 118, 119} <= dense


def test_dbscan_meets_distinct_points(spark, monkeypatch):
    rng = np.random.default_rng(3)
    own = np.vstack([rng.integers(0, 6, (40, 2)), [[30, 30], [31, 30], [60, 0]]]).astype(float)
    x = own[np.concatenate([np.arange(43), rng.integers(0, 42, 300)])]
    df = spark.createDataFrame([(i, float(a), None if i == 5 else float(b)) for i, (a, b) in enumerate(x)], "k long, a double, b double")
    x[5, 1] = np.delete(x[:, 1], 5).mean()
    plans, settled = [], outlier.settled
    monkeypatch.setattr(outlier, "settled", lambda t: plans.append((t.count(), t._jdf.queryExecution().executedPlan().toString())) or settled(t))
    got = {r["k"]: (r["n_near"], r["is_outlier"]) for r in outlier.dbscan_outliers(df, "k", ["a", "b"], 0.3, 9).collect()}
    z = (x - x.mean(0)) / x.std(0)
    near = ((z[:, None] - z[None]) ** 2).sum(-1) <= 0.09
    n = near.sum(1)
    assert got == {i: (n[i], not (near[i] & (n >= 9)).any()) for i in range(len(x))}
    assert 0 < sum(v[1] for v in got.values()) < len(x)
    assert plans[0][0] == len(np.unique(x, axis=0))
    assert not any("BroadcastHashJoin" in p and "Generate" in p for _, p in plans)


def test_constant_column_flags_nothing(spark):
    df = spark.range(10).select(F.lit(1.0).alias("x"))
    assert df.where(outlier.zscore_mask(outlier.fit_zscore(df, ["x"]))).count() == 0


def test_mutual_information_prefers_the_informative(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, float(i % 2 * 3 + rng.normal()), float(rng.normal())) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, y int, good double, bad double")
    s = {r["feature"]: r["score"] for r in select.mutual_information(df, ["good", "bad"], "y", ["k"]).collect()}
    assert s["good"] > 0.3 and s["bad"] < 0.1
    assert select.select(df, ["bad", "good"], "y", "anova", 1) == ["good"]
    with pytest.raises(ValueError):
        select.select(df, ["good"], "y", "nothing", 1)


def test_pca_is_centred(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(float(a + 100), float(a * 2 + b)) for a, b in rng.normal(size=(200, 2))], "a double, b double")
    scored, table = select.pca(df, ["a", "b"], 2)
    assert abs(scored.agg(F.avg("component_1")).first()[0]) < 1e-8
    assert table.agg(F.max("cumulative")).first()[0] == pytest.approx(1)


def test_resampling_counts(spark):
    df = spark.createDataFrame([(i, int(i < 12), float(i % 5), float(i % 3)) for i in range(60)], "k long, y int, a double, b double")
    assert {r["y"]: r["count"] for r in resample.undersample(df, "y", ["k"]).groupBy("y").count().collect()} == {0: 12, 1: 12}
    made = resample.smote(df, "k", ["a", "b"], "y")
    assert {r["y"]: r["count"] for r in made.groupBy("y").count().collect()} == {0: 48, 1: 48}
    assert made.where("synthetic and (a < 0 or a > 4 or b < 0 or b > 2)").count() == 0
    assert abs(resample.adasyn(df, "k", ["a", "b"], "y").where("y = 1").count() - 48) <= 12


def test_auc_closed_form(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "t int, s double")
    assert metrics.auc(df, F.col("t") == 1, "s").first()["auc"] == 0.875


def test_raster_kernels():
    x = np.arange(64, dtype=float).reshape(8, 8)
    assert rasters.phash(x) == rasters.phash(x.copy()) and np.allclose(rasters.resize(np.full((5, 7), 3.0), 3, 4), 3)
    c = rasters.dct_matrix(8)
    assert np.allclose(c @ c.T, np.eye(8)) and rasters.ssim(x, x) == pytest.approx(1) and rasters.psnr(x, x) == math.inf
    assert np.allclose(rasters.rotate(x, 0), x) and np.array_equal(rasters.flip(rasters.flip(x)), x)
    rgb = np.zeros((1, 3, 3))
    rgb[0] = [[255, 0, 0], [0, 255, 0], [0, 0, 255]]
    assert rasters.to_hsv(rgb)[0, :, 0].tolist() == [0, 60, 120] and rasters.to_lab(np.full((1, 1, 3), 255.0))[0, 0].tolist() == [255, 128, 128]
    edge = np.zeros((32, 32))
    edge[:, 16:] = 255
    assert 0 < rasters.canny(edge, 50, 150).mean() <= 2 / 32


def test_hamming_pairs_and_greedy(spark):
    rng = np.random.default_rng(7)
    hashes = rng.integers(-(1 << 63), 1 << 63, 40).tolist()
    hashes += [h ^ (1 << int(rng.integers(0, 62))) ^ (1 << int(rng.integers(0, 62))) for h in hashes[:20]]
    df = spark.createDataFrame(list(enumerate(hashes)), "k long, h long")
    near = lambda a, b: bin((hashes[a] ^ hashes[b]) & ((1 << 64) - 1)).count("1") <= 4
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if near(a, b)}
    pairs = images.hamming_pairs(df, "k", "h", 4)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want
    gone = set()
    for a in range(60):
        if a not in gone:
            gone |= {b for b in range(a + 1, 60) if near(a, b)}
    assert {r["key"] for r in images.greedy_duplicates(pairs).collect()} == gone


def test_profiles_of_gaps(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    assert profile.drop_empty_columns(df).columns == ["a"]
    assert {r["column"]: r["level"] for r in profile.missing_by_column(df).collect()} == {"a": "low", "b": "severe"}
    assert profile.missing_correlations(df.select("a")) is None
    assert hypothesis.mcar_test(df.na.fill(0.0), ["a", "b"]).first()["status"] == "no missing values"


def test_series_edges(spark):
    rows = [("2020-01-01", 1.0), ("2020-01-02", 3.0), ("bad", 9.0), ("2020-01-03", 2.0), ("2020-01-04", None)]
    s = series.daily(spark.createDataFrame(rows, "t string, v double").withColumn("t", F.expr("try_to_date(t)")), "t", "v")
    assert [r["y"] for r in s.orderBy("d").collect()] == [1.0, 3.0, 2.0, 0.0]
    w = series.over()
    assert [r["n"] for r in s.withColumn("n", series.new_counts(w)).orderBy("d").collect()] == [0.0, 2.0, 0.0, 0.0]
    assert s.where(series.temporal_split(s, w).columns[0] + " is not null").count() == 4
    with pytest.raises(ValueError):
        series.daily(s, "d", "nothing")


def test_anomalies_of_the_spike_series(spark):
    import datetime

    rows = [(datetime.date(2020, 1, 1) + datetime.timedelta(i), float(np.linspace(10, 100, 100)[i] + 10 * np.sin(i) + (50 if i == 30 else -40 if i == 75 else 0))) for i in range(100)]
    df = spark.createDataFrame(rows, "d date, y double")
    found = {(r["d"] - rows[0][0]).days for r in series.anomalies(df, "stl").where("is_anomaly").collect()}
    assert {30, 75} <= found
