"""Ranks, quantiles and codes by fixed bounds: the same under any partitioning, and exact beside plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.functions import order
from quarrykit.operators import encode, outlier, scale


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(4)
    return [float(x) for x in rng.integers(0, 40, 700)] + [float(x) for x in rng.normal(0, 9, 300)] + [7.0] * 400


@pytest.mark.parametrize("parts, shuffles, ranges", [(1, "3", 1024), (9, "50", 1024), (4, "50", 2)])
def test_ranks_are_stable(spark, monkeypatch, values, parts, shuffles, ranges):
    monkeypatch.setattr(order, "MOST_RANGES", ranges)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        df = spark.createDataFrame([(v, i, "x") for i, v in enumerate(values)] + [(None, -1, "x")], "v double, i long, more string").repartition(parts)
        got = {r["i"]: r["r"] for r in order.average_ranks(df, "v", "r").select("i", "r").collect()}
        steps = sorted((r["value"], r["cum_count"]) for r in order.ecdf(df, "v").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    x = np.array(values)
    low, high = np.searchsorted(np.sort(x), x, side="left"), np.searchsorted(np.sort(x), x, side="right")
    assert got == {**{i: (a + 1 + b) / 2 for i, (a, b) in enumerate(zip(low, high))}, -1: None}
    assert steps == sorted({(v, int(b)) for v, b in zip(values, high)})


@pytest.mark.parametrize("exact", [2_000_000, 0])
def test_quantiles_equal_plain(spark, monkeypatch, values, exact):
    monkeypatch.setattr(order, "EXACT_ROWS", exact)
    df = spark.createDataFrame([(v, None, i) for i, v in enumerate(values)] + [(None, None, -1)], "v double, nothing double, i long")
    p = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = order.quantiles(df, {"v": F.col("v"), "nothing": F.col("nothing")}, p)
    np.testing.assert_allclose(got["v"], np.quantile(values, p), rtol=1e-12)
    assert got["nothing"] is None
    grid = scale.quantile(df, ["v"], 100).grids["v"]
    np.testing.assert_allclose(grid, np.quantile(values, np.linspace(0, 1, 100)), rtol=1e-9)
    mean, q1, q3 = outlier.fit_iqr(df, ["v"])["v"]
    np.testing.assert_allclose([q1, q3], np.quantile([*values, np.mean(values)], [0.25, 0.75]), rtol=1e-9)


def test_normal_quantiles_do_not_depend_on_the_batch(spark):
    df = spark.range(30_000).select((F.col("id") * 1.0).alias("v"), "id")
    fit = scale.quantile(df, ["v"], output="normal")
    whole = {r["id"]: r["v"] for r in fit.transform(df.coalesce(1)).where("id % 999 = 0 or id = 29999").collect()}
    some = {r["id"]: r["v"] for r in fit.transform(df.where("id % 999 = 0 or id = 29999").repartition(7)).collect()}
    assert whole == some
    assert max(whole.values()) == pytest.approx(scale.NORMAL_CLIP) and min(whole.values()) == pytest.approx(-scale.NORMAL_CLIP)


def test_codes_are_ranked_in_spark(spark):
    names = [f"c{i % 300:03d}" for i in range(900)] + [None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, n string").repartition(6)
    cats = sorted({n or encode.MISSING for n in names})
    got = {r["i"]: r["n_ord"] for r in encode.ordinal_encode(df, ["n"]).collect()}
    assert got == {i: cats.index(n or encode.MISSING) for i, n in enumerate(names)}
    bits = encode.binary_encode(df, ["n"]).collect()
    assert all(sum(r[f"n_bin_{k + 1}"] << (8 - k) for k in range(9)) == cats.index(names[r["i"]] or encode.MISSING) + 1 for r in bits)


def test_target_without_any_value(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", None)], "k long, c string, y double")
    assert [r["c_target"] for r in encode.target_encode(df, ["c"], "y").collect()] == [None, None]
    fold = F.col("k") % 2
    assert [r["c_target"] for r in encode.target_encode_oof(df, ["c"], "y", fold).collect()] == [None, None]


@pytest.mark.parametrize("exact, groups", [(2_000_000, 200), (0, 200), (0, 1)])
def test_grouped_quantiles_equal_plain(spark, monkeypatch, values, exact, groups):
    monkeypatch.setattr(order, "EXACT_ROWS", exact)
    monkeypatch.setattr(order, "MOST_GROUPS", groups)
    df = spark.createDataFrame([("abc"[i % 3] if i % 3 else None, v) for i, v in enumerate(values)], "g string, v double")
    got = {r["g"]: r["q"] for r in order.grouped_quantiles(df, ["g"], "v", [0.05, 0.5, 0.9]).collect()}
    for k, g in ((0, None), (1, "b"), (2, "c")):
        np.testing.assert_allclose(got[g], np.quantile(values[k::3], [0.05, 0.5, 0.9]), rtol=1e-12)


def test_hash_ranks_equal_one_window(spark):
    from pyspark.sql import Window as W

    from quarrykit import core

    df = spark.createDataFrame([(i, None if i % 5 == 0 else "xy"[i % 2]) for i in range(900)], "k long, g string").repartition(5)
    w = W.partitionBy("g").orderBy(core.hash_order(["k"]), "k")
    want = {r["k"]: (r["r"], r["n"]) for r in df.withColumn("r", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(W.partitionBy("g"))).collect()}
    assert {r["k"]: (r["rank"], r["rank_of"]) for r in core.hash_rank(df, "g", ["k"]).collect()} == want


@pytest.mark.parametrize("dims, block", [(1, 20), (2, 20), (2, 2048), (5, 40)])
def test_nearest_equals_plain(spark, dims, block):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(0, 1, (150, dims)), rng.normal(6, 0.2, (100, dims)), np.round(rng.normal(0, 2, (60, dims)))])
    names = [f"c{i}" for i in range(dims)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, " + ", ".join(f"{n} double" for n in names))
    for other in (None, df.where("k % 3 = 0")):
        pool = [i for i in range(len(x)) if other is None or i % 3 == 0]
        want = set()
        for i in range(len(x)):
            d = sorted((round(float(((x[i] - x[j]) ** 2).sum()), 9), j) for j in pool if j != i)[:4]
            want |= {(i, r + 1, j) for r, (_, j) in enumerate(d)}
        got = {(r["key"], r["rank"], r["mate"]) for r in outlier.nearest(df, "k", names, 4, other, block).collect()}
        assert got == want
    assert outlier.nearest(df, "k", names, 4, df.where("k < 3"), block).where("key > 5").groupBy("key").count().where("count <> 3").count() == 0
