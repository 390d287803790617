"""Experiments over images: registered over all classes with the operators' defaults, and held on small fixtures."""

import numpy as np
import pytest

from quarrykit.functions import rasters
from quarrykit.operators import images
from quarrykit.plans import catalogue


@pytest.mark.parametrize("query, operator", [("img_augmentation_experiment", "augmentation_experiment"), ("img_color_space_scores", "color_space_scores")])
def test_registered_whole(spark, sf, monkeypatch, query, operator):
    seen = []
    monkeypatch.setattr(images, operator, lambda df, *a, **b: seen.append((df, a, b)))
    catalogue.queries()[query](spark, sf)
    df, a, b = seen[0]
    assert df.count() == 500 and df.select("label").distinct().count() == 10
    assert a == ("vec_id", "label") and not b


def test_pipelines_are_five_ten_and_eight():
    assert (len(images.SINGLE), len(images.THREE), len(images.VARIANTS), len(images.PIPELINES)) == (5, 10, 8, 23)
    x = np.random.default_rng(1).integers(0, 256, (8, 8, 1)).astype(float)
    rng = np.random.default_rng(7)
    want = rasters.flip(rasters.crop(rasters.rotate(rasters.adjust(rasters.noise(x, 0, 30, rng), 1.1, 10), 10), 0.85, rng))
    np.testing.assert_array_equal(images.run_pipeline(x, images.VARIANTS["lead_noise_30"], 7), want)


def _rasters(spark, channels, sizes):
    rng = np.random.default_rng(3)
    rows = [(100 * y + i, y, [float(v) for v in np.clip(90 * y + 20 + rng.normal(0, 4, 64 * channels), 0, 255).round()]) for y, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame([(k, y, px, 8, 8, channels) for k, y, px in rows], "k long, y int, pixels array<double>, height int, width int, channels int")


def test_experiment_scores_each_pipeline(spark):
    chosen = {k: images.PIPELINES[k] for k in ("flip", "flip+rotate+crop", "lead_adjust_0.7")}
    out = images.augmentation_experiment(_rasters(spark, 1, (20, 10, 10)), "k", "y", chosen).collect()
    assert [r["pipeline"] for r in out] == list(chosen)
    assert out[0]["accuracy"] == 1.0 and all(0 <= r["macro_f1"] <= 1 for r in out)


def test_color_scores_cover_all_spaces(spark):
    out = images.color_space_scores(_rasters(spark, 3, (70, 70)), "k", "y").collect()  # more rows than components
    assert [r["space"] for r in out] == ["RGB", "HSV", "LAB", "Grayscale"]
    assert all(r["weighted_f1"] > 0.9 for r in out if r["space"] != "HSV")


def test_grown_rasters_come_in_bounded_batches(spark, monkeypatch):
    boxed = images._boxed
    acc = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(images, "BATCH_VALUES", 4096)
    monkeypatch.setattr(images, "_boxed", lambda xs: acc.add(1) or boxed(xs))
    rows = [(i, None if i == 3 else f"n{i}", 2, 2, 1, [float(i), 1.0, 2.0, 3.0]) for i in range(10)]
    df = spark.createDataFrame(rows, "k long, name string, height int, width int, channels int, pixels array<double>").coalesce(1)
    out = images.resize(df, 64)
    assert out.columns == df.columns
    got = sorted(out.collect())
    assert acc.value == 10
    for r, (k, name, *shape, px) in zip(got, rows):
        assert (r["k"], r["name"], r["height"], r["width"], r["channels"]) == (k, name, 64, 64, 1)
        np.testing.assert_allclose(r["pixels"], rasters.resize(np.reshape(px, (2, 2)), 64, 64).ravel())
