"""Queries that once ran over less than their whole input, held against plain versions."""

import numpy as np
import pandas as pd

from quarrykit.core import sample_exact
from quarrykit.functions import rasters
from quarrykit.operators import select
from quarrykit.plans import catalogue


def embeddings(sf):
    return pd.read_parquet(f"{sf}/embeddings.parquet").sort_values("vec_id")


def test_tsne_covers_all_vectors(spark, sf):
    got = catalogue.queries()["tsne_embedding"](spark, sf).toPandas()
    assert sorted(got["vec_id"]) == embeddings(sf)["vec_id"].tolist()
    assert np.isfinite(got[["x", "y"]].to_numpy()).all()


def test_tsne_samples_in_hash_order(spark, monkeypatch):
    monkeypatch.setattr(select, "TSNE_ROWS", 20)
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(200)], "k long, a double, b double")
    got = {r["k"] for r in select.embed_2d(df, "k", ["a", "b"]).collect()}
    assert len(got) == 20 and got == {r["k"] for r in sample_exact(df, 20, ["k"]).collect()} and max(got) >= 100


def test_ssim_curve_averages_all_rasters(spark, sf):
    got = {r["size"]: (r["psnr"], r["ssim"]) for r in catalogue.queries()["viz_ssim_curve"](spark, sf).collect()}
    px = [np.clip(np.floor(np.asarray(e, dtype=float) * 400 + 128), 0, 255).reshape(8, 8, 1) for e in embeddings(sf)["embedding"]]
    for size, own in got.items():
        small = [rasters.resize(x, size, size) for x in px]
        want = np.mean([(rasters.psnr(x, y), rasters.ssim(x, y)) for x, y in zip(px, small)], axis=0)
        np.testing.assert_allclose(own, want, rtol=1e-9)
    assert sorted(got) == [32, 64]
