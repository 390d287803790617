import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.core import fold_of, hash_unit, sample_exact, stratified_folds, stratified_fraction
from quarrykit.sources import rasters, tables


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "k int, s string, v double")
    path = tables.save_table(df, f"{tmp_path}/out.csv", one_file=True)
    back = tables.load_table(spark, path)
    assert sorted(map(tuple, back.collect())) == [(1, "a", 2.5), (2, None, None)]
    with pytest.raises(OSError):
        tables.load_table(spark, f"{tmp_path}/nothing.csv")


def test_series_source(spark, tmp_path):
    df = spark.createDataFrame([("2020-01-02", "x", 1.0), ("oops", "x", 2.0)], "ObservationDate string, c string, v double")
    tables.save_table(df, f"{tmp_path}/s.csv")
    s = tables.load_series(spark, f"{tmp_path}/s.csv", rename={"ObservationDate": "Date"}, schema="ObservationDate string, c string, v double")
    assert s.where("Date is null").count() == 1
    with pytest.raises(ValueError):
        tables.load_series(spark, f"{tmp_path}/s.csv", time="Nope")


def test_dataset(spark):
    d = tables.Dataset(spark.range(3).withColumn("y", F.lit(1)), target="y").checked()
    assert d.features.columns == ["id"] and d.labels.columns == ["y"] and d.accept(lambda x: x.limit(1)).data.count() == 1
    with pytest.raises(ValueError):
        tables.Dataset(spark.range(0)).checked()
    with pytest.raises(ValueError):
        tables.Dataset(spark.range(1), target="no")
    assert tables.pipeline(spark.range(4), lambda x: x.where("id > 0"), lambda x: x.limit(2)).count() == 2


def test_images(spark, tmp_path):
    rng = np.random.default_rng(0)
    px = rng.integers(0, 256, (4, 5, 3)).astype(float)
    rows = [(f"dog_{i}.png", 4, 5, 3, px.ravel().tolist()) for i in range(2)] + [("cat_0.png", 4, 5, 3, (255 - px).ravel().tolist())]
    df = spark.createDataFrame(rows, "file_name string, height int, width int, channels int, pixels array<double>")
    assert len(rasters.save_images(df, str(tmp_path)).collect()) == 3
    (tmp_path / "dog" / "broken.png").write_bytes(b"no image")
    back = rasters.load_images(spark, str(tmp_path), ["dog", "cat"]).collect()
    assert sorted(r["label"] for r in back) == [1, 1, 2]
    assert all(np.array_equal(r["pixels"], px.ravel()) for r in back if r["label"] == 1)
    names = {r["file_name"] for r in rasters.image_paths(spark, str(tmp_path), ["dog", "cat"]).collect()}
    assert names == {"dog_0.png", "dog_1.png", "dog_2.png", "cat_0.png"}
    moved = rasters.remove_files(spark.createDataFrame([(f"{tmp_path}/cat/cat_0.png",), (f"{tmp_path}/gone.png",)], "path string"), str(tmp_path), f"{tmp_path}/archive").collect()
    assert sorted(r["moved"] for r in moved) == [False, True]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("y", F.col("id") % 3)
    pick = lambda d: sorted(r["id"] for r in sample_exact(d, 50, ["id"]).collect())
    assert pick(df.repartition(1)) == pick(df.repartition(7)) and len(pick(df)) == 50
    s = stratified_fraction(df, "y", 0.2, ["id"]).where("in_sample").groupBy("y").count().collect()
    assert {r["count"] for r in s} == {33}
    assert {r["n"] for r in stratified_folds(df, "y", 5, ["id"]).groupBy("y", "fold").agg(F.count("*").alias("n")).collect()} <= {33, 34}
    assert df.where(hash_unit(["id"]) >= 1).count() == 0 and df.select(fold_of(["id"], 5)).distinct().count() == 5
