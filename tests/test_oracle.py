"""Every registered query with SQL against DuckDB on the same tables; the others must run and give rows."""

import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest

from quarrykit.plans import catalogue

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"select_rfecv", "resample_comparison", "img_augmentation_experiment", "img_color_space_scores", "outlier_nine_methods", "img_edge_density", "select_k_sweep", "select_best_k", "img_resize_ablation", "img_normalization_curves", "img_normalization_scores"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].map(lambda v: isinstance(v, (list, np.ndarray))).any():
            df[c] = df[c].map(lambda v: tuple(map(float, v)))
        elif df[c].map(lambda v: isinstance(v, (datetime.date, pd.Timestamp))).any():
            df[c] = pd.to_datetime(df[c]).astype("datetime64[us]")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, sf, duck, name):
    got = normal(catalogue.queries()[name](spark, sf).toPandas())
    want = normal(duck.execute(catalogue.oracle_sql()[name]).fetchdf())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if pd.api.types.is_float_dtype(got[c]) or pd.api.types.is_float_dtype(want[c]):
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)
        else:
            assert (got[c] == want[c]).all(), c


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()) - SLOW))
def test_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).limit(5).collect() is not None
