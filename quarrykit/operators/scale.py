"""Scalers of numeric columns: a fit is one aggregate, a transform is column expressions.

Missing values are left out of the fit and kept by the transform; other columns pass
through; a zero range, deviation or interquartile range divides by 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import numeric_columns, require
from ..functions.distributions import normal_ppfs
from ..functions.order import quantiles

NORMAL_CLIP = 5.199337582187473  # the normal quantile of 1 - 1e-7
QUANTILES = 1000


@dataclass
class Scaler:
    """(shift, divisor, factor, offset) of each column: (x - shift) / divisor * factor + offset."""

    terms: dict[str, tuple[float, float, float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        require(df, *self.terms)

        def scaled(c: str, t: tuple[float, float, float, float]) -> Column:
            return (F.col(c).cast("double") - F.lit(t[0])) / F.lit(t[1]) * F.lit(t[2]) + F.lit(t[3])

        return df.withColumns({c: scaled(c, t) for c, t in self.terms.items()})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(o)) / F.lit(f) * F.lit(d) + F.lit(s) for c, (s, d, f, o) in self.terms.items()})


def _checked(df: DataFrame, columns: list[str] | None) -> list[str]:
    columns = columns or numeric_columns(df)
    if not columns:
        raise ValueError("no numeric columns")
    return columns


def _number(c: str) -> Column:
    return F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))


def _stats(df: DataFrame, columns: list[str] | None, aggs: dict) -> tuple[list[str], dict]:
    columns = _checked(df, columns)
    x = {c: _number(c) for c in columns}
    row = df.agg(*[f(x[c]).alias(f"{k}:{c}") for c in columns for k, f in aggs.items()]).first()
    return columns, {c: {k: row[f"{k}:{c}"] for k in aggs} for c in columns}


def minmax(df: DataFrame, columns: list[str] | None = None, low: float = 0.0, high: float = 1.0) -> Scaler:
    columns, s = _stats(df, columns, {"min": F.min, "max": F.max})
    return Scaler({c: (v["min"], (v["max"] - v["min"]) or 1.0, high - low, low) for c, v in s.items() if v["min"] is not None})


def zscore(df: DataFrame, columns: list[str] | None = None, with_mean: bool = True, with_std: bool = True) -> Scaler:
    columns, s = _stats(df, columns, {"avg": F.avg, "sd": F.stddev_pop})
    return Scaler({c: (v["avg"] if with_mean else 0.0, (v["sd"] or 1.0) if with_std else 1.0, 1.0, 0.0) for c, v in s.items() if v["avg"] is not None})


def robust(df: DataFrame, columns: list[str] | None = None, centering: bool = True, scaling: bool = True, quantile_range: tuple[float, float] = (25.0, 75.0)) -> Scaler:
    columns = _checked(df, columns)
    q = quantiles(df, {c: _number(c) for c in columns}, [p / 100 for p in (quantile_range[0], 50.0, quantile_range[1])])
    return Scaler({c: (v[1] if centering else 0.0, ((v[2] - v[0]) or 1.0) if scaling else 1.0, 1.0, 0.0) for c, v in q.items() if v})


@dataclass
class QuantileScaler:
    """The reference quantiles of each column; values between them are interpolated, ties from both sides."""

    grids: dict[str, list[float]]
    output: str = "uniform"

    def transform(self, df: DataFrame) -> DataFrame:
        require(df, *self.grids)
        normal = self.output == "normal"

        def mapper(grid: list[float]):
            q = np.array(grid)
            r = np.linspace(0, 1, len(q))

            @F.pandas_udf("double")
            def place(x: pd.Series) -> pd.Series:
                v = x.to_numpy(dtype=float)
                u = 0.5 * (np.interp(v, q, r) - np.interp(-v, -q[::-1], -r[::-1]))
                u[np.isnan(v)] = np.nan
                if normal:
                    u = np.clip(normal_ppfs(u), -NORMAL_CLIP, NORMAL_CLIP)
                return pd.Series(u).where(~np.isnan(v))

            return place

        return df.withColumns({c: mapper(g)(F.col(c).cast("double")) for c, g in self.grids.items()})


def quantile(df: DataFrame, columns: list[str] | None = None, n_quantiles: int = QUANTILES, output: str = "uniform") -> QuantileScaler:
    columns = columns or numeric_columns(df)
    n = min(n_quantiles, max(1, df.count()))
    q = quantiles(df, {c: _number(c) for c in columns}, np.linspace(0, 1, n).tolist())
    return QuantileScaler({c: np.maximum.accumulate(v).tolist() for c, v in q.items() if v}, output)
