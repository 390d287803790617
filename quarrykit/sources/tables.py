"""Tables and series in and out of files, and the thin dataset wrapper with its target and time roles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import require
from ..operators import profile


def load_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV file with a header, or Parquet, ORC or JSON by its ending; without a schema CSV types are inferred, which reads it twice."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        if kind in ("parquet", "orc", "json"):
            return getattr(reader, kind)(path)
        return reader.option("header", True).option("inferSchema", schema is None).csv(path)
    except Exception as e:
        raise OSError(f"can't read {path}: {e}") from e


def save_table(df: DataFrame, path: str, kind: str = "csv", one_file: bool = False, partition_by: list[str] | None = None) -> str:
    """Writes a directory of CSV files with a header, or Parquet; ``one_file`` sends all rows through one task."""
    out = df.coalesce(1) if one_file else df
    writer = out.write.mode("overwrite")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(kind).save(path)
    return path


def load_series(spark: SparkSession, path: str, time: str = "Date", rename: dict[str, str] | None = None, schema: str | None = None) -> DataFrame:
    """A table with a time column; times that can't be read become NULL. Order is stated by each operator, not stored."""
    df = load_table(spark, path, schema).withColumnsRenamed(rename or {})
    require(df, time)
    return df.withColumn(time, F.try_to_timestamp(F.col(time).cast("string"))) if dict(df.dtypes)[time] == "string" else df


@dataclass(frozen=True)
class Dataset:
    """A DataFrame with the names of its target, time and entity columns."""

    data: DataFrame
    target: str | None = None
    time: str | None = None
    entity: str | None = None

    def __post_init__(self) -> None:
        require(self.data, *[c for c in (self.target, self.time, self.entity) if c])

    def checked(self) -> Dataset:
        """Fails on an empty table (one short job)."""
        if self.data.isEmpty():
            raise ValueError("the table is empty")
        return self

    def with_target(self, target: str) -> Dataset:
        return replace(self, target=target)

    @property
    def features(self) -> DataFrame:
        return self.data.drop(self.target) if self.target else self.data

    @property
    def labels(self) -> DataFrame:
        if not self.target:
            raise ValueError("no target is set")
        return self.data.select(self.target)

    def info(self) -> DataFrame:
        return profile.table_info(self.data, self.time)

    def clone(self) -> Dataset:
        """DataFrames don't change, so a clone is the same plan."""
        return replace(self)

    def accept(self, service: Callable[[DataFrame], DataFrame]) -> Dataset:
        return replace(self, data=self.data.transform(service))


def pipeline(df: DataFrame, *services: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Services one after the other."""
    return reduce(lambda d, f: d.transform(f), services, df)
