"""Streaming twins of the daily operators: windowed sums with a watermark, running moments, flags against a fit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import outlier


def daily_stream(stream: DataFrame, time: str, value: str, entity: str, late: str = "2 days") -> DataFrame:
    """(entity, d, y, n): one row a day, closed when the watermark passes; later events are left out."""
    t = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    g = t.groupBy(F.window("_t", "1 day"), entity).agg(F.sum(F.col(value).cast("double")).alias("y"), F.count("*").alias("n"))
    return g.select(entity, F.to_date("window.start").alias("d"), "y", "n")


def sessions(stream: DataFrame, time: str, entity: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(entity, start, stop, n) of runs of events without a longer gap."""
    t = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    g = t.groupBy(F.session_window("_t", gap), entity).agg(F.count("*").alias("n"))
    return g.select(entity, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def running_moments(stream: DataFrame, value: str, entity: str) -> DataFrame:
    """(entity, n, mean, sd_pop) so far, for incremental scaling: run in update or complete mode."""
    return stream.groupBy(entity).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd_pop"))


def flag_stream(stream: DataFrame, fit: dict[str, tuple[float, float]], threshold: float = 3.0) -> DataFrame:
    """Each event with ``is_outlier`` against a fit on static data."""
    return stream.withColumn("is_outlier", outlier.zscore_mask(fit, threshold))


def difference_stream(stream: DataFrame, time: str, value: str, entity: str) -> DataFrame:
    """(entity, time, y, diff): difference to the entity's previous event, kept as state; a batch is taken in time order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(time)
        last = state.get[0] if state.exists else None
        y = pdf[value].astype(float)
        diff = y.diff()
        if last is not None and len(diff):
            diff.iloc[0] = y.iloc[0] - last
        state.update((float(y.iloc[-1]),))
        yield pd.DataFrame({entity: key[0], time: pdf[time], "y": y, "diff": diff})

    kinds = dict(stream.dtypes)
    return stream.groupBy(entity).applyInPandasWithState(step, f"{entity} {kinds[entity]}, {time} {kinds[time]}, y double, diff double", "last double", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs what is available and returns it as an in-memory table, for tests and bounded backfills."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
