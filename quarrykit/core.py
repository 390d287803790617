"""Session, column roles and the hash-based helpers that every operator shares."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import sys
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

SEED = 42
#: Bits of the hash by which strata are cut for numbering: 1024 parts each.
PART_BITS = 10


def session(name: str = "quarrykit", cores: int | str = "*", shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the settings that results rely on (UTC, adaptive execution)."""
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    build = SparkSession.builder.master(f"local[{cores}]").appName(name)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    spark = build.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of numeric type; booleans are not numeric."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {', '.join(missing)}")


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN, the missing marker of array libraries, as NULL."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns or df.columns if kinds[c] in ("double", "float")})


def finite(c: Column | str) -> Column:
    """The value as double, NULL unless it is finite."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def any_of(predicates: list[Column]) -> Column:
    """True where any predicate holds; comparisons with NULL are false."""
    out = F.lit(False)
    for p in predicates:
        out = out | F.coalesce(p, F.lit(False))
    return out


def hash_order(keys: list[str], seed: int = SEED) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))


def hash_unit(keys: list[str], seed: int = SEED) -> Column:
    """A reproducible number in [0, 1) for each key, whatever the partitioning."""
    return F.pmod(hash_order(keys, seed), F.lit(1 << 40)) / F.lit(float(1 << 40))


def sample_exact(df: DataFrame, n: int, keys: list[str], seed: int = SEED) -> DataFrame:
    """Exactly n rows (or all), reproducible: the first n in hash order."""
    return df.orderBy(hash_order(keys, seed), *keys).limit(n)


def hash_rank(df: DataFrame, stratum: str | None, keys: list[str], seed: int = SEED, name: str = "rank") -> DataFrame:
    """``df`` with each row's place, from 0, in hash order of its keys within its stratum, and with ``name``_of, the stratum's rows.

    A stratum is cut by the first bits of the hash, so a class that holds most rows is
    numbered by many tasks; what stands before each part is a small table.
    """
    own = F.col(stratum) if stratum else F.lit(0)
    placed = df.withColumns({"_h": hash_order(keys, seed), "_s": own}).withColumn("_part", F.shiftright("_h", 64 - PART_BITS))
    counts = placed.groupBy("_s", "_part").agg(F.count("*").alias("_n"))
    whole = W.partitionBy("_s")
    before = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col("_s").alias("_s2"), F.col("_part").alias("_part2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias(f"{name}_of"))
    inside = F.row_number().over(W.partitionBy("_s", "_part").orderBy("_h", *keys)) - 1
    joined = placed.withColumn("_in", inside).join(broadcast_if_small(starts), F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_part") == F.col("_part2")))
    return joined.withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_h", "_s", "_part", "_s2", "_part2", "_before", "_in")


def stratified_fraction(df: DataFrame, stratum: str, fraction: float, keys: list[str], seed: int = SEED) -> DataFrame:
    """``in_sample`` is true for round(n * fraction) rows of each stratum."""
    ranked = hash_rank(df, stratum, keys, seed, "_rank")
    return ranked.withColumn("in_sample", F.col("_rank") < F.round(F.col("_rank_of") * fraction)).drop("_rank", "_rank_of")


def fold_of(keys: list[str], k: int) -> Column:
    """A fold in 0..k-1 from the md5 of the key: the same in any engine."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in keys])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")


def stratified_folds(df: DataFrame, stratum: str, k: int, keys: list[str], seed: int = SEED) -> DataFrame:
    return hash_rank(df, stratum, keys, seed, "_rank").withColumn("fold", F.pmod("_rank", F.lit(k)).cast("int")).drop("_rank", "_rank_of")


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The columns of ``right`` in the rows of ``left``, NULL where it has no such key; rows only in ``right`` go. Keys of ``right`` are distinct."""
    return left.select(key).join(right, key, "left")


def side_by_side(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """All columns of two tables with the same distinct keys, one row a key in either; clashing names raise."""
    clash = sorted((set(a.columns) & set(b.columns)) - {key})
    if clash:
        raise ValueError(f"columns in both tables: {', '.join(clash)}")
    return a.join(b, key, "full")


def broadcast_if_small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """A broadcast hint only for a side that is counted and found small; else the join shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder that the session names in spark.checkpoint.dir: its lineage ends there.

    Only a local session that names none gets a temporary folder, which goes with the process.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="quarrykit-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
