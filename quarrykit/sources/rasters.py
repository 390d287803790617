"""Images from class folders as raster rows, and rasters back to PNG files or tables."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ENDINGS = ("jpg", "jpeg", "png")
BATCH_ROWS = 64


def image_paths(spark: SparkSession, folder: str, classes: list[str]) -> DataFrame:
    """(path, class, label from 1, file_name): files of the known class folders, numbered by path within their class."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    parts = F.split("path", "/")
    ending = F.lower(F.element_at(F.split(F.element_at(parts, -1), r"\."), -1))
    known = F.create_map(*[F.lit(v) for i, c in enumerate(classes) for v in (c, i + 1)])
    name = F.element_at(parts, -2)
    rows = files.where(ending.isin(*ENDINGS)).select("path", name.alias("class"), known[name].alias("label"), ending.alias("_e")).where(F.col("label").isNotNull())
    n = F.row_number().over(W.partitionBy("class").orderBy("path")) - 1
    return rows.select("path", "class", "label", F.concat("class", F.lit("_"), n.cast("string"), F.lit("."), "_e").alias("file_name"))


def load_images(spark: SparkSession, folder: str, classes: list[str], only: str | None = None) -> DataFrame:
    """(path, class, label, height, width, channels, pixels) in RGB order; files that can't be decoded are left out with their labels."""
    where = f"{folder.rstrip('/')}/{only}" if only else folder
    raw = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(where).select("image.*")
    known = F.create_map(*[F.lit(v) for i, c in enumerate(classes) for v in (c, i + 1)])
    name = F.element_at(F.split("origin", "/"), -2)
    rows = raw.select(F.col("origin").alias("path"), name.alias("class"), known[name].alias("label"), "height", "width", F.col("nChannels").alias("channels"), "data")

    @F.pandas_udf("array<double>")
    def rgb(data: pd.Series, channels: pd.Series) -> pd.Series:
        def one(b: bytes, c: int) -> np.ndarray:
            x = np.frombuffer(b, np.uint8).reshape(-1, c).astype(float)
            return (x[:, [2, 1, 0, *range(3, c)]] if c >= 3 else x).ravel()

        return pd.Series([one(b, c) for b, c in zip(data, channels)])

    return rows.where(F.col("label").isNotNull()).withColumn("pixels", rgb("data", "channels")).drop("data")


def png(x: np.ndarray) -> bytes:
    """An 8-bit grey or RGB raster as PNG bytes."""
    h, w = x.shape[:2]
    body = np.clip(np.round(x), 0, 255).astype(np.uint8).reshape(h, -1)
    lines = np.zeros((h, body.shape[1] + 1), dtype=np.uint8)
    lines[:, 1:] = body

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 0 if x.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def encode_png(df: DataFrame, stretch: bool = False) -> DataFrame:
    """Adds ``png`` bytes; ``stretch`` spreads each raster over 0..255 first."""

    @F.pandas_udf("binary")
    def run(h: pd.Series, w: pd.Series, c: pd.Series, px: pd.Series) -> pd.Series:
        out = []
        for a, b, k, p in zip(h, w, c, px):
            x = np.asarray(p, dtype=float).reshape((a, b) if k == 1 else (a, b, k))
            if stretch and x.max() > x.min():
                x = (x - x.min()) / (x.max() - x.min()) * 255
            out.append(png(x))
        return pd.Series(out)

    return df.withColumn("png", run("height", "width", "channels", "pixels"))


def save_images(df: DataFrame, folder: str, name: str = "file_name") -> DataFrame:
    """Writes <folder>/<class>/<name> for each row, the class being the name up to its first ``_``; (path, n_bytes) of each.

    Each file is written whole under a name of the task's own and renamed, so a task that
    runs again leaves the same files.
    """
    from pyarrow import fs

    target = folder if "://" in folder else f"file://{folder}"

    def write(batches):
        files, base = fs.FileSystem.from_uri(target)
        for pdf in batches:
            out = []
            for n, body in zip(pdf[name], pdf["png"]):
                place = f"{base}/{n.split('_')[0]}"
                files.create_dir(place, recursive=True)
                with files.open_output_stream(f"{place}/.{n}.part") as f:
                    f.write(body)
                files.move(f"{place}/.{n}.part", f"{place}/{n}")
                out.append((f"{place}/{n}", len(body)))
            yield pd.DataFrame(out, columns=["path", "n_bytes"])

    return encode_png(df).select(name, "png").mapInPandas(write, "path string, n_bytes long")


def remove_files(paths: DataFrame, source: str, archive: str) -> DataFrame:
    """Moves files out of ``source`` to ``archive``: (path, moved); a file that is gone is reported, not raised."""
    from pyarrow import fs

    def run(batches):
        for pdf in batches:
            out = []
            for p in pdf["path"]:
                plain = p.removeprefix("file://").removeprefix("file:")
                files, base = fs.FileSystem.from_uri(archive if "://" in archive else f"file://{archive}")
                files.create_dir(base, recursive=True)
                try:
                    files.move(plain, f"{base}/{plain.rsplit('/', 1)[-1]}")
                    out.append((p, True))
                except OSError:
                    out.append((p, False))
            yield pd.DataFrame(out, columns=["path", "moved"])

    return paths.select("path").mapInPandas(run, "path string, moved boolean")
