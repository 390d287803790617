"""Shared pieces of the corpus operators: durable tables, Arrow views, hashing."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LIBC = ctypes.CDLL(None)
#: Rows and bytes of one Arrow batch; long texts make batches of many rows heavy.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
#: The separators of ``[^\x20\x09-\x0D]+`` as a byte table.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes with A-Z lowered and nothing else changed.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Text bytes hashed at once, which bounds the working memory.
HASH_BYTES = 500_000
#: Text bytes that a Python operator works on at once, or one text.
SLICE_BYTES = 1 << 20


_LOCAL = re.compile(r"local(\[[^\]]*\])?")
_OWN_FOLDERS: list[str] = []
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in a local session that sets none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not _LOCAL.fullmatch(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _OWN_FOLDERS.append(tempfile.mkdtemp(prefix="quarrykit-"))
        atexit.register(shutil.rmtree, _OWN_FOLDERS[-1], ignore_errors=True)
        folder = "file://" + _OWN_FOLDERS[-1]
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/quarrykit/{what}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def durable(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: its lineage ends there.

    The table stays until ``discard`` or ``clean_up``, as results are lazy and read it.
    """
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    trim_driver(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _WRITTEN.remove(path)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table.written_at)


def clean_up(spark: SparkSession) -> int:
    """Deletes all tables and archives that this process wrote; for the end of a job, when no result is read any more."""
    paths = list(_WRITTEN)
    for path in paths:
        _delete(spark, path)
    return len(paths)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """What this process freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def trim_driver(spark: SparkSession) -> str:
    """What the driver's JVM freed outside its heap (plans' code, threads, compilers) goes back to the system; its answer, empty from a JVM without that command."""
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        kinds = new_array(jvm.java.lang.Class, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.java.lang.Class.forName(name)
        values = new_array(jvm.java.lang.Object, 4)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)  # the server's own class is closed
        return str(invoke.invoke(server, values))
    except Py4JError:
        return ""


@contextmanager
def trimmed():
    """Around a task's batches in a Python worker, as workers outlive tasks."""
    try:
        yield
    finally:
        trim()


def slices(batch: pa.RecordBatch, column: str = "text"):
    """All rows of ``batch`` in parts of at most ``SLICE_BYTES`` of text, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < len(ends):
        before = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield batch.slice(i, j - i)
        i = j


def arrow_rows(df: DataFrame) -> DataFrame:
    """Bounds the Arrow batches that Python operators of this session get."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer over unsigned 64-bit integers (Steele et al., SplitMix)."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_table(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers that depend on ``seed`` only."""
    with np.errstate(over="ignore"):
        base = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix64(base + np.uint64(seed) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


_TABLES: dict[int, np.ndarray] = {}


def _multipliers(n: int, seed: int) -> np.ndarray:
    table = _TABLES.get(seed)
    if table is None or len(table) < n:
        table = odd_table(max(4096, n), seed)
        if n <= 1 << 20:
            _TABLES[seed] = table
    return table


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n, at = len(texts), texts.offset
    _, where, data = texts.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, dtype=np.int64)[at : at + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


class Words:
    """The words of a column of texts: byte bounds, and each text's range of words."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        sep = SEPARATOR[raw]
        n = len(raw)
        inner = offsets[(offsets > 0) & (offsets < n)]
        before = np.ones(n, dtype=bool)
        before[1:] = sep[:-1]
        before[inner] = True
        after = np.ones(n, dtype=bool)
        after[:-1] = sep[1:]
        after[inner - 1] = True
        self.raw = raw
        self.starts = np.flatnonzero(before & ~sep)
        self.ends = np.flatnonzero(after & ~sep) + 1
        self.first = np.searchsorted(self.starts, offsets)  # n + 1 word offsets

    def hashes(self, seed: int = 1, which: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit multilinear hash of the bytes of each word, or of those at the positions ``which``."""
        starts, ends = (self.starts, self.ends) if which is None else (self.starts[which], self.ends[which])
        out = np.empty(len(starts), dtype=np.uint64)
        lens = ends - starts
        total = np.concatenate(([0], np.cumsum(lens)))
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(total, total[i] + HASH_BYTES, side="right")) - 1)
            out[i:j] = self._hash(starts[i:j], lens[i:j], seed)
            i = j
        return out

    def _hash(self, starts: np.ndarray, lens: np.ndarray, seed: int) -> np.ndarray:
        table = _multipliers(int(lens.max()), seed)
        heads = np.cumsum(lens) - lens
        rank = np.arange(int(lens.sum())) - np.repeat(heads, lens)
        with np.errstate(over="ignore"):
            terms = (self.raw[rank + np.repeat(starts, lens)].astype(np.uint64) + np.uint64(1)) * table[rank]
            return mix64(np.add.reduceat(terms, heads) + lens.astype(np.uint64))


def rolling(hashes: np.ndarray, length: int, seed: int) -> np.ndarray:
    """The hash of every run of ``length`` neighbours, over one array of word hashes."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    table = odd_table(length, seed)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for t in range(length):
            out += hashes[t : t + n] * table[t]
    return mix64(out)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator needs, under fixed names."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
