"""SimHash fingerprints and the search for all fingerprints within a Hamming radius.

Terms are pairs of neighbouring words (a single word where there is only one), weighted
1 + ln(frequency); the sign of each of 64 weighted votes is a bit. For the search, 64 bits
are cut into blocks; fingerprints within the radius agree on all but ``radius`` blocks, so
a table for each choice of the other blocks, keyed by their bits, holds every partner. A key
with more than ``CROWDED`` fingerprints is subdivided by its remaining bits in the same
way, so low-entropy blocks make no all-pairs and nothing is dropped.

Defined cases: a null text counts as empty; a text without words has fingerprint 0; equal
texts have equal fingerprints; null ids come before all others, and rows that share an id
follow each other in order of their text; a single document follows itself; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_rows, documents, mix64, odd_table, parts, text_bytes

RADIUS, BLOCKS = 3, 5
CROWDED = 4096
_LOWEST = -(1 << 63)
_SLICE = 1 << 15


def simhash(texts: list[str]) -> np.ndarray:
    """A 64-bit fingerprint of each text."""
    words = Words(*text_bytes(pa.array(texts, pa.large_string())))
    hashes = words.hashes()
    a, b = odd_table(2, 23)
    with np.errstate(over="ignore"):
        pairs = mix64(hashes[:-1] * a + hashes[1:] * b) if len(hashes) else hashes
    out = np.zeros(len(texts), dtype=np.uint64)
    for i, (first, stop) in enumerate(zip(words.first[:-1], words.first[1:])):
        if stop > first:
            terms, counts = np.unique(pairs[first : stop - 1] if stop - first > 1 else hashes[first:stop], return_counts=True)
            weights = (1 + np.log(counts)).astype(np.float32)
            votes = np.zeros(64, dtype=np.float64)
            for k in range(0, len(terms), _SLICE):
                bits = np.unpackbits(terms[k : k + _SLICE].astype(">u8").view(np.uint8)).reshape(-1, 64)
                votes += weights[k : k + _SLICE] @ bits.astype(np.float32)
            out[i] = np.packbits(2 * votes > weights.sum(dtype=np.float64)).view(">u8")[0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits."""
    return 1 - np.bitwise_count(a ^ b) / 64


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bits long"


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and the likeness to both it and the next document.

    Texts move once: ids are dealt into ranges whose bounds are ids themselves, and the
    document at a bound is also sent, as a guard, to the range before it.
    """
    docs = documents(arrow_rows(df), id_col, text_col).select(F.coalesce("doc_id", F.lit(_LOWEST)).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = 4 * parts(df.sparkSession)
    at = F.array(*[F.lit(i / n) for i in range(n)])
    cuts = np.unique(np.array(docs.agg(F.percentile_approx("key", at, 100 * n)).first()[0] or [0], dtype=np.int64))
    last = len(cuts) - 1

    def deal(batches):
        zip1 = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            keys = batch.column("key").to_numpy()
            home = np.maximum(np.searchsorted(cuts, keys, side="right") - 1, 0)
            guards = np.flatnonzero(cuts[home] == keys)
            rows = np.concatenate((np.arange(len(keys)), guards))
            bucket = np.concatenate((home, np.where(home[guards] == 0, last, home[guards] - 1)))
            texts = batch.column("text").to_pylist()
            body = [zip1(t.encode()) for t in texts]
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int64()), pa.array((np.arange(len(rows)) >= len(keys)).astype(np.int32)), batch.column("key").take(take), batch.column("doc_id").take(take), pa.array([body[i] for i in rows], pa.binary())],
                names=["bucket", "guard", "key", "doc_id", "body"],
            )

    def follow(batches):
        unzip = zstandard.ZstdDecompressor().decompress
        held = None  # the row that still waits for its follower: (bucket, guard, doc_id, text, fingerprint)
        for batch in batches:
            texts = [unzip(x).decode() for x in batch.column("body").to_pylist()]
            prints = simhash(texts)
            rows = list(zip(batch.column("bucket").to_pylist(), batch.column("guard").to_pylist(), batch.column("doc_id").to_pylist(), texts, prints.tolist()))
            todo = []
            for row in rows:
                if held is not None and not held[1] and held[0] == row[0]:
                    todo.append((held, row))
                held = row
            if todo:
                changed = [edited(a[3], b[3]) for a, b in todo]
                own, other = (np.array([x[k][4] for x in todo], dtype=np.uint64) for k in (0, 1))
                new = simhash(changed)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[2] for a, _ in todo], pa.int64()),
                        pa.array([len(a[3]) for a, _ in todo], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
                        pa.array([f"{x:016x}" for x in own.tolist()]),
                        pa.array([f"{x:016x}" for x in new.tolist()]),
                        pa.array(likeness(own, new)),
                        pa.array(likeness(own, other)),
                        pa.array(own.view(np.int64)),
                    ],
                    names=[c.split()[0] for c in RESULT.split(", ")],
                )

    dealt = docs.mapInArrow(deal, "bucket long, guard int, key long, doc_id long, body binary")
    return dealt.repartition(parts(df.sparkSession), "bucket").sortWithinPartitions("bucket", "guard", "key", "body").mapInArrow(follow, RESULT)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _block_masks(bits: list[int], n: int) -> list[int]:
    """Bit positions cut into n runs of nearly equal length, as masks."""
    edges = [len(bits) * i // n for i in range(n + 1)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(edges, edges[1:])]


def within_radius(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All (query, found) of distinct ``bits long`` values that differ in at most ``radius`` bits, each once."""
    cut = _block_masks(list(range(64)), blocks)
    tables = [sum(x) for x in combinations(cut, blocks - radius)]
    finer = [_block_masks([b for b in range(64) if not mask >> b & 1], radius + 1) for mask in tables]

    def keyed(df: DataFrame) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(t).alias("t"), F.col("bits").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(tables)])
        return df.select("bits", F.inline(cells))

    indexed = keyed(index.select("bits").distinct())
    crowded = indexed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("t", "key", F.lit(True).alias("crowded"))

    def subdivided(df: DataFrame) -> DataFrame:
        parts_ = F.element_at(F.array(*[F.array(*[F.lit(_signed(m)) for m in own]) for own in finer]), F.col("t") + 1)
        sub = F.when(F.coalesce("crowded", F.lit(False)), F.transform(parts_, lambda m, i: F.struct(i.alias("s"), F.col("bits").bitwiseAND(m).alias("sub"))))
        whole = F.array(F.struct(F.lit(-1).alias("s"), F.lit(0).cast("long").alias("sub")))
        return df.join(crowded, ["t", "key"], "left").select("bits", "t", "key", F.inline(F.coalesce(sub, whole)))

    left = subdivided(keyed(queries.select("bits").distinct())).withColumnRenamed("bits", "query")
    right = subdivided(indexed).withColumnRenamed("bits", "found")
    near = F.bit_count(F.col("query").bitwiseXOR(F.col("found"))) <= radius
    return left.join(right, ["t", "key", "s", "sub"]).where(near).select("query", "found").distinct()
