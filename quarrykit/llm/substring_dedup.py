"""Exact repeated passages found by fixed-block anchors.

A repeat of ``window`` words holds one whole block of ``(window + 1) // 2`` words of
the grid laid over its own document. So the non-overlapping blocks of all documents
are the index, every rolling window of the block's length is a probe, and a block
that is met anywhere but at its own place is an anchor. Each anchor is extended: the
windows of full length around it are compared by 96 bits, 64 of one hash of their words
and 32 of another, independent one; those that start at two places or more are repeats,
and their union makes the maximal exact repeats.

Documents are dealt into cells by hash. A cell sends each hash once, however often it
holds it, as sorted and delta-coded blobs by hash range. So a passage that a third of
all documents share costs one entry a cell, and no pairs are made.

Defined cases: a null text and an empty text have no words; a text with fewer words
than ``window`` is kept whole; equal rows are separate documents, so their passages
repeat; null ids are kept; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_rows, documents, parts, rolling, text_bytes

CELL_BYTES = 6_000_000
BUCKET_WINDOWS = 4_000_000
#: Bits of an anchor hash beyond those needed to count the windows: it only sifts.
SPARE_BITS = 16
SECOND_SEED = 29


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as compressed byte planes of their gaps."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    planes = gaps.view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u8").ravel(), dtype=np.uint64)


def _cell_words(table: pa.Table) -> tuple[Words, np.ndarray]:
    words = Words(*text_bytes(table.column("text")))
    return words, words.hashes()


def _inside(words: Words, length: int) -> np.ndarray:
    """Word positions at which a run of ``length`` words of one document starts."""
    n = int(words.first[-1])
    ok = np.zeros(max(0, n - length + 1), dtype=bool)
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= length:
            ok[a : b - length + 1] = True
    return np.flatnonzero(ok)


def _merged(hashes: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted hashes, whether each occurs twice, and the OR of its marks."""
    order = np.argsort(hashes, kind="stable")
    hashes, marks = hashes[order], marks[order]
    new = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, int)
    counts = np.diff(np.append(new, len(hashes)))
    some = np.logical_or.reduceat(marks, new) if len(new) else np.zeros(0, bool)
    return hashes[new], counts > 1, some


class Anchors:
    """The block length, the width of sifted hashes and the ranges they are dealt by."""

    def __init__(self, window: int, bits: int, buckets: int):
        self.window, self.bits, self.buckets = window, bits, buckets
        self.block = (window + 1) // 2

    def probes(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, sifted hashes and grid marks of all windows of the block's length."""
        at = _inside(words, self.block)
        sifted = rolling(hashes, self.block, 3)[at] >> np.uint64(64 - self.bits)
        doc = np.searchsorted(words.first, at, side="right") - 1
        return at, sifted, (at - words.first[doc]) % self.block == 0

    def candidates(self, words: Words, hashes: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions and two-part hashes of full windows that hold an anchor."""
        at, sifted, grid = self.probes(words, hashes)
        found = np.zeros(len(at), dtype=bool)
        if len(anchors) and len(at):
            found = anchors[np.minimum(np.searchsorted(anchors, sifted), len(anchors) - 1)] == sifted
        seen = np.zeros((2, len(hashes) + 1), dtype=np.int64)
        for row, hits in zip(seen, (at[found], at[found & grid])):
            row[hits + 1] = 1
        seen = np.cumsum(seen, axis=1)
        full = _inside(words, self.window)
        reach = full + self.window - self.block + 1
        full = full[((seen[:, reach] - seen[:, full]) > 0).all(axis=0)]
        if not len(full):
            return full, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return full, rolling(hashes, self.window, 5)[full], rolling(self.others(words, full), self.window, 7)[full] >> np.uint64(32)

    def others(self, words: Words, full: np.ndarray) -> np.ndarray:
        """Hashes of the words in the windows at ``full``, by other multipliers than those that found them; 0 elsewhere."""
        step = np.zeros(len(words.starts) + 1, dtype=np.int64)
        step[full] += 1
        step[full + self.window] -= 1
        inside = np.flatnonzero(np.cumsum(step)[:-1] > 0)
        out = np.zeros(len(words.starts), dtype=np.uint64)
        out[inside] = words.hashes(SECOND_SEED, inside)
        return out

    def split(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """Bounds of the buckets in a sorted array of hashes of ``width`` bits."""
        edges = [(b << width) // self.buckets for b in range(1, self.buckets)]
        return np.concatenate(([0], np.searchsorted(hashes, np.array(edges, dtype=np.uint64)), [len(hashes)])).astype(np.int64)


PACKED = "cell long, bucket int, body binary, marks binary, more binary"
REPLY = "cell long, body binary, more binary"


def _rows(cell: int, spans: np.ndarray, main: np.ndarray, marks: np.ndarray, more: np.ndarray | None) -> pa.Table:
    zip1 = zstandard.ZstdCompressor(level=1).compress
    rows = [(cell, b, pack(main[i:j]), zip1(marks[i:j].tobytes()), more[i:j].astype("<u4").tobytes() if more is not None else b"") for b, (i, j) in enumerate(zip(spans[:-1], spans[1:])) if j > i]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], names=["cell", "bucket", "body", "marks", "more"])


def _reply(cells: list[int], bodies: list[bytes], more: list[bytes]) -> pa.Table:
    return pa.table([pa.array(cells, pa.int64()), pa.array(bodies, pa.binary()), pa.array(more, pa.binary())], names=["cell", "body", "more"])


def repeats(df: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_removed, spans (word ranges of the maximal repeats) and kept_text."""
    spark = df.sparkSession
    docs = documents(arrow_rows(df), id_col, text_col)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    cells = max(parts(spark), -(-size[0] // CELL_BYTES))
    buckets = max(parts(spark), -(-size[0] // (6 * BUCKET_WINDOWS)))
    plan = Anchors(window, min(62, max(40, int(size[0]).bit_length() + SPARE_BITS)), buckets)
    dealt = docs.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text"), F.lit(cells))).repartition(parts(spark), "cell")

    def probe(table: pa.Table) -> pa.Table:
        words, hashes = _cell_words(table)
        _, sifted, grid = plan.probes(words, hashes)
        main, twice, grid = _merged(sifted, grid)
        return _rows(table.column("cell")[0].as_py(), plan.split(main, plan.bits), main, twice + 2 * grid.astype(np.uint8), None)

    def anchor(table: pa.Table) -> pa.Table:
        """Of one range of hashes: those of a block that occur at two places, back to the cells that hold them."""
        main = [unpack(b) for b in table.column("body").to_pylist()]
        marks = [np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8) for b in table.column("marks").to_pylist()]
        flat, flags = np.concatenate(main), np.concatenate(marks)
        kept, many, block = _merged(flat, (flags & 2) > 0)
        own = np.zeros(len(kept), dtype=bool)
        own[np.searchsorted(kept, flat[(flags & 1) > 0])] = True
        kept = kept[(many | own) & block]
        held = [np.intersect1d(x, kept, assume_unique=True) for x in main]
        full = [i for i, x in enumerate(held) if len(x)]
        cell = table.column("cell").to_pylist()
        return _reply([cell[i] for i in full], [pack(held[i]) for i in full], [b""] * len(full))

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _rows(0, np.zeros(1, int), np.zeros(0), np.zeros(0), None)
        words, hashes = _cell_words(left)
        _, main, more = plan.candidates(words, hashes, np.sort(np.concatenate([unpack(b) for b in right.column("body").to_pylist()])))
        order = np.lexsort((more, main))
        main, more = main[order], more[order]
        new = np.flatnonzero(np.concatenate(([True], (main[1:] != main[:-1]) | (more[1:] != more[:-1])))) if len(main) else np.zeros(0, int)
        twice = (np.diff(np.append(new, len(main))) > 1).astype(np.uint8)
        return _rows(left.column("cell")[0].as_py(), plan.split(main[new], 64), main[new], twice, more[new])

    def confirm(table: pa.Table) -> pa.Table:
        """Of one range of hashes: full windows that start at two places, back to the cells that hold them."""
        main = [unpack(b) for b in table.column("body").to_pylist()]
        more = [np.frombuffer(b, "<u4").astype(np.uint64) for b in table.column("more").to_pylist()]
        twice = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8) for b in table.column("marks").to_pylist()])
        flat, rest, owner = np.concatenate(main), np.concatenate(more), np.repeat(np.arange(len(main)), [len(x) for x in main])
        order = np.lexsort((rest, flat))
        flat, rest, owner, twice = flat[order], rest[order], owner[order], twice[order]
        new = np.flatnonzero(np.concatenate(([True], (flat[1:] != flat[:-1]) | (rest[1:] != rest[:-1]))))
        count = np.diff(np.append(new, len(flat)))
        good = np.repeat((count > 1) | (np.add.reduceat(twice.astype(np.int64), new) > 0), count)
        flat, rest, owner = flat[good], rest[good], owner[good]
        cell, cells_, bodies, others = table.column("cell").to_pylist(), [], [], []
        for i in np.unique(owner):
            pick = owner == i
            cells_.append(cell[i])
            bodies.append(pack(flat[pick]))
            others.append(rest[pick].astype("<u4").tobytes())
        return _reply(cells_, bodies, others)

    def remove(left: pa.Table, right: pa.Table, third: pa.Table) -> pa.Table:
        words, hashes = _cell_words(left)
        covered = np.zeros(len(hashes), dtype=bool)
        if right.num_rows and third.num_rows:
            at, main, more = plan.candidates(words, hashes, np.sort(np.concatenate([unpack(b) for b in right.column("body").to_pylist()])))
            pair = np.dtype([("a", np.uint64), ("b", np.uint64)])
            known = np.empty(sum(len(b) // 4 for b in third.column("more").to_pylist()), dtype=pair)
            known["a"] = np.concatenate([unpack(b) for b in third.column("body").to_pylist()])
            known["b"] = np.concatenate([np.frombuffer(b, "<u4") for b in third.column("more").to_pylist()])
            mine = np.empty(len(at), dtype=pair)
            mine["a"], mine["b"] = main, more
            step = np.zeros(len(hashes) + 1, dtype=np.int64)
            hit = at[np.isin(mine, known)]
            np.add.at(step, hit, 1)
            np.add.at(step, hit + window, -1)
            covered = np.cumsum(step)[:-1] > 0
        return _kept(left, words, covered)

    probed = dealt.groupBy("cell").applyInArrow(probe, PACKED)
    anchors = probed.groupBy("bucket").applyInArrow(anchor, REPLY)
    full = dealt.groupBy("cell").cogroup(anchors.groupBy("cell")).applyInArrow(extend, PACKED)
    confirmed = full.groupBy("bucket").applyInArrow(confirm, REPLY)
    both = anchors.withColumn("kind", F.lit(1)).unionByName(confirmed.withColumn("kind", F.lit(2)))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = right.column("kind").to_numpy(zero_copy_only=False) if right.num_rows else np.zeros(0)
        return remove(left, right.filter(pa.array(kind == 1)), right.filter(pa.array(kind == 2))) if left.num_rows else _none()

    return dealt.groupBy("cell").cogroup(both.groupBy("cell")).applyInArrow(finish, RESULT)


RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<first:long,stop:long>>, kept_text string"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))


def _none() -> pa.Table:
    return pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), _SPANS, pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])


def _kept(table: pa.Table, words: Words, covered: np.ndarray) -> pa.Table:
    n, removed, spans, kept = [], [], [], []
    ends = words.first.tolist()
    for text, a, b in zip(table.column("text").to_pylist(), ends[:-1], ends[1:]):
        mark = covered[a:b]
        edge = np.flatnonzero(np.diff(mark.astype(np.int8), prepend=0, append=0)) if mark.any() else []
        spans.append([{"first": int(i), "stop": int(j)} for i, j in zip(edge[::2], edge[1::2])])
        pieces = (text or "").encode().split()
        n.append(b - a)
        removed.append(int(mark.sum()))
        kept.append(b" ".join(compress(pieces, (~mark).tolist()) if removed[-1] else pieces).decode())
    return pa.table([table.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])
