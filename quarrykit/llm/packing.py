"""Best-fit decreasing packing of token pieces into sequences.

Pieces of one length are interchangeable, so the plan is made over counts of lengths:
best-fit decreasing with a segment tree over remaining capacities, where one step puts
all pieces of a length that fit into all open bins of the tightest capacity. The plan
names bins and ranks only; its size depends on the capacity, not on the documents.
Pieces then find their rank within their length in Spark, in salted groups, and join
the plan by length and rank range.

Defined cases: a null or empty text is its end token alone; repeated rows and repeated
or null ids are packed as separate documents; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import LOWER, arrow_rows, documents, durable, slices, text_bytes, trim, trimmed

CAPACITY = 4096
END_ID = 1
#: Runs of letters or signs whose ids a worker remembers (some 60 MB).
CACHE_RUNS = 300_000
#: Pieces of one length that one task numbers at most, about.
SALT_ROWS, LEAST_SALTS = 1_000_000, 64
#: Plan steps that are broadcast (8 MB); longer plans go to this many tasks a length.
BROADCAST_STEPS, PLAN_COPIES = 200_000, 64
#: Plan steps that one length and rank block may meet in the join.
RANK_BLOCK = 64


class TightestFit:
    """A segment tree over capacities: the smallest one in use that is at least a given length."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.used = np.zeros(2 * self.base, dtype=bool)

    def set(self, at: int, on: bool) -> None:
        i = at + self.base
        self.used[i] = on
        while i > 1:
            i //= 2
            on = bool(self.used[2 * i] or self.used[2 * i + 1])
            if self.used[i] == on:
                break
            self.used[i] = on

    def find(self, least: int) -> int | None:
        i = least + self.base
        if self.used[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.used[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return None
        while i < self.base:
            i = 2 * i if self.used[2 * i] else 2 * i + 1
        return i - self.base


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Steps (length, first rank, pieces, first bin, offset) of best-fit decreasing, and the number of bins."""
    steps, bins = [], 0
    open_: dict[int, list[tuple[int, int]]] = {}
    tree = TightestFit(capacity)

    def add(rest: int, first: int, n: int) -> None:
        if rest:
            open_.setdefault(rest, []).append((first, n))
            tree.set(rest, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            rest = tree.find(length)
            if rest is None:
                each = capacity // length
                full, odd = divmod(left, each)
                for k in range(each if full else 0):
                    steps.append((length, rank, full, bins, k * length))
                    rank += full
                for k in range(odd):
                    steps.append((length, rank, 1, bins + full, k * length))
                    rank += 1
                if full:
                    add(capacity - each * length, bins, full)
                if odd:
                    add(capacity - odd * length, bins + full, 1)
                bins += full + bool(odd)
                left = 0
                continue
            first, n = open_[rest].pop()
            if not open_[rest]:
                tree.set(rest, False)
            put = min(n, left)
            steps.append((length, rank, put, first, capacity - rest))
            rank, left = rank + put, left - put
            if put < n:
                add(rest, first + put, n - put)
            add(rest - length, first, put)
    return steps, bins


#: The split that this module knows, as the tokenizer file states it: letters, single digits, or signs, lower-cased.
_KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of Latin letters, ASCII digits and plain signs only: the tokenizer cuts these at each change of kind and after each digit.
_NOT_PLAIN = r"[^A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:;=?@\[-`{}~]"
_KIND = np.full(256, 1, dtype=np.uint8)  # letters, and the bytes of those beyond ASCII
_KIND[0x21:0x7F] = 3
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
_TOGETHER = 1000


def _spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lens[i] - 1 of all i, one after the other."""
    ends = np.cumsum(lens)
    out = np.arange(int(ends[-1]) if len(ends) else 0)
    return out + np.repeat(starts - (ends - lens), lens)


class WordIds:
    """Token ids of columns of texts, by their distinct words: the tokenizer drops white space and no token spans it.

    Plain words are made of runs whose ids are found many at a time and remembered, at most
    ``CACHE_RUNS`` of them; the token that ends a run is known by its vocabulary entry. All
    other words are given to the tokenizer. A tokenizer that splits in another way than
    ``_KNOWN_SPLIT`` with word ends gets whole texts instead.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        stated = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}  # without reading the vocabulary again
        splits = (stated.get("pretokenizers") or [{}])[0].get("pattern") or {}
        self.by_word = splits.get("Regex") == _KNOWN_SPLIT and getattr(self.tokenizer.model, "end_of_word_suffix", None) == "</w>"
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for k, i in vocabulary.items() if k.endswith("</w>")]] = True
        self.merger = Tokenizer(self.tokenizer.model)  # the same model for runs, which need neither normalizing nor splitting
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.forget()
        del stated, vocabulary
        trim()

    def forget(self) -> None:
        self.runs: dict[str, int] = {}
        self.flat, self.starts = np.zeros(1 << 16, dtype="<u4"), np.zeros(1 << 16, dtype=np.int64)

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), dtype="<u4"), np.array([len(x) for x in found], dtype=np.int64)

    def _learn(self, new: list[str]) -> None:
        ids, _ = self._ids(self.merger, [" ".join(new[i : i + _TOGETHER]) for i in range(0, len(new), _TOGETHER)])
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(new):
            raise ValueError("a run has another number of tokens' ends than one")
        n = len(self.runs)
        at = int(self.starts[n])
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(new) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[at : at + len(ids)] = ids
        self.starts[n + 1 : n + len(new) + 1] = at + stops  # where each run's ids end and the next one's start
        self.runs.update(zip(new, range(n, n + len(new))))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words in a row, and how many each has."""
        raw, offsets = text_bytes(words)
        second = np.zeros(len(raw), dtype=bool)  # of the two bytes of a letter beyond ASCII
        second[1:] = raw[:-1] == 0xC3
        low = LOWER[raw]
        low[second & (raw <= 0x9E)] += 0x20
        kind = _KIND[raw]
        begins = kind == 2
        begins[1:] |= kind[1:] != kind[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        edges = np.append(np.flatnonzero(begins), len(raw))
        runs = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(low)]).dictionary_encode()
        names = runs.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.runs) + len(names) > CACHE_RUNS:
            self.forget()
        if new := [x for x in names if x not in self.runs]:
            self._learn(new)
        run = np.array(list(map(self.runs.__getitem__, names)), dtype=np.int64)[runs.indices.to_numpy()]
        first = self.starts[run]
        lens = self.starts[run + 1] - first
        total = np.concatenate(([0], np.cumsum(lens)))
        return self.flat[_spread(first, lens)], np.diff(total[np.searchsorted(edges, offsets)])

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has; null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        if not self.by_word:
            return self._ids(self.tokenizer, texts.to_pylist())
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        strange = pc.match_substring_regex(coded.dictionary, _NOT_PLAIN)
        order = np.argsort(strange.to_numpy(zero_copy_only=False), kind="stable")  # plain words first
        odd = coded.dictionary.filter(strange)
        ids, lens = self._words(coded.dictionary.filter(pc.invert(strange)))
        if len(odd):
            more, own = self._ids(self.tokenizer, odd.to_pylist())
            ids, lens = np.concatenate([ids, more]), np.concatenate([lens, own])
        starts = np.empty(len(lens), dtype=np.int64)
        starts[order] = np.cumsum(lens) - lens
        lens[order] = lens.copy()
        word = coded.indices.to_numpy()
        each = lens[word]
        out = ids[_spread(starts[word], each)]
        total = np.concatenate(([0], np.cumsum(each)))
        bounds = split.offsets.to_numpy()
        return out, np.diff(total[bounds - bounds[0]])


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def token_pieces(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, digest: bool = False) -> DataFrame:
    """doc_id, piece, start, length, and ids (binary) or their ids_crc32: each text's ids and the end id, cut only where longer than ``capacity``."""
    last = ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), last]

    def cut(batches):
        with trimmed():
            model = encoder(tokenizer_path)
            for batch in (part for given in batches for part in slices(given)):
                ids, lens = model.encode_column(batch.column("text"))
                stops = np.cumsum(lens)
                whole = np.insert(ids, stops, np.uint32(end_id)).astype("<u4", copy=False)  # an end id behind each text
                lens = lens + 1
                pieces = -(-lens // capacity)
                row = np.repeat(np.arange(len(lens)), pieces)
                piece = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, lens[row] - start)
                at = (np.cumsum(lens) - lens)[row] + start
                body = memoryview(whole.tobytes())
                cuts = (body[4 * i : 4 * (i + n)] for i, n in zip(at.tolist(), length.tolist()))
                end = pa.array([zlib.crc32(x) for x in cuts], pa.int64()) if digest else pa.array([bytes(x) for x in cuts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), end], names=[n for n, _ in kinds])

    return df.mapInArrow(cut, "doc_id long, piece int, start long, length long, " + ("ids_crc32 long" if digest else "ids binary"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table with doc_id, piece, length and more) with sequence_id and offset."""
    spark = pieces.sparkSession
    amounts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row a length
    salts = max(LEAST_SALTS, -(-max(amounts.values(), default=0) // SALT_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*pieces.columns), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    steps, _ = plan_bins(amounts, capacity)
    plan = spark.createDataFrame(steps or [(0, 0, 0, 0, 0)], "length long, rank long, n long, bin long, offset long")
    number = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", F.xxhash64(*pieces.columns))) - 1
    ranked = salted.withColumn("_number", number).join(starts, ["length", "salt"]).withColumn("_at", F.col("before") + F.col("_number"))
    # Steps of a length are sorted by rank without gaps: each piece has one, found within blocks of steps.
    lined = plan.withColumn("_step", F.row_number().over(W.partitionBy("length").orderBy("rank")))
    blocks = lined.groupBy("length", (F.col("_step") / RANK_BLOCK).cast("long").alias("_block")).agg(
        F.min("rank").alias("low"),
        F.max(F.col("rank") + F.col("n")).alias("high"),
        F.collect_list(F.struct("rank", "n", "bin", "offset")).alias("steps"),
    )
    per_length = blocks.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "high", "steps"))).alias("blocks"))
    if len(steps) <= BROADCAST_STEPS:
        joined = ranked.join(F.broadcast(per_length), "length")
    else:  # a length may hold most pieces: its plan is sent to several tasks
        copies = per_length.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(PLAN_COPIES - 1))))
        joined = ranked.withColumn("_copy", F.col("salt") % PLAN_COPIES).join(copies, ["length", "_copy"])
    block = F.filter("blocks", lambda b: (b["low"] <= F.col("_at")) & (F.col("_at") < b["high"]))[0]
    step = F.filter(block["steps"], lambda s: (s["rank"] <= F.col("_at")) & (F.col("_at") < s["rank"] + s["n"]))[0]
    bin_ = F.col("_step.bin") + F.col("_at") - F.col("_step.rank")
    return joined.withColumn("_step", step).select(*pieces.columns, bin_.alias("sequence_id"), F.col("_step.offset").alias("offset"))


def packed_documents(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(documents(arrow_rows(df), id_col, text_col), tokenizer_path, capacity, digest=True)
    return pack(durable(pieces, "pieces"), capacity)
