"""MinHash near-duplicates with sequential Bayesian verification.

Bands of minimum hashes propose pairs. A pair's signatures are compared batch by batch
and it is dropped as soon as the posterior chance that its Jaccard similarity reaches
the threshold falls below ``miss`` (Satuluri & Parthasarathy, BayesLSH). What survives
is decided on the full shingle sets, whose shingles are compared by 64-bit hashes.

Rows with equal sets are one class, and one row of it, its node, takes part. A bucket
makes no all-pairs: its members meet one centre, another one in each band. Components of
the confirmed links are merged and the other bands' centres are met. Members of a bucket
that are then still in different components meet only if they share one of their rarest
shingles and are near in size, as all pairs that reach the threshold do (prefix and length
filtering), so a large group of copies and what merely resembles it don't make all pairs
either; a shingle that many of them share is dealt to several tasks.

Defined cases: a null or blank text has an empty set and links with nothing; fewer words
than the shingle length make one shingle; rows that share an id but not a set are told
apart, and a component's id is the smallest of all its rows; a null id takes part in no
link, its component is null and it is kept; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, arrow_rows, discard, documents, durable, mix64, odd_table, slices, text_bytes, trimmed
from .components import components

BANDS, ROWS = 56, 7
#: Bands whose centres are met in the first round.
FIRST_BANDS = 6
#: Signature values compared between two looks at the posterior.
BATCH = 56
#: Ids up to which the wanted documents are found by a broadcast (8 MB), else by a shuffle.
BROADCAST_IDS = 1_000_000
#: Mates at one shingle and size step, or pairs of one node, that one task joins, about; and nodes with more pairs at most.
HEAVY, MOST_HUBS = 1000, 100_000
_BLOCK = 512


def shingle_sets(texts: pa.Array, length: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles."""
    raw, offsets = text_bytes(texts)
    words = Words(LOWER[raw], offsets)
    hashes = words.hashes()
    table = odd_table(length, 11)
    out = []
    with np.errstate(over="ignore"):
        for a, b in zip(words.first[:-1], words.first[1:]):
            own = hashes[a:b]
            n = max(min(len(own), 1), len(own) - length + 1)
            total = np.zeros(n, dtype=np.uint64)
            for t in range(length):
                if t < len(own):
                    total += own[t : t + n] * table[t]
            out.append(np.unique(mix64(total + np.uint64(min(len(own), length)))))
    return out


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Minimum hashes of a non-empty set."""
    mult = (odd_table(size, 13) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    add = (odd_table(size, 17) >> np.uint64(32)).astype(np.uint32)
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    buffer = np.empty((min(_BLOCK, len(values)), size), dtype=np.uint32)
    for i in range(0, len(values), _BLOCK):
        part = values[i : i + _BLOCK]
        view = buffer[: len(part)]
        np.multiply(part[:, None], mult[None, :], out=view)
        np.add(view, add[None, :], out=view)
        np.minimum(least, view.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band; its lowest byte is the band's number."""
    table = odd_table(rows, 19)
    with np.errstate(over="ignore"):
        keys = mix64((least.reshape(bands, rows).astype(np.uint64) * table).sum(axis=1, dtype=np.uint64))
    return ((keys & ~np.uint64(0xFF)) | np.arange(bands, dtype=np.uint64)).view(np.int64)


def least_matches(size: int, batch: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """For each number of values compared, the fewest equal ones that keep a pair alive."""
    grid = (np.arange(2000) + 0.5) / 2000
    agree = grid + (1 - grid) / 256  # one byte of each value is compared
    out = []
    for n in [*range(batch, size, batch), size]:
        low = 0
        for m in range(n + 1):
            log = m * np.log(agree) + (n - m) * np.log1p(-np.minimum(agree, 1 - 1e-9))
            weight = np.exp(log - log.max())
            if weight[grid >= threshold].sum() / weight.sum() >= miss:
                low = m
                break
        out.append((n, low))
    return out


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def describe(df: DataFrame, length: int, bands: int, rows: int) -> DataFrame:
    """What stands for each text: doc_id, text_hash, n_shingles, digest of the set, band keys and a byte of each minimum."""

    def one(batches):
        with trimmed():
            for batch in (part for given in batches for part in slices(given)):
                sizes, digest, keys, marks = [], [], [], []
                for s in shingle_sets(batch.column("text"), length):
                    least = signature(s, bands * rows) if len(s) else None
                    sizes.append(len(s))
                    digest.append(_digest(s))
                    keys.append(band_keys(least, bands, rows) if least is not None else None)
                    marks.append((least & 0xFF).astype(np.uint8).tobytes() if least is not None else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                    names=["doc_id", "text_hash", "n_shingles", "digest", "keys", "marks"],
                )

    return df.select("doc_id", F.md5("text").alias("text_hash"), "text").mapInArrow(one, "doc_id long, text_hash string, n_shingles long, digest binary, keys array<long>, marks binary")


class Verifier:
    """Decides pairs (a, b) of ``nodes(node, doc_id, digest, marks)`` of one corpus."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, length: int, threshold: int, bounds: list[tuple[int, int]]):
        self.docs, self.nodes, self.length, self.threshold, self.bounds = docs, nodes, length, threshold, bounds

    @staticmethod
    def _joined(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
        """Written ``pairs`` with both sides' values. A node of many pairs sends its value to several tasks; there are less than ``MOST_HUBS`` of them on a side, as they hold ``heavy`` pairs each."""
        heavy = max(HEAVY, -(-pairs.count() // MOST_HUBS))
        ends = [pairs.groupBy(F.col(side).alias("node")).agg(F.count("*").alias("n")).where(F.col("n") > heavy) for side in ("a", "b")]
        many = ends[0].unionByName(ends[1]).groupBy("node").agg(F.max("n").alias("n"))
        many = F.broadcast(many.select("node", F.ceil(F.col("n") / heavy).cast("int").alias("cells")))
        cells = F.coalesce("cells", F.lit(1))
        sent = values.select("node", name).join(many, "node", "left").select("node", F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"), name)
        for side, other, to in (("a", "b", "left"), ("b", "a", "right")):
            dealt = pairs.join(many.withColumnRenamed("node", side), side, "left").withColumn("cell", F.pmod(F.xxhash64(other), cells).cast("int")).drop("cells")
            pairs = dealt.join(sent.select(F.col("node").alias(side), "cell", F.col(name).alias(to)), [side, "cell"]).drop("cell")
        return pairs.select("a", "b", "left", "right")

    def alive(self, pairs: DataFrame) -> DataFrame:
        """Pairs that no look at the posterior drops."""
        bounds = self.bounds

        def prune(batches):
            with trimmed():
                for batch in batches:
                    left, right = ([np.frombuffer(x, np.uint8) for x in batch.column(c).to_pylist()] for c in ("left", "right"))
                    if not left:
                        continue
                    left, right = np.stack(left), np.stack(right)
                    live, equal, at = np.arange(len(left)), np.zeros(len(left), dtype=np.int64), 0
                    for n, low in bounds:
                        equal[live] += (left[live, at:n] == right[live, at:n]).sum(axis=1)
                        live, at = live[equal[live] >= low], n
                    yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(live)) for c in ("a", "b")], names=["a", "b"])

        return self._joined(pairs, self.nodes, "marks").mapInArrow(prune, "a long, b long")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(node, body): the shingles of the ``wanted(node)``, from texts read again by id and told apart by digest."""
        wanted = durable(wanted.distinct().join(self.nodes.select("node", "doc_id", "digest"), "node"), "wanted")
        ids = wanted.select("doc_id").distinct()
        ids = F.broadcast(ids) if wanted.count() <= BROADCAST_IDS else ids
        length = self.length

        def one(batches):
            with trimmed():
                for batch in (part for given in batches for part in slices(given)):
                    sets = shingle_sets(batch.column("text"), length)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "digest", "body"])

        found = self.docs.join(ids, "doc_id", "left_semi").mapInArrow(one, "doc_id long, digest binary, body binary")
        return found.join(wanted, ["doc_id", "digest"]).select("node", "body")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs those whose full sets reach the threshold, as a written table."""
        asked = durable(pairs, "asked")
        if asked.isEmpty():
            return asked
        pairs = durable(self.alive(asked), "alive")
        sets = durable(self.sets(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))), "sets")
        threshold = self.threshold

        def exact(batches):
            with trimmed():
                for batch in batches:
                    good = []
                    for left, right in zip(batch.column("left"), batch.column("right")):  # a pair at a time, without copies
                        x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (left, right))
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        good.append(bool(100 * both >= threshold * (len(x) + len(y) - both)))
                    keep = pa.array(good, pa.bool_())
                    yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

        found = durable(self._joined(pairs, sets, "body").mapInArrow(exact, "a long, b long"), "links")
        discard(asked, pairs, sets)
        return found


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def rare_mates(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different ``groups(node, own)`` that share one of their rarest shingles and could reach ``percent``.

    With one order of all shingles, here by how many of these sets hold them, two sets of
    similarity t share a shingle among the first n - ceil(t * n) + 1 of each. Sizes are cut
    into steps of the ratio t, so a set meets those of its own step and the next one only,
    and the mates at a shingle and step beyond ``HEAVY`` are dealt to several tasks.
    """

    def opened(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([np.frombuffer(x, np.int64) for x in batch.column("body").to_pylist()], pa.list_(pa.int64()))], names=["node", "s"])

    rows = sets.mapInArrow(opened, "node long, s array<long>").select("node", F.size("s").alias("n"), F.explode("s").alias("s"))
    common = rows.groupBy("s").agg(F.count("*").alias("held")).where("held > 1")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(1)).alias("held"), "s")))
    ranked = rows.join(common, "s", "left").groupBy("node", "n").agg(order.alias("ranked"))
    first = F.slice("ranked", 1, (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent) + 1e-9)).cast("int") if percent < 100 else F.col("n").cast("int")
    heads = ranked.select("node", "n", F.posexplode(first).alias("at", "x")).where("x.held > 1")
    heads = durable(heads.select("node", "n", "at", F.col("x.s").alias("s"), step.alias("step")).join(groups, "node"), "heads")
    # only shingles at which different components meet, and how many stand at each
    met = heads.groupBy("s", "step").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("held"))
    mixed = met.groupBy("s").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("s")
    # the shorter of a pair shares one of fewer first places, and both leave room for the overlap behind their first common one
    short = heads.where(F.col("at") <= F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)))
    short = short.withColumn("step", F.explode(F.array(F.col("step"), F.col("step") + 1)))
    asked = short.groupBy("s", "step").agg(F.count("*").alias("asked"))
    parts = lambda n: F.ceil(F.col(n) / HEAVY).cast("int")
    cells = met.join(mixed, "s", "left_semi").join(asked, ["s", "step"]).select("s", "step", parts("held").alias("cells"), parts("asked").alias("rows"))
    cells = durable(cells, "cells")
    many = cells.where("cells > 1 or rows > 1")  # less than 3 / HEAVY of the rows, dealt by broadcast where few
    many = F.broadcast(many) if many.count() <= BROADCAST_IDS else many
    one = F.lit(1)

    def dealt(side: DataFrame, name: str, own: str, other: str, id_: str) -> DataFrame:
        """Each row in one of its side's parts, and in a copy for each part of the other side."""
        out = side.join(many, ["s", "step"], "left").withColumn(name, F.pmod(F.xxhash64(id_), F.coalesce(own, one)).cast("int"))
        return out.withColumn({"cell": "row", "row": "cell"}[name], F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1))).drop("cells", "rows")

    short = dealt(short, "row", "rows", "cells", "node")
    mates = heads.select("s", "step", F.col("node").alias("mate"), F.col("n").alias("size"), F.col("at").alias("place"), F.col("own").alias("its"))
    known = cells.select("s", "step", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "rows").select("s", "step", "cell", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))
    mates = dealt(mates, "cell", "cells", "rows", "mate").join(known, ["s", "step", "cell", "row"], "left_semi")
    overlap = F.ceil(percent * (F.col("n") + F.col("size")) / (100 + percent))
    fits = (F.col("n") <= F.col("size")) & (F.col("size") * percent <= F.col("n") * 100) & (F.col("at") <= F.col("n") - overlap) & (F.col("place") <= F.col("size") - overlap)
    near = short.join(mates, ["s", "step", "cell", "row"]).where((F.col("own") != F.col("its")) & fits)
    return _pairs(near, "node", "mate")


def near_duplicates(df: DataFrame, shingle: int = 5, percent: int = 80, miss: float = 1e-9, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text_hash (md5), n_shingles, component_id (smallest id reachable over links) and kept."""
    docs = documents(arrow_rows(df), id_col, text_col)
    # a number for each row, fixed by the written table
    table = durable(describe(docs, shingle, bands, rows).withColumn("row", F.monotonically_increasing_id()), "signatures")
    real = table.where("doc_id is not null and n_shingles > 0")
    classes = durable(real.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min(F.struct("row", "doc_id")).alias("node"), F.count("*").alias("n")), "classes")
    copies = real.select("digest", "row").join(classes.where("n > 1"), "digest").where("row <> node.row").select("row")
    nodes = real.join(copies, "row", "left_anti").withColumnRenamed("row", "node")

    slots = nodes.select("node", F.explode("keys").alias("key"))
    buckets = slots.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", "key").alias("h"), "node")).alias("centre")).where("n > 1")
    met = durable(slots.join(buckets, "key").select("key", "node", F.col("centre.node").alias("centre"), "n"), "buckets")

    check = Verifier(docs, nodes.select("node", "doc_id", "digest", "marks"), shingle, percent, least_matches(bands * rows, BATCH, percent / 100, miss))
    first = check.links(_pairs(met.where(F.col("key").bitwiseAND(F.lit(0xFF)) < FIRST_BANDS), "node", "centre"))
    label = components(first)

    def labelled(rows_: DataFrame, label: DataFrame, col: str, name: str) -> DataFrame:
        named = label.select(F.col("node").alias(col), F.col("label").alias("_label"))
        return rows_.join(named, col, "left").withColumn(name, F.coalesce("_label", col)).drop("_label")

    rest = labelled(labelled(met.where(F.col("key").bitwiseAND(F.lit(0xFF)) >= FIRST_BANDS), label, "node", "own"), label, "centre", "other")
    second = first.unionByName(check.links(_pairs(rest.where("own <> other"), "node", "centre")))
    label = durable(components(second), "labels")

    rest = labelled(met.where("n > 2"), label, "node", "own")
    split = rest.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select("key")
    contested = durable(rest.join(split, "key", "left_semi").select("node", "own").distinct(), "contested")
    if not contested.isEmpty():
        label = components(second.unionByName(check.links(rare_mates(check.sets(contested.select("node")), contested, percent))))

    # a component is named after the smallest id of its classes
    named = classes.select("digest", "rep", F.col("node.row").alias("node")).join(label, "node", "left")
    named = durable(named.select("digest", "rep", F.coalesce("label", "node").alias("label")), "named")
    names = named.groupBy("label").agg(F.min("rep").alias("component"))
    whole = table.select("doc_id", "text_hash", "n_shingles", "digest").join(named.join(names, "label").select("digest", "component"), "digest", "left")
    found = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component"))
    out = whole.select("doc_id", "text_hash", "n_shingles", found.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
