"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources get blocks by highest quotients target / (2k + 1), each source's blocks are dealt
to its shards in the same way by their tokens, and a shard takes its whole documents as
often as its quota holds it, then a run of its blocks from a seeded start, cyclic. Documents
stand in their shard in order of a seeded hash, so a run is a random choice of them and
cuts two documents at most (three pieces). Shards are cut by hash so that each is a bounded
window, whatever the size of its source; the driver holds a row for each source and shard,
at most ``SHARDS`` more than sources, and no more than ``MOST_SOURCES`` sources.

Defined cases: a null source is a source of its own and sorts last; a null text and a
document without words are of size 0 and nothing is taken; repeated rows are separate
documents; an empty table gives an empty result; more than ``MOST_SOURCES`` sources raise.
Other columns are passed through whatever their names; only those that this operator adds
replace columns of the same name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST_TIMES = 3
SHARDS, LEAST_SHARD_TOKENS = 1 << 16, 20_000
#: Blocks of a shard, about, and tokens of a block at least.
BLOCKS, LEAST_BLOCK = 512, 16
MOST_SOURCES = 1_000_000
ADDED = ["source_size", "target", "taken", "block", "line_start", "wanted", "n_blocks", "turn", "passes"]


def targets(sizes: list[int], weights: list[float], most_times: float = MOST_TIMES) -> list[float]:
    """Shares of the whole by weight; what exceeds ``most_times`` a source's size is shared again."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total > most_times * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(most_times * sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def sainte_lague(seats: int, weights: list[float], limits: list[int]) -> list[int]:
    """``seats`` by the highest quotients weight / (2k + 1), no more than each limit; ties go to the first.

    All seats whose quotient is above a bound found by bisection are given at once, the
    rest one by one.
    """
    w, cap = np.array(weights, dtype=float), np.array(limits, dtype=np.int64)
    cap = np.where(w > 0, cap, 0)
    seats = int(min(seats, cap.sum()))
    if seats <= 0:
        return [0] * len(weights)

    def given(bound: float) -> np.ndarray:
        return np.minimum(cap, np.floor((w / bound + 1) / 2).astype(np.int64))

    low, high = w.max() / (4.0 * cap.max() + 4) * 1e-9, w.max() * 2
    for _ in range(200):
        mid = (low * high) ** 0.5
        low, high = (mid, high) if given(mid).sum() > seats else (low, mid)
    out = given(high)
    while (short := seats - int(out.sum())) > 0:
        quotient = np.where(out < cap, w / (2 * out + 1), -1.0)
        for i in np.argsort(-quotient, kind="stable")[:short]:
            if quotient[i] > 0:
                out[i] += 1
    return out.tolist()


def mix(df: DataFrame, source_col: str = "source", size_col: str = "size", weights: tuple[float, ...] = WEIGHTS, id_col: str = "doc_id", seed: int = 11) -> DataFrame:
    """``df`` with source_size, target, taken, and of the last partial pass: block, line_start, wanted, n_blocks, turn, passes."""
    spark = df.sparkSession
    given = df.select(F.struct("*").alias("row"), F.col(source_col).alias("source"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("size"), F.col(id_col).alias("id"))
    by = {r[0]: r[1] for r in given.groupBy("source").agg(F.sum("size")).limit(MOST_SOURCES + 1).collect()}
    if len(by) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    names = sorted((x for x in by if x is not None)) + ([None] if None in by else [])
    sizes = [by[x] for x in names]
    total = sum(sizes)
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(names))])
    shard_tokens = max(LEAST_SHARD_TOKENS, total // SHARDS)
    block = max(LEAST_BLOCK, shard_tokens // BLOCKS)
    sources = spark.createDataFrame([(x, i, s, a, max(1, -(-s // shard_tokens))) for i, (x, s, a) in enumerate(zip(names, sizes, aims))] or [("", 0, 0, 0.0, 1)], "name string, s int, source_size long, target double, shards long")
    sources = F.broadcast(sources) if len(names) <= 100_000 else sources
    rows = given.join(sources, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    # an id that is missing or repeated doesn't put its rows into one shard
    rows = rows.withColumn("place", F.xxhash64("id", F.xxhash64("row"), F.lit(seed))).withColumn("shard", F.pmod(F.xxhash64("place", F.lit(seed + 1)), F.col("shards")))

    quotas: list[tuple[int, int, int, int, int, int]] = []
    held: dict[int, list[tuple[int, int]]] = {}
    for r in rows.groupBy("s", "shard").agg(F.sum("size").alias("n")).where("n > 0").collect():
        held.setdefault(r["s"], []).append((r["shard"], r["n"]))
    # targets in blocks of each source's own mean length, as the last block of a shard is shorter
    own_blocks = {s: sum(-(-n // block) for _, n in own) for s, own in held.items()}
    asked = [aims[s] * own_blocks[s] / sizes[s] if s in held else 0.0 for s in range(len(names))]
    seats = sainte_lague(round(sum(asked)), asked, [MOST_TIMES * own_blocks.get(s, 0) for s in range(len(names))])
    for s, own in held.items():
        own.sort()
        n_blocks = [-(-n // block) for _, n in own]
        for (k, _), q, nb in zip(own, sainte_lague(seats[s], [float(x) for x in n_blocks], [MOST_TIMES * x for x in n_blocks]), n_blocks):
            turn = (s * 7919 + k * 104_729 + seed * 1_299_709) % nb
            quotas.append((s, k, q // nb, q % nb, nb, turn))
    quota = spark.createDataFrame(quotas or [(0, 0, 0, 0, 1, 0)], "s int, shard long, passes long, wanted long, n_blocks long, turn long")
    quota = F.broadcast(quota) if len(quotas) <= 100_000 else quota

    line = W.partitionBy("s", "shard").orderBy("place", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("line_start", F.coalesce(F.sum("size").over(line), F.lit(0)).cast("long")).join(quota, ["s", "shard"], "left").withColumn("block", F.lit(block).cast("long"))
    stop = F.col("line_start") + F.col("size")
    taken = F.col("passes") * F.col("size") + sum(least_between(a, b, F.col("line_start"), stop) for a, b in chosen_runs())
    rows = rows.withColumn("taken", F.coalesce(taken, F.lit(0)).cast("long")).withColumn("passes", F.coalesce("passes", F.lit(0)))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c not in ADDED], *ADDED)


def chosen_runs() -> list[tuple[Column, Column]]:
    """The positions [a, b) of a shard's line that its quota takes beyond whole passes: ``wanted`` blocks from ``turn`` on, and what runs over its end."""
    first, stop = F.col("turn"), F.col("turn") + F.col("wanted")
    over = F.greatest(F.lit(0), stop - F.col("n_blocks"))
    return [(first * F.col("block"), (stop - over) * F.col("block")), (F.lit(0), over * F.col("block"))]


def least_between(a: Column, b: Column, low: Column, high: Column) -> Column:
    """How much of [a, b) is in [low, high)."""
    return F.greatest(F.lit(0), F.least(b, high) - F.greatest(a, low))


def is_chosen(position: Column) -> Column:
    """Whether the token at a position of the line is in a chosen block."""
    (a, b), (c, d) = chosen_runs()
    return ((position >= a) & (position < b)) | ((position >= c) & (position < d))


#: A word with the white space behind it, so that words in a row make the text again.
SPACED_WORD = WORD + r"[\x20\x09-\x0D]*"


def partial_texts(text: Column, size: Column) -> Column:
    """array<string>: the chosen runs of a document, each as it stands in the text, without white space at its ends."""
    words = F.regexp_extract_all(text, F.lit(f"({SPACED_WORD})"))
    start = F.col("line_start")
    out = []
    for a, b in chosen_runs():
        low, high = F.greatest(a, start), F.least(b, start + size)
        run = F.array_join(F.slice(words, (low - start + 1).cast("int"), (high - low).cast("int")), "")
        out.append(F.when(high > low, F.regexp_replace(run, r"[\x20\x09-\x0D]+$", "")))
    return F.array_compact(F.array(*out))


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
