"""Sharding by sampled splitters, under the law of near equal bytes.

Keys are drawn with a chance in proportion to their size, quantiles of the draw cut the
key space into many small ranges, and a range that turns out overfull is drawn again and
cut further. The key is (hash of the text, id): equal texts stand together, and a text
whose copies outgrow a range is cut by id. Ranges are then dealt to shards, the largest
first to the emptiest; the ranges of one text stay together unless they outgrow a shard.

Defined cases: a null text has size 1 and the checksum of no bytes; null ids sort first;
rows equal in every column are interchangeable; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import durable

RANGES_PER_SHARD = 64
#: Ranges at most, which bounds what the driver holds.
MOST_RANGES = 50_000
#: Expected draws for each range.
DRAWS = 32
#: A range above so many times the aim in bytes or rows is cut again, in so many rounds at most.
OVERFULL, ROUNDS = 2, 4
RANGE_BYTES = 1 << 28
_LOWEST = -(1 << 63)


def _cuts(keys: list[tuple[int, int, float]], aim: float) -> list[tuple[int, int]]:
    """First keys of ranges of about ``aim`` weight, from (hash, id, weight)."""
    out, held = [], 0.0
    for h, d, w in sorted(keys):
        if held >= aim:
            out.append((h, d))
            held = 0.0
        held += w
    return out


def _snapped(cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Bounds moved to the first id of their hash, but for a hash with several bounds, which gets its own ranges."""
    by: dict[int, set[int]] = {}
    for h, d in cuts:
        by.setdefault(h, set()).add(d)
    out = {(_LOWEST, _LOWEST)}
    for h, ids in by.items():
        out.add((h, _LOWEST))
        if len(ids - {_LOWEST}) > 1:
            out |= {(h, d) for d in ids}
            if h < (1 << 63) - 1:
                out.add((h + 1, _LOWEST))
    return sorted(out)


def _ranger(bounds: list[tuple[int, int]]):
    hashes, ids = (np.array(x, dtype=np.int64) for x in zip(*bounds))

    @F.pandas_udf("int")
    def place(h: pd.Series, d: pd.Series) -> pd.Series:
        h, d = h.to_numpy(np.int64), d.to_numpy(np.int64)
        low, high = np.searchsorted(hashes, h, side="left"), np.searchsorted(hashes, h, side="right")
        at = high - 1
        for i in np.unique(low[high - low > 1]):
            pick = (low == i) & (high > low)
            at[pick] = i + np.searchsorted(ids[i : high[pick][0]], d[pick], side="right") - 1
        return pd.Series(at.astype(np.int32))

    return place


def assign(ranges: dict[int, tuple[int, int]], bounds: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """(range, shard, first slot): whole units, the largest first to the emptiest shard."""
    share = sum(b for _, b in ranges.values()) / shards
    groups: dict[object, list[int]] = {}
    for r in sorted(ranges):
        groups.setdefault(("text", bounds[r][0]), []).append(r)
    units = []
    for own in groups.values():
        total = sum(ranges[r][1] for r in own)
        units += [own] if total <= share else [[r] for r in own]
    load, rows, out = [0] * shards, [0] * shards, []
    for own in sorted(units, key=lambda u: (-sum(ranges[r][1] for r in u), u[0])):
        s = min(range(shards), key=lambda i: (load[i], i))
        for r in own:
            out.append((r, s, rows[s]))
            rows[s] += ranges[r][0]
            load[s] += ranges[r][1]
    return out


def shard(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law isn't by key)."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    rows = durable(rows, "keys").withColumn("d", F.coalesce("doc_id", F.lit(_LOWEST)))
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    wanted = min(MOST_RANGES, max(shards * RANGES_PER_SHARD, total // RANGE_BYTES))
    aim, aim_rows = max(1.0, total / wanted), max(1.0, n / wanted)
    draw = F.pmod(F.xxhash64("h", "d", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))

    def sampled(part: DataFrame, rate: float) -> list[tuple[int, int, float]]:
        return [(r[0], r[1], max(r[2], 1 / rate)) for r in part.where(draw < F.col("size") * F.lit(rate)).select("h", "d", "size").collect()]

    bounds = _snapped(_cuts(sampled(rows, DRAWS / aim), aim))
    for round_ in range(ROUNDS):
        placed = rows.withColumn("range", _ranger(bounds)("h", "d"))
        ranges = {r["range"]: (r["n"], r["bytes"]) for r in placed.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()}
        over = [r for r, (k, b) in ranges.items() if k > 1 and (b > OVERFULL * aim or k > 2 * OVERFULL * aim_rows)]
        if not over or round_ == ROUNDS - 1:
            break
        # by rows and bytes alike: a draw of each row in proportion to what it takes of the range's aim
        again = placed.join(F.broadcast(spark.createDataFrame([(r,) for r in over], "range int")), "range").withColumn("size", F.col("size") / aim + F.lit(1.0 / aim_rows))
        more = _cuts(sampled(again, float(DRAWS)), 1.0)
        if set(more) <= set(bounds):
            break
        bounds = _snapped(sorted({*bounds, *more} - {(_LOWEST, _LOWEST)}))
    plan = F.broadcast(spark.createDataFrame(assign(ranges, bounds, shards) or [(0, 0, 0)], "range int, shard int, first long"))  # one row a range
    slot = F.row_number().over(W.partitionBy("range").orderBy("h", "d", "size", "text_crc32")) - 1
    out = placed.withColumn("_slot", slot).join(plan, "range")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("_slot")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
