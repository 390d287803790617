"""Hamming search and greedy removal against plain loops."""

import numpy as np
import pytest

from quarrykit.operators import images


@pytest.mark.parametrize("n", [10, 1e5, 1e9])
@pytest.mark.parametrize("most", [0, 3, 10, 20])
def test_block_tables_miss_no_pair(most, n):
    tables = images.block_tables(most, n)
    assert 0 < len(tables) <= images.MOST_TABLES
    rng = np.random.default_rng(most)
    for _ in range(300):
        x = sum(1 << int(i) for i in rng.choice(64, most, replace=False))
        assert any(not x & m for m in tables)


@pytest.mark.parametrize("few", [32, 0])
def test_pairs_and_greedy_removal_equal_plain(spark, monkeypatch, few):
    monkeypatch.setattr(images, "FEW_TABLES", few)
    rng = np.random.default_rng(9)
    base = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 12)]
    hashes = []
    for b in base:
        for _ in range(7):
            x = b & ((1 << 64) - 1)
            for bit in rng.choice(64, rng.integers(0, 9), replace=False):
                x ^= 1 << int(bit)
            hashes.append(x - (1 << 64) if x >> 63 else x)
    hashes += base[:3] * 2
    order = rng.permutation(len(hashes))
    rows = [(int(k), hashes[i]) for k, i in enumerate(order)] + [(1000, None)]
    df = spark.createDataFrame(rows, "k long, h long").repartition(5)
    apart = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1")
    want = {(a, b, apart(x, y)) for a, x in rows for b, y in rows if x is not None and y is not None and a < b and apart(x, y) <= 10}
    pairs = images.hamming_pairs(df, "k", "h", 10)
    assert {tuple(r) for r in pairs.collect()} == want and any(d == 0 for _, _, d in want)
    kept, gone = [], {}
    for k, x in rows[:-1]:
        near = [j for j in kept if apart(rows[j][1], x) <= 10]
        if near:
            gone[k] = min(near)
        else:
            kept.append(k)
    assert {r["key"]: r["kept_by"] for r in images.greedy_duplicates(pairs).collect()} == gone


def test_greedy_removal_of_a_long_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    assert {tuple(r) for r in images.greedy_duplicates(chain).collect()} == {(1, 0), (3, 2), (5, 4), (7, 6), (9, 8)}
    assert images.greedy_duplicates(chain.where("a > 99")).count() == 0


def test_copies_of_a_hash_are_not_paired(spark, monkeypatch):
    rng = np.random.default_rng(9)
    own = rng.integers(0, 1 << 20, 60) << 40
    rows = [(int(i), int(h)) for i, h in zip(rng.permutation(1500) * 2, np.concatenate([np.full(700, own[0]), own[rng.integers(0, 60, 800)]]))]
    pairs, greedy = [], images.greedy_duplicates
    monkeypatch.setattr(images, "greedy_duplicates", lambda p: pairs.append(p.count()) or greedy(p))
    df = spark.createDataFrame([*rows, (1, None)], "k long, h long")
    got = {r["key"]: r["kept_by"] for r in images.hash_duplicates(df, "k", "h", 6).collect()}
    want, kept = {}, []
    for k, h in sorted(rows):
        near = [a for a, g in kept if (g ^ h).bit_count() <= 6]
        if near:
            want[k] = min(near)
        else:
            kept.append((k, h))
    assert got == want and len(kept) > 1
    assert pairs[0] <= 60 * 59 // 2
