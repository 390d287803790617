"""Operators over texts against plain versions, with gaps, copies, ties and empty tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quarrykit.llm import components as components_
from quarrykit.llm import fingerprints, language_id, line_dedup, media, near_dedup, packing, queries, substring_dedup

from quarrykit.llm.common import Words

from . import brute
from .conftest import frame


def key(r):
    return tuple((x is None, x) for x in r)


def test_substring_dedup_equals_plain(docs, rows):
    out = substring_dedup.repeats(docs, window=35).collect()
    got = [(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in out]
    assert sorted(got, key=key) == sorted(brute.op3([(r[0], r[1]) for r in rows]), key=key)
    assert sum(r["n_removed"] for r in out) > 500
    assert all(sum(s["stop"] - s["first"] for s in r["spans"]) == r["n_removed"] for r in out)


@pytest.mark.parametrize("window", [4, 7])
def test_substring_dedup_short_windows(spark, window):
    rows = [(1, "a b c d e f g h"), (2, "x c d e f y"), (3, "le le le le le le le le le"), (4, None), (5, "a b c")]
    out = substring_dedup.repeats(frame(spark, [(*r, None, None) for r in rows]), window=window).collect()
    want = {d: (n, k) for d, n, k, _ in brute.op3(rows, window)}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in out} == want


def test_substring_dedup_with_colliding_word_hashes(spark, monkeypatch):
    """With a first hash that is the same for all words, the second, independent one tells the windows apart."""
    whole = Words.hashes

    def few(self, seed=1, which=None):
        out = whole(self, seed, which)
        return out * np.uint64(seed != 1)

    monkeypatch.setattr(Words, "hashes", few)
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 2000, 60))) for i in range(12)]
    rows += [(20 + i, " ".join(rows[i][1].split()[10:50])) for i in range(4)]
    table = pa.table({"text": [t for _, t in rows]})
    words, hashes = substring_dedup._cell_words(table)
    plan = substring_dedup.Anchors(35, 62, 1)
    at, main, more = plan.candidates(words, hashes, np.unique(plan.probes(words, hashes)[1]))
    flat = [w for _, t in rows for w in t.split()]
    by = defaultdict(set)
    for i, a, b in zip(at, main, more):
        by[a, b].add(tuple(flat[i : i + 35]))
    assert len(at) > 300 and all(len(x) == 1 for x in by.values())


def test_empty_tables(spark, empty):
    assert substring_dedup.repeats(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert fingerprints.fingerprint_documents(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert media.media_features(empty).count() == 0
    assert packing.packed_documents(empty, queries.tokenizer_path()).count() == 0
    assert language_id.predict(empty, language_id.fit(empty)).count() == 0


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates_equal_plain(spark, plain, shingle):
    out = near_dedup.near_duplicates(frame(spark, plain), shingle=shingle, percent=80)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect())
    assert got == sorted(brute.op10([(r[0], r[1]) for r in plain], shingle))
    assert sum(not r[3] for r in got) > 25


def test_near_duplicates_repeated_and_null_ids(docs, rows):
    out = near_dedup.near_duplicates(docs, shingle=2).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    assert all(r["kept"] and r["component_id"] is None for r in out if r["doc_id"] is None)


def test_near_duplicates_around_a_hub(spark):
    """Copies whose mutual similarity is below the threshold still meet through what they were made from, and strangers don't."""
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words))]
    for i in range(60):
        w = list(words)
        for j in range(8):
            w[(i * 13 + j * 23) % 200] = f"n{i}_{j}"
        rows.append((10 + i, " ".join(w)))
    rows += [(100 + i, " ".join(words[:120] + [f"z{i}_{j}" for j in range(80)])) for i in range(40)]
    out = near_dedup.near_duplicates(frame(spark, [(*r, None, None) for r in rows]), shingle=2).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out) == sorted(brute.op10(rows))


@pytest.mark.parametrize("heavy, hub", [(2, 3), (1, 10**6)])
def test_near_duplicates_with_hot_shingles_and_hubs(spark, monkeypatch, heavy, hub):
    """Strangers that share their rarest shingles, of several sizes, beside two groups of copies; all joins dealt small."""
    monkeypatch.setattr(near_dedup, "HEAVY", heavy)
    monkeypatch.setattr(components_, "HUB", hub)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        w = list(words[: 40 + i % 20])
        for j in range(int(rng.integers(0, 9))):
            w[int(rng.integers(0, len(w)))] = f"n{rng.integers(0, 30)}"
        rows.append((i, " ".join(w)))
    out = near_dedup.near_duplicates(frame(spark, [(*r, None, None) for r in rows], 5), shingle=2).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out) == sorted(brute.op10(rows))


def test_near_duplicates_tell_rows_of_one_id_apart(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a), (2, b), (2, a), (3, b + " more"), (4, "something else"), (4, "something else")]
    out = near_dedup.near_duplicates(frame(spark, [(*r, None, None) for r in rows]), shingle=2).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in out) == Counter([(1, 1, True), (2, 2, True), (2, 1, False), (3, 2, False), (4, 4, True), (4, 4, True)])


def test_components_equal_plain(spark, monkeypatch):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(100, 200 + i) for i in range(30)] + [(300 + i, 301 + i) for i in range(20)]
    for hub in (2, 10**6):
        monkeypatch.setattr(components_, "HUB", hub)
        got = {r["node"]: r["label"] for r in components_.components(spark.createDataFrame(links, "a long, b long")).collect()}
        want = {x: x for x in {x for a, b in links if a != b for x in (a, b)}}
        while True:
            new = dict(want)
            for a, b in links:
                if a != b:
                    new[a] = new[b] = min(new[a], new[b])
            if new == want:
                break
            want = new
        assert got == want


def test_bayes_bounds_prune_and_keep():
    bounds = near_dedup.least_matches(392, 56, 0.8, 1e-9)
    assert bounds[-1][0] == 392 and all(0 < low < 0.8 * n for n, low in bounds)
    assert [low / n for n, low in bounds] == sorted(low / n for n, low in bounds)


def test_packing_round_trip(docs, rows):
    out = packing.packed_documents(docs, queries.tokenizer_path(), capacity=256).collect()
    ids = packing.encoder(queries.tokenizer_path()).tokenizer
    want = Counter()
    for doc, text, *_ in rows:
        x = [*ids.encode(text or "", add_special_tokens=False).ids, 1]
        want.update((doc, p, i, len(x[i : i + 256]), brute.crc(x[i : i + 256])) for p, i in enumerate(range(0, len(x), 256)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.05 * -(-sum(r["length"] for r in out) // 256) + 1


def test_plan_equals_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes = rng.integers(1, 101, 300)
        free: list[int] = []
        for s in sorted(sizes.tolist(), reverse=True):
            fits = [x for x in free if x >= s]
            if fits:
                free[free.index(min(fits))] -= s
            else:
                free.append(100 - s)
        steps, bins = packing.plan_bins(dict(Counter(sizes.tolist())), 100)
        assert bins == len(free)
        assert sum(n for _, _, n, _, _ in steps) == len(sizes)


ODD = ["it's <|startoftext|>x", "á é", "½x ¾", "a×b÷c", "re're 'S", "", "  lead", "trail \n", "ÿŸß ẞ|", "e\u0301x", "x\x1cy\x85z", "a\x00b", "ª²³µº 12ab3.4", "\u00a0x\u2003y", "C\u0303Ã"]


def random_texts(n=300):
    rng = np.random.default_rng(8)
    letters = list("abcXYZÀßÿ×÷'<|>.,;0189 \n\té\u0301\u200dΩ中") + [" "] * 8
    return ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(n)]


def same_ids(own, texts):
    ids, lens = own.encode_column(pa.array(texts, pa.string()))
    ends = np.cumsum(lens)
    for t, a, b in zip(texts, ends - lens, ends):
        assert ids[a:b].tolist() == own.tokenizer.encode(t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("cache", [300_000, 700])
def test_tokenizer_words_equal_whole_texts(rows, monkeypatch, cache):
    monkeypatch.setattr(packing, "CACHE_RUNS", cache)
    own = packing.WordIds(queries.tokenizer_path())
    assert own.by_word
    texts = [r[1] for r in rows] + ODD + random_texts()
    same_ids(own, texts)
    for t in texts:
        same_ids(own, [t])
    same_ids(own, [])


def test_other_tokenizers_get_whole_texts():
    own = packing.WordIds(queries.tokenizer_path().replace("word_bpe_49k", "byte_bpe_50k"))
    assert not own.by_word
    same_ids(own, ["two words", None, *ODD])


def test_packing_without_broadcast_and_with_salts(docs, monkeypatch):
    """Long plans are joined by shuffle and long lists of one length are cut; the packing stays whole."""
    monkeypatch.setattr(packing, "BROADCAST_STEPS", 0)
    monkeypatch.setattr(packing, "PLAN_COPIES", 3)
    monkeypatch.setattr(packing, "LEAST_SALTS", 1)
    monkeypatch.setattr(packing, "SALT_ROWS", 20)
    pieces = packing.token_pieces(docs.select("doc_id", "text"), queries.tokenizer_path(), 64, digest=True).cache()
    out = packing.pack(pieces, 64).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in out) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in pieces.collect())
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 64


def plain_fingerprint_rows(rows):
    order = sorted(((r[0] if r[0] is not None else -(1 << 63)), r[1] or "") for r in rows)
    return order


def test_fingerprints(spark, plain):
    out = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(frame(spark, plain, 5)).collect()}
    order = sorted(plain)
    for a, b in zip(order, order[1:] + order[:1]):
        text, following = a[1] or "", b[1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = out[a[0]]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        own, new, other = (int(x) for x in fingerprints.simhash([text, changed, following]))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (f"{own:016x}", f"{new:016x}")
        assert r["near_edited"] == 1 - bin(own ^ new).count("1") / 64 and r["near_next"] == 1 - bin(own ^ other).count("1") / 64


def test_fingerprints_repeated_rows(docs, rows):
    out = fingerprints.fingerprint_documents(docs).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    assert len({r["fingerprint"] for r in out if r["doc_id"] in (5, *range(100, 112))}) == 1


@pytest.mark.parametrize("crowded", [4096, 3])
def test_radius_search_equals_plain(spark, monkeypatch, crowded):
    monkeypatch.setattr(fingerprints, "CROWDED", crowded)
    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 63), 1 << 63, 60).tolist()
    for b in base[:30]:
        for _ in range(4):
            x = b & ((1 << 64) - 1)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            base.append(x - (1 << 64) if x >> 63 else x)
    df = spark.createDataFrame([(x,) for x in base], "bits long")
    got = {(r["query"], r["found"]) for r in fingerprints.within_radius(df, df).collect()}
    assert got == {(a, b) for a in base for b in base if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3}


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_query_of_fingerprints_finds_all_within_the_radius(spark, monkeypatch, tmp_path, plain, broadcast):
    monkeypatch.setattr(queries, "BROADCAST_PRINTS", broadcast)
    frame(spark, plain).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op1_simhash_fingerprints(spark, str(tmp_path)).collect()
    bits = {r["doc_id"]: int(r["fingerprint"], 16) for r in out}
    classes = {}
    for doc in sorted(bits):
        classes.setdefault(bits[doc], doc)
    for r in out:
        if r["doc_id"] % 50:
            assert r["n_near"] is None and r["near_ids"] is None
        else:
            near = [d for d, b in bits.items() if bin(b ^ bits[r["doc_id"]]).count("1") <= fingerprints.RADIUS]
            assert r["n_near"] == len(near) - 1 and r["near_ids"] == sorted({classes[bits[d]] for d in near})
    assert any(r["n_near"] for r in out)


def test_language_held_out_accuracy(spark, rows):
    labelled = [r for r in rows if r[2] and r[1] and any(c.isalpha() for c in r[1]) and r[0] is not None and r[0] < 80]
    df = frame(spark, labelled)
    model = language_id.fit(df.where(~language_id.held_out()))
    out = language_id.predict(df, model).where(language_id.held_out()).select("lang", "lang_pred", "score").collect()
    assert len(out) >= 5 and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.9 * len(out)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_of_gaps(docs, rows):
    out = language_id.predict(docs, language_id.fit(docs)).select("doc_id", "lang_pred", "score").collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    by = {r["doc_id"]: r["lang_pred"] for r in out}
    assert [by[i] for i in (112, 113, 114, 115)] == ["und"] * 4 and by[116] != "und"


def test_language_without_labels(spark, docs):
    model = language_id.fit(docs.where("false"))
    assert {r["lang_pred"] for r in language_id.predict(docs, model).collect()} == {"und"}
    one = language_id.fit(docs.where("lang = 'en'"))
    assert {r["lang_pred"] for r in language_id.predict(docs.where("doc_id = 3"), one).collect()} == {"en"}


def plain_line_chunks(text):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    lines, out, held = text.split("\n"), [], []
    hashes = [md5(x) for x in lines]
    for i, line in enumerate(lines):
        held.append(line)
        if i + 1 == len(lines) or md5((hashes[i - 1] if i else "") + hashes[i])[-1] in "0123":
            out.append(held)
            held = []
    return out


def test_line_dedup_equals_plain(spark, plain):
    rows = [*plain, (500, "p\nq\nr\ns\nt\nu\nv\nw\nx\ny", None, None), (501, "new\nline\np\nq\nr\ns\nt\nu\nv\nw\nx\ny", None, None)]
    seen, want = set(), {}
    for doc, text, *_ in sorted(rows, key=lambda r: r[0]):
        if text is None:
            want[doc] = (0, 0, None)
            continue
        kept, gone = [], 0
        for c in plain_line_chunks(text):
            body = "\n".join(c)
            if len(c) >= 2 and body in seen:
                gone += len(c)
                continue
            seen.add(body)
            kept.append(body)
        want[doc] = (text.count("\n") + 1, gone, "\n".join(kept))
    out = line_dedup.dedup_lines(frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in out} == want
    assert sum(v[1] for v in want.values()) > 10 and want[501][1] > 0


@pytest.mark.parametrize("heavy, broadcast", [(1, 10**6), (7, 10**6), (7, 0)])
def test_line_dedup_of_hot_chunks(spark, monkeypatch, heavy, broadcast):
    """A chunk that a third of all rows hold is dealt to several tasks and still removed everywhere but once."""
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)
    monkeypatch.setattr(line_dedup, "BROADCAST_HASHES", broadcast)
    shared = "\n".join(f"shared line {i}" for i in range(30))
    rows = [(i, f"own {i}\n{shared}\nend {i}" if i % 3 == 0 else f"own {i}\nother {i}", None, None) for i in range(120)]
    first = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(frame(spark, rows, 7)).collect()}
    monkeypatch.setattr(line_dedup, "HEAVY", 10**6)
    monkeypatch.setattr(line_dedup, "BROADCAST_HASHES", 10**6)
    assert first == {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert first[0] == 0 and all(first[i] > 10 for i in range(3, 120, 3)) and not any(first[i] for i in range(1, 120, 3))


def test_line_dedup_gaps(docs, rows):
    out = line_dedup.dedup_lines(docs).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)


def test_line_dedup_is_native(docs):
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_media_round_trip(docs, rows):
    out = media.media_features(docs).collect()
    want = Counter()
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        full = raw + b"\0" * ((-len(raw)) % 64 or (64 if not raw else 0))
        want[doc, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out) == want
    assert len({(r["media_sha256"], r["feature"]) for r in out if r["doc_id"] in range(100, 112)}) == 1


def test_media_ranges_and_retries(spark, docs, monkeypatch, tmp_path):
    monkeypatch.setattr(media, "RANGE_BYTES", 20_000)
    monkeypatch.setattr(media, "BATCH_BYTES", 3000)
    writer = media.ArchiveWriter(f"file://{tmp_path}", "part-0", 1)
    bodies = [media.encode_png(media.payload("text %d " % i * (i * 9 % 400))[0]) for i in range(120)]
    for i, b in enumerate(bodies):
        writer.add(f"{i}.{i}.png", b)
    writer.close()
    reader = media.ArchiveReader(f"file://{tmp_path}")
    ranges = reader.partitions()
    assert len(ranges) > 1
    got = [row for part in ranges for batch in reader.read(part) for row in batch.to_pylist()]
    assert [(r["doc_id"], r["media"]) for r in got] == list(enumerate(bodies))
    name, body, _ = reader.member(got[7]["path"], got[7]["member_offset"])
    assert (name, body) == ("7.7.png", bodies[7])
    with open(got[7]["path"], "r+b") as f:
        f.seek(got[7]["member_offset"] + 600)
        f.write(b"damage")
    with pytest.raises((ValueError, OSError, zlib.error)):
        reader.member(got[7]["path"], got[7]["member_offset"])


def test_png_filters():
    rows = np.arange(256, dtype=np.uint8).reshape(4, 64)
    up = rows.copy()
    up[1:] = rows[1:] - rows[:-1]
    lines = np.concatenate([np.full((4, 1), 2, np.uint8), up], axis=1)
    import struct

    png = media._SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 4, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(lines.tobytes())) + media._chunk(b"IEND", b"")
    assert media.decode_png(png) == rows.tobytes() and media.decode_png(media.encode_png(rows.tobytes())) == rows.tobytes()
