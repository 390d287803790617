"""Sharding, mixing, page extraction and the pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.llm import html_extract, mixing, sharding

from . import brute
from .conftest import frame


def test_sharding_law(docs, rows):
    out = sharding.shard(docs, shards=4).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_is_even_and_keeps_copies(spark):
    rows = [(i, f"text {i} " * (1 + i % 40), None, None) for i in range(4000)] + [(5000 + i, "the same text again " * 5, None, None) for i in range(300)]
    out = sharding.shard(frame(spark, rows), shards=8).collect()
    bytes_ = Counter()
    for r in out:
        bytes_[r["shard"]] += r["size"]
    assert len(bytes_) == 8 and max(bytes_.values()) < 1.05 * min(bytes_.values())
    assert len({r["shard"] for r in out if r["doc_id"] >= 5000}) == 1
    again = sharding.shard(frame(spark, rows, 7), shards=8).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)


def test_sharding_splits_what_outgrows_a_shard(spark):
    rows = [(i, f"text {i} " * 10, None, None) for i in range(2000)] + [(5000 + i, "the same text again " * 5, None, None) for i in range(1500)]
    out = sharding.shard(frame(spark, rows), shards=8).collect()
    bytes_ = Counter()
    for r in out:
        bytes_[r["shard"]] += r["size"]
    assert max(bytes_.values()) < 1.1 * min(bytes_.values())


def test_sharding_empty(empty):
    assert sharding.shard(empty).count() == 0


def test_sainte_lague_equals_plain():
    rng = np.random.default_rng(5)
    for _ in range(50):
        w = rng.integers(0, 50, 6).astype(float).tolist()
        cap = rng.integers(0, 40, 6).tolist()
        seats = int(rng.integers(0, 120))
        want = [0] * 6
        for _ in range(seats):
            q = [w[i] / (2 * want[i] + 1) if want[i] < cap[i] else -1 for i in range(6)]
            if max(q) <= 0:
                break
            want[q.index(max(q))] += 1
        assert mixing.sainte_lague(seats, w, cap) == want


def test_targets():
    got = mixing.targets([100, 10, 100], [5, 2, 1])
    assert got[1] == 30 and sum(got) == pytest.approx(210) and got[0] == pytest.approx(5 * got[2])
    assert mixing.targets([0, 0], [5, 2]) == [0, 0] and mixing.targets([], []) == []


def test_mixing(spark, docs, rows):
    sized = docs.select("doc_id", "source", "taken", "target", mixing.word_count("text").alias("size"))
    out = mixing.mix(sized).collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((r[0], len(brute.words(r[1]))) for r in rows)
    taken, target = Counter(), {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(20, 0.01 * t), (s, taken[s], t)
    again = mixing.mix(sized.repartition(5)).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in out) == Counter((r["doc_id"], r["size"], r["taken"]) for r in again)


def test_mixing_blocks_agree_with_positions(spark, docs):
    sized = docs.select("doc_id", "source", mixing.word_count("text").alias("size"))
    out = mixing.mix(sized).withColumn("chosen", F.expr("transform(sequence(0, greatest(size, 1) - 1), i -> i)"))
    out = out.withColumn("n_chosen", F.when(F.col("size") > 0, F.size(F.filter("chosen", lambda i: mixing.is_chosen(F.col("line_start") + i)))).otherwise(0))
    assert out.where("taken <> passes * size + n_chosen").count() == 0
    parts = mixing.partial_texts(F.col("text"), F.col("size"))
    kept = mixing.mix(docs.select("doc_id", "source", "text", mixing.word_count("text").alias("size"))).select("text", "size", "taken", "passes", parts.alias("parts")).where("taken > passes * size").collect()
    assert kept
    for r in kept:
        assert sum(len(brute.words(p)) for p in r["parts"]) == r["taken"] - r["passes"] * r["size"]
        assert all(p in r["text"] and p == p.strip(" \t\n\x0b\x0c\r") for p in r["parts"]) and len(r["parts"]) <= 2


def test_mixing_passes_other_columns_through(spark, docs):
    named = docs.select("doc_id", "source", mixing.word_count("text").alias("size"), *[F.lit(c).alias(c) for c in ("_s", "s", "shard", "_source", "place", "id", "row", "name", "target")])
    out = mixing.mix(named)
    assert out.columns == ["doc_id", "source", "size", "_s", "s", "shard", "_source", "place", "id", "row", "name", *mixing.ADDED]
    assert {tuple(r[c] for c in ("_s", "s", "shard", "_source", "place", "id", "row", "name")) for r in out.collect()} == {("_s", "s", "shard", "_source", "place", "id", "row", "name")}


def test_mixing_of_repeated_and_null_ids_spreads(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_SHARD_TOKENS", 50)
    df = spark.createDataFrame([(None if i % 2 else 7, "a", 10, i) for i in range(200)] + [(1000 + i, "b", 10, i) for i in range(100)], "doc_id long, source string, size long, k int")
    out = mixing.mix(df).collect()
    assert len({(r["n_blocks"], r["turn"], r["line_start"]) for r in out if r["source"] == "a"}) > 20
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((r["source"], r["k"], r["taken"]) for r in out) == sorted((r["source"], r["k"], r["taken"]) for r in again)


def test_mixing_takes_few_documents_in_part(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3], 40 + i % 50) for i in range(3000)], "doc_id long, source string, size long")
    out = mixing.mix(df).collect()
    assert sum(r["taken"] % r["size"] > 0 for r in out) <= 3 * len({(r["source"], r["turn"], r["n_blocks"]) for r in out})


def test_mixing_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, size long")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>About</a></ul></nav><div class="cookie-banner">We use cookies</div>
<div id=sidebar><p>Popular posts</div>%s<form><input value=x>Search</form>
<section id="comments"><article class="comment"><p>First!</p></article></section><footer>&copy; site</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "page_id long, url string, html string, host string, text string, template string")


def texts(out):
    return {r["page_id"]: r["text"] for r in out.collect()}


def test_html_article(spark):
    body = "<article><h1>Head &amp; line</h1><p><b>One\n  two<br>three<p>Four&nbsp;five</p><div class=advert>Buy</div><aside>More</aside><ul><li>x<li>y</ul></article>"
    rows = [(1, "http://a.org/1", PAGE % body), (2, None, None), (3, "nohost", ""), (4, "http://a.org/2", "<p>only <i>a</i> paragraph"), (5, "http://a.org/3", "plain text < 3 &lt; 4"), (6, "http://b.org", "<div><p>unclosed <b"), (None, "http://b.org", None)]
    got = texts(html_extract.extract(pages(spark, rows)))
    assert got[1] == "Head & line\n\nOne two three\n\nFour five\n\nx\n\ny"
    assert got[2] == "" and got[3] == "" and got[None] == "" and got[4] == "only a paragraph" and got[5] == "plain text < 3 < 4" and got[6] == "unclosed"


def test_html_template_of_a_host(spark):
    """Boxes that no name gives away go where they recur on a host, and stay on a host with few pages."""
    page = "<body><div class=q7><p>Weather desk <a href=/w>now</a></p></div><div class=z><p>Story %d tells its own tale.</p></div><div class=k><p>All rights</p></div></body>"
    rows = [(i, f"https://news.example/{i}", page % i) for i in range(12)] + [(100, "https://small.example/1", page % 100)]
    got = texts(html_extract.extract(pages(spark, rows)))
    assert all(got[i] == f"Story {i} tells its own tale." for i in range(12))
    assert got[100] == "Weather desk now\n\nStory 100 tells its own tale.\n\nAll rights"


def test_html_articles_posted_often_stay(spark):
    body = "<article><h1>News</h1><p>The very same story of many pages.</p></article>"
    rows = [(i, f"http://copy.example/{i}", PAGE % body) for i in range(10)]
    assert set(texts(html_extract.extract(pages(spark, rows))).values()) == {"News\n\nThe very same story of many pages."}


def test_html_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "BROADCAST_HASHES", 0)
    test_html_template_of_a_host(spark)


def test_html_empty(spark):
    assert html_extract.extract(pages(spark, [])).count() == 0
