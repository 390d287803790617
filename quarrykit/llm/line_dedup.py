"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

Lines are hashed; a hash over each line's and the previous line's hash marks a chunk's
last line, so boundaries move with the content and an inserted line spoils one chunk
only. A chunk of at least ``MIN_LINES`` lines that occurs anywhere earlier (smallest
doc_id, then place) is removed. Chunk hashes only sift: the chunks whose hash occurs
twice are grouped by their bytes.

Defined cases: a null text has no lines and stays null; an empty text is one empty line;
rows equal in id and text are one document; a null id sorts after all others; an empty
table gives an empty result; other columns are not read, or passed on unchanged whatever
their names by ``without_repeats``. Lines are split at line feeds
only and what is kept is not changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, durable

MIN_LINES = 2
#: Hexadecimal digits that mark a boundary: 4 of 16, chunks of about four lines.
MARKS = ("0", "1", "2", "3")
#: Chunks of one hash that one task compares, about, and hashes with more than that at most.
HEAVY, MOST_HEAVY = 1000, 1_000_000
#: Repeated hashes that are broadcast (16 MB).
BROADCAST_HASHES = 1_000_000
_NO_ID = (1 << 63) - 1


def chunks(text: Column) -> Column:
    """array<string>: the chunks of a text, in order.

    Every step takes whole arrays, so the work is linear in the text: each line is led by y
    where a chunk begins and by x elsewhere, the lines are joined and cut before each y. No
    line holds a line feed, so only the joints match.
    """
    lines = F.split(text, "\n", -1)
    hashes = F.transform(lines, lambda x: F.md5(x))
    before = F.concat(F.array(F.lit("")), F.slice(hashes, 1, F.size(lines) - 1))
    ends = F.zip_with(before, hashes, lambda p, h: F.substring(F.md5(F.concat(p, h)), -1, 1).isin(*MARKS))
    begins = F.concat(F.array(F.lit(False)), F.slice(ends, 1, F.size(lines) - 1))
    joined = F.array_join(F.zip_with(begins, lines, lambda b, x: F.concat(F.when(b, F.lit("y")).otherwise(F.lit("x")), x)), "\n")
    return F.transform(F.split(F.substr(joined, F.lit(2)), "\ny", -1), lambda c: F.replace(c, F.lit("\nx"), F.lit("\n")))


def count_lines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def _place(row: str) -> list[Column]:
    """What tells documents apart: the id, and a hash of the text where ids repeat or are missing."""
    return [F.coalesce(F.col(f"{row}.doc_id"), F.lit(_NO_ID)).alias("d"), F.md5(f"{row}.text").alias("t")]


def repeated_chunks(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(d, t, gone): for each document the numbers of its chunks that occur earlier."""
    cut = docs.where(F.col("doc.text").isNotNull()).select(*_place("doc"), F.posexplode(chunks(F.col("doc.text"))).alias("k", "body"))
    cut = cut.where(count_lines(F.col("body")) >= min_lines)
    # 1. hashes of chunks that occur twice anywhere
    hashed = cut.select(F.xxhash64("body").alias("h"))
    twice = durable(hashed.groupBy("h").agg(F.count("*").alias("times")).where("times > 1"), "hashes")
    # 2. a hash of many chunks is dealt to several tasks; there are less than MOST_HEAVY such hashes, as they hold `heavy` chunks each
    total, distinct = twice.agg(F.coalesce(F.sum("times"), F.lit(0)), F.count("*")).first()
    heavy = max(HEAVY, -(-total // MOST_HEAVY))
    many = twice.where(F.col("times") > heavy).select("h", F.ceil(F.col("times") / heavy).cast("int").alias("cells"))
    cells = F.coalesce("cells", F.lit(1))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(many), "h", "left").withColumn("cell", F.pmod(F.xxhash64("d", "t", "k"), cells).cast("int")).withColumn("cells", cells)

    # 3. the bytes of those chunks only; the first of each keeps its place
    bodies = cut.withColumn("h", F.xxhash64("body"))
    if distinct <= BROADCAST_HASHES:
        bodies = bodies.join(F.broadcast(twice.select("h")), "h", "left_semi")
    else:  # chunks are sifted without their bytes, which are then cut from the documents concerned
        copies = twice.join(F.broadcast(many), "h", "left").select("h", F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"))
        named = dealt(bodies.select("h", "d", "t", "k")).join(copies, ["h", "cell"], "left_semi").groupBy("d", "t").agg(F.collect_set("k").alias("ks"))
        found = docs.select("doc", *_place("doc")).join(named, ["d", "t"])
        bodies = found.select("d", "t", "ks", F.posexplode(chunks(F.col("doc.text"))).alias("k", "body")).where(F.array_contains("ks", F.col("k"))).drop("ks").withColumn("h", F.xxhash64("body"))
    suspect = durable(dealt(bodies).select("h", "cell", "cells", "d", "t", "k", "body"), "suspects")
    place = F.struct("d", "t", "k")
    own = suspect.groupBy("h", "cell", "cells", "body").agg(F.min(place).alias("first"), F.count("*").alias("times"))
    owner = own.groupBy("h", "cells", "body").agg(F.min("first").alias("first"), F.sum("times").alias("times")).where("times > 1")
    owner = owner.select("h", "body", "first", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    return suspect.join(owner, ["h", "cell", "body"]).where(place != F.col("first")).groupBy("d", "t").agg(F.collect_set("k").alias("gone"))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """(row, doc, n_lines, n_removed, n_chunks_removed, kept): ``row`` holds all columns of ``df``, ``kept`` is what is left of the text."""
    docs = df.select(F.struct("*").alias("row"), F.struct(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).alias("doc"))
    gone = repeated_chunks(docs.select("doc"), min_lines)
    both = docs.select("row", "doc", *_place("doc")).join(gone, ["d", "t"], "left")
    none = F.array().cast("array<int>")
    cs = F.when(F.size(F.coalesce("gone", none)) > 0, chunks(F.col("doc.text")))
    whole = both.select("row", "doc", F.coalesce("gone", none).alias("gone"), cs.alias("cs"), "t")
    kept = F.filter(F.col("cs"), lambda c, i: ~F.array_contains("gone", i))
    removed = F.aggregate(F.filter(F.col("cs"), lambda c, i: F.array_contains("gone", i)), F.lit(0), lambda a, c: a + count_lines(c))
    n_lines = F.when(F.col("doc.text").isNull(), 0).otherwise(count_lines(F.col("doc.text")))
    return whole.select(
        "row",
        "doc",
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.size("gone").cast("long").alias("n_chunks_removed"),
        F.when(F.col("cs").isNull(), F.col("doc.text")).otherwise(F.array_join(kept, "\n")).alias("kept"),
    )


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed (lines), n_chunks_removed, text (what is kept)."""
    out = without_repeats(documents(df, id_col, text_col), min_lines=min_lines)
    return out.select("doc.doc_id", "n_lines", "n_removed", "n_chunks_removed", F.col("kept").alias("text"))


#: The same in SQL for the oracle (DuckDB): one row a document.
ORACLE = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, list_transform(ls, lambda x: md5(x)) AS hs FROM d),
b AS (SELECT *, list_concat([0], list_filter(range(1, len(ls)), lambda i: substr(md5(concat(CASE WHEN i > 1 THEN hs[i - 1] ELSE '' END, hs[i])), 32, 1) IN ('0', '1', '2', '3')), [len(ls)]) AS bs FROM h),
c AS (SELECT doc_id, text, ls, bs, unnest(range(0, len(bs) - 1)) AS k FROM b),
x AS (SELECT doc_id, k, bs[k + 2] - bs[k + 1] AS n, array_to_string(ls[bs[k + 1] + 1:bs[k + 2]], chr(10)) AS body FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY n >= 2, body ORDER BY doc_id, k) AS r FROM x),
a AS (SELECT doc_id, sum(n) AS n_lines, coalesce(sum(n) FILTER (n >= 2 AND r > 1), 0) AS n_removed, count(*) FILTER (n >= 2 AND r > 1) AS n_chunks_removed,
      coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (NOT (n >= 2 AND r > 1)), '') AS text FROM o GROUP BY doc_id)
SELECT doc_id, n_lines::bigint AS n_lines, n_removed::bigint AS n_removed, n_chunks_removed::bigint AS n_chunks_removed, {text} FROM a
UNION ALL SELECT doc_id, 0, 0, 0, NULL FROM documents WHERE text IS NULL"""
