"""From raw documents to packed training sequences: five stages over the whole corpus.

Each stage takes what its predecessor kept, as a written table with the columns of
``documents``, and its decisions take effect: documents in no language go, repeated line
chunks go, one document of each near-duplicate group stays, sources are thinned or
repeated to their targets, and what is left is packed. A null text is in no language, so
it goes in the first stage; a document whose lines are all repeated is left as an empty
text, which mixing drops; rows that share an id are told apart by their texts, and rows
equal in both stay once; a null id takes part in no near-duplicate link; an empty table
passes through all stages; further columns of ``documents``, whatever their names, are
passed through up to packing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm import language_id, line_dedup, mixing, near_dedup, packing
from quarrykit.llm.common import durable
from quarrykit.llm.queries import tokenizer_path


def _rows(row: str, text: Column, columns: list[str]) -> list[Column]:
    """The columns of a document kept whole as a struct, with another text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return [new.get(c, F.col(row).getField(c)).alias(c) for c in columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter of any language are rejected; a missing language is filled in."""
    model = language_id.fit(docs)
    given = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    named = language_id.predict(given, model).where(F.col("lang_pred") != language_id.UNKNOWN)
    return named.select(*[(F.coalesce(F.col("row.lang"), F.col("lang_pred")) if c == "lang" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that occur before are cut out of the texts; no document goes."""
    return line_dedup.without_repeats(docs).select(*_rows("row", F.col("kept"), docs.columns))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group with five-word shingles of similarity 0.8 or more the smallest id stays, once."""
    found = near_dedup.near_duplicates(docs, shingle=5, percent=80)
    keys = ["_id", "_hash"]
    named = found.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.coalesce("text_hash", F.lit("")).alias("_hash"), "kept")
    spread = (F.monotonically_increasing_id() % 100_000).cast("string")  # rows without an id meet nothing: they needn't meet each other
    hashed = F.when(F.col("doc_id").isNull(), spread).otherwise(F.coalesce(F.md5("text"), F.lit("")))
    wrapped = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"), hashed.alias("_hash"))
    left = wrapped.join(named.where(~F.col("kept")).select(*keys).distinct(), keys, "left_anti")
    twice = durable(named.where("kept").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys), "twice")
    if not twice.isEmpty():  # rows equal in id and text: only these are gathered by key
        left = left.join(twice, keys, "left_anti").unionByName(left.join(twice, keys, "left_semi").dropDuplicates(keys))
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each whole pass over a document, and one for each run of its words that the mix takes once more."""
    sized = docs.select(F.struct("*").alias("row"), "doc_id", "source", mixing.word_count("text").alias("size"))
    mixed = mixing.mix(sized).where("taken > 0")
    whole = F.array_repeat(F.col("row.text"), F.col("passes").cast("int"))
    part = F.when(F.col("taken") > F.col("passes") * F.col("size"), mixing.partial_texts(F.col("row.text"), F.col("size"))).otherwise(F.array().cast("array<string>"))
    rows = mixed.select("row", F.explode(F.concat(whole, part)).alias("part"))
    return rows.select(*_rows("row", F.col("part"), docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens in as few sequences as best-fit decreasing finds."""
    return packing.packed_documents(docs, tokenizer_path(), capacity=4096)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("near_dedup", remove_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language ID, near-duplicate signatures and tokenization have no SQL form; tests/llm/test_pipeline.py has plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs, f"stage-{name}")
    return docs
