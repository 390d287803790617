"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, html_extract, language_id, line_dedup, media, mixing, near_dedup, packing, sharding, substring_dedup
from .common import durable

TOKENIZER = "word_bpe_49k.json"
#: Fingerprints that are broadcast with their counts (16 MB); more are sent in copies to this many tasks each.
BROADCAST_PRINTS, PRINT_COPIES = 1_000_000, 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents; every fiftieth id also searches all others within the radius: n_near, and near_ids.

    Rows of one fingerprint are a class, named after its smallest doc_id; near_ids are the
    classes found, the own one included, at most as many as there are words of 64 bits
    within the radius (43 745 for three bits).
    """
    prints = durable(fingerprints.fingerprint_documents(table(spark, sf_dir, "documents")), "prints")
    asked = prints.where("doc_id % 50 = 0")
    pairs = fingerprints.within_radius(asked, prints)
    sizes = prints.groupBy(F.col("bits").alias("found")).agg(F.count("*").alias("n"), F.min("doc_id").alias("id"))
    found = (F.sum("n") - 1).alias("n_near"), F.sort_array(F.collect_list("id")).alias("near_ids")
    near = durable(pairs.join(sizes, "found").groupBy(F.col("query").alias("bits")).agg(*found), "near")
    # equal texts have equal fingerprints, so one of them may stand in a third of all rows
    if near.count() <= BROADCAST_PRINTS:
        counted = prints.join(F.broadcast(near), "bits", "left")
    else:
        copies = near.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(PRINT_COPIES - 1))))
        counted = prints.withColumn("cell", F.pmod(F.xxhash64("doc_id", "edited_sha256"), F.lit(PRINT_COPIES)).cast("int")).join(copies, ["bits", "cell"], "left")
    asked_ = F.col("doc_id") % 50 == 0
    return counted.select(*[c for c in prints.columns if c != "bits"], *[F.when(asked_, F.col(c)).alias(c) for c in ("n_near", "near_ids")])


def op2_sampled_splitter_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.repeats(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op5_sainte_lague_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = durable(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("size")), "sizes")
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def op6_media_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op7_html_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096)


def op9_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_chunks_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80).drop("text_hash")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op9_line_chunk_dedup": line_dedup.ORACLE.replace("{text}", "sha256(text) AS kept_sha256")}
