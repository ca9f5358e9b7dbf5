"""One registered query per operator: each applies it with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import licenses, secret_scan
from loomgraph.llm.decontaminate import contamination
from loomgraph.llm.divergence import judge
from loomgraph.llm.frames import table
from loomgraph.llm.hard_negatives import mined, relabelled
from loomgraph.llm.language_id import held_out_languages
from loomgraph.llm.near_dedup import near_duplicates
from loomgraph.llm.packing import pack
from loomgraph.llm.quality_pu import held_out_scores
from loomgraph.llm.sql import WARC, divergence_sql, hard_negatives_sql, vector_codes_sql
from loomgraph.llm.substring_dedup import strip_repeats
from loomgraph.llm.suffix_dedup import strip_repeated_bytes
from loomgraph.llm.vector_codes import compressed
from loomgraph.llm.warc import round_trip

# Shards of 16 MB of pages, files of 8 MB: the given tables are small.
ARCHIVES = {"shard_bytes": 16 << 20, "roll_bytes": 8 << 20}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {
    "op3_divergence_rules": divergence_sql(),
    "op10_warc_round_trip": WARC,
    "op12_vector_codes": vector_codes_sql(),
    "op13_hard_negatives": hard_negatives_sql(),
}


def public_vocabulary() -> dict[str, str]:
    """Places of the byte-level vocabulary, as tokenizer file and as ranks."""
    from public_tokenizers import path

    return {"vocabulary": path("byte_bpe_50k.json"), "ranks": path("byte_bpe_50k.tiktoken")}


def _registered(build):
    QUERIES[build.__name__] = build
    return build


@_registered
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of each document."""
    return secret_scan.report(table(spark, folder, "documents"))


@_registered
def op2_language_ecoc(spark: SparkSession, folder: str) -> DataFrame:
    """Language of each document, learned from three of four folds."""
    return held_out_languages(table(spark, folder, "documents")).select("doc_id", "held_out", "lang_pred", "score", "runner_up", "ambiguous")


@_registered
def op3_divergence_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Quality counts of each document and whether the rules keep it."""
    found = judge(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_registered
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as token sequences of at most 2048 ids."""
    return pack(table(spark, folder, "documents"), **public_vocabulary())


@_registered
def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License of each document as a file of a tree, its own or its directory's."""
    return licenses.scan(licenses.as_files(table(spark, folder, "documents")))


@_registered
def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words left of each document when every repeated window of 35 words is taken out."""
    return strip_repeats(table(spark, folder, "documents"), with_text=False)


@_registered
def op7_quality_pu(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of each document, learned from two of three folds."""
    found = held_out_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@_registered
def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Test items that a document holds, with the edits it takes."""
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), short=True)


@_registered
def op9_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate group of each document, and whether it is the one to keep."""
    return near_duplicates(table(spark, folder, "documents"))


@_registered
def op10_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The record of each page, written to archives and read back."""
    records = round_trip(table(spark, folder, "pages").select("page_id", "url", "html"), **ARCHIVES)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_registered
def op11_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes left of each document when every repeated string of 400 bytes is taken out."""
    return strip_repeated_bytes(table(spark, folder, "documents"))


@_registered
def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Code of each vector, four bytes long, with its error and that of its label."""
    return compressed(table(spark, folder, "embeddings"))


@_registered
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector, for each of its nearest neighbours of the same label."""
    return mined(relabelled(table(spark, folder, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
