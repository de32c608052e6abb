"""The queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from causeway.llm import chunks, divergence, jaccard, mixing, oracles, packing, pages, quality, suffix_tree, suffixes, topk, trie, urls, warc
from causeway.llm._common import new_path, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = new_path(spark, "warc")
    warc.write_archive(warc.archive_rows(rows, "page_id", "url", "html"), path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    # The payloads of responses are measured anew; of revisits only the headers are read.
    held = warc.read_archive(spark, path).where("record_type = 'response'").select("record_id", "refers_to", "record_type", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    seen = warc.read_archive(spark, path, payload=False).where("record_type = 'revisit'").select("record_id", "refers_to", "record_type", "payload_bytes", F.regexp_extract("payload_digest", "^sha256:(.*)$", 1).alias("payload_digest"))
    return held.unionByName(seen).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "repeats")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op5_suffix_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_tree.score(docs, held_out=F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select("doc_id", "quality.*")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, is_query=F.col("vec_id") % 100 == 0)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages.extract(rows).select("page_id", "url", "page.*")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_warc, op3_source_mixing, op4_best_fit_packing, op5_suffix_tree_scoring, op6_ngram_jaccard_join, op7_quality_rules, op8_exact_top_k, op9_suffix_dedup, op10_url_filters, op11_source_divergence, op12_html_extraction, op13_conversation_trie)}


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
