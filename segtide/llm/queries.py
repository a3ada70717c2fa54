"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segtide.llm import bpe, bpe_transducer, conversation_repair, html_extraction, jaccard_join, merkle_manifest, mixing, mtree, quality_classifier, quality_rules, substring_dedup, token_counts, url_filter
from segtide.llm.common import read

#: Tokenizer files, numbers of the search, the token limit, weights of sources and the URL rules.
WORD_BPE, BYTE_BPE, RANKS, TOKEN_LIMIT = "word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", 2048
BEST, SCALE, EVERY = 20, 64, 20
QUALITY_THRESHOLD = 0.3
SOURCE_WEIGHTS, SOURCE_SHARE, MOST_COPIES = (5, 2, 1), 1.5, 2.0
URL_RULES = [
    url_filter.Rule("com/", "allow"),
    url_filter.Rule("example.com/en/", "block"),
    url_filter.Rule("www.example.com/en/", "allow"),
    url_filter.Rule("net/es/", "block"),
    url_filter.Rule("net/fr/", "block"),
]


def mtree_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best vectors for every twentieth one."""
    return mtree.top_k(read(spark, sf_dir, "embeddings"), BEST, SCALE, EVERY)


def html_extraction_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extraction.extract(read(spark, sf_dir, "pages"), keep=["page_id", "url"])


def token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = token_counts.token_counts(documents, public_tokenizers.path(WORD_BPE), keep=["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def url_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"])


def jaccard_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and component of every document."""
    return jaccard_join.similar_groups(read(spark, sf_dir, "documents"))


def substring_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document."""
    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents"), digest=True)


def quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality_rules.judge_quality(read(spark, sf_dir, "documents"), keep=["doc_id"])


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    found = mixing.shares(read(spark, sf_dir, "documents"), SOURCE_WEIGHTS, SOURCE_SHARE, MOST_COPIES)
    return found.select("doc_id", "size", "source_size", "target", "taken")


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, as hashes."""
    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), keep=["doc_id"])


def quality_classifier_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = quality_classifier.classify(documents.withColumn("held_out", quality_classifier.held_out()), labels, QUALITY_THRESHOLD, keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", "predicted")


def bpe_transducer_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the ranks for many languages and what they decode to, as hashes."""
    return bpe_transducer.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), keep=["doc_id"])


def conversation_repair_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    return conversation_repair.repair(conversation_repair.damage(read(spark, sf_dir, "conversations")))


def merkle_manifest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document."""
    return merkle_manifest.manifest(read(spark, sf_dir, "documents"))


REGISTRY = {
    "op1_mtree": mtree_query,
    "op2_html_extraction": html_extraction_query,
    "op3_token_counts": token_counts_query,
    "op4_url_filter": url_filter_query,
    "op5_jaccard_join": jaccard_join_query,
    "op6_substring_dedup": substring_dedup_query,
    "op7_quality_rules": quality_rules_query,
    "op8_mixing": mixing_query,
    "op9_bpe": bpe_query,
    "op10_quality_classifier": quality_classifier_query,
    "op11_conversation_repair": conversation_repair_query,
    "op12_merkle_manifest": merkle_manifest_query,
    "op13_bpe_transducer": bpe_transducer_query,
}
