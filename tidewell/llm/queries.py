"""Queries of this subpackage: each applies an operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import byte_bpe, divergence, hard_negatives, html_text, imatch, license_scan, mixing, ngram_jaccard, passage_chains, piece_codec, quality, secret_scan, toxicity

#: The public tokenizer file that op8 uses where no other is named.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The public rank file that op11 uses where no other is named.
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with Jaccard similarity 0.85 or more on 4-word shingles."""
    return ngram_jaccard.similar(_table(spark, sf_dir, "documents"), k=4, percent=85, count_links=False).select("doc_id", "n_shingles", "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document: grade 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    grade = F.col("toxic") * (2 - F.col("quality"))
    return toxicity.score(docs, toxicity.train(docs, labels, grade, grades=3))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and texts of Dice 0.8 or more."""
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 5, 2, 1, repeating; 150 % of all words; at most twice a source."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every document and of its edited text."""
    return imatch.with_edits(_table(spark, sf_dir, "documents"))


def op7_passage_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has as well, exactly or nearly."""
    return passage_chains.repeated_passages(_table(spark, sf_dir, "documents"))


def op8_piece_codec(spark: SparkSession, sf_dir: str, model_file: str = PIECE_MODEL) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text.

    Piece costs are Zipf log-probabilities by the ranks of the model file, which has merges only.
    """
    return piece_codec.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), model_file).select("doc_id", "n_ids", "round_trip", "ids")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the base patterns and of the Markov models."""
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and language bands of 5-gram perplexity."""
    return quality.assess(_table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str, rank_file: str = BYTE_RANKS) -> DataFrame:
    """Digests of the byte-level BPE ids of every document, and of what they decode to."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    encoded = byte_bpe.encode(docs, rank_file, public_tokenizers.PATTERN, keep_text=False)
    return byte_bpe.decode(encoded, rank_file, public_tokenizers.PATTERN).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive."""
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ in their terms."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (op1_ngram_jaccard, op2_toxicity, op3_html_text, op4_license_scan, op5_mix_sources, op6_imatch, op7_passage_chains, op8_piece_codec, op9_secret_scan, op10_quality_rules, op11_byte_bpe, op12_hard_negatives, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": ngram_jaccard.oracle(), "op4_license_scan": license_scan.oracle(), "op5_mix_sources": mixing.oracle(), "op12_hard_negatives": hard_negatives.oracle(), "op13_source_divergence": divergence.oracle()}
