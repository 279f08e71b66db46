"""The corpus pipeline: documents to piece ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet
in the shared folder and reads it again as the next stage's documents.  The stages up to the
mix return the columns of documents.

Defined results: documents of null or empty text fail the quality rules; of rows that are
equal, or whose ids are null, one stays as of any other near duplicates; null sources are a
source of their own; a document of the mix stands there 0, 1 or 2 times; an empty table gives
an empty result with the columns of the last stage.  Further columns of ``documents`` are kept
by all stages, but for ``ids``, ``n_ids`` and ``round_trip``, which the last one sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import mixing, ngram_jaccard, piece_codec, quality, secret_scan
from tidewell.llm.queries import PIECE_MODEL
from tidewell.sources.shared import alone, discard

def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are in their language's perplexity band."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by Jaccard 0.8 on 5-word shingles."""
    return ngram_jaccard.one_each(docs, k=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their secrets masked."""
    return secret_scan.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 times."""
    return mixing.mixed(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their pieces."""
    return piece_codec.encode(docs, PIECE_MODEL)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("source_mix", source_mix),
    ("piece_ids", piece_ids),
]

#: SQL can't express the language model, the components and the Viterbi search.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    What a stage keeps in the shared folder is deleted when its result is written, and that
    when the next one's is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, apply in STAGES:
        given = docs
        docs = alone(lambda apply=apply, given=given: apply(spark, given, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
