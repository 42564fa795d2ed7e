"""From raw documents to token files: five stages, each stored and read again as the next one's documents.

``run`` applies them to the table documents. Every stage works on all rows the
one before it kept; the first four return the columns of documents, the last
the read-back digest of the token files. The mixing stage returns its documents
in the mixed order, files and their rows, and the token files keep that order:
``start`` counts the ids of the documents that the schedule puts before one.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldline.llm import decontaminate, mixing, quality, simhash, tokens
from fieldline.session import discard, finished, new_path

# Tokenization has no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None

TOKENIZER = "word_bpe_49k.json"


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that mixes sources to their target weights."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order in which ``docs`` is stored, read back: doc_id, start, n_tokens, ids_crc32."""
    path = new_path(spark, "corpus-tokens")
    tokens.write(docs, path, public_tokenizers.path(TOKENIZER), as_stored=True)
    return tokens.checksums(tokens.read(spark, path))


STAGES = [
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spent = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = finished(spark, partial(stage, spark, docs, sf_dir), f"corpus-{name}")
        discard(*spent)
        spent = [docs]
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(*spent)
    return out
