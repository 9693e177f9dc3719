"""Corpus preparation: documents to packed training sequences.

Each stage reads what the one before it wrote. The stages keep every column and row
they do not decide on; the last one returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm import langid, lineruns, mixing, packing, simhash
from tremor.llm.common import Scratch, col, free_name

# A score below this is no language: natural text of the learned languages scores 0.4
# and more, even if it is short or half of it is markup.
MIN_LANGUAGE_SCORE = 0.2
MIN_RUN_WORDS = 20
SHINGLE_WORDS, MAX_BITS = 3, 2
MAX_REPEATS = 1.25


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or unlike every learned language, go."""
    held, lang, score = (free_name(docs, x) for x in ("held_out", "lang_pred", "score"))
    found = langid.identify(docs, carry=True, results=(held, lang, score))
    return found.where((F.col(lang) != langid.UNDETERMINED) & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*map(col, docs.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted; a document of which no word is
    left goes, and ``n_chars`` follows the text."""
    deleted = free_name(docs, "deleted_lines")
    out = lineruns.dedup_lines(docs, min_words=MIN_RUN_WORDS, lines_name=deleted)
    touched = F.size(deleted) > 0
    out = out.where(~touched | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return out.withColumn("n_chars", F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*map(col, docs.columns))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.one_per_group(docs, words=SHINGLE_WORDS, budget=MAX_BITS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are read up to ``MAX_REPEATS`` times; no document is left out."""
    epoch, block, place = (free_name(docs, x) for x in ("epoch", "block", "place"))
    mixed = mixing.mix(docs, target_entropy=None, max_repeats=MAX_REPEATS, epoch_name=epoch, order_names=(block, place))
    return mixed.select(*map(col, docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents at their places in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Language profiles, hashes and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
