"""From raw documents to encoded, mixed training data; each stage is one of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapframe.llm import bpe, grace_dedup, language_id, ngram_join, source_mix
from snapframe.llm.common import materialise, release
from snapframe.session import ship, table

TOKENIZER = "word_bpe_49k.json"
TIME = "position"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; null, empty and letterless texts go (language_id.keep_identified)."""
    ship(spark)
    return language_id.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays; null text counts as empty (grace_dedup.keep_distinct)."""
    ship(spark)
    return grace_dedup.keep_distinct(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8, the smallest doc_id stays; texts without words all do (ngram_join.keep_first)."""
    ship(spark)
    return ngram_join.keep_first(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, repeated or left out as the sources' targets ask.

    Besides the columns of documents there is position, the training time, as files keep no order;
    where the input has a column of that name, underscores are added.
    """
    ship(spark)
    return source_mix.mixed_documents(docs, position=TIME)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, position, n_tokens, ids_sha256, decoded_sha256 and ids of every copy that is left; to be read by position.

    The training time is the column with the most underscores after its name, as mix_sources names
    it; documents without any have no position.
    """
    import public_tokenizers

    ship(spark)
    times = [c for c in docs.columns if c.lower().rstrip("_") == TIME]
    timed = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(TIME) for c in sorted(times, key=len)[-1:]))
    return bpe.encode_digests(timed, public_tokenizers.path(TOKENIZER), carry=tuple(timed.columns[2:]), with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_join", join_near_copies),
    ("source_mix", mix_sources),
    ("bpe", encode_text),
]

ORACLE_SQL = None  # the language model and the tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written to the shared folder and reread.

    A stage's rows are deleted once the next stage's are written.
    """
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if written is not None:
            release(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
