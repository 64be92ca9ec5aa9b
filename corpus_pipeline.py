"""The corpus pipeline: documents through five operators, each stage on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import line_dedup, mixing, near_dedup, sentencepiece_chunks, toxicity
from granary.llm._common import Scratch, table, temporaries


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below 0.3, by a classifier fitted on labelled documents."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), 0.3)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand (but for an edit) in earlier ones; those left without text go."""
    left = line_dedup.dedup(docs)
    return left.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words a shingle, a similarity of 0.8 or more."""
    return near_dedup.deduplicate(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by probabilities that bring sources, languages and topics to their target shares."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    import public_tokenizers

    # Executors have grown by now: a smaller table of chunks than by default.
    return sentencepiece_chunks.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=True, limit=16 << 20)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("near dedup", drop_near_duplicates), ("mixing", mix_sources), ("encoding", encode)]

#: SQL can't express the classifier, the edit join or the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs, last = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with temporaries():  # a stage's own tables go once its result is saved
            docs = scratch.save(stage(spark, docs, sf_dir), at := name.replace(" ", "_"))
        if last:
            scratch.drop(last)
        last = at
    return docs
