"""From raw documents to packed training sequences. Each stage's rows are written as Parquet and read again by the next.

What holds for every stage: all rows that the stage before kept are worked on, whole texts, never a part of them; nulls may stand in any column; an
empty table gives an empty one; repeated rows are documents of their own; columns besides those of `documents`, of any name, are kept by all stages
but the last, which returns pieces. Work tables lie in spark.checkpoint.dir, so a lost executor repeats tasks of one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from querylens.llm import minhash_dedup, mixing, packing, secret_index, toxicity_fm
from querylens.llm.common import Scratch, load


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. Null and empty texts, and rows without a doc_id, are scored like others; labels without toxic
    ones reject nothing, and toxic ones alone reject all."""
    return toxicity_fm.keep_clean(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more) stays: the one of least doc_id, a null one last; of
    repeated rows the first. Texts without words, nulls among them, are like nothing and all stay."""
    return minhash_dedup.deduplicate(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts, all kinds of spans; rows stay. A null text stays null; n_chars follows a
    text that was cut, other columns stay as they are."""
    return secret_index.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in the schedule's order. A null source is a source of its own, the last; texts without words,
    nulls among them, are taken 0 times; the document in which a source's target ends is cut there."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens. A null or empty text is its end token alone; repeats of a document are packed each."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("pack", pack)]

#: A model's scores, tokens and components have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{i}-{name}", "zstd")
        if i > 1:
            scratch.drop(f"stage-{i - 2}-{STAGES[i - 2][0]}")
    return docs
