"""A corpus pipeline over ``documents``: five stages, each a function of (spark, docs,
sf_dir) whose result is written as Parquet and read again as the next one's docs.

Toxic documents go; one document of each group of near-duplicates stays (five-word
shingles, similarity 0.8); documents that hold a benchmark window go; sources are cut to
their target weights; the rest becomes token-id files, of which each document's place,
length and checksum are returned. The first four return the columns that they are given,
also columns that the operators use names of, and keep every row that they do not reject:
null and empty texts and null ids pass through, repeated rows are told apart only by
near_dedup, of which one stays, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barlab.llm.common import BATCH, TEXT_ROWS, drop_staged, free_heaps, staged, table
from barlab.llm.decontaminate import without_benchmark
from barlab.llm.mixture import mixed_documents
from barlab.llm.near_dedup import keep_one
from barlab.llm.token_files import default_tokenizer, read_token_files, write_token_files
from barlab.llm.toxicity import without_toxic


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Smaller Arrow batches than Spark's usual 10,000 rows, as each row has a whole text. A
    stage's frame is computed after the stage returns, so the setting stays; run() puts the
    session's own back. The heaps that the stage before has filled are given back, too."""
    free_heaps(spark)
    spark.conf.set(BATCH, str(rows))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores under 0.5; a null or empty text scores as one without any word."""
    text_batches(spark)
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates and of each id: the one of the smallest id, of rows
    that repeat it the one of the least text. Texts without words and null ids link with nothing."""
    text_batches(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no window of ten benchmark words occurs; an item of fewer words is one window,
    and null texts and items have none."""
    text_batches(spark)
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that a mixture of 80 hundredths of all tokens uses; of ties in a leaf's order, hashes of
    ids, the shorter text comes first. Texts without words use nothing and stay."""
    text_batches(spark)
    return mixed_documents(docs, share=80)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's place, length and checksum in the token files; null ids come first, rows that
    repeat an id follow each other by text, and a null text is an end id alone."""
    text_batches(spark)
    return read_token_files(write_token_files(docs, default_tokenizer()))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_ids", token_ids)]

#: SQL has no expression for the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path, before = table(spark, sf_dir, "documents"), None, spark.conf.get(BATCH)
    try:
        for name, stage in STAGES[:-1]:
            old = path
            docs, path = staged(stage(spark, docs, sf_dir), name)
            if old:
                drop_staged(spark, old)
        out = STAGES[-1][1](spark, docs, sf_dir)
        drop_staged(spark, path)  # the token files are written, and nothing else is read from here on
    finally:
        spark.conf.set(BATCH, before)
    return out
