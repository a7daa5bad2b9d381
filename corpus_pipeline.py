"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage
returns as Parquet in the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import langid, linededup, mixing, nearcopies, simhash, spm
from pointloom.llm.common import crc_rest, own, read, stored
from pointloom.llm.queries import TOKENIZER

#: Rows that executors hold at once of what they read and of what they send Python workers: the defaults, 4,096 and 10,000, are 10 and 20 MB of texts for each task and buffer.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": 500, "spark.sql.execution.arrow.maxRecordsPerBatch": 500}


def _bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with the session's batches held to BATCHES from then on: what it returns is worked out after it."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, most in BATCHES.items():
            now = int(spark.conf.get(name))
            spark.conf.set(name, min(now, most) if now > 0 else most)
        return stage(spark, docs, sf_dir)

    return run_stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that the model knows, or without one that prevails, go.

    Null, empty and blank texts have none. Repeated rows stay or go together. An empty table gives no row.
    """
    model = langid.train(docs.where(crc_rest(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang"))
    return langid.keep_identified(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines seen before go; n_chars follows the text, null for a null text.

    Every row stays, with an empty text if all its lines go; rows that repeat id and text lose
    the same lines. See linededup.line_dedup(). An empty table gives no row.
    """
    cut = linededup.line_dedup(docs)
    return cut.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else own(cut, c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the smallest id.

    Near are texts with almost equal fingerprints, or with a similarity of 0.8 over five-word
    shingles: see nearcopies.near_groups(). Null, empty and blank texts are one group; of rows
    that repeat the id one stays; rows without an id stay. See simhash.one_of_each(). An empty
    table gives no row.
    """
    return simhash.one_of_each(docs, nearcopies.near_groups(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights; a document is repeated as often as its rate says.

    A null source is a source. Rows that repeat an id, or have none, share a coin. Sources
    without a word give no row. See mixing.mix(). An empty table gives no row.
    """
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and whether they decode to its text.

    Every row has a row: of a null text with null ids, of an empty one with none. Texts of any
    length have the ids of the whole text. An empty table gives no row.
    """
    model = spm.load(spark, TOKENIZER)
    return spm.tokenised(docs, model)


STAGES = [(stage.__name__, _bounded(stage)) for stage in (language, lines, near_copies, mixture, tokens)]

#: Language models, fingerprints and token lattices are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
