"""Helpers shared by the document operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word of every contract: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one only in local mode, where none is named, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pointloom-"))
        named = sc.getCheckpointDir()
    return f"{named.rstrip('/')}/pointloom-{sc.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it again. It goes when the application ends."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    # snappy would take direct memory for each column of each task, higher levels of zstd larger windows outside the heap
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", 1).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table from stored() that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def own(df: DataFrame, name: str) -> Column:
    """A column of ``df`` by its exact name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def nested(df: DataFrame, *needed: str) -> DataFrame:
    """``df`` with all its columns in one, ``row``, and beside it those that are needed, so that no name clashes with a helper's; ``row.*`` brings them back."""
    return df.select(F.struct(*[own(df, c) for c in df.columns]).alias("row"), *[own(df, c) for c in needed])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to so many rows, so that a worker's results stay small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run meanwhile send Python workers so many rows at once at most: executors hold whole batches outside the heap, workers hold them again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows if int(before) <= 0 else min(rows, int(before)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def crc_rest(column, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("null"))) % modulus


def word_count(column):
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")
