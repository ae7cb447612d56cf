"""Helpers that the operators of this subpackage share.

Every operator packs its input's columns into one struct and selects what it
needs beside it, so extra columns with clashing names do no harm.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir, ship_package
from tidemark.sources.snapshots import _file_system

#: The white space that separates words in every contract here.
WHITE = "\\x20\\x09-\\x0D"
#: A word as a Java, Python and DuckDB regular expression.
WORD = f"[^{WHITE}]+"

#: Rows and bytes that go to a Python worker at once; long texts make small batches.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df, written to the shared folder as Parquet and read again.

    This cuts the lineage like a reliable checkpoint: a lost executor costs no
    recomputation. In difference to a checkpoint, the files have a size that the
    planner sees, so joins are broadcast only when the table proves to be small. The
    folder goes when the driver ends, or before by discard().
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/staged-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(at)
    fs, place = _file_system(spark, at)
    fs.deleteOnExit(place)
    found = spark.read.schema(df.schema).parquet(at)
    found._staged_at = at
    return found


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that no plan will read any more."""
    for df in tables:
        fs, place = _file_system(df.sparkSession, df._staged_at)
        fs.delete(place, True)


def bounded_batches(spark: SparkSession) -> None:
    """Before Python runs: give workers the package, and bound what one holds at once, by rows and by bytes.

    A plan takes these two settings when it runs, after the operator has returned its
    frame, so they stay with the session. Values that the user has set lower are kept.
    """
    ship_package(spark)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame) -> Column:
    """All columns of docs as one struct, named _row."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row")


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def fold(key: Column) -> Column:
    """crc32 of an id as text, modulo 5; rows with 0 are held out of all learning."""
    return F.crc32(key.cast("string")) % 5


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files are; PUBLIC_TOKENIZERS overrides it."""
    at = os.environ.get("PUBLIC_TOKENIZERS")
    if at:
        return os.path.join(at, name)
    import public_tokenizers

    return public_tokenizers.path(name)
