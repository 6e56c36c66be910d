"""Shared helpers: durable intermediate tables, batches of bounded bytes, words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from textlake.sources.tables import new_path

#: ``[^\x20\x09-\x0D]+``: the words of every operator here.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Bytes of one slice of an Arrow batch that becomes Python objects at once.
SLICE_BYTES = 4 << 20
#: Rows of one file of a narrow table, and of a table with texts.
NARROW_ROWS, TEXT_ROWS = 400_000, 8_000
_PATH = "_textlake_path"


def materialize(df: DataFrame, name: str, most: int | None = None, rows: int = NARROW_ROWS) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    The table cuts the lineage, outlives lost executors and has a size in bytes that the planner
    knows, so it alone decides which side of a later join is small enough to broadcast.  Where the
    caller knows that there are at most ``most`` rows, they are written in files of about ``rows``, so
    small tables don't become as many files as there are shuffle partitions.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if most is not None:
        df = df.coalesce(1 + most // rows)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__[_PATH] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes materialized tables.  Call it only when all that reads them has been written."""
    for t in tables:
        if path := t.__dict__.pop(_PATH, None):
            remove(t.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: A side of a join that holds at most so many bytes, measured, is broadcast.
BROADCAST_BYTES = 16 << 20


def _width(kind: DataType) -> int:
    return sum(_width(f.dataType) for f in kind.fields) if isinstance(kind, StructType) else 16


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a materialized table for broadcast if its rows, their texts and lists measured, hold at
    most ``limit`` bytes; else the join is shuffled.  For sides that stay far smaller than the other."""
    size = F.lit(16 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        if isinstance(f.dataType, (StringType, BinaryType)):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, ArrayType):
            size = size + F.coalesce(F.size(f.name), F.lit(0)) * _width(f.dataType.elementType)
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= limit else df


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes, one row at least."""
    for batch in batches:
        rows = max(1, batch.num_rows * limit // max(1, batch.nbytes))
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            if part.num_rows > 1 and part.nbytes > 4 * limit:  # a few long rows among short ones
                yield from (part.slice(i, 1) for i in range(part.num_rows))
            else:
                yield part


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc32_of(column: Column, modulus: int) -> Column:
    return F.crc32(column.cast("string")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have in any letter case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
