"""Helpers shared by the text operators: inputs, durable intermediates, row-batch plumbing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..storage import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._krylite_path = path
    return out


def materialize_kinds(df: DataFrame, kind: str, columns: dict[int, list[str]], name: str) -> dict[int, DataFrame]:
    """Rows of several kinds from one pass, each kind written to a folder of its own with the columns it has."""
    from pyspark.sql.types import StructType

    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(kind).parquet(path)
    out = {}
    for k, names in columns.items():
        at = f"{path}/{kind}={k}"
        schema = StructType([df.schema[c] for c in names])
        there = spark._jvm.org.apache.hadoop.fs.Path(at)
        if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            out[k] = spark.read.schema(schema).parquet(at)
            out[k]._krylite_path = at
        else:
            out[k] = spark.createDataFrame([], schema)
    return out


def release(df: DataFrame | None) -> None:
    """Delete what materialize() wrote once nothing reads it any more."""
    path = getattr(df, "_krylite_path", None)
    if path:
        remove(df.sparkSession, path)


def parts_of(batches: Iterator[pa.RecordBatch], at: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about `most` bytes of text (column `at`) at a time, and at least one row."""
    for batch in batches:
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(at)), 0).cast(pa.int64())).to_numpy()
        start = 0
        while start < len(ends):
            before = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def sliced(batches: Iterator[pa.RecordBatch], at: int, most: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The same with the texts (null as empty): only so much text is in Python at once."""
    for part in parts_of(batches, at, most):
        yield part, [t or "" for t in part.column(at).to_pylist()]


def slices(texts: list[str], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about `most` characters each, at least one text a range."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def map_texts(df: DataFrame, keys: list[str], text: str, schema: str, work: Callable[[list[str]], list[list]]) -> DataFrame:
    """Select keys and one text column, and append the columns that `work` computes for lists of texts.

    Null texts reach `work` as empty strings. Other columns of `df` are dropped before Python sees the rows.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    narrow = df.select(*[F.col(k) for k in keys], F.col(text).alias("__text"))
    made = StructType.fromDDL(schema)
    out = StructType([narrow.schema[k] for k in keys] + made.fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in sliced(batches, len(keys)):
            arrays = [rows.column(i).cast(arrow.field(i).type) for i in range(len(keys))]
            arrays += [pa.array(c, type=arrow.field(len(keys) + i).type) for i, c in enumerate(work(texts))]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return narrow.mapInArrow(run, out)


def map_rows(df: DataFrame, text: str, work: Callable[[pa.RecordBatch, list[str]], pa.RecordBatch]) -> DataFrame:
    """Whole rows through `work`, which gets slices of rows with their texts (null as empty) and returns rows alike."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in sliced(batches, at):
            yield work(rows, texts)

    return df.mapInArrow(run, df.schema)


def bitmap(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """A bitmap of hashed keys, in pieces of 32,768 bits: at most 2 ** bits / 8 bytes, however many keys there are."""
    from pyspark.sql import functions as F

    at = keys.select((F.pmod(F.xxhash64(key), F.lit(1 << bits)) + 1).alias("__h"))
    return at.groupBy(F.bitmap_bucket_number("__h").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__h")).alias("__bitmap"))


def maybe_in(df: DataFrame, key: str, bits: DataFrame, width: int) -> DataFrame:
    """Rows whose key may be in a bitmap of `width` bits: those in it stay, few others do. The bitmap's size is fixed, so
    it is broadcast."""
    from pyspark.sql import functions as F

    rows = df.withColumn("__h", F.pmod(F.xxhash64(key), F.lit(1 << width)) + 1).withColumn("__bucket", F.bitmap_bucket_number("__h")).withColumn("__at", F.bitmap_bit_position("__h"))
    found = rows.join(F.broadcast(bits), "__bucket")
    byte = F.conv(F.hex(F.substring("__bitmap", (F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return found.where(F.call_function("getbit", byte, (F.col("__at") % 8).cast("int")) == 1).select(df.columns)


#: Bits of the largest bitmap that thins out rows ahead of a shuffle: 16 MB.
MOST_BITS = 27
#: Rows up to which a narrow table is broadcast: some megabytes.
FEW_ROWS = 100_000


def thinned(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of `df` whose key is in the (written) table `keys`, and a few others: the bitmap has 16 bits for each key, up
    to MOST_BITS bits; with more keys than that, more others stay."""
    width = max(15, min(MOST_BITS, (16 * keys.count()).bit_length()))
    return maybe_in(df, key, bitmap(keys, key, width), width)


def small(df: DataFrame, rows: int, most: int = FEW_ROWS) -> DataFrame:
    """A narrow table of so many rows, to be broadcast if they are few, and joined by a sort if not."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if rows <= most else df.hint("merge")
