"""Conflict-constrained best-fit packing of documents into fixed-size bins.

Bins are kept in order of their free space and carry two bitmaps: the sources and the duplicate clusters they hold. A
document goes to the fullest bin that has room and shares neither with it: the search starts at the smallest sufficient
free space and walks to its successors until a compatible bin is found; without one, a bin is opened. Documents longer
than a bin are cut into whole-bin pieces, which fill bins of their own, and a rest, which is packed.

Documents are dealt at random into packing groups of bounded size, so a hot source, a large cluster or a row that repeats
very often is spread evenly, no group grows with the data, and only ids and lengths move.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a packing group holds on average.
GROUP_ROWS = 4096


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """The bin of each (length, source, cluster); lengths are at most the capacity, -1 stands for no source or cluster."""
    order = sorted(range(len(items)), key=lambda i: (-items[i][0], i))
    bins = [0] * len(items)
    free: list[tuple[int, int]] = []  # (free space, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    for i in order:
        length, source, cluster = items[i]
        s = 1 << source if source >= 0 else 0
        c = 1 << cluster if cluster >= 0 else 0
        at = bisect_left(free, (length, -1))
        while at < len(free) and (sources[b := free[at][1]] & s or clusters[b] & c):
            at += 1
        if at < len(free):
            room, b = free.pop(at)
        else:
            room, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        bins[i] = b
        sources[b] |= s
        clusters[b] |= c
        if room > length:
            insort(free, (room - length, b))
    return bins


def numbers(values: list, once: bool) -> list[int]:
    """Small numbers for values; -1 for null and, if `once`, for values that occur only once and so conflict with none."""
    count: dict = defaultdict(int)
    for v in values:
        count[v] += 1
    known: dict = {}
    return [-1 if v is None or once and count[v] == 1 else known.setdefault(v, len(known)) for v in values]


def pack(df: DataFrame, capacity: int, key: str = "doc_id", length: str = "length", source: str = "source", cluster: str = "cluster", group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: key, piece (from 0), start, length, bin_id, and the bin's fill.

    No bin holds two pieces of the same source or of the same cluster, except the rest of a cut document, which counts
    as its document; null sources and clusters conflict with nothing. A null length counts as 0; rows of length 0 get a
    piece of length 0. Rows that repeat a key are packed each for itself; ties go by row order within a group, which
    is sorted by key and length first. An empty table gives no rows; other columns are ignored.
    """
    if capacity < 1 or group_rows < 1:
        raise ValueError("capacity and group_rows must be positive")
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("__key"), F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0)).alias("__len"), F.col(source).cast("string").alias("__source"), F.xxhash64(F.col(cluster).cast("string")).alias("__hash"), F.col(cluster).isNull().alias("__alone"))
    n = df.count()
    groups = max(1, -(-n // group_rows))
    # rows alike are told apart by a number, so that they don't all fall into one group
    told = rows.groupBy(*rows.columns).agg(F.count("*").alias("__n")).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).drop("__n")
    dealt = told.withColumn("__group", F.pmod(F.xxhash64(F.col("__key").cast("string"), "__len", "__source", "__hash", "__copy"), F.lit(groups))).drop("__copy")
    kind = rows.schema["__key"].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, bin_id long, bin_fill long"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tasks' rows come sorted by group; one group is in memory at a time."""
        held, number = [], None
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if number is not None and row[5] != number:
                    yield emit(held, number)
                    held = []
                number = row[5]
                held.append(row)
        if held:
            yield emit(held, number)

    def emit(held: list, group: int) -> pa.RecordBatch:
        whole, items = [], []
        src, clu = numbers([r[2] for r in held], False), numbers([None if r[4] else r[3] for r in held], True)
        for i, (_, size, *_rest) in enumerate(held):
            full = (size - 1) // capacity if size else 0
            whole += [(i, p) for p in range(full)]
            items.append((size - full * capacity, src[i], clu[i]))
        bins = best_fit(items, capacity)
        fill: dict[int, int] = defaultdict(int)
        for (size, _, _), b in zip(items, bins, strict=True):
            fill[b] += size
        base = group << 32
        out = [(held[i][0], p, p * capacity, capacity, base + len(held) + j, capacity) for j, (i, p) in enumerate(whole)]
        for i, ((size, _, _), b) in enumerate(zip(items, bins, strict=True)):
            p = (held[i][1] - size) // capacity
            out.append((held[i][0], p, p * capacity, size, base + b, fill[b]))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    parts = min(groups, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sorted_rows = dealt.repartition(parts, "__group").sortWithinPartitions("__group", "__key", "__len", "__source", "__hash")
    return sorted_rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """The bin of every document, or of every piece of one that is longer than a bin."""
    from .common import table

    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame, capacity: int = 16_384) -> DataFrame:
    """Pack whole documents by UTF-8 bytes; copies (equal apart from case and white space at the ends) form clusters."""
    same = F.xxhash64(F.lower(F.trim(F.col("text"))))
    rows = docs.select("doc_id", F.octet_length("text").alias("length"), "source", F.when(F.length(F.trim(F.col("text"))) > 0, same).alias("cluster"))
    return pack(rows, capacity)
