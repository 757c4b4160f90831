"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments of nearly equal width, about the logarithm of the number of codes, and every code is listed
under the value of each of its segments. A query looks up its own segment values, then all values at distance 1 from
them, and so on. After all m segments have been searched to radius r, every code within Hamming distance
m * (r + 1) - 1 has been met, since a code further than r in each segment differs in m * (r + 1) bits at least; each
segment searched one further adds 1. A query searches no more segments than cover its kth distance so far (ties
included), and leaves when that is covered, so the answer is exact.

The lists are dealt by segment and by the first bits of the value into parts, each written once as packed arrays in the
order of the values. In each round a part gets the queries with a value to look up in it, as codes: the values are formed
next to the lists, so they are never rows of a table. Only codes within the kth distance so far come back. Parts with more
codes than others are cut by a hash.

Equal codes are one class, with the k + 1 smallest ids, as only those can be among the k nearest of anything. A code is
met once: at the first of its segments that is nearest to the query's. Where the values to look up would outnumber the
codes, the queries that are left (in practice those of tables with few codes) are compared with all codes in blocks.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, release

#: Widest segment; values are numbers of so many bits.
WIDEST = 32
#: Values that a query looks up in a segment at a radius, at most; beyond that all codes are compared.
MOST_FLIPS = 200_000
#: Codes of a part, about, and queries that meet a part in one task, about.
PART_CODES, PART_QUERIES = 1 << 20, 1 << 20
#: Codes that are compared at a time.
AT_ONCE = 1 << 19
#: Widest rest of a value for which a part has an array of places; wider ones are searched for.
PLACES = 21
#: Codes and queries of a block where all are compared.
BLOCK_CODES, BLOCK_QUERIES = 65_536, 1024
#: Further than anything.
FAR = 1 << 30


def sign_codes(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key and code (binary, one bit per component, set where it is positive); null vectors and null keys are left out.

    Null and non-finite components count as not positive.
    """
    bits = F.transform(F.col(vector), lambda x: F.when((x > 0) & (x < float("inf")), "1").otherwise("0"))
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, F.array_join(bits, "").alias("bits"))


@lru_cache(maxsize=64)
def masks(width: int, radius: int) -> np.ndarray:
    """The numbers of so many bits with `radius` bits set."""
    if radius > width:
        return np.empty(0, np.int64)
    return np.array([sum(1 << i for i in c) for c in combinations(range(width), radius)], np.int64)


def segments(width: int, w: int) -> list[tuple[int, int]]:
    """First bit and width of each segment of a code: as few as are at most w wide, the wider ones first."""
    m = max(1, -(-width // w))
    return [(i * (width // m) + min(i, width % m), width // m + (i < width % m)) for i in range(m)]


def classes_of(rows: DataFrame, key: str, most: int) -> DataFrame:
    """bits, width, words (64 bits each, the last filled up with 0), ids (the `most` smallest) and rep (the smallest) of
    each different code."""
    ids = rows.select("bits", F.col(key).cast("long").alias("id")).distinct()
    first = ids.withColumn("__rank", F.row_number().over(W.partitionBy("bits").orderBy("id"))).where(F.col("__rank") <= most)
    got = first.groupBy("bits").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    last = F.greatest(F.ceil(F.length("bits") / 64).cast("int"), F.lit(1)) - 1
    word = lambda i: F.conv(F.rpad(F.substring(F.col("bits"), i * 64 + 1, F.lit(64)), 64, "0"), 2, -10).cast("long")
    return got.select("bits", F.length("bits").alias("width"), F.transform(F.sequence(F.lit(0), last), word).alias("words"), "ids", F.col("ids")[0].alias("rep"))


def by_segment(classes: DataFrame, w: int, first_bits: int) -> DataFrame:
    """The classes once for each segment, with the first bits of its value, as a number (prefix)."""
    m = F.greatest(F.ceil(F.col("width") / w).cast("int"), F.lit(1))
    rows = classes.withColumn("m", m).withColumn("segment", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    each, more = F.floor(F.col("width") / F.col("m")).cast("int"), F.col("width") % F.col("m")
    begin = F.col("segment") * each + F.least("segment", more)
    some = F.least(F.lit(first_bits), each + (F.col("segment") < more).cast("int"))
    return rows.withColumn("prefix", F.coalesce(F.conv(F.substring("bits", begin + 1, some), 2, 10).cast("long"), F.lit(0)))


def words_of(column: pa.ChunkedArray) -> np.ndarray:
    """Codes as rows of 64-bit words."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(column), -1)


def cut(words: np.ndarray, begin: int, width: int) -> np.ndarray:
    """So many bits of each code (63 at most) as a number."""
    if not width:
        return np.zeros(len(words), np.int64)
    word, at = divmod(begin, 64)
    here = min(width, 64 - at)
    got = (words[:, word] >> np.uint64(64 - at - here)) & np.uint64((1 << here) - 1)
    if here < width:
        got = (got << np.uint64(width - here)) | (words[:, word + 1] >> np.uint64(64 - width + here))
    return got.astype(np.int64)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which rows of words differ."""
    if a.shape[-1] == 1:
        return np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int32)
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


def nearest_few(query: np.ndarray, distance: np.ndarray, other: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` nearest rows of each query, by query, distance and id."""
    order = np.lexsort((other, distance, query))
    q = query[order]
    begin = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
    return order[rank < most]


def lists(classes: DataFrame, n_codes: int, w: int) -> tuple[DataFrame, DataFrame, int]:
    """The codes by segment and value: a packed row for each part; the parts; and how many first bits they go by."""
    first_bits = max(0, ceil(log2(max(1, n_codes / PART_CODES))))
    rows = by_segment(classes, w, first_bits)
    where = ["width", "segment", "prefix"]
    sizes = rows.groupBy(*where).count().withColumn("subs", F.ceil(F.col("count") / (2 * PART_CODES)).cast("int"))
    each = sizes.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    # some thousands of rows: numbering them in one task is nothing
    parts = materialize(each.withColumn("part", F.row_number().over(W.orderBy(*where, "sub"))).select(*where, "subs", "sub", "part"), "ham-parts")
    sub = F.pmod(F.xxhash64("words"), F.col("subs")).cast("int")
    dealt = rows.select(*where, "words", "rep", F.size("ids").alias("n")).join(F.broadcast(parts), where).where(F.col("sub") == sub)

    def pack(t: pa.Table) -> pa.Table:
        part, width, j, prefix = (t[c][0].as_py() for c in ("part", *where))
        words = words_of(t["words"])
        order = np.argsort(cut(words, *segments(width, w)[j]), kind="stable")
        data = [words[order], t["rep"].to_numpy()[order], t["n"].to_numpy()[order].astype(np.int32)]
        heads = [pa.array([x], t) for x, t in ((part, pa.int32()), (width, pa.int32()), (j, pa.int32()), (prefix, pa.int64()))]
        return pa.Table.from_arrays([*heads, *(pa.array([x.tobytes()], pa.binary()) for x in data)], ["part", *where, "words", "reps", "ns"])

    packed = dealt.select("part", *where, "words", "rep", "n").groupBy("part").applyInArrow(pack, "part int, width int, segment int, prefix long, words binary, reps binary, ns binary")
    return materialize(packed, "ham-index"), parts, first_bits


def looked_up(index: DataFrame, asks: DataFrame, blocks: int, tasks: int, w: int, first_bits: int, radius: int, k: int) -> DataFrame:
    """rep, width, other, distance, n: codes that the queries meet at this radius, where they may be among the nearest."""
    out = pa.schema([("rep", pa.int64()), ("width", pa.int32()), ("other", pa.int64()), ("distance", pa.int32()), ("n", pa.int32())])

    def search(part: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(part) or not len(asked):
            return out.empty_table()
        width, j, prefix = (part[c][0].as_py() for c in ("width", "segment", "prefix"))
        cuts = segments(width, w)
        begin, wide = cuts[j]
        low = wide - min(first_bits, wide)
        words = np.frombuffer(part["words"][0].as_py(), np.uint64).reshape(-1, max(1, -(-width // 64)))
        reps, ns = np.frombuffer(part["reps"][0].as_py(), np.int64), np.frombuffer(part["ns"][0].as_py(), np.int32)
        own = cut(words, begin + wide - low, low)
        place = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=1 << low))]) if low <= PLACES else None
        mine, who, most = words_of(asked["words"]), asked["rep"].to_numpy(), asked["most"].to_numpy().copy()
        further = np.bitwise_count(cut(mine, begin, wide - low) ^ np.int64(prefix))
        value = cut(mine, begin + wide - low, low)
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))]

        def meet(query: np.ndarray, at: np.ndarray) -> None:
            d = apart(words[at], mine[query])
            near = np.flatnonzero(d <= most[query])
            query, at, d = query[near], at[near], d[near]
            # met before: at a smaller radius, or at this one in an earlier segment
            new = np.ones(len(query), bool)
            for i, (b, x) in enumerate(cuts):
                if i != j:
                    new &= np.bitwise_count(cut(words[at], b, x) ^ cut(mine[query], b, x)) >= radius + (i < j)
            query, at, d = query[new], at[new], d[new]
            few = nearest_few(query, d, reps[at], k + 1)
            query, at, d = query[few], at[few], d[few]
            kept.append((query, at, d))
            # k + 1 codes at hand: nothing further than the last of them counts
            full, count = np.unique(query, return_counts=True)
            last = np.cumsum(count) - 1
            full, last = full[count > k], last[count > k]
            most[full] = np.minimum(most[full], d[last])

        for h in np.unique(further).tolist():
            flips = masks(low, radius - h) if h <= radius else masks(low, low + 1)
            of = np.flatnonzero(further == h)
            for lo in range(0, len(of) if len(flips) else 0, step := max(1, AT_ONCE // max(1, len(flips)))):
                some = of[lo : lo + step]
                values = (value[some, None] ^ flips[None]).ravel()
                if place is None:
                    first, end = np.searchsorted(own, values, "left"), np.searchsorted(own, values, "right")
                else:
                    first, end = place[values], place[values + 1]
                hit = np.flatnonzero(end > first)
                first, size, query = first[hit], (end - first)[hit], some[hit // len(flips)]
                total = np.cumsum(size)
                a = 0
                while a < len(hit):
                    before = int(total[a - 1]) if a else 0
                    z = max(a + 1, int(np.searchsorted(total, before + AT_ONCE, "right")))
                    run = size[a:z]
                    at = np.repeat(first[a:z] - (total[a:z] - run - before), run) + np.arange(int(total[z - 1]) - before)
                    meet(np.repeat(query[a:z], run), at)
                    a = z
        query, at, d = (np.concatenate(x) for x in zip(*kept, strict=True))
        few = nearest_few(query, d, reps[at], k + 1)
        query, at, d = query[few], at[few], d[few]
        return pa.Table.from_arrays([pa.array(who[query]), pa.array(np.full(len(query), width, np.int32)), pa.array(reps[at]), pa.array(d), pa.array(ns[at])], schema=out)

    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(tasks, "part", "block")
    asks = asks.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")).repartition(tasks, "part", "block")
    return held.groupBy("part", "block").cogroup(asks.groupBy("part", "block")).applyInArrow(search, "rep long, width int, other long, distance int, n int")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """Of rows (rep, other, distance, n) the nearest k + 1 codes of each query: no other holds one of its nearest ids."""
    nearest = W.partitionBy("rep", "width").orderBy("distance", "other")
    return found.withColumn("__rank", F.row_number().over(nearest)).where(F.col("__rank") <= k + 1).drop("__rank")


def compared(active: DataFrame, classes: DataFrame, n_codes: int, n_queries: int, k: int) -> DataFrame:
    """rep, other, distance, n: the nearest codes of each query by blocks of codes and of queries."""
    blocks, qblocks = max(1, -(-n_codes // BLOCK_CODES)), max(1, -(-n_queries // BLOCK_QUERIES))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    h = F.xxhash64("rep", "width")
    held = classes.select("width", F.pmod(h, F.lit(blocks)).cast("int").alias("block"), spread(qblocks).alias("qblock"), F.lit(False).alias("asks"), "rep", "words", F.size("ids").alias("n"))
    asks = active.select("width", spread(blocks).alias("block"), F.pmod(h, F.lit(qblocks)).cast("int").alias("qblock"), F.lit(True).alias("asks"), "rep", "words", F.lit(0).alias("n"))
    out = pa.schema([("rep", pa.int64()), ("width", pa.int32()), ("other", pa.int64()), ("distance", pa.int32()), ("n", pa.int32())])

    def compare(t: pa.Table) -> pa.Table:
        asks = t["asks"].to_numpy(zero_copy_only=False)
        code = words_of(t["words"])
        rep, n = t["rep"].to_numpy(), t["n"].to_numpy()
        mine, ids, size = code[~asks], rep[~asks], n[~asks]
        cols: list[list] = [[], [], [], []]
        for q, c in zip(rep[asks].tolist(), code[asks], strict=True):
            d = apart(mine, c[None])
            at = np.lexsort((ids, d))[: k + 1]
            cols[0] += [q] * len(at)
            for x, y in zip(cols[1:], (ids, d, size), strict=True):
                x += y[at].tolist()
        width = pa.array(np.full(len(cols[0]), t["width"][0].as_py()), pa.int32())
        arrays = [pa.array(cols[0], pa.int64()), width, pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())]
        return pa.Table.from_arrays(arrays, schema=out)

    found = held.unionByName(asks).groupBy("width", "block", "qblock").applyInArrow(compare, "rep long, width int, other long, distance int, n int")
    return best_of(found, k)


def nearest(codes: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", width: int | None = None) -> DataFrame:
    """query_id, neighbour_id, distance, rank (1 to k) for each query; a query never finds the row of its own id.

    `codes` and `queries` hold key (long) and bits (string of 0 and 1). Codes of another length than a query's are no
    neighbours of it. Ties go to the smaller id. Fewer than k rows come out only where fewer candidates exist; empty
    inputs give an empty result. Ids are taken as distinct; rows that repeat count once; null ids and codes are left out.
    `width` is the most bits of a segment, by default log2 of the number of codes.
    """
    rows = codes.where(F.col(key).isNotNull() & F.col("bits").isNotNull())
    classes = materialize(classes_of(rows, key, k + 1), "ham-classes")
    n_codes = classes.count()
    w = width or int(np.clip(round(np.log2(max(2, n_codes))), 1, WIDEST))
    asked = queries.where(F.col(key).isNotNull() & F.col("bits").isNotNull()).select(F.col(key).cast("long").alias("query_id"), "bits").distinct()
    wanted = materialize(classes_of(asked.withColumnRenamed("query_id", key), key, 1), "ham-queries")  # rep stands for the query's code
    index, parts, first_bits = lists(classes, n_codes, w)
    n_parts = parts.count()
    cores = codes.sparkSession.sparkContext.defaultParallelism
    # `most`: the kth distance so far
    best, active, radius = None, wanted.withColumn("most", F.lit(FAR)), 0
    widest = max((segments(r.width, w)[0][1] for r in parts.select("width").distinct().collect()), default=0)
    m = F.greatest(F.ceil(F.col("width") / w).cast("int"), F.lit(1))
    while (left := active.count()) and radius <= widest:
        if comb(widest, radius) > min(MOST_FLIPS, max(1, n_codes)):
            rest = materialize(compared(active, classes, n_codes, left, k), "ham-best")
            done = best.join(active.select("rep", "width"), ["rep", "width"], "left_anti") if best is not None else None
            best = rest if done is None else rest.unionByName(done.select(rest.columns))
            break
        # segments that are still to be searched this far, and the parts with values this near
        each = by_segment(active, w, first_bits).where(F.col("segment") <= F.col("most") - m * radius)
        each = each.select("width", "segment", F.col("prefix").alias("__prefix"), "words", "rep", "most")
        near = F.bit_count(F.col("__prefix").bitwiseXOR(F.col("prefix"))) <= radius
        asks = each.join(F.broadcast(parts), ["width", "segment"]).where(near).select("part", "words", "rep", "most")
        blocks = -(-left // PART_QUERIES)
        found = looked_up(index, asks, blocks, max(1, min(n_parts * blocks, 4 * cores)), w, first_bits, radius, k)
        known = found if best is None else found.unionByName(best)
        best = materialize(best_of(known, k), "ham-best")
        radius += 1
        # all codes within m * radius - 1 have been met, or within the kth distance
        upto = F.sum("n").over(W.partitionBy("rep", "width").orderBy("distance", "other"))
        kth = best.withColumn("__upto", upto).where(F.col("__upto") > k).groupBy("rep", "width").agg(F.min("distance").alias("most"))
        active = active.drop("most").join(kth, ["rep", "width"], "left").withColumn("most", F.coalesce("most", F.lit(FAR)))
        active = materialize(active.where(F.col("most") >= m * radius), "ham-active")
    if best is None:
        return queries.sparkSession.createDataFrame([], "query_id long, neighbour_id long, distance int, rank int")
    listed = best.select(F.col("rep").alias("asked"), "width", "distance", F.col("other").alias("rep")).join(classes.select("rep", "width", "ids"), ["rep", "width"])
    near = listed.select("asked", "width", "distance", F.explode("ids").alias("neighbour_id"))
    of_query = asked.join(wanted.select("bits", "width", F.col("rep").alias("asked")), "bits").select("query_id", "asked", "width")
    rows = of_query.join(near, ["asked", "width"]).where(F.col("query_id") != F.col("neighbour_id"))
    rows = rows.groupBy("query_id", "neighbour_id").agg(F.min("distance").alias("distance"))
    order = W.partitionBy("query_id").orderBy("distance", "neighbour_id")
    release(index)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def op7_hamming_topk(spark, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every vector whose id is divisible by 50, against all vectors."""
    from .common import table

    codes = sign_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(codes, codes.where(F.col("vec_id") % 50 == 0), 10)
