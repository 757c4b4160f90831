"""N-gram Jaccard join with vertical partitioning.

A global order of n-grams, frequent ones last, is cut into fragments. Candidate pairs share n-grams of their prefixes in
that order; their overlap is counted fragment by fragment, apart from one another, and summed per pair. Texts with the
same set of n-grams are one class and compared once.

Prefixes are half as long again as one common n-gram needs, so that a set that links with any other has several n-grams
of its prefix in common with other sets. A set with fewer links with nothing and is left out before pairs are formed:
that is most sets, also of those with a passage in common. Before texts are read again, the sizes of a pair's ranges of
fingerprints bound its overlap from above: the smaller one of each range, summed. Pairs under the bound go.

The result is whole without listing all pairs of a group of near copies. First every class is compared with one hub of
each of its prefix n-grams; that joins most of a group. Then every prefix n-gram that still has classes of different
components gives the pairs between different components whose first common n-gram it may be: those with enough n-grams
left from there on. They are compared as well. A pair that is never compared lies within one component, or has too few
n-grams behind its first common one and so can't reach the threshold.

N-grams and their sets are compared by 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, materialize_kinds, parts_of, release, small, thinned
from .components import components

#: Buckets of the n-gram frequency table: a fixed size, whatever the corpus.
BUCKET_BITS = 22
#: N-grams met fewer times than this in repeats aren't set back in the order.
FREQUENT = 16
#: Ranges of fingerprints whose sizes are kept for every set.
RANGES = 64
#: N-grams that a task counts at a time.
COUNT_ROWS = 2_000_000
#: Sets that are compared with one copy of their hub's fragments.
MEMBERS = 256
#: Bytes of text that are cut into words at a time.
SLICE = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Fingerprints of words, from the bytes of many texts at once: sums of mixed random numbers, one for each byte and
    its place in the word. Sums of powers won't do: modulo 2 ** 64 they are alike for some long words of two letters."""

    def __init__(self) -> None:
        rng = np.random.default_rng(20_240_229)
        self.of_byte = rng.integers(0, 1 << 64, 256, np.uint64)
        self.of_byte[65:91] = self.of_byte[97:123]  # A-Z as a-z
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True

    def cut(self, data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of texts that lie one after another: their fingerprints, and before which word each text begins.
        `start` has the texts' first places, and the length of all."""
        n = len(data)
        if n == 0:
            return np.empty(0, np.uint64), np.zeros(len(start), np.int64)
        gap = np.empty(n + 1, bool)
        white = self.space[data]
        gap[1:], gap[0] = white, True
        edge = gap.copy()
        edge[start] = True  # a word ends with its text
        first = np.flatnonzero(~white & edge[:-1])
        last = np.flatnonzero(~white & np.append(white[1:] | edge[1:-1], True)) + 1
        length = last - first
        end = np.cumsum(length)
        inside = data[~white]
        place = np.arange(len(inside)) - np.repeat(end - length, length)
        total = np.zeros(len(inside) + 1, np.uint64)
        np.cumsum(mix(self.of_byte[inside] + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), out=total[1:])
        h = total[end] - total[end - length]
        return mix(h + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.searchsorted(first, start)


_words: list[Words] = []


def shingle_sets(texts: pa.Array, n: int = 3) -> list[np.ndarray]:
    """Sorted distinct n-gram fingerprints (unsigned 64 bits) of each text: A-Z lower-cased, words split at ASCII white
    space; a text of fewer words gives its whole sequence as one, one without words (or null) gives none."""
    if not _words:
        _words.append(Words())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, places, data = texts.buffers()
    start = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[start[0] : start[-1]] if data is not None else np.empty(0, np.uint8)
    out = []
    with np.errstate(over="ignore"):
        flat, at = _words[0].cut(data, start - start[0])
        total = np.zeros(len(flat), np.uint64)
        for j in range(min(n, len(flat))):
            total[: len(flat) - j] = mix(total[: len(flat) - j] * np.uint64(0x9E3779B97F4A7C15) + flat[j:] + np.uint64(j + 1))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            k = b - a
            if k >= n:
                s = np.sort(total[a : b - n + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif k:
                h = np.uint64(k)
                for w in flat[a:b]:
                    h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w)
                out.append(np.array([h], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def batches_of_sets(batches: Iterator[pa.RecordBatch], n: int):
    """Keys and n-gram sets of consecutive rows (key, text), a bounded amount of text at a time."""
    for part in parts_of(batches, 1, SLICE):
        yield part.column(0), shingle_sets(part.column(1), n)


COUNTED = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("count", T.LongType())])


def repeats(docs: DataFrame, n: int) -> DataFrame:
    """bucket and count: how often n-grams that repeat between different sets of a task were met."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(COUNTED)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(held)
        held.clear()
        every.sort()
        again = np.flatnonzero(every[1:] == every[:-1])
        # a run of k equal n-grams counts k: one for each that follows an equal one, and one for the first
        first = np.concatenate([[True], every[again[1:]] != every[again[:-1]]]) if len(again) else np.empty(0, bool)
        bucket, at = np.unique((every[again] >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), return_inverse=True)
        total = np.bincount(at, 1 + first, len(bucket)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(total)], schema=arrow)

    def run(batches):
        held, size, seen = [], 0, set()
        for _, sets in batches_of_sets(batches, n):
            for s in sets:
                if not len(s) or (sid := fingerprint(s)) in seen:
                    continue
                seen.add(sid)
                held.append(s)
                size += len(s)
                if size > COUNT_ROWS:
                    yield counted(held)
                    size, seen = 0, set()
        if held:
            yield counted(held)

    return docs.mapInArrow(run, COUNTED)


def levels(counts: DataFrame) -> np.ndarray:
    """Frequency class of every bucket, 0 for rare ones: a table of fixed size."""
    table = np.zeros(1 << BUCKET_BITS, np.uint8)
    got = counts.groupBy("bucket").agg(F.sum("count").alias("c")).where(F.col("c") >= FREQUENT).select("bucket", F.floor(F.log2("c")).cast("int").alias("level")).toArrow()
    table[got["bucket"].to_numpy()] = got["level"].to_numpy()
    return table


def in_order(s: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set in the global order, and the levels alongside: rare n-grams by fingerprint, then ever more frequent ones."""
    level = table[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
    order = np.argsort(level, kind="stable")
    return s[order], level[order]


class Broadcasts:
    """The frequency table as a broadcast variable; its size is fixed."""

    def __init__(self, spark, table: np.ndarray):
        import zlib

        self.value = spark.sparkContext.broadcast(zlib.compress(table.tobytes(), 1))

    def table(self) -> np.ndarray:
        import zlib

        return np.frombuffer(zlib.decompress(self.value.value), np.uint8)


def needed_prefix(n, percent: int):
    """Length of the prefix in which a set shares an n-gram with every set that it links with."""
    if isinstance(n, int):
        return n - -(-percent * n // 100) + 1
    return n - F.ceil(percent * n / 100).cast("int") + 1


def prefix_size(n, percent: int):
    """Length of the prefix that is used: half as long again."""
    p = needed_prefix(n, percent)
    if isinstance(n, int):
        return min(n, p + p // 2)
    return F.least(n, p + F.floor(p / 2).cast("int"))


def least_shared(n: F.Column, percent: int) -> F.Column:
    """N-grams of a set's prefix that stand in the prefix of another, if it links with any.

    Of two linked sets, the one whose prefix ends first in the order has at most needed_prefix - 1 n-grams of its own
    there, so the others are common, and in both prefixes. The number grows with the set; the smallest set that may link
    with one of n n-grams has percent % of them.
    """
    m = F.ceil(percent * n / 100).cast("int")
    return prefix_size(m, percent) - needed_prefix(m, percent) + 1


SIGNED = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sid", T.LongType()), T.StructField("common", T.FloatType()), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("token", T.LongType()), T.StructField("place", T.LongType())])


def sign(docs: DataFrame, sent: Broadcasts, n: int, percent: int) -> DataFrame:
    """In one pass over the texts, rows of two kinds (0 and 1): id, n, sid (the set's fingerprint), how frequent its n-grams are in
    all, and sizes (n-grams in each range of fingerprints) of every document; token, sid and place (n and the position)
    of the prefix n-grams of every set with a key, once a task."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(SIGNED)

    def run(batches):
        table, seen = sent.table(), set()
        for keys, sets in batches_of_sets(batches, n):
            length = np.fromiter(map(len, sets), np.int64, len(sets))
            every = np.concatenate(sets)
            of = np.repeat(np.arange(len(sets)), length)
            level = table[(every >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
            sids = [fingerprint(s) if len(s) else None for s in sets]
            common = np.bincount(of, level, len(sets)) / np.maximum(length, 1)
            sizes = np.bincount(of * RANGES + (every >> np.uint64(64 - RANGES.bit_length() + 1)).astype(np.int64), minlength=len(sets) * RANGES).astype(np.int32)
            sizes = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * RANGES), pa.array(sizes)).cast(arrow.field("sizes").type)
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), keys.cast(pa.int64()), pa.array(length), pa.array(sids, pa.int64()), pa.array(common.astype(np.float32)), sizes, none, none], schema=arrow)

            if len(seen) > 200_000:  # bounded memory: a set may be listed again
                seen.clear()
            fresh = np.zeros(len(sets), bool)
            for i, (sid, known) in enumerate(zip(sids, keys.is_valid().to_pylist(), strict=True)):
                if sid is not None and known and sid not in seen:
                    seen.add(sid)
                    fresh[i] = True
            p = np.array([prefix_size(k, percent) if k else 0 for k in length.tolist()], np.int64)
            rare = level == 0
            upto = np.cumsum(rare)
            begin = np.concatenate([[0], np.cumsum(length)])
            first = np.concatenate([[0], upto])[begin]  # rare n-grams before each set
            enough = fresh & (np.diff(first) >= p)
            rank = upto - first[:-1][of] - 1
            chosen = np.flatnonzero(rare & enough[of] & (rank < p[of]))
            tokens, owner, places = [signed(every[chosen])], [of[chosen]], [rank[chosen]]
            for i in np.flatnonzero(fresh & ~enough).tolist():
                ordered, _ = in_order(sets[i], table)
                tokens.append(signed(ordered[: p[i]]))
                owner.append(np.repeat(i, p[i]))
                places.append(np.arange(p[i]))
            tokens, owner, places = map(np.concatenate, (tokens, owner, places))
            if len(tokens):
                named = np.array([x or 0 for x in sids], np.int64)[owner]
                none = pa.nulls(len(tokens), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(tokens), np.int32)), none, none, pa.array(named), none.cast(pa.float32()), pa.nulls(len(tokens), arrow.field("sizes").type), pa.array(tokens), pa.array(places + (length[owner] << 32))], schema=arrow)

    return docs.mapInArrow(run, SIGNED)


def fragments(docs: DataFrame, sent: Broadcasts, n: int, cuts: int) -> DataFrame:
    """The sets cut along the global order: (sid, task, fragment, tokens), each set once a task. Rare n-grams fall into
    `cuts` equal ranges of their fingerprints, frequent ones into as many again."""
    schema = T.StructType([T.StructField("sid", T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("fragment", T.IntegerType()), T.StructField("tokens", T.ArrayType(T.LongType(), False))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        table, seen, task = sent.table(), set(), TaskContext.get().partitionId()
        for _, sets in batches_of_sets(batches, n):
            sids, numbers, tokens = [], [], []
            for s in sets:
                if not len(s) or (sid := fingerprint(s)) in seen:
                    continue
                seen.add(sid)
                ordered, level = in_order(s, table)
                part = (ordered >> np.uint64(32)).astype(np.int64) * cuts >> 32
                part += cuts * (level > 0)
                for f in np.unique(part).tolist():
                    sids.append(sid)
                    numbers.append(f)
                    tokens.append(signed(ordered[part == f]))
            if sids:
                offsets = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tokens)))
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(np.full(len(sids), task, np.int32)), pa.array(numbers, pa.int32()), lists.cast(arrow.field("tokens").type)], schema=arrow)

    return docs.mapInArrow(run, schema)


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, sent: Broadcasts, n: int, percent: int, cuts: int) -> DataFrame:
    """The pairs (a, b, ra, rb, na, nb: sets, their documents, their sizes) that reach the threshold, as links (a, b).

    Partial overlaps are counted per fragment and summed per pair. A set b with many partners has copies of its
    fragments, one for so many of them, and so isn't one task's work. Rows that repeat, and copies that a bitmap lets
    through, give a set's fragments again; those of one task are taken, or overlaps would be counted twice.
    """
    ends = pairs.select(F.col("ra").alias("id")).union(pairs.select("rb"))
    ends = materialize(ends.distinct(), "jac-ends")
    sizes = materialize(thinned(rows, "id", ends).select("sid", "sizes").groupBy("sid").agg(F.first("sizes").alias("sizes")), "jac-sizes")
    size_of = lambda c: sizes.select(F.col("sid").alias(c), F.col("sizes").alias(f"s{c}"))
    most = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    bounded = pairs.join(size_of("a"), "a").join(size_of("b"), "b").where((100 + percent) * most >= percent * (F.col("na") + F.col("nb")))
    copies = bounded.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("copies"))
    bounded = bounded.drop("sa", "sb")
    chosen = materialize(bounded.join(copies, "b").select(*pairs.columns, "copies", F.pmod(F.xxhash64("a"), "copies").cast("int").alias("copy")), "jac-bounded")
    needed = materialize(chosen.select(F.col("ra").alias("id")).union(chosen.select("rb")).distinct(), "jac-needed")
    parts = materialize(fragments(thinned(docs, "id", needed), sent, n, cuts), "jac-fragments")
    few = chosen.count()
    of_set = parts.select("sid", "task").distinct().groupBy("sid").agg(F.min("task").alias("first"), F.count("*").alias("tasks"))
    again = materialize(of_set.where("tasks > 1").select("sid", "first"), "jac-again")
    once = parts.join(small(again, again.count()), "sid", "left").where("first is null or task = first")
    left = once.join(small(chosen.drop("copies"), few), F.col("sid") == F.col("a")).select("a", "b", "copy", "fragment", "ra", "rb", "na", "nb", F.col("tokens").alias("ta"))
    spread = chosen.select("b", "copies").distinct().withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    right = once.join(small(spread, few), F.col("sid") == F.col("b")).select("b", "copy", "fragment", F.col("tokens").alias("tb"))
    partial = left.join(right, ["b", "copy", "fragment"]).select("a", "b", "ra", "rb", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("overlap"))
    total = partial.groupBy("a", "b", "ra", "rb", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    out = materialize(total.where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b"), "jac-links")
    for x in (parts, again, needed, chosen, sizes, ends):
        release(x)
    return out


def similar_sizes(percent: int) -> F.Column:
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))


def largest_partner(n: str, pos: str, percent: int) -> F.Column:
    """Size of the largest set that one of n n-grams may link with, if they have none in common ahead of position `pos`."""
    return F.floor(((100 + percent) * (F.col(n) - F.col(pos)).cast("long") - percent * F.col(n).cast("long")) / percent)


def between_components(placed: DataFrame) -> DataFrame:
    """The pairs (a, b, ra, rb, na, nb) of sets of different components that may reach the threshold, from rows of token,
    sid, rep, n, most (largest_partner) and component.

    All that linked sets have in common stands at their first common n-gram or behind it, in both. So at one n-gram at
    least, both are small enough for each other: n <= most. That is asked of each set and the n-gram's smallest n and
    largest most, then of each two components, and only then of two sets. So a large group of near copies, where most
    are of one component and the others begin with n-grams of their own, doesn't give all its pairs.
    """
    split = placed.groupBy("token").agg(F.min("n").alias("lo"), F.max("most").alias("hi"), F.min("component").alias("one"), F.max("component").alias("other")).where("one <> other").select("token", "lo", "hi")
    split = materialize(split, "jac-split")
    apart = thinned(placed, "token", split).join(split, "token").where("lo <= most and n <= hi").select(placed.columns)
    apart = materialize(apart, "jac-apart")
    ranges = apart.groupBy("token", "component").agg(F.min("n").alias("lo"), F.max("most").alias("hi"))
    side = lambda df, x: df.select("token", *[F.col(c).alias(f"{k}{x}") for c, k in (("component", "c"), ("sid", ""), ("rep", "r"), ("n", "n"), ("most", "m"), ("lo", "l"), ("hi", "h")) if c in df.columns])
    both = side(ranges, "a").join(side(ranges, "b"), "token").where("ca < cb and la <= hb and lb <= ha").select("token", "ca", "cb", "lb", "hb")
    both = materialize(both, "jac-components")
    some = both.join(side(apart, "a"), ["token", "ca"]).where("na <= hb and lb <= ma").drop("lb", "hb")
    cross = some.join(side(apart, "b"), ["token", "cb"]).where("na <= mb and nb <= ma").select("a", "b", "ra", "rb", "na", "nb").distinct()
    out = materialize(cross, "jac-cross")
    for x in (split, apart, both):
        release(x)
    return out


def jaccard_classes(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90, cuts: int = 2) -> DataFrame:
    """One row per row of `df`: key, n_shingles, component_id.

    Two texts link when 100 * |A & B| >= percent * |A | B| of their n-gram sets. Null and empty texts and texts of white
    space have 0 n-grams and stand alone; a text of fewer than n words has one n-gram, its whole sequence. Keys are
    integers; rows that repeat a key are documents of their own; a null key has a null component. Equal texts are linked, whatever their number; an
    empty table gives no rows; other columns are ignored. Texts are read whole.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1..100")
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sent = Broadcasts(spark, levels(repeats(docs, n)))
    made = materialize_kinds(sign(docs, sent, n, percent), "kind", {0: ["id", "n", "sid", "common", "sizes"], 1: ["token", "sid", "place"]}, "jac-signed")
    rows, listed = made[0], made[1]
    # classes of equal sets; `order` goes by how common the n-grams are, then by the fingerprint
    order = F.shiftleft((F.col("common") * 256).cast("long"), 40).bitwiseOR(F.col("sid").bitwiseAND(F.lit((1 << 40) - 1)))
    classes = rows.where("sid is not null and id is not null").groupBy("sid").agg(F.min("id").alias("rep"), F.max("common").alias("common"), F.max("n").cast("int").alias("n"))
    classes = materialize(classes.select("sid", "rep", "n", order.alias("order")), "jac-classes")

    # n-grams listed more than once, and the sets with enough of them; what only copies of one set list does no harm
    shared = materialize(listed.groupBy("token").count().where("count > 1").select("token"), "jac-tokens")
    met = thinned(listed, "token", shared).join(shared, "token")  # a semi join would be moved ahead of the thinning
    sets = met.groupBy("sid").agg(F.collect_set(F.struct("token", "place")).alias("at"))
    sets = sets.where(F.size("at") >= least_shared(F.shiftright(F.col("at")[0]["place"], 32).cast("int"), percent)).join(classes, "sid").select("sid", "rep", "n", "order", F.explode("at").alias("x"))
    held = materialize(sets.select("x.token", "sid", "rep", "n", "order", F.col("x.place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos")), "jac-shared")
    release(shared)
    release(listed)

    # each class with the hub of each of its prefix n-grams: the set made of the most common n-grams
    hubs = held.groupBy("token").agg(F.max("order").alias("hub"))
    near = held.select("token", "sid", "rep", "n", "order").join(hubs, "token").where("order <> hub").select("sid", "rep", "n", "hub").distinct()
    of_hub = classes.select(F.col("order").alias("hub"), F.col("sid").alias("b"), F.col("rep").alias("rb"), F.col("n").alias("nb"))
    pairs = near.join(of_hub, "hub").select(F.col("sid").alias("a"), "b", F.col("rep").alias("ra"), "rb", F.col("n").alias("na"), "nb")
    first = materialize(pairs.where(similar_sizes(percent) & (F.col("a") != F.col("b"))), "jac-pairs")
    links = verified(first, docs, rows, sent, n, percent, cuts)

    # n-grams that still have different components: pairs between those
    comp = components(links)
    placed = held.join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    placed = materialize(placed.select("token", "sid", "rep", "n", largest_partner("n", "pos", percent).alias("most"), "component"), "jac-placed")
    cross = between_components(placed)
    tried = first.select("a", "b").union(first.select("b", "a"))
    second = materialize(cross.join(tried, ["a", "b"], "left_anti").select(first.columns), "jac-pairs")
    found = comp
    if second.limit(1).count():
        more = verified(second, docs, rows, sent, n, percent, cuts)
        found = components(links.unionByName(more))
        release(more)
    for x in (held, first, placed, cross, second, links):
        release(x)
    # sets are the nodes, so rows of one id with different texts stay apart; a component's name is its smallest id
    nodes = found.withColumnRenamed("node", "sid")
    least = nodes.join(classes.select("sid", "rep"), "sid").groupBy("component").agg(F.min("rep").alias("least"))
    named = classes.select("sid", "rep").join(nodes.join(least, "component").select("sid", "least"), "sid", "left")
    result = rows.select("id", "n", "sid").join(named, "sid", "left")
    return result.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("least", "rep", "id")).alias("component_id"))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """n_shingles and component_id of every document: three-word shingles, Jaccard 0.9 or more."""
    from .common import table

    return jaccard_classes(table(spark, sf_dir, "documents"))
