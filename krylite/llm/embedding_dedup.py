"""Near-duplicate embeddings by inverted lists with product-quantised residuals.

Equal vectors of a label are counted once, as a class. Coarse centroids and residual codebooks are fitted on a bounded
sample; every class goes to the list of its nearest centroid and stores a code of its residual, one byte a subspace.
Past Settings.most_lists lists there is a second level: centroids of the residuals split every list, so that lists keep their
size while there are up to a thousand times as many. A class asks several of the nearest lists. There, asymmetric distances, sums of table look-ups by code, pick the
candidates with a margin for the quantisation error, and exact cosines in double precision decide. Lists are cut into
blocks, so that a hot list is worked on by many tasks in bounded memory, and only counts and a spanning set of links
leave a block, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .components import components


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.93
    #: Bound of the vectors that centroids and codebooks are fitted on, in the order of a hash.
    sample: int = 20_000
    list_rows: int = 512
    most_lists: int = 1024
    #: Centroids of the second level at most, and how many of them are asked under each centroid of the first.
    most_fine: int = 1024
    probes: int = 8
    fine_probes: int = 4
    subspaces: int = 8
    codewords: int = 64
    #: Rows of a block: memory of a task is bounded by two blocks.
    block_rows: int = 2048


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, centres, 1)[:, 0]
        count = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        full = count > 0
        centres[full] = total[full] / count[full, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centres of each row, nearest first."""
    out = []
    for i in range(0, len(x), 4096):
        d = (centres * centres).sum(1) - 2 * x[i : i + 4096] @ centres.T
        near = np.argpartition(d, min(n, d.shape[1] - 1), 1)[:, :n] if n < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
        out.append(np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), 1, kind="stable"), 1))
    return np.concatenate(out) if out else np.empty((0, n), np.int64)


class Quantiser:
    """Coarse centroids (of one level or two) and residual codebooks for unit vectors of one width."""

    def __init__(self, x: np.ndarray, rows: int, s: Settings):
        self.s = s
        lists = int(np.clip(rows // s.list_rows, 1, s.most_lists))
        self.centres = kmeans(x, min(lists, len(x)))
        near = nearest(x, self.centres, 1)[:, 0]
        fine = int(np.clip(rows // (s.list_rows * s.most_lists), 1, s.most_fine))
        self.fine = kmeans(x - self.centres[near], min(fine, len(x))) if fine > 1 else np.zeros((1, x.shape[1]))
        res = x - self.centre(self.probes(x)[:, 0])
        self.cuts = [(i * x.shape[1] // s.subspaces, (i + 1) * x.shape[1] // s.subspaces) for i in range(s.subspaces)]
        self.cuts = [(a, b) for a, b in self.cuts if b > a]
        self.books = [kmeans(res[:, a:b], min(s.codewords, len(x))) for a, b in self.cuts]

    def centre(self, lists: np.ndarray) -> np.ndarray:
        return self.centres[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def probes(self, x: np.ndarray) -> np.ndarray:
        """Numbers of the lists that each row asks, its own first."""
        coarse = nearest(x, self.centres, min(self.s.probes, len(self.centres)))
        k = len(self.fine)
        if k == 1:
            return coarse
        found, far = [], []
        for j in range(coarse.shape[1]):
            res = x - self.centres[coarse[:, j]]
            fine = nearest(res, self.fine, min(self.s.fine_probes, k))
            found.append(coarse[:, j, None] * k + fine)
            far.append(((res[:, None] - self.fine[fine]) ** 2).sum(2))
        found, far = np.concatenate(found, 1), np.concatenate(far, 1)
        return np.take_along_axis(found, np.argsort(far, 1, kind="stable"), 1)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        res = x - self.centre(lists)
        return np.stack([nearest(res[:, a:b], book, 1)[:, 0] for (a, b), book in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)

    def error(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Length of what the code of each row leaves out."""
        res = x - self.centre(lists)
        for j, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True)):
            res[:, a:b] -= book[codes[:, j]]
        return np.sqrt((res * res).sum(1))

    def look_up(self, q: np.ndarray, number: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of queries to the coded members of one list."""
        res = q - self.centre(np.array([number]))
        total = np.zeros((len(q), len(codes)))
        for j, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True)):
            part = res[:, a:b]
            table = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)
            total += table[:, codes[:, j]]
        return np.maximum(total, 0)


def usable(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """key, label and unit-free vectors (double) that may link: label and vector not null, finite and not zero."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine)


def unit(lists: pa.ChunkedArray) -> np.ndarray:
    t = lists.combine_chunks()
    x = np.asarray(t.flatten(), np.float64).reshape(len(t), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", settings: Settings = Settings()) -> DataFrame:
    """One row per row of `df`: key, n_links, component_id, kept.

    Rows that can't link (null label, vector null, empty, zero or with null or non-finite components) and vectors of
    other widths than a partner's stand alone; a null key has no component. Ids are taken as distinct; equal vectors are
    linked with each other whatever their number. Empty tables give no rows; other columns are ignored.
    """
    s = settings
    rows = usable(df, key, vector, label)
    members = materialize(rows.select("id", "label", F.size("v").alias("width"), F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"), "v"), "emb-rows")
    same = ["label", "width", "h1", "h2"]
    classes = materialize(members.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.min_by("v", "id").alias("v")), "emb-classes")
    links, counts = link_classes(classes, s)
    comp = components(links)
    known = classes.select(*same, "rep", "n").join(counts, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select(*same, (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    of_row = members.select("id", *same).join(known, same).select("id", "n_links", "component_id")
    out = df.select(key).join(of_row, F.col(key).cast("long") == F.col("id"), "left")
    comp_id = F.coalesce("component_id", F.col(key).cast("long"))
    return out.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col(key) == comp_id, F.lit(False)).alias("kept"))


def link_classes(classes: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that span every component of classes, and for each class the rows of the classes it links with."""
    spark = classes.sparkSession
    books: dict[int, Quantiser] = {}
    for width, rows in classes.groupBy("width").count().collect():  # a handful of widths
        got = classes.where(F.col("width") == width).orderBy(F.xxhash64("rep"), "rep").limit(s.sample).select("v").toArrow()
        books[width] = Quantiser(unit(got["v"]), rows, s)
    many = T.ArrayType(T.IntegerType())
    coded = T.StructType([T.StructField("label", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("rep", T.LongType()), T.StructField("n", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("home", T.IntegerType()), T.StructField("probes", many), T.StructField("code", T.BinaryType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(coded)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            widths = t["width"].to_numpy()
            for w in np.unique(widths):
                part = t.filter(pa.array(widths == w))
                q, x = books[int(w)], unit(part["v"])
                probes = q.probes(x)
                codes = q.codes(x, probes[:, 0])
                cols = [part[c].combine_chunks() for c in ("label", "width", "rep", "n", "v")]
                cols += [pa.array(probes[:, 0], pa.int32()), pa.array(probes.tolist(), arrow.field("probes").type), pa.array([c.tobytes() for c in codes], pa.binary())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    placed = materialize(classes.select("label", "width", "rep", "n", "v").mapInArrow(assign, coded), "emb-placed")
    place = ["label", "width", "list"]
    home = placed.groupBy("label", "width", F.col("home").alias("list")).count().withColumn("mblocks", F.ceil(F.col("count") / s.block_rows).cast("int")).drop("count")
    asked = placed.withColumn("list", F.explode("probes"))
    askers = asked.groupBy(*place).count().withColumn("qblocks", F.ceil(F.col("count") / s.block_rows).cast("int")).drop("count")
    shape = home.join(askers, place)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keep = ["rep", "n", "v", "home", "probes", "code"]
    h = F.xxhash64("rep")
    held = placed.withColumn("list", F.col("home")).join(shape, place).select(*place, F.pmod(h, "mblocks").cast("int").alias("m"), spread("qblocks").alias("q"), F.lit(False).alias("asks"), *keep)
    asks = asked.join(shape, place).select(*place, spread("mblocks").alias("m"), F.pmod(h, "qblocks").cast("int").alias("q"), F.lit(True).alias("asks"), *keep)
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("more", T.LongType())])
    out_arrow = to_arrow_schema(out)

    def compare(t: pa.Table) -> pa.Table:
        number, width = t["list"][0].as_py(), t["width"][0].as_py()
        asks = t["asks"].to_numpy(zero_copy_only=False)
        quant, x = books[width], unit(t["v"])
        rep, n, homes = t["rep"].to_numpy(), t["n"].to_numpy(), t["home"].to_numpy()
        mi, qi = np.flatnonzero(~asks), np.flatnonzero(asks)
        total: dict[int, int] = {}
        edges: set[tuple[int, int]] = set()
        if len(mi) and len(qi):
            codes = np.frombuffer(b"".join(t["code"].filter(pa.array(~asks)).to_pylist()), np.uint8).reshape(len(mi), -1)
            reach = quant.error(x[mi], homes[mi], codes)
            probes_of = np.array(t["probes"].filter(pa.array(~asks)).to_pylist(), np.int32)
            wide = np.sqrt(2 - 2 * s.threshold) + 1e-9
            got = np.zeros(len(t), np.int64)
            root = np.arange(len(t))  # a block's own components, so that a spanning set of links leaves it
            for lo in range(0, len(qi), 256):
                own = qi[lo : lo + 256]
                # a distance to the decoded vector is within the decoding error of the true one
                maybe = np.sqrt(quant.look_up(x[own], number, codes)) <= wide + reach
                maybe &= rep[own][:, None] != rep[mi][None]
                r, c = np.nonzero(maybe)
                exact = np.empty(len(r))
                for at in range(0, len(r), 65_536):
                    exact[at : at + 65_536] = np.einsum("ij,ij->i", x[own[r[at : at + 65_536]]], x[mi[c[at : at + 65_536]]])
                hit = exact >= s.threshold
                r, c = r[hit], c[hit]
                np.add.at(got, own[r], n[mi[c]])
                alone = (probes_of[c] != homes[own[r], None]).all(1)  # the partner doesn't ask this one's list: credit it here
                np.add.at(got, mi[c[alone]], n[own[r[alone]]])
                hook(root, own[r], mi[c])
            flat = flatten(root)
            for i in np.flatnonzero(got):
                total[int(rep[i])] = total.get(int(rep[i]), 0) + int(got[i])
            least: dict[int, int] = {}
            for i, f in enumerate(flat.tolist()):
                least[f] = min(least.get(f, int(rep[i])), int(rep[i]))
            for i in np.flatnonzero(np.bincount(flat, minlength=len(flat))[flat] > 1):
                edges.add((int(rep[i]), least[int(flat[i])]))
        rows = [(a, b, 0) for a, b in edges if a != b] + [(a, a, m) for a, m in total.items()]
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(cols, out_arrow, strict=True)], schema=out_arrow)

    found = materialize(held.unionByName(asks).groupBy(*place, "m", "q").applyInArrow(compare, out), "emb-links")
    counts = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("more").alias("more"))
    return found.where("a <> b").select("a", "b").distinct(), counts


def hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union-find over pairs, in place."""
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        while root[j] != j:
            root[j] = root[root[j]]
            j = root[j]
        if i != j:
            root[max(i, j)] = min(i, j)


def flatten(root: np.ndarray) -> np.ndarray:
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root = up


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and component of every embedding: equal labels, cosine 0.93 or more."""
    from .common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))
