"""The sparse-vector store: vectors are DataFrames keyed by `det`, one column per vector.

Adding is a union and a partial-then-final sum; acceptance rules are semi and anti joins. A vector is never gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "det"


def any_nonzero(values: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(v) != 0 for v in values])


def merge(vec: DataFrame, spawn: DataFrame, value: str = "v", key: str = KEY) -> DataFrame:
    """vec + spawn by key; zero-valued adds are dropped before the shuffle, zero sums stay as stored keys."""
    adds = spawn.where(F.col(value) != 0).select(key, value)
    return vec.select(key, value).unionByName(adds).groupBy(key).agg(F.sum(value).alias(value))


def accepted(vec: DataFrame, spawn: DataFrame, origin: str = "v", key: str = KEY) -> DataFrame:
    """The initiator rule: adds flagged `ini` always count, others only where the origin column is not 0 at the start."""
    held = vec.where(F.col(origin) != 0).select(key)
    return spawn.where("ini").unionByName(spawn.where(~F.col("ini")).join(held, key, "left_semi"))


def rejected(vec: DataFrame, spawn: DataFrame, origin: str = "v", key: str = KEY) -> DataFrame:
    held = vec.where(F.col(origin) != 0).select(key)
    return spawn.where(~F.col("ini")).join(held, key, "left_anti")


def merge_initiator(vec: DataFrame, spawn: DataFrame, value: str = "v", origin: str = "v", key: str = KEY) -> DataFrame:
    """Merge under the initiator rule. In place (origin and destination one column), an add to a key that an initiator
    also adds to in the same step counts as well; that key's adds don't depend on their order of arrival."""
    if origin == value:
        held = vec.where(F.col(origin) != 0).select(key).unionByName(spawn.where("ini").select(key))
        ok = spawn.where("ini").unionByName(spawn.where(~F.col("ini")).join(held, key, "left_semi"))
    else:
        ok = accepted(vec, spawn, origin, key)
    return merge(vec, ok, value, key)


def accepted_non_initiators(vec: DataFrame, spawn: DataFrame, origin: str = "v", key: str = KEY) -> DataFrame:
    """One row: how many adds without the flag were accepted."""
    held = vec.where(F.col(origin) != 0).select(key)
    return spawn.where(~F.col("ini")).join(held, key, "left_semi").agg(F.count("*").alias("n_accepted"))


def sign_coherent(vec: DataFrame, spawn: DataFrame, value: str = "v", key: str = KEY) -> DataFrame:
    """One row: adds that have the sign of the stored value they go to."""
    both = spawn.select(key, F.col(value).alias("add")).join(vec.select(key, value), key)
    return both.agg(F.sum((F.col("add") * F.col(value) > 0).cast("long")).alias("n_coherent"))


def dot(a: DataFrame, b: DataFrame, va: str = "v", vb: str = "v", key: str = KEY) -> DataFrame:
    """One row: the sum of products over shared keys. The planner broadcasts a side only if its size allows."""
    both = a.select(key, F.col(va).alias("__a")).join(b.select(key, F.col(vb).alias("__b")), key)
    return both.agg(F.coalesce(F.sum(F.col("__a") * F.col("__b")), F.lit(0)).alias("dot"))


def batched_dot(a: DataFrame, b: DataFrame, vas: list[str], vbs: list[str], key: str = KEY) -> DataFrame:
    """i, j, dot for every pair of columns, from one join and one aggregate."""
    both = a.select(key, *[F.col(v).alias(f"__a{i}") for i, v in enumerate(vas)]).join(b.select(key, *[F.col(v).alias(f"__b{j}") for j, v in enumerate(vbs)]), key)
    sums = both.agg(*[F.coalesce(F.sum(F.col(f"__a{i}") * F.col(f"__b{j}")), F.lit(0)).alias(f"s{i}_{j}") for i in range(len(vas)) for j in range(len(vbs))])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{i}_{j}").alias("dot")) for i in range(len(vas)) for j in range(len(vbs))])
    return sums.select(F.explode(cells).alias("c")).select("c.*")


def internal_dot(vec: DataFrame, i: str, j: str) -> DataFrame:
    return vec.agg(F.sum(F.col(i) * F.col(j)).alias("dot"))


def axpy(vec: DataFrame, i: str, j: str, c: float | int = 1) -> DataFrame:
    return vec.withColumn(i, F.col(i) + F.lit(c) * F.col(j))


def copy(vec: DataFrame, src: str, dst: str) -> DataFrame:
    return vec.withColumn(dst, F.col(src))


def weight(vec: DataFrame, i: str, j: str, p: float | int) -> DataFrame:
    """v_i *= (1 + |v_j|) ** p"""
    factor = 1 + F.abs(F.col(j))
    return vec.withColumn(i, F.col(i) * (factor if p == 1 else F.pow(factor, F.lit(p))))


def zero(vec: DataFrame, i: str) -> DataFrame:
    return vec.withColumn(i, F.lit(0).cast(vec.schema[i].dataType))


def one_norm(vec: DataFrame, v: str = "v") -> DataFrame:
    return vec.agg(F.sum(F.abs(v)).alias("one_norm"))


def sum_squares(vec: DataFrame, v: str = "v") -> DataFrame:
    """The sum of squares, without a root."""
    return vec.agg(F.sum(F.col(v) * F.col(v)).alias("sum_squares"))


def dense_norm(vec: DataFrame, v: str = "v", flag: str = "is_dense") -> DataFrame:
    return vec.agg(F.coalesce(F.sum(F.when(F.col(flag), F.abs(v))), F.lit(0)).alias("dense_norm"))


def counts(vec: DataFrame, v: str = "v") -> DataFrame:
    """Stored keys and keys with a value in this vector."""
    return vec.agg(F.count("*").alias("n_keys"), F.sum((F.col(v) != 0).cast("long")).alias("n_nonzero"))


def prune(vec: DataFrame, values: list[str], pinned: str | None = None) -> DataFrame:
    """Rows that are zero in every vector go, unless pinned."""
    keep = any_nonzero(values)
    return vec.where(keep | F.col(pinned) if pinned else keep)


def nonzero(vec: DataFrame, v: str) -> DataFrame:
    return vec.where(F.col(v) != 0).select(KEY, v)


def pin(vec: DataFrame, keys: DataFrame, flag: str = "pinned", key: str = KEY) -> DataFrame:
    """Flag rows by key; keys that aren't stored yet are stored with zeros."""
    values = [c for c in vec.columns if c not in (key, flag)]
    marked = keys.select(key).distinct().withColumn(flag, F.lit(True))
    out = vec.drop(flag).join(marked, key, "full")
    return out.select(key, *[F.coalesce(c, F.lit(0).cast(vec.schema[c].dataType)).alias(c) for c in values], F.coalesce(flag, F.lit(False)).alias(flag))


def with_diagonal(vec: DataFrame, diag: Column, name: str = "diag") -> DataFrame:
    """The memoised diagonal: computed where it is null."""
    return vec.withColumn(name, F.coalesce(F.col(name), diag) if name in vec.columns else diag)


def diag_multiply(vec: DataFrame, src: str, dst: str, diag: Column, a: float = 0.0, b: float = 1.0) -> DataFrame:
    """v_dst = v_src * (a + b * diagonal)"""
    return vec.withColumn(dst, F.col(src) * (F.lit(a) + F.lit(b) * diag))


def death_cloning(vec: DataFrame, v: str, diag: Column, eps: float, shift: float) -> DataFrame:
    return vec.withColumn(v, F.col(v) * (1 - F.lit(eps) * (diag - F.lit(shift))))


def coo_multiply(coo: DataFrame, vec: DataFrame, v: str = "v") -> DataFrame:
    """A stored block (src, dst, val) times a vector."""
    got = coo.join(vec.select(F.col(KEY).alias("src"), F.col(v).alias("__v")), "src")
    return got.groupBy(F.col("dst").alias(KEY)).agg(F.sum(F.col("val") * F.col("__v")).alias(v))


def rotate(vec: DataFrame, values: list[str], matrix) -> DataFrame:
    """New columns are linear combinations: new_j = sum_i v_i * matrix[i][j]."""
    new = [reduce(lambda a, b: a + b, [F.col(v) * F.lit(float(matrix[i][j])) for i, v in enumerate(values)]).alias(values[j]) for j in range(len(values))]
    return vec.select(*[c for c in vec.columns if c not in values], *new)


def gram_schmidt(vec: DataFrame, values: list[str]) -> DataFrame:
    """Orthonormal columns, one after another; k * k sums leave the cluster in one aggregate."""
    import numpy as np

    k = len(values)
    row = vec.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(values) for j, b in enumerate(values)]).first()
    gram = np.array([[float(row[f"s{i}_{j}"]) for j in range(k)] for i in range(k)])
    return rotate(vec, values, np.linalg.inv(np.linalg.cholesky(gram)).T)


def owner(parts: int, key: str = KEY) -> Column:
    """The partition that a key belongs to."""
    return F.pmod(F.xxhash64(key), F.lit(parts))


def bucket_sizes(vec: DataFrame, parts: int) -> DataFrame:
    return vec.groupBy(owner(parts).alias("part")).agg(F.count("*").alias("n"))
