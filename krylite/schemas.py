"""Schemas of the tables that the engine reads and writes, and checks on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

L, D, I, S, B = T.LongType(), T.DoubleType(), T.IntegerType(), T.StringType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


VECTOR = struct(det=L, v=D)
WALKERS = struct(det=L, v=L)
SPAWN = struct(det=L, v=D, ini=B)
ONE_BODY = struct(p=I, q=I, val=D)
TWO_BODY = struct(p=I, q=I, r=I, s=I, val=D)
ORBITALS = struct(orb=I, irrep=I)
COO = struct(src=L, dst=L, val=D)
TRAJECTORY = struct(run=S, iter=L, metric=S, value=D)
STATE = struct(run=S, iter=L, shift=D, last_norm=D, seed=L)
MATRIX_TRAJECTORY = struct(run=S, iter=L, i=I, j=I, h=D, d=D)


class BadKey(ValueError):
    """A key doesn't hold the number of electrons that its vector needs."""


def check_electrons(df: DataFrame, n_elec: int, key: str = "det") -> DataFrame:
    """The same rows; the query fails with BadKey's message where a key has another number of set bits."""
    bad = F.raise_error(F.concat(F.lit("BadKey: "), F.col(key).cast("string")))
    return df.withColumn(key, F.when(F.bit_count(key) == n_elec, F.col(key)).otherwise(bad.cast("long")))
