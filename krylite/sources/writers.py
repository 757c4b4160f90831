"""Writers: checkpoints by iteration, trajectories in long form, matrices of small runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MATRIX_TRAJECTORY, STATE, TRAJECTORY


def save_checkpoint(vec: DataFrame, path: str, iteration: int) -> None:
    """One folder an iteration; an iteration saved again is replaced, others stay."""
    vec.write.mode("overwrite").parquet(f"{path}/iter={iteration}")


def save_state(spark: SparkSession, path: str, run: str, iteration: int, shift: float, last_norm: float, seed: int) -> None:
    spark.createDataFrame([(run, iteration, float(shift), float(last_norm), seed)], STATE).coalesce(1).write.mode("append").parquet(path)


def load_state(spark: SparkSession, path: str, run: str):
    return spark.read.schema(STATE).parquet(path).where(F.col("run") == run).orderBy(F.col("iter").desc()).limit(1).first()


def append_trajectory(spark: SparkSession, path: str, rows: list[tuple[str, int, str, float]]) -> None:
    spark.createDataFrame(rows, TRAJECTORY).coalesce(1).write.mode("append").parquet(path)


def append_matrices(spark: SparkSession, path: str, run: str, iteration: int, h: np.ndarray, d: np.ndarray) -> None:
    rows = [(run, iteration, i, j, float(h[i, j]), float(d[i, j])) for i in range(len(h)) for j in range(len(h))]
    spark.createDataFrame(rows, MATRIX_TRAJECTORY).coalesce(1).write.mode("append").parquet(path)


def write_text_trajectory(series: DataFrame, path: str, order: str = "iter", value: str = "value") -> None:
    """One number a line, in order."""
    series.select(order, F.col(value).cast("string").alias("value")).orderBy(order).select("value").write.mode("overwrite").text(path)


def write_vector_text(vec: DataFrame, prefix: str, key: str = "det", value: str = "v") -> None:
    """`<prefix>dets` and `<prefix>vals`: one number a line, in the order of the keys, which pairs the lines of the two.

    Each is sorted by ranges, so no task holds the whole vector.
    """
    for column, name in ((key, "dets"), (value, "vals")):
        vec.select(F.col(key).alias("__key"), F.col(column).cast("string").alias("value")).orderBy("__key").select("value").write.mode("overwrite").text(f"{prefix}{name}")


def write_npy(path: str, a: np.ndarray, append: bool = False) -> None:
    """An array file; appending goes along axis 0."""
    if append:
        import os

        if os.path.exists(path):
            a = np.concatenate([np.load(path), a])
    np.save(path, a)


def write_npz(path: str, **arrays: np.ndarray) -> None:
    np.savez(path, **arrays)


def matrix_arrays(traj: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(iterations, k, k) arrays of h and d from a matrix trajectory."""
    rows = traj.orderBy("iter", "i", "j").toPandas()
    return tuple(rows[c].to_numpy().reshape(-1, k, k) for c in ("h", "d"))
