"""Append-only trajectories read as streams: running means and windowed norms while a run is still writing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TRAJECTORY
from ..storage import shared_dir


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(TRAJECTORY).parquet(path)


def running_means(stream: DataFrame) -> DataFrame:
    """Mean, count and last iteration of every metric of every run; for complete or update output."""
    return stream.groupBy("run", "metric").agg(F.avg("value").alias("mean"), F.count("*").alias("n"), F.max("iter").alias("last"))


def windowed(events: DataFrame, ts: str, value: str, length: str, late: str) -> DataFrame:
    """Sums over tumbling windows of a timed series; rows later than the watermark are dropped by the engine."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length)).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Process what is there and return the result table, written to the shared folder: the last whole result in complete
    mode, all rows in append mode."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    done: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")  # a batch that runs again replaces itself
        done.append(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    kept = done[-1:] if mode == "complete" else sorted(set(done))
    return spark.read.schema(stream.schema).parquet(*[f"{path}/{k}" for k in kept])
