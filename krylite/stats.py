"""Statistics of trajectories: ratio estimators, autocorrelation, efficiency."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def after_burn_in(traj: DataFrame, burn_in: int, order: str = "iter") -> DataFrame:
    return traj.where(F.col(order) >= burn_in)


def aligned(num: DataFrame, den: DataFrame, burn_in: int, order: str = "iter") -> DataFrame:
    """num and den of the same iteration, from burn_in on."""
    a, b = after_burn_in(num, burn_in, order), after_burn_in(den, burn_in, order)
    return a.select(order, F.col("value").alias("num")).join(b.select(order, F.col("value").alias("den")), order)


def residuals(pairs: DataFrame, order: str = "iter") -> DataFrame:
    """num / <den> - <num> den / <den>^2, the series whose mean is 0 and whose variance is the ratio's."""
    means = pairs.agg(F.avg("num").alias("__n"), F.avg("den").alias("__d"))
    joined = pairs.crossJoin(F.broadcast(means))  # one row
    return joined.select(order, (F.col("num") / F.col("__d") - F.col("__n") * F.col("den") / (F.col("__d") * F.col("__d"))).alias("residual"))


def autocovariance(series: DataFrame, lags: int, value: str = "residual", order: str = "iter") -> DataFrame:
    """(lag, cov) for lags 0..lags of consecutive iterations, by an equi-join on shifted iteration numbers."""
    mean = series.agg(F.avg(value).alias("__m"), F.count("*").alias("__n"))
    x = series.crossJoin(F.broadcast(mean)).select(F.col(order).alias("i"), (F.col(value) - F.col("__m")).alias("x"), "__n")
    shifted = x.select(F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"), "i", F.col("x").alias("y")).withColumn("i", F.col("i") - F.col("lag"))
    return x.join(shifted, "i").groupBy("lag").agg((F.sum(F.col("x") * F.col("y")) / F.max("__n")).alias("cov"))


def integrated_time(rho: np.ndarray, c: float = 2.0) -> float:
    """1 + 2 sum of rho up to the first window of at least c times the running estimate."""
    tau = 2 * np.cumsum(rho) - 1
    window = np.arange(len(tau)) >= c * tau
    return float(tau[np.argmax(window)] if window.any() else tau[-1])


def autocorrelation_time(values: np.ndarray, c: float = 2.0) -> float:
    """Of a whole series on the driver, by FFT."""
    x = np.asarray(values, float) - np.mean(values)
    n = 1 << (2 * len(x) - 1).bit_length()
    f = np.fft.rfft(x, n)
    acf = np.fft.irfft(f * np.conj(f), n)[: len(x)]
    return integrated_time(acf / acf[0], c) if acf[0] > 0 else 1.0


def summary(num: DataFrame, den: DataFrame, burn_in: int, exact: float = 0.0, order: str = "iter") -> dict:
    """Ratio, its error against `exact`, two standard deviations, autocorrelation time and efficiency.

    The series stays on the executors: lags are summed there, more of them until the window of the time estimate closes.
    """
    pairs = aligned(num, den, burn_in, order)
    means = pairs.agg(F.avg("num"), F.avg("den"), F.count("*")).first()
    series, lags = residuals(pairs, order), 64
    while True:
        lags = min(lags, max(0, means[2] - 1))
        cov = {r["lag"]: r["cov"] for r in autocovariance(series, lags, "residual", order).collect()}  # a row for each lag
        var = float(cov.get(0, 0.0))
        rho = np.array([cov.get(k, 0.0) / var if var else 0.0 for k in range(lags + 1)])
        if lags >= means[2] - 1 or (np.arange(len(rho)) >= 2.0 * (2 * np.cumsum(rho) - 1)).any():
            break
        lags *= 4
    tau = integrated_time(rho) if var else 1.0
    ratio = means[0] / means[1]
    return {"ratio": ratio, "error": ratio - exact, "two_sigma": 2 * np.sqrt(var * tau / means[2]), "tau": tau, "efficiency": 1 / (var * tau) if var else float("inf")}


def running_mean_deviation(series: DataFrame, exact: float, value: str = "value", order: str = "iter", run: str = "run") -> DataFrame:
    """|cumulative mean - exact| after each row of a run."""
    w = W.partitionBy(run).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return series.withColumn("deviation", F.abs(F.avg(value).over(w) - F.lit(exact)))


def blocked(series: DataFrame, size: int, value: str = "value", order: str = "iter") -> DataFrame:
    """Means of blocks of consecutive iterations, for blocking analysis."""
    return series.groupBy(F.floor(F.col(order) / size).alias("block")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
