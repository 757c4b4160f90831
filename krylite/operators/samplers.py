"""Sequential and multinomial samplers, as numpy functions and as grouped Arrow operators.

Random numbers come from generators seeded by (seed, group), so a task that runs again draws the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .compress import Preserved, preserve


def generator(seed: int, *keys: int) -> np.random.Generator:
    return np.random.default_rng(np.random.SeedSequence([seed & (2**63 - 1), *[int(k) & (2**63 - 1) for k in keys]]))


def pivotal(weights: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Ordered pivotal sampling of exactly n rows: inclusion probability n * w / sum(w), at most 1 each.

    Rows are visited in order; the undecided row and the next one settle their probabilities between them, so that at
    any time one row is undecided and no unit of probability is far from its samples.
    """
    picked = np.zeros(len(weights), bool)
    total = weights.sum()
    if n <= 0 or total <= 0:
        return picked
    p = np.minimum(weights * (n / total), 1.0)
    u = rng.random(len(p))
    held, share = -1, 0.0
    for i in np.flatnonzero(p > 0):
        q = p[i]
        if held < 0:
            held, share = i, q
            continue
        both = share + q
        if both < 1.0:  # one of the two takes all
            if u[i] * both < q:
                held = i
            share = both
        else:  # one is picked, the other keeps what is left
            left = both - 1.0
            if u[i] * (2.0 - both) < 1.0 - q:
                picked[held] = True
                held = i
            else:
                picked[i] = True
            share = left
        if share >= 1.0 - 1e-12:
            picked[held] = True
            held, share = -1, 0.0
        elif share <= 1e-12:
            held, share = -1, 0.0
    if held >= 0 and rng.random() < share:
        picked[held] = True
    return picked


def pivotal_budget(norms: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Samples for each part: the whole part of n * share, and the fractions settled by pivotal sampling."""
    total = norms.sum()
    if total <= 0 or n <= 0:
        return np.zeros(len(norms), np.int64)
    want = norms * (n / total)
    whole = np.floor(want + 1e-12).astype(np.int64)
    rest = n - int(whole.sum())
    return whole + pivotal(np.maximum(want - whole, 0), rest, rng)


def adjust_probabilities(p: np.ndarray, n: int) -> np.ndarray:
    """Inclusion probabilities that add up to the whole number n and are at most 1: scaled up or down in rounds."""
    p = np.minimum(p, 1.0).copy()
    if n >= (p > 0).sum():
        return (p > 0).astype(float)
    for _ in range(60):
        free = (p > 0) & (p < 1)
        gap = n - p.sum()
        if abs(gap) < 1e-12 or not free.any():
            break
        if gap > 0:  # towards one, by what is missing
            room = (1 - p[free]).sum()
            p[free] += (1 - p[free]) * min(1.0, gap / room)
        else:
            p[free] *= max(0.0, 1 + gap / p[free].sum())
    return p


def alias_table(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alias, probability of staying) for constant-time draws from p."""
    k = len(p)
    stay, alias = np.asarray(p, float) * (k / np.sum(p)), np.arange(k)
    small, large = [i for i in range(k) if stay[i] < 1], [i for i in range(k) if stay[i] >= 1]
    while small and large:
        s, g = small.pop(), large[-1]
        alias[s] = g
        stay[g] -= 1 - stay[s]
        if stay[g] < 1:
            small.append(large.pop())
    for i in small + large:
        stay[i] = 1.0
    return alias, stay


def alias_draw(alias: np.ndarray, stay: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    at = rng.integers(0, len(alias), n)
    return np.where(rng.random(n) < stay[at], at, alias[at])


def alias_counts(alias: np.ndarray, stay: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    return np.bincount(alias_draw(alias, stay, n, rng), minlength=len(alias))


def round_binomially(p: float, n: int, rng: np.random.Generator) -> int:
    whole = int(np.floor(p))
    return whole * n + int(rng.binomial(n, p - whole))


def count_successes(n: int, p: float, rng: np.random.Generator) -> int:
    return int(rng.binomial(n, p))


def pivotal_segments(df: DataFrame, segment: str, n: str, value: str = "v", order: str = "det", seed: int = 0) -> DataFrame:
    """Pivotal sampling inside segments with an integer budget column; a `new` column of +-norm/n, other rows go.

    Segments are bounded parts of a vector (see `pivotal_compress`), each a task's work.
    """
    kept = [c for c in df.columns]
    schema = df.withColumn("new", F.lit(0.0)).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        w = pdf[value].abs().to_numpy(float)
        budget = int(pdf[n].iloc[0])
        hit = pivotal(w, budget, generator(seed, int(pdf[segment].iloc[0])))
        out = pdf[hit].copy()
        out["new"] = np.sign(out[value].to_numpy(float)) * (w.sum() / budget if budget else 0.0)
        return out[[*kept, "new"]]

    return df.where(F.col(value) != 0).groupBy(segment).applyInPandas(run, schema)


def pivotal_compress(df: DataFrame, m: int, value: str = "v", order: str = "det", seed: int = 0, rows_per_part: int = 100_000) -> DataFrame:
    """Preservation, then pivotal sampling in parts of bounded size: at most m rows, unbiased, in column `value`.

    Budgets for the parts are whole numbers by pivotal rounding on the driver (one number a part); inside a part the
    probabilities are adjusted to add up to its budget.
    """
    p: Preserved = preserve(df, m, value)
    kept = p.df.where("keep").withColumn("new", F.col(value).cast("double"))
    names = [c for c in df.columns if c != value]
    if p.n_left == 0:
        return kept.select(*names, F.col("new").alias(value))
    rows = p.df.where(~F.col("keep") & (F.col(value) != 0))
    parts = max(1, -(-rows.count() // rows_per_part))
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(order), F.lit(parts)).cast("int"))
    norms = {r["__part"]: float(r["n"]) for r in rows.groupBy("__part").agg(F.sum(F.abs(value)).alias("n")).collect()}
    keys = sorted(norms)
    budget = dict(zip(keys, pivotal_budget(np.array([norms[k] for k in keys]), p.n_left, generator(seed, 0)).tolist(), strict=True))
    unit = p.rest / p.n_left
    schema = rows.drop("__part", "keep").withColumn("new", F.lit(0.0)).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        part = int(pdf["__part"].iloc[0])
        want = pdf[value].abs().to_numpy(float) / unit
        given = adjust_probabilities(want, budget[part])
        hit = pivotal(given, int(round(given.sum())), generator(seed, 1, part)) if budget[part] else np.zeros(len(pdf), bool)
        out = pdf[hit].copy()
        # a row drawn with another probability than its own carries its share accordingly, so that means are kept
        out["new"] = np.sign(out[value].to_numpy(float)) * unit * np.where(given[hit] > 0, want[hit] / given[hit], 0.0)
        return out.drop(columns=["__part", "keep"])

    drawn = rows.groupBy("__part").applyInPandas(run, schema)
    return kept.select(*names, "new").unionByName(drawn.select(*names, "new")).withColumnRenamed("new", value)


def compress_columns(vec: DataFrame, values: list[str], m: int, how: str = "pivotal", seed: int = 0, key: str = "det", pinned: str | None = None) -> DataFrame:
    """Compress several columns one by one; rows that are zero in all of them go, unless pinned."""
    from .compress import compress

    out = None
    for i, v in enumerate(values):
        one = vec.where(F.col(v) != 0).select(key, v)
        if how == "pivotal":
            small = pivotal_compress(one, m, v, key, seed + i)
        elif how == "systematic":
            r = float(generator(seed, i).random())
            small = compress(one.withColumn(v, F.col(v).cast("double")), m, v, [key], r)
        elif how == "multinomial":
            small = multinomial(one, m, v, key, seed + i)
        else:
            raise ValueError(how)
        small = small.select(key, v)
        out = small if out is None else out.join(small, key, "full")
    rest = [c for c in vec.columns if c not in values and c != key]
    if rest:
        out = vec.select(key, *rest).join(out, key, "left")
        if pinned is None:
            out = out.where(" or ".join(f"{v} is not null" for v in values))
        else:
            out = out.where(F.col(pinned) | F.expr(" or ".join(f"{v} is not null" for v in values)))
    return out.select(key, *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values], *rest)


def multinomial(vec: DataFrame, n: int, value: str = "v", key: str = "det", seed: int = 0, rows_per_part: int = 100_000) -> DataFrame:
    """n independent draws by |v|: draws for each part by one alias table on the driver, then for its rows by another."""
    rows = vec.where(F.col(value) != 0)
    parts = max(1, -(-rows.count() // rows_per_part))
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    norms = {r["__part"]: float(r["n"]) for r in rows.groupBy("__part").agg(F.sum(F.abs(value)).alias("n")).collect()}
    if not norms:
        return vec.select(key, F.col(value).cast("double").alias(value))
    keys, total = sorted(norms), sum(norms.values())
    draws = dict(zip(keys, alias_counts(*alias_table(np.array([norms[k] for k in keys])), n, generator(seed, 2)).tolist(), strict=True))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        part = int(pdf["__part"].iloc[0])
        v = pdf[value].to_numpy(float)
        hits = alias_counts(*alias_table(np.abs(v)), draws[part], generator(seed, 3, part))
        out = pd.DataFrame({key: pdf[key], value: np.sign(v) * hits * (total / n)})
        return out[hits > 0]

    kind = vec.schema[key].dataType.simpleString()
    return rows.groupBy("__part").applyInPandas(run, f"{key} {kind}, {value} double")


def alias_sample(df: DataFrame, group: str, state: str, p: str, n: int, seed: int = 0) -> DataFrame:
    """Counts of n alias draws among the states of each group; a group is one distribution."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(state, kind="stable")
        got = alias_counts(*alias_table(pdf[p].to_numpy(float)), n, generator(seed, int(pdf[group].iloc[0])))
        return pd.DataFrame({group: pdf[group], state: pdf[state], "n_drawn": got})

    g, s = df.schema[group].dataType.simpleString(), df.schema[state].dataType.simpleString()
    return df.groupBy(group).applyInPandas(run, f"{group} {g}, {state} {s}, n_drawn long")


def cumulative(df: DataFrame, group: str, state: str, p: str) -> DataFrame:
    """Inverse-transform form of an alias table: upper bound of each state's share, for range joins."""
    w = W.partitionBy(group)
    return df.withColumn("upto", F.sum(p).over(w.orderBy(state).rowsBetween(W.unboundedPreceding, 0)) / F.sum(p).over(w))
