"""Stochastic compression: exact preservation, systematic resampling, hierarchical forms, budgets and controls.

What several passes read is written once. Prefix sums are two-level: keys are cut into ranges, more of them for more rows,
the ranges' sums are accumulated over a table with a row per range, and inside a range a window runs. No window spans the
vector.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import scratch

#: What is left counts as nothing under these.
REST_NONE = 1e-9
SUB_REST_NONE = 1e-8
SUB_TINY = 1e-12
#: Rows of a vector that one window runs over.
FEW_ROWS = 20_000


@dataclass(frozen=True)
class Preserved:
    """Rows with a boolean `keep`; how many samples and how much norm are left for the others."""

    df: DataFrame
    n_left: int
    rest: float | int
    norm: float | int
    rows: int = 0


def head_start(sizes: DataFrame, m: int, size: str) -> tuple[int, float | int, float | int, int]:
    """(kept, rest, norm, rows) of a set of large rows that the fixed point keeps for sure.

    One aggregate gives count and sum by quarters of powers of two (a few thousand at most). The threshold of the rows
    from some size on being at most that size, the falling threshold can't stop above it.
    """
    bucket = F.floor(F.log2(F.col(size).cast("double")) * 4).cast("int")
    found = sizes.where(F.col(size) > 0).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.sum(size).alias("s")).collect()
    found.sort(key=lambda r: r["b"])
    norm = sum(r["s"] for r in found)
    kept, rest, best = sum(r["n"] for r in found), 0, (0, norm)
    rows = kept
    for r in found:  # from the smallest on; the rows of this bucket and above are kept
        if kept < m and rest / (m - kept) <= 2.0 ** (r["b"] / 4) * (1 - 1e-9):
            best = (kept, rest)
            break
        kept, rest = kept - r["n"], rest + r["s"]
    return *best, norm, rows


def preserve(df: DataFrame, m: int, value: str = "v") -> Preserved:
    """Mark the rows with |v| >= rest / (m - kept), by the fixed point of a falling threshold.

    The rows are written once. One aggregate by magnitudes brings the threshold close to its end, and a few more passes
    over one column settle it. Equal magnitudes are kept or not together. Integer values are compared exactly.
    """
    size = F.abs(F.col(value))
    whole = df.schema[value].dataType.typeName() in ("long", "integer", "short", "byte")
    df = scratch(df.where(F.col(value).isNotNull()), "preserve")
    kept, rest, norm, rows = head_start(df.select(size.alias("__size")), m, "__size")
    cut = None  # the threshold that the kept rows were counted by
    while m > kept and rest > 0:
        new = Fraction(rest, m - kept) if whole else rest / (m - kept)
        if cut is not None and new >= cut:  # it falls no more; rounding may even raise it past rows that equal it
            break
        over = size * F.lit(new.denominator) >= F.lit(new.numerator) if whole else size >= F.lit(new)
        k, t = df.agg(F.sum(over.cast("long")), F.sum(F.when(~over, size))).first()
        k, t = k or 0, t or 0
        if k >= m:  # every sample is taken by a kept row
            return Preserved(df.withColumn("keep", over), 0, t, norm, rows)
        kept, rest, cut = k, t, new
    if m <= 0:
        return Preserved(df.withColumn("keep", F.lit(False)), 0, rest, norm, rows)
    left = 0 if rest < REST_NONE else m - kept
    if kept == 0:
        keep = F.lit(False)
    elif rest == 0:
        keep = size > 0
    else:
        keep = over
    return Preserved(df.withColumn("keep", keep), left, rest, norm, rows)


def range_tree(key: Column, bounds: list, lo: int = 0, hi: int | None = None) -> Column:
    """Number of the range that holds a key, as a balanced tree of comparisons."""
    hi = len(bounds) if hi is None else hi
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(key < F.lit(bounds[mid]), range_tree(key, bounds, lo, mid)).otherwise(range_tree(key, bounds, mid + 1, hi))


def with_prefix(df: DataFrame, order: list[str], amount: Column, name: str = "cum", rows: int = 0, ranges: int | None = None) -> DataFrame:
    """Inclusive prefix sums of `amount` in the order given, over ranges of the first order column: 64, or one for half a
    million rows up to 512. `rows`, if it is known to be at most FEW_ROWS, makes do with one."""
    df = df.withColumn("__amount", amount)
    if ranges is None and 0 < rows <= FEW_ROWS:
        alone = W.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(name, F.sum("__amount").over(alone)).drop("__amount")
    ranges = ranges or min(512, max(64, rows // 500_000))
    cuts = df.agg(F.percentile_approx(F.col(order[0]), [i / ranges for i in range(1, ranges)], max(1000, 10 * ranges))).first()[0] or []
    df = df.withColumn("__range", range_tree(F.col(order[0]), sorted(set(cuts))))
    sums = df.groupBy("__range").agg(F.sum("__amount").alias("__sum"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__range", "__before")
    inside = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    got = df.join(F.broadcast(before), "__range")  # at most `ranges` rows
    return got.withColumn(name, F.col("__before") + F.sum("__amount").over(inside)).drop("__range", "__before", "__amount")


def ticks_below(cum: Column, total: float | int, n: int, r: float, whole: bool) -> Column:
    """Sample ticks (r + k) * total / n, k = 0, 1, ..., below a prefix sum. Whole numbers with r = 1/2 stay exact."""
    if whole:
        if r != 0.5:
            raise ValueError("integer vectors are resampled with r = 1/2")
        t = int(total)
        # ceil(c * n / t - 1/2) without division: floor((2 c n - t + 2 t - 1) / (2 t))
        return F.greatest(F.lit(0).cast("long"), F.call_function("div", (2 * cum * F.lit(n) + F.lit(t - 1)).cast("long"), F.lit(2 * t).cast("long")))
    return F.greatest(F.lit(0).cast("long"), F.ceil(cum * F.lit(n / total) - F.lit(r)).cast("long"))


def with_ticks(df: DataFrame, order: list[str], amount: Column, total, n: int, r: float, whole: bool, rows: int = 0) -> DataFrame:
    """`hits`: how many ticks fall into each row's share of the prefix sum."""
    df = with_prefix(df, order, amount, "__c", rows).withColumn("__w", amount)
    upto = ticks_below(F.col("__c"), total, n, r, whole)
    below = df.withColumn("__upto", upto).withColumn("__c", F.col("__c") - F.col("__w"))
    return below.withColumn("hits", F.col("__upto") - ticks_below(F.col("__c"), total, n, r, whole)).drop("__c", "__w", "__upto")


def systematic(p: Preserved, value: str = "v", order: list[str] | None = None, r: float = 0.5) -> DataFrame:
    """Kept rows as they are; others become +-rest/n where a tick falls into them; the rest go."""
    order = order or ["det"]
    whole = p.df.schema[value].dataType.typeName() in ("long", "integer", "short", "byte")
    if p.n_left == 0:
        return p.df.where("keep").withColumn("new", F.col(value).cast("double"))
    amount = F.when(F.col("keep"), F.lit(0)).otherwise(F.abs(F.col(value)))
    got = with_ticks(p.df.where(F.col(value) != 0), order, amount, p.rest, p.n_left, r, whole, p.rows)
    unit = p.rest / p.n_left
    new = F.when(F.col("keep"), F.col(value).cast("double")).when(F.col("hits") > 0, F.signum(F.col(value).cast("double")) * F.lit(unit))
    return got.withColumn("new", new).where(F.col("new").isNotNull()).drop("hits")


def compress(df: DataFrame, m: int, value: str = "v", order: list[str] | None = None, r: float = 0.5) -> DataFrame:
    """Preservation, then systematic resampling: at most m rows, unbiased, in column `value`."""
    got = systematic(preserve(df, m, value), value, order, r)
    return got.drop(value, "keep").withColumnRenamed("new", value)


def systematic_segments(df: DataFrame, segment: list[str], n: Column, value: str, order: list[str], r: Column, magnitude: Column | None = None) -> DataFrame:
    """Systematic resampling inside segments; segments are bounded sub-problems (one row's children, one group).

    Ticks (r + k) * norm / n of each segment; a hit becomes +-magnitude (norm / n by default).
    """
    w = W.partitionBy(*segment)
    size = F.abs(F.col(value))
    got = df.where(F.col(value) != 0).withColumn("__g", F.sum(size).over(w)).withColumn("__c", F.sum(size).over(w.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    tick = lambda c: F.greatest(F.lit(0).cast("long"), F.ceil(c * n / F.col("__g") - r).cast("long"))
    hit = tick(F.col("__c")) > tick(F.col("__c") - size)
    unit = magnitude if magnitude is not None else F.col("__g") / n
    return got.where(hit).withColumn("new", F.signum(F.col(value).cast("double")) * unit).drop("__g", "__c")


def systematic_budget(df: DataFrame, part: str, norm: str, n: int, r: float = 0.5) -> DataFrame:
    """Samples for each part by ticks over the parts' norms; a row for each part."""
    whole = df.schema[norm].dataType.typeName() in ("long", "integer")
    total = df.agg(F.sum(norm)).first()[0]
    return with_ticks(df, [part], F.col(norm), total, n, r, whole).withColumnRenamed("hits", "budget")


def column_samples(df: DataFrame, n: int, value: str = "v", order: list[str] | None = None, r: float = 0.5) -> DataFrame:
    """How many matrix-column samples each row gets: ticks over |v|, more than one where the row is large."""
    whole = df.schema[value].dataType.typeName() in ("long", "integer")
    total = df.agg(F.sum(F.abs(value))).first()[0]
    return with_ticks(df, order or ["det"], F.abs(F.col(value)), total, n, r, whole).withColumnRenamed("hits", "n_walk")


def round_binomial(p: Column, u: Column) -> Column:
    """Stochastic rounding of one number: floor(p), plus 1 with the probability of its fraction."""
    return F.floor(p) + (u < p - F.floor(p)).cast("long")


def round_small(value: Column, u: Column, least: float = 1.0) -> Column:
    """Elements under `least` are rounded to 0 or +-least, unbiased; others stay."""
    up = (u * F.lit(least) < F.abs(value)).cast("double")
    return F.when(F.abs(value) < least, F.signum(value) * up * F.lit(least)).otherwise(value)


def children(df: DataFrame, weights: str | None, value: str = "v", n_div: str | None = None, row: str = "row") -> DataFrame:
    """(row, sub, child value) of rows that are cut uniformly (n_div > 0) or by an array of weights."""
    if n_div is None:
        return df.select(*[c for c in df.columns if c != weights], F.posexplode(weights).alias("sub", "__w")).withColumn("child", F.col(value) * F.col("__w")).drop("__w")
    share = F.when(F.col(n_div) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.col(n_div), F.lit(1))), lambda _: 1.0 / F.col(n_div)))
    if weights is not None:
        share = share.otherwise(F.col(weights))
    return df.select("*", F.posexplode(share).alias("sub", "__w")).withColumn("child", F.col(value) * F.col("__w")).drop("__w")


def hierarchical(df: DataFrame, m: int, weights: str | None, value: str = "v", row: str = "row", n_div: str | None = None, r: float = 0.5) -> DataFrame:
    """Compression of subdivided rows: (row, sub, new). Children of at most 1e-12 are never kept exactly."""
    parts = children(df, weights, value, n_div, row).where(F.col("child") != 0)
    p = preserve(parts, m, "child")
    if parts.schema["child"].dataType.typeName() == "double":
        p = Preserved(p.df.withColumn("keep", F.col("keep") & (F.abs("child") > SUB_TINY)), 0 if p.n_left == 0 or p.rest / p.n_left < SUB_REST_NONE else p.n_left, p.rest, p.norm, p.rows)
    return systematic(p, "child", [row, "sub"], r)


def hits_only(df: DataFrame, value: str = "new") -> DataFrame:
    """The expanded groups that still carry a value."""
    return df.where(F.col(value) != 0)


def adjust_shift(shift: float, norm: float, last: float, target: float, zeta: float) -> tuple[float, float]:
    """(new shift, norm to remember): S -= zeta * ln(N / N_last), once the norm has passed the target."""
    if last:
        return shift - zeta * math.log(norm / last), norm
    return (shift, norm) if norm >= target else (shift, 0.0)


def adjust_geometric(shift: float, norm: float, last: float, zeta: float) -> tuple[float, float]:
    return shift - zeta * math.log(norm / last) if last else shift, norm


def shift_series(norms: DataFrame, target: float, zeta: float, order: str = "iter", norm: str = "norm") -> DataFrame:
    """The shift after each row of a norm series: a running sum of log ratios from where the target is first passed.

    A trajectory is one bounded series per run; its window stays inside a run.
    """
    w = W.partitionBy("run").orderBy(order)
    on = F.max((F.col(norm) >= target).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)) == 1
    step = F.when(on, -F.lit(zeta) * F.log(F.col(norm) / F.lag(norm).over(w))).otherwise(0.0)
    return norms.withColumn("__step", step).withColumn("shift", F.sum("__step").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__step")
