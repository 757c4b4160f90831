import numpy as np
import pytest
from pyspark.sql import functions as F

from krylite.operators import compress as C
from krylite.operators import samplers as Z
from krylite.operators import vector as V


def greedy(v, m):
    """Keep the largest while it is at least what is left on average."""
    order = np.argsort(-np.abs(v), kind="stable")
    rest, kept = np.abs(v).sum(), []
    for i in order:
        if len(kept) < m and abs(v[i]) * (m - len(kept)) >= rest - 1e-12 and abs(v[i]) > 0:
            kept.append(int(i))
            rest -= abs(v[i])
        else:
            break
    return set(kept)


def frame(spark, v):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "det long, v double")


def test_preserve_equals_greedy(spark):
    rng = np.random.default_rng(1)
    for k in range(6):
        v = rng.normal(size=80) ** (2 * (k % 3) + 1)
        p = C.preserve(frame(spark, v), 25)
        kept = {r.det for r in p.df.where("keep").collect()}
        assert kept == greedy(v, 25) and p.n_left == 25 - len(kept)


def test_preserve_ends_on_equal_magnitudes(spark):
    """Rows that equal the threshold but for rounding aren't taken and left in turns."""
    for v, m in (([0.1] * 7 + [0.3] * 3, 10), ([1 / 3] * 28, 28), ([0.1] * 60 + [0.7, 0.2, 0.2], 40), ([5.0] * 4, 4), ([0.0, 0.0], 3)):
        p = C.preserve(frame(spark, v), m)
        kept = p.df.where("keep").count()
        assert kept + p.n_left <= m and (p.rows, len(greedy(v, m)) <= m) == (sum(x > 0 for x in v), True)


def test_systematic_equals_sequential(spark):
    rng = np.random.default_rng(2)
    v, r = rng.normal(size=300) ** 3, 0.37
    p = C.preserve(frame(spark, v), 60)
    got = {x.det: x.new for x in C.systematic(p, r=r).collect()}
    kept = greedy(v, 60)
    unit, tick, at, want = p.rest / p.n_left, 0, 0.0, {}
    for i, x in enumerate(v):
        if i in kept:
            want[i] = x
            continue
        at += abs(x)
        if (r + tick) * unit < at:
            want[i] = np.sign(x) * unit
            tick += 1
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_identity_when_target_is_large(spark):
    v = np.random.default_rng(3).normal(size=50)
    df = frame(spark, v)
    for out in (C.compress(df, 60), Z.pivotal_compress(df, 60), C.compress(df.withColumn("v", F.col("v") * 0), 10)):
        got = {r.det: r.v for r in out.collect()}
        assert not got or got == {i: x for i, x in enumerate(v)}
    assert C.compress(df.limit(0), 5).count() == 0 and C.preserve(df, 0).n_left == 0


def test_means_are_kept(spark):
    v = np.array([5.0, -3, 2, 1, 1, -1, 0.5, 0.5, -0.25, 0.25])
    rng = np.random.default_rng(4)
    n = 4000
    total = np.zeros(len(v))
    for _ in range(n):
        hit = Z.pivotal(np.abs(v[2:]), 3, rng)
        assert hit.sum() == 3
        total[2:] += hit
    p = np.abs(v[2:]) * 3 / np.abs(v[2:]).sum()
    assert np.abs(total[2:] / n - p).max() < 5 * np.sqrt(0.25 / n)


def test_pivotal_columns_are_unbiased(spark):
    v = np.random.default_rng(5).normal(size=40)
    df = frame(spark, v)
    runs = [{r.det: r.v for r in Z.pivotal_compress(df, 15, seed=s).collect()} for s in range(25)]
    assert all(len(x) <= 15 for x in runs)
    mean = np.mean([sum(x.values()) for x in runs])
    spread = np.std([sum(x.values()) for x in runs]) / 5
    assert abs(mean - v.sum()) < 5 * spread + 1e-9


def test_budgets():
    rng = np.random.default_rng(6)
    norms = np.array([1.0, 2.5, 0.0, 7.25])
    total = np.zeros(4)
    for _ in range(3000):
        b = Z.pivotal_budget(norms, 7, rng)
        assert b.sum() == 7
        total += b
    assert np.abs(total / 3000 - norms * 7 / norms.sum()).max() < 0.05
    p = Z.adjust_probabilities(np.array([0.9, 0.8, 0.7, 0.1]), 3)
    assert abs(p.sum() - 3) < 1e-9 and p.max() <= 1


def test_alias():
    p = np.array([0.10125, 0.05625, 0.0875, 0.03, 0.095, 0.05375, 0.095, 0.0875, 0.0625, 0.33125])
    got = Z.alias_counts(*Z.alias_table(p), 300_000, np.random.default_rng(7))
    assert np.abs(got / 300_000 - p).max() < 3e-3


def test_binomial_rounding():
    rng = np.random.default_rng(8)
    x = [Z.round_binomially(2.3, 10, rng) for _ in range(4000)]
    assert min(x) >= 20 and max(x) <= 30 and abs(np.mean(x) - 23) < 0.2


def test_multinomial(spark):
    v = np.random.default_rng(9).normal(size=30)
    got = Z.multinomial(frame(spark, v), 200, seed=1).collect()
    assert abs(sum(abs(r.v) for r in got) - np.abs(v).sum()) < 1e-9
    assert all(np.sign(r.v) == np.sign(v[r.det]) for r in got)


def test_hierarchical_identity(spark):
    df = spark.createDataFrame([(1, 2.0, [0.5, 0.25, 0.25], 0), (2, -1.0, [1.0], 3), (3, 0.0, [1.0], 0)], "row long, v double, w array<double>, k int")
    got = {(r.row, r.sub): round(r.new, 9) for r in C.hierarchical(df, 100, "w", n_div="k").collect()}
    assert got == {(1, 0): 1.0, (1, 1): 0.5, (1, 2): 0.5, (2, 0): round(-1 / 3, 9), (2, 1): round(-1 / 3, 9), (2, 2): round(-1 / 3, 9)}


def test_shift():
    assert C.adjust_shift(0.0, 5.0, 0.0, 10.0, 1.0) == (0.0, 0.0)
    assert C.adjust_shift(0.0, 11.0, 0.0, 10.0, 1.0) == (0.0, 11.0)
    s, last = C.adjust_shift(0.0, 22.0, 11.0, 10.0, 2.0)
    assert abs(s + 2 * np.log(2)) < 1e-12 and last == 22.0


def test_merge(spark):
    one = spark.createDataFrame([(0b00010001, 1.0), (0b00010001, 1.0), (0b00100001, -1.0), (0b00100001, -1.0), (3, 0.0)], "det long, v double")
    got = {r.det: r.v for r in V.merge(one.limit(0), one).collect()}
    assert got == {0b00010001: 2.0, 0b00100001: -2.0}


def test_electron_check(spark):
    from krylite.schemas import check_electrons

    df = spark.createDataFrame([(3,), (7,)], "det long")
    assert check_electrons(df.where("det = 3"), 2).count() == 1
    with pytest.raises(Exception, match="BadKey"):
        check_electrons(df, 2).collect()


def test_prefix_over_ranges(spark):
    rows = [(int(i), int(x)) for i, x in enumerate(np.random.default_rng(10).integers(0, 9, 500))]
    df = spark.createDataFrame(rows, "k long, x long").repartition(6)
    got = {r.k: r.cum for r in C.with_prefix(df, ["k"], F.col("x"), ranges=8).collect()}
    assert got == dict(enumerate(np.cumsum([x for _, x in rows]).tolist()))


def test_gram_schmidt(spark):
    x = np.random.default_rng(11).normal(size=(30, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "det long, v0 double, v1 double")
    got = V.gram_schmidt(df, ["v0", "v1"]).toPandas()[["v0", "v1"]].to_numpy()
    assert np.allclose(got.T @ got, np.eye(2))
