"""Near-uniform excitation sampling: multinomial draws of allowed singles and doubles with their probabilities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import strings
from .samplers import generator


def virtual_counts(det: str, irreps: list[int]) -> Column:
    """Empty orbitals for each irrep and spin, as an array at irrep * 2 + spin."""
    n = len(irreps)
    cell = lambda x, s: F.lit(0) if not (orbs := [k + s * n for k in range(n) if irreps[k] == x]) else sum((1 - B.read_bit(det, k) for k in orbs), F.lit(0))
    return F.array(*[cell(x, s) for x in range(8) for s in (0, 1)])


def counts_of(det: int, irreps: list[int]) -> list[list[int]]:
    n = len(irreps)
    out = [[0, 0] for _ in range(8)]
    for s in (0, 1):
        for k in range(n):
            out[irreps[k]][s] += not det >> (k + s * n) & 1
    return out


def allowed_occupied(det: int, irreps: list[int]) -> list[tuple[int, list[int]]]:
    """Occupied orbitals that have an allowed single excitation, and its virtuals."""
    n, out = len(irreps), []
    for i in strings.positions(det):
        virt = [k + i // n * n for k in range(n) if irreps[k] == irreps[i % n] and not det >> (k + i // n * n) & 1]
        if virt:
            out.append((i, virt))
    return out


def first_virtuals(det: int, i: int, j: int, irreps: list[int]) -> list[tuple[int, int]]:
    """Allowed first virtuals of a pair and how many partners each has."""
    n = len(irreps)
    spins = sorted({i // n, j // n})
    product = irreps[i % n] ^ irreps[j % n]
    count = counts_of(det, irreps)
    same = i // n == j // n
    out = []
    for s in spins:
        other = s if same else 1 - s
        for k in range(n):
            if not det >> (k + s * n) & 1:
                partners = count[product ^ irreps[k]][other] - (product == 0 and same)
                if partners > 0:
                    out.append((k + s * n, partners))
    return out


def draw_doubles(det: int, irreps: list[int], n_draws: int, rng: np.random.Generator) -> list[tuple[int, int, int, int, float]]:
    """(i, j, a, b, probability): a uniform occupied pair, a uniform allowed virtual, a uniform partner; draws of pairs
    without any are dropped."""
    n, occ = len(irreps), strings.positions(det)
    out = []
    pairs = len(occ) * (len(occ) - 1) // 2
    known: dict = {}
    for _ in range(n_draws):
        x, y = sorted(rng.choice(len(occ), 2, replace=False))
        i, j = occ[x], occ[y]
        if (i, j) not in known:
            known[i, j] = dict(first_virtuals(det, i, j, irreps))
        first = known[i, j]
        if not first:
            continue
        a = int(rng.choice(list(first)))
        spin = (i // n) ^ (j // n) ^ (a // n)
        irrep = irreps[i % n] ^ irreps[j % n] ^ irreps[a % n]
        partners = [k + spin * n for k in range(n) if irreps[k] == irrep and not det >> (k + spin * n) & 1 and k + spin * n != a]
        b = int(rng.choice(partners))
        p = (1 / first[a] + 1 / first[b]) / (pairs * len(first))
        out.append((i, j, min(a, b), max(a, b), p))
    return out


def draw_singles(det: int, irreps: list[int], n_draws: int, rng: np.random.Generator) -> list[tuple[int, int, float]]:
    allowed = allowed_occupied(det, irreps)
    out = []
    for _ in range(n_draws if allowed else 0):
        i, virt = allowed[int(rng.integers(len(allowed)))]
        out.append((i, int(rng.choice(virt)), 1 / (len(virt) * len(allowed))))
    return out


DRAWN = "det long, v double, n_walk long, det2 long, i int, j int, a int, b int, prob double, sign int"


def spawn(df: DataFrame, irreps: list[int], p_doub: float, seed: int) -> DataFrame:
    """n_walk draws for each row (det, v, n_walk): singles or doubles (i, a twice for singles), with probability and sign.

    Draws depend on the key and the seed only. Samples of a row are consecutive; rows are read in batches.
    """
    names = [x.split()[0] for x in DRAWN.split(", ")]
    kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches):
        for b in batches:
            rows = []
            for det, v, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not n:
                    continue
                rng = generator(seed, det)
                two = int(rng.binomial(n, p_doub))
                for i, j, a, c, p in draw_doubles(det, irreps, two, rng):
                    d, s = strings.double(det, i, j, a, c) if i // len(irreps) == a // len(irreps) else strings.double(det, i, j, c, a)
                    x, y = (a, c) if i // len(irreps) == a // len(irreps) else (c, a)
                    rows.append((det, v, n, d, i, j, x, y, p * p_doub, s))
                for i, a, p in draw_singles(det, irreps, n - two, rng):
                    d, s = strings.single(det, i, a)
                    rows.append((det, v, n, d, i, i, a, a, p * (1 - p_doub), s))
            cols = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], schema=schema)

    return df.select("det", F.col("v").cast("double").alias("v"), F.col("n_walk").cast("long").alias("n_walk")).mapInArrow(run, DRAWN)
