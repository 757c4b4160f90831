"""Heat-bath Power-Pitzer factorisation: an excitation is drawn orbital by orbital, with weights from integral sums.

The tensors depend on the molecule only and travel with the tasks. Weights of one stage are arrays beside each row; a
stage is a hierarchical compression over the rows' children, so at most m rows live between stages and no row is
expanded into all of its excitations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import strings
from .compress import hierarchical
from .molecule import Molecule
from .samplers import alias_draw, alias_table, generator, pivotal_compress


@dataclass(frozen=True)
class Tensors:
    """d_same (pairs of one spin), d_diff (pairs of both), s (row sums), exchange roots with the diagonal in place."""

    d_same: np.ndarray
    d_diff: np.ndarray
    s: np.ndarray
    exchange: np.ndarray

    @property
    def s_norm(self) -> float:
        return float(self.s.sum())

    @property
    def exchange_norms(self) -> np.ndarray:
        return self.exchange.sum(1)


def tensors(mol: Molecule) -> Tensors:
    n = mol.n_orb
    phys = mol.eri.transpose(0, 2, 1, 3)  # <ij|ab> = (ia|jb)
    i, j, a, b = np.ogrid[:n, :n, :n, :n]
    d_diff = np.where((i != a) & (j != b), np.abs(phys), 0).sum((2, 3))
    apart = (a != i) & (a != j) & (b != i) & (b != j) & (b < a)
    d_same = np.where(apart, 2 * np.abs(phys - phys.transpose(0, 1, 3, 2)), 0).sum((2, 3))
    np.fill_diagonal(d_same, 0)
    s = d_same.sum(1) + d_diff.sum(1)
    k = np.arange(n)
    return Tensors(d_same, d_diff, s, np.sqrt(np.abs(mol.eri[k[:, None], k[None], k[None], k[:, None]])))


def tensor_tables(two_body: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same sums by aggregation over a table of <pq|rs>: d_diff(p, q), d_same(p < q), s(p)."""
    x = two_body.select("p", "q", "r", "s", "val")
    d_diff = x.where("p <> r and q <> s").groupBy("p", "q").agg(F.sum(F.abs("val")).alias("d"))
    swapped = x.select("p", "q", F.col("r").alias("s"), F.col("s").alias("r"), F.col("val").alias("other"))
    pairs = x.where("p < q and s < r and r <> p and r <> q and s <> p and s <> q").join(swapped, ["p", "q", "r", "s"])
    d_same = pairs.groupBy("p", "q").agg((2 * F.sum(F.abs(F.col("val") - F.col("other")))).alias("d"))
    both = d_same.select("p", "d").unionByName(d_same.select(F.col("q").alias("p"), "d")).unionByName(d_diff.select("p", "d"))
    return d_diff, d_same, both.groupBy("p").agg(F.sum("d").alias("s"))


def normalised(w: np.ndarray) -> np.ndarray:
    total = w.sum()
    return w / total if total > 0 else w


def o1_weights(t: Tensors, n_orb: int, occ: list[int], exclude_first: bool = False) -> tuple[np.ndarray, float]:
    """Weights of the first electron and the sum over them relative to all orbitals."""
    w = t.s[np.array(occ[1:] if exclude_first else occ) % n_orb]
    return normalised(w), float(w.sum() / t.s_norm)


def o2_weights(t: Tensors, n_orb: int, occ: list[int], o1: int, half: bool = False) -> tuple[np.ndarray, float]:
    """Weights of the second electron; with `half`, only of those before the first."""
    o = np.array(occ)
    w = np.where(o // n_orb == o1 // n_orb, t.d_same[o1 % n_orb, o % n_orb], t.d_diff[o1 % n_orb, o % n_orb])
    w = np.where((o == o1) | (half & (o >= o1)), 0, w)
    return normalised(w), float(w.sum() / t.s[o1 % n_orb]) if t.s[o1 % n_orb] else 0.0


def u1_weights(t: Tensors, n_orb: int, det: int, o1: int) -> tuple[np.ndarray, float]:
    """Weights of the first virtual, by spin-free orbital of o1's spin."""
    free = np.array([not det >> (k + o1 // n_orb * n_orb) & 1 for k in range(n_orb)])
    w = np.where(free, t.exchange[o1 % n_orb], 0)
    return normalised(w), float(w.sum() / t.exchange_norms[o1 % n_orb])


def u2_weights(t: Tensors, irreps: list[int], det: int, o1: int, o2: int, u1: int, half: bool = False) -> tuple[np.ndarray, float]:
    """Weights of the second virtual: of the irrep that the other three require, empty, of o2's spin, not u1."""
    n = len(irreps)
    need = irreps[o1 % n] ^ irreps[o2 % n] ^ irreps[u1 % n]
    same = o1 // n == o2 // n
    ok = np.array([irreps[k] == need and not det >> (k + o2 // n * n) & 1 and not (same and k == u1 % n) and not (half and same and k > u1 % n) for k in range(n)])
    w = np.where(ok, t.exchange[o2 % n], 0)
    return normalised(w), float(w.sum() / t.exchange_norms[o2 % n])


def unnormalised_weight(t: Tensors, n_orb: int, o1: int, o2: int, u1: int, u2: int) -> float:
    same = o1 // n_orb == o2 // n_orb
    o1, o2, u1, u2 = (x % n_orb for x in (o1, o2, u1, u2))
    d = (t.d_same if same else t.d_diff)[o1, o2]
    return float(d * t.exchange[o1, u1] * t.exchange[o2, u2] / t.s_norm / t.exchange_norms[o1] / t.exchange_norms[o2])


def path_weight(t: Tensors, irreps: list[int], det: int, occ: list[int], o1: int, o2: int, u1: int, u2: int) -> float:
    n = len(irreps)
    a = o1_weights(t, n, occ)[0][occ.index(o1)]
    b = o2_weights(t, n, occ, o1)[0][occ.index(o2)]
    c = u1_weights(t, n, det, o1)[0][u1 % n]
    return float(a * b * c * u2_weights(t, irreps, det, o1, o2, u1)[0][u2 % n])


def total_weight(t: Tensors, irreps: list[int], det: int, i: int, j: int, a: int, b: int) -> float:
    """Probability of a double by any order of its choices."""
    n, occ = len(irreps), strings.positions(det)
    if i // n == j // n:
        return sum(path_weight(t, irreps, det, occ, *x) for x in ((i, j, a, b), (i, j, b, a), (j, i, a, b), (j, i, b, a)))
    if a // n != i // n:
        a, b = b, a
    return path_weight(t, irreps, det, occ, i, j, a, b) + path_weight(t, irreps, det, occ, j, i, b, a)


def draw_doubles(t: Tensors, irreps: list[int], det: int, n_draws: int, rng: np.random.Generator) -> list[tuple[int, int, int, int, float]]:
    """Multinomial form: independent draws (i < j, a, b, probability) by alias tables at each level."""
    n, occ = len(irreps), strings.positions(det)
    w1, norm = o1_weights(t, n, occ)
    out = []
    if norm <= 0:
        return out
    for x in alias_draw(*alias_table(w1), n_draws, rng):
        o1 = occ[int(x)]
        w2, s2 = o2_weights(t, n, occ, o1)
        if s2 <= 0:
            continue
        o2 = occ[int(alias_draw(*alias_table(w2), 1, rng)[0])]
        w3, s3 = u1_weights(t, n, det, o1)
        if s3 <= 0:
            continue
        u1 = int(alias_draw(*alias_table(w3), 1, rng)[0]) + o1 // n * n
        w4, s4 = u2_weights(t, irreps, det, o1, o2, u1)
        if s4 <= 0:
            continue
        u2 = int(alias_draw(*alias_table(w4), 1, rng)[0]) + o2 // n * n
        (i, a), (j, b) = sorted(((o1, u1), (o2, u2)))
        out.append((i, j, a, b, total_weight(t, irreps, det, i, j, a, b)))
    return out


def double_probability(mol: Molecule) -> float:
    """Share of doubles among the reference's excitations."""
    from .near_uniform import allowed_occupied, first_virtuals

    det, occ = mol.reference, strings.positions(mol.reference)
    singles = sum(len(v) for _, v in allowed_occupied(det, mol.irreps))
    doubles = sum(sum(p for _, p in first_virtuals(det, i, j, mol.irreps)) / 2 for x, j in enumerate(occ) for i in occ[:x])
    return doubles / (singles + doubles)


def apply(vec: DataFrame, mol: Molecule, t: Tensors, m: int, p_doub: float, how: str = "systematic", seed: int = 0, unit_elements: bool = False) -> DataFrame:
    """Compressed off-diagonal H v: rows (det, det2, i, j, a, b, el), at most about m of them.

    Five stages: single or double; first electron; second electron (or the single's virtual); first virtual; second
    virtual. Each stage multiplies by its conditional probabilities and compresses to m rows. At the end a sample is
    divided by the probability of its excitation in any order and multiplied by the matrix element and the parity.
    With `unit_elements` all elements count 1, so that, where nothing needs compressing, every sample adds up to |v|.
    """
    n, irreps = mol.n_orb, mol.irreps

    def stage(df: DataFrame, weights, columns: list[str], number: int) -> DataFrame:
        """Children of each row by the weights that `weights(det, *chosen)` gives; the chosen child is `sub`."""

        @F.pandas_udf("array<double>")
        def shares(rows: pd.DataFrame) -> pd.Series:
            return pd.Series([list(map(float, weights(*map(int, x)))) for x in rows[columns].itertuples(index=False)])

        df = df.withColumn("w", shares(F.struct(*columns)))
        if how == "systematic":
            r = float(generator(seed, number).random())
            got = hierarchical(df, m, "w", "v", "row", r=r)
        else:
            parts = df.select("*", F.posexplode("w").alias("sub", "__w")).withColumn("v", F.col("v") * F.col("__w")).where("v <> 0").withColumn("__order", F.xxhash64("row", "sub"))
            got = pivotal_compress(parts.drop("__w"), m, "v", "__order", seed + number).withColumn("new", F.col("v"))
        return got.select(*[c for c in df.columns if c not in ("w", "v")], "sub", F.col("new").alias("v")).where(F.col("v") != 0)

    def singles_of(det: int) -> list[int]:
        from .near_uniform import allowed_occupied

        return [o for o, _ in allowed_occupied(det, irreps)]

    def virtuals_of(det: int, o: int) -> list[int]:
        return [k + o // n * n for k in range(n) if irreps[k] == irreps[o % n] and not det >> (k + o // n * n) & 1]

    def uniform(k: int) -> list[float]:
        return [1.0 / k] * k

    rows = vec.where("v <> 0").select("det", F.col("v").cast("double").alias("v"))
    with_id = lambda df, *cols: df.withColumn("row", F.xxhash64(*cols))
    one = stage(with_id(rows, "det"), lambda det: [1 - p_doub, p_doub] if singles_of(det) else [0.0, 1.0], ["det"], 1).withColumnRenamed("sub", "kind")
    # a single's last two stages have one child each
    two = stage(with_id(one, "det", "kind"), lambda det, kind: uniform(len(singles_of(det))) if kind == 0 else o1_weights(t, n, strings.positions(det))[0], ["det", "kind"], 2).withColumnRenamed("sub", "x1")

    def third(det: int, kind: int, x1: int):
        if kind == 0:
            return uniform(len(virtuals_of(det, singles_of(det)[x1])))
        occ = strings.positions(det)
        return o2_weights(t, n, occ, occ[x1])[0]

    three = stage(with_id(two, "det", "kind", "x1"), third, ["det", "kind", "x1"], 3).withColumnRenamed("sub", "x2")

    def fourth(det: int, kind: int, x1: int):
        return [1.0] if kind == 0 else u1_weights(t, n, det, strings.positions(det)[x1])[0]

    four = stage(with_id(three, "det", "kind", "x1", "x2"), fourth, ["det", "kind", "x1"], 4).withColumnRenamed("sub", "x3")

    def fifth(det: int, kind: int, x1: int, x2: int, x3: int):
        if kind == 0:
            return [1.0]
        occ = strings.positions(det)
        return u2_weights(t, irreps, det, occ[x1], occ[x2], x3 + occ[x1] // n * n)[0]

    five = stage(with_id(four, "det", "kind", "x1", "x2", "x3"), fifth, ["det", "kind", "x1", "x2", "x3"], 5).withColumnRenamed("sub", "x4")

    def finish(batches):
        for pdf in batches:
            out = []
            for det, v, kind, x1, x2, x3, x4 in pdf.itertuples(index=False):
                occ = strings.positions(det)
                if kind == 0:
                    allowed = singles_of(det)
                    i, virt = allowed[x1], virtuals_of(det, allowed[x1])
                    a = virt[x2]
                    p = (1 - p_doub) / len(allowed) / len(virt)
                    d, sign = strings.single(det, i, a)
                    el = 1.0 if unit_elements else sign * mol.single_element(i, a, occ)
                    out.append((det, d, i, i, a, a, v / p * el))
                else:
                    o1, o2 = occ[x1], occ[x2]
                    u1, u2 = x3 + o1 // n * n, x4 + o2 // n * n
                    (i, a), (j, b) = sorted(((o1, u1), (o2, u2)))
                    if i // n == j // n and a > b:
                        a, b = b, a
                    p = total_weight(t, irreps, det, i, j, a, b) * (p_doub if singles_of(det) else 1.0)
                    d, sign = strings.double(det, i, j, a, b)
                    el = 1.0 if unit_elements else sign * float(mol.double_element(i, j, a, b))
                    out.append((det, d, i, j, a, b, v / p * el))
            yield pd.DataFrame(out, columns=["det", "det2", "i", "j", "a", "b", "el"])

    done = five.select("det", "v", "kind", "x1", "x2", "x3", "x4").mapInPandas(finish, "det long, det2 long, i int, j int, a int, b int, el double")
    return done.groupBy("det", "det2", "i", "j", "a", "b").agg(F.sum("el").alias("el"))


def o1_table(df: DataFrame, s: DataFrame, n_orb: int, det: str = "det") -> DataFrame:
    """det, o1 and its weight, by a join with the row sums (one row an orbital)."""
    occ = df.select(det, F.explode(B.positions(det, 2 * n_orb)).alias("o1")).withColumn("p", F.col("o1") % n_orb)
    got = occ.join(F.broadcast(s), "p")
    total = got.groupBy(det).agg(F.sum("s").alias("total"))
    return got.join(total, det).select(det, "o1", (F.col("s") / F.col("total")).alias("weight"))


def o2_table(df: DataFrame, d_same: DataFrame, d_diff: DataFrame, n_orb: int, det: str = "det", o1: str = "o1") -> DataFrame:
    """det, o1, o2 and its weight given o1, by joins with the pair sums (at most n_orb ** 2 rows each)."""
    occ = df.select(det, o1, F.explode(B.positions(det, 2 * n_orb)).alias("o2")).where(F.col("o2") != F.col(o1))
    one_spin = (F.col(o1) / n_orb).cast("int") == (F.col("o2") / n_orb).cast("int")
    x, y = F.col(o1) % n_orb, F.col("o2") % n_orb
    occ = occ.withColumn("p", F.when(one_spin, F.least(x, y)).otherwise(x)).withColumn("q", F.when(one_spin, F.greatest(x, y)).otherwise(y)).withColumn("same", one_spin)
    sums = d_same.select("p", "q", "d", F.lit(True).alias("same")).unionByName(d_diff.select("p", "q", "d", F.lit(False).alias("same")))
    got = occ.join(F.broadcast(sums), ["p", "q", "same"])
    total = got.groupBy(det, o1).agg(F.sum("d").alias("total"))
    return got.join(total, [det, o1]).select(det, o1, "o2", (F.col("d") / F.col("total")).alias("weight"))


def u1_table(df: DataFrame, exchange: DataFrame, n_orb: int, det: str = "det", o1: str = "o1") -> DataFrame:
    """det, o1, u1 and its weight given o1: empty orbitals of o1's spin by exchange roots (p, q, root)."""
    base = (F.col(o1) / n_orb).cast("int") * n_orb
    free = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n_orb - 1)), lambda k: k + base), lambda k: B.read_bit(det, k) == 0)
    virt = df.select(det, o1, F.explode(free).alias("u1")).withColumn("p", F.col(o1) % n_orb).withColumn("q", F.col("u1") % n_orb)
    got = virt.join(F.broadcast(exchange), ["p", "q"])
    total = got.groupBy(det, o1).agg(F.sum("root").alias("total"))
    return got.join(total, [det, o1]).select(det, o1, "u1", (F.col("root") / F.col("total")).alias("weight"))
