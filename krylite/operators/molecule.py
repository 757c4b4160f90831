"""Molecular Hamiltonians on LONG keys (up to 31 orbitals).

Excitations are generated by native array expressions; matrix elements are sums over integral arrays, for a whole batch
at a time. The arrays go along with the tasks: at 31 orbitals, the most a key holds, they have 7.4 MB.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import strings


@dataclass
class Molecule:
    """Active space: frozen orbitals are folded into h and core. `eri` is in chemists' order (pq|rs)."""

    n_orb: int
    n_elec: int
    h: np.ndarray
    eri: np.ndarray
    irreps: list[int] = field(default_factory=list)
    core: float = 0.0

    def __post_init__(self) -> None:
        if 2 * self.n_orb > 63:
            raise ValueError("keys of this molecule need more than 63 bits")
        self.irreps = list(self.irreps) or [0] * self.n_orb
        if len(self.irreps) != self.n_orb or not all(0 <= x < 8 for x in self.irreps):
            raise ValueError("one irrep of 0..7 is needed for every orbital")

    @classmethod
    def with_frozen(cls, n_frozen: int, n_elec_total: int, h: np.ndarray, eri: np.ndarray, irreps: list[int], core: float = 0.0) -> Molecule:
        f = n_frozen // 2
        c = slice(0, f)
        a = slice(f, None)
        direct = np.einsum("ffpq->pq", eri[c, c][:, :, a, a]) if f else 0
        exchange = np.einsum("pffq->pq", eri[a, c][:, :, c, a]) if f else 0
        inner = 2 * np.trace(h[c, c]) + 2 * np.einsum("iijj", eri[c, c, c, c]) - np.einsum("ijji", eri[c, c, c, c]) if f else 0.0
        return cls(len(h) - f, n_elec_total - n_frozen, h[a, a] + 2 * direct - exchange, eri[a, a, a, a], list(irreps[f:] if len(irreps) == len(h) else irreps), core + float(inner))

    @property
    def reference(self) -> int:
        return strings.hf_string(self.n_orb, self.n_elec)

    def double_element(self, i, j, a, b) -> np.ndarray:
        """<ij|ab> - [one spin] <ij|ba>, without sign."""
        n = self.n_orb
        same = np.asarray(i) // n == np.asarray(j) // n
        i, j, a, b = (np.asarray(x) % n for x in (i, j, a, b))
        return self.eri[i, a, j, b] - np.where(same, self.eri[i, b, j, a], 0.0)

    def single_element(self, i: int, a: int, occ: list[int]) -> float:
        n = self.n_orb
        p, q, spin = i % n, a % n, i // n
        o = np.array([x for x in occ if x != i])
        s, same = o % n, o // n == spin
        return float(self.h[p, q] + self.eri[p, q, s, s].sum() - self.eri[p, s[same], s[same], q].sum())

    def diagonal(self, occ: list[int]) -> float:
        n = self.n_orb
        o = np.array(occ, int)
        s, spin = o % n, o // n
        direct = self.eri[s[:, None], s[:, None], s[None], s[None]]
        exchange = self.eri[s[:, None], s[None], s[None], s[:, None]] * (spin[:, None] == spin[None])
        return float(self.core + self.h[s, s].sum() + 0.5 * (direct - exchange).sum())

    def occupations(self, dets: np.ndarray) -> np.ndarray:
        """Rows of 0 and 1 by spin orbital."""
        return (np.asarray(dets, np.int64)[:, None] >> np.arange(2 * self.n_orb)) & 1

    def diagonals(self, dets: np.ndarray) -> np.ndarray:
        """diagonal() of many keys."""
        k = np.arange(self.n_orb)
        direct, exchange = self.eri[k[:, None], k[:, None], k[None], k[None]], self.eri[k[:, None], k[None], k[None], k[:, None]]
        pairs = np.block([[direct - exchange, direct], [direct, direct - exchange]])
        occ = self.occupations(dets).astype(float)
        return self.core + occ @ np.tile(self.h[k, k], 2) + 0.5 * ((occ @ pairs) * occ).sum(1)

    def single_elements(self, dets: np.ndarray, i: np.ndarray, a: np.ndarray) -> np.ndarray:
        """single_element() of many keys and moves."""
        n, k = self.n_orb, np.arange(self.n_orb)
        p, q, spin = i % n, a % n, i // n
        direct, exchange = self.eri[:, :, k, k][p, q], self.eri[:, k, k, :].transpose(0, 2, 1)[p, q]
        occ = self.occupations(dets)
        occ[np.arange(len(occ)), i] = 0
        both = occ.reshape(-1, 2, n)
        return self.h[p, q] + (both.sum(1) * direct).sum(1) - (both[np.arange(len(occ)), spin] * exchange).sum(1)

    def flip_adjusted_diagonal(self, det: int, parity: int) -> float:
        """Diagonal in the basis of spin-flip pairs: the partner's element joins in; odd self-conjugate keys give 0."""
        kind, orbs = strings.flip_connection(det, self.n_orb)
        d = self.diagonal(strings.positions(det))
        if kind == 0:
            return d if parity > 0 else 0.0
        if kind == 1:
            i, j = orbs
            a, b = j - self.n_orb, i + self.n_orb
            _, sign = strings.double(det, i, j, a, b)
            return d + parity * sign * float(self.double_element(i, j, a, b))
        return d


def irrep_of(mol_irreps: list[int], orb: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in mol_irreps]), orb % len(mol_irreps))


def singles(df: DataFrame, n_orb: int, irreps: list[int], det: str = "det") -> DataFrame:
    """Symmetry-allowed single excitations of each row: i, a, det2, sign."""
    occ = df.withColumn("i", F.explode(B.positions(det, 2 * n_orb)))
    spin = (F.col("i") / n_orb).cast("int")
    virt = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n_orb - 1)), lambda k: k + spin * n_orb), lambda k: (B.read_bit(det, k) == 0) & (irrep_of(irreps, k) == irrep_of(irreps, F.col("i"))))
    out = occ.withColumn("a", F.explode(virt))
    return out.withColumn("det2", B.single(det, "i", "a")).withColumn("sign", B.single_parity(det, "i", "a"))


def doubles(df: DataFrame, n_orb: int, irreps: list[int], det: str = "det") -> DataFrame:
    """Symmetry-allowed doubles i < j -> a < b of each row (alpha before beta where the spins differ): det2, sign.

    The last orbital is drawn from those of the irrep that the other three require, never filtered from all pairs.
    """
    out = df.withColumn("j", F.explode(B.positions(det, 2 * n_orb)))
    out = out.withColumn("i", F.explode(F.filter(B.positions(det, 2 * n_orb), lambda k: k < F.col("j"))))
    si, sj = (F.col("i") / n_orb).cast("int"), (F.col("j") / n_orb).cast("int")
    orbitals = lambda spin: F.transform(F.sequence(F.lit(0), F.lit(n_orb - 1)), lambda k: k + spin * n_orb)
    out = out.withColumn("a", F.explode(F.filter(orbitals(si), lambda k: B.read_bit(det, k) == 0)))
    need = irrep_of(irreps, F.col("i")).bitwiseXOR(irrep_of(irreps, F.col("j"))).bitwiseXOR(irrep_of(irreps, F.col("a")))
    by_irrep = F.array(*[F.array(*[F.lit(k) for k in range(n_orb) if irreps[k] == x]).cast("array<int>") for x in range(8)])
    last = F.filter(F.transform(F.get(by_irrep, need), lambda k: k + sj * n_orb), lambda k: (B.read_bit(det, k) == 0) & ((si != sj) | (k > F.col("a"))))
    out = out.withColumn("b", F.explode(last))
    return out.withColumn("det2", B.double(det, "i", "j", "a", "b")).withColumn("sign", B.double_parity(det, "i", "j", "a", "b"))


def count_doubles_without_symmetry(n_elec: int, n_orb: int) -> int:
    half, free = n_elec // 2, n_orb - n_elec // 2
    pairs = lambda k: k * (k - 1) // 2
    return 2 * pairs(half) * pairs(free) + half * half * free * free


def count_singles(n_orb: int, irreps: list[int], det: str = "det") -> Column:
    occ = B.positions(det, 2 * n_orb)
    free = lambda i: F.size(F.filter(F.transform(F.sequence(F.lit(0), F.lit(n_orb - 1)), lambda k: k + (i / n_orb).cast("int") * n_orb), lambda k: (B.read_bit(det, k) == 0) & (irrep_of(irreps, k) == irrep_of(irreps, i))))
    return F.aggregate(F.transform(occ, free), F.lit(0), lambda x, y: x + y)


def irrep_lookup(orbitals: DataFrame) -> DataFrame:
    """irrep and its orbitals in order, from a table (orb, irrep)."""
    return orbitals.groupBy("irrep").agg(F.sort_array(F.collect_list("orb")).alias("orbs"))


def nth_virtual_of_irrep(det: str, irreps: list[int], irrep: Column, spin: Column, n: Column) -> Column:
    k = len(irreps)
    virt = F.filter(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda o: o + spin * k), lambda o: (B.read_bit(det, o) == 0) & (irrep_of(irreps, o) == irrep))
    return F.get(virt, n)


def diagonal_of(mol: Molecule):
    @F.pandas_udf("double")
    def diag(det: pd.Series) -> pd.Series:
        return pd.Series(mol.diagonals(det.to_numpy(np.int64)))

    return diag


def flip_diagonal_of(mol: Molecule, parity: int):
    @F.pandas_udf("double")
    def diag(det: pd.Series) -> pd.Series:
        return det.map(lambda d: mol.flip_adjusted_diagonal(int(d), parity)).astype(float)

    return diag


def offdiagonal(df: DataFrame, mol: Molecule, det: str = "det") -> DataFrame:
    """Rows of `df` joined with their off-diagonal elements: det2, el (with sign)."""

    @F.pandas_udf("double")
    def of_single(d: pd.Series, i: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series(mol.single_elements(*(x.to_numpy(np.int64) for x in (d, i, a))))

    @F.pandas_udf("double")
    def of_double(i: pd.Series, j: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(mol.double_element(*(x.to_numpy(int) for x in (i, j, a, b))), dtype=float)

    one = singles(df, mol.n_orb, mol.irreps, det).withColumn("el", F.col("sign") * of_single(det, "i", "a"))
    two = doubles(df, mol.n_orb, mol.irreps, det).withColumn("el", F.col("sign") * of_double("i", "j", "a", "b"))
    return one.select(*df.columns, "det2", "el").unionByName(two.select(*df.columns, "det2", "el")).where(F.col("el") != 0)


def fold(det: str, value: Column, n_orb: int, parity: int) -> tuple[Column, Column]:
    """Time reversal: the smaller of a key and its spin flip, and the value in the basis of the pairs.

    A self-conjugate key is its own pair: it stays for even parity and gives 0 for odd.
    """
    flip = B.flip_spins(det, n_orb)
    key = F.least(F.col(det), flip)
    new = F.when(F.col(det) == flip, F.lit(1.0 if parity > 0 else 0.0)).when(F.col(det) < flip, F.sqrt(F.lit(0.5))).otherwise(F.lit(float(parity)) * F.sqrt(F.lit(0.5)))
    return key, value * new


def unfold(df: DataFrame, value: str, n_orb: int, parity: int, det: str = "det") -> DataFrame:
    """A vector over spin-flip pairs as one over single keys."""
    flip = B.flip_spins(det, n_orb)
    lone = F.col(det) == flip
    half = F.sqrt(F.lit(0.5))
    return df.select(det, F.when(lone, F.col(value)).otherwise(F.col(value) * half).alias(value)).unionByName(df.where(~lone).select(flip.alias(det), (F.col(value) * half * parity).alias(value)))


def multiply(df: DataFrame, mol: Molecule, value: str = "v", det: str = "det", parity: int | None = None) -> DataFrame:
    """H v without the core energy's shift; with a parity, keys stand for spin-flip pairs."""
    v = df.select(det, F.col(value).alias(value))
    if parity is not None:  # unfold, multiply, fold
        v = unfold(v, value, mol.n_orb, parity, det)
    off = offdiagonal(v, mol, det).select(F.col("det2").alias(det), (F.col("el") * F.col(value)).alias(value))
    own = v.select(det, (diagonal_of(mol)(det) * F.col(value)).alias(value))
    out = own.unionByName(off)
    if parity is not None:
        key, new = fold(det, F.col(value), mol.n_orb, parity)
        out = out.select(key.alias(det), new.alias(value))
    return out.groupBy(det).agg(F.sum(value).alias(value)).where(F.abs(value) > 0)


def one_electron(df: DataFrame, n_orb: int, des: int, cre: int, value: str = "v", det: str = "det") -> DataFrame:
    """sum over spins of a+_cre a_des applied to a vector."""
    out = None
    for s in (0, n_orb):
        i, a = des + s, cre + s
        if i == a:
            part = df.where(B.read_bit(det, i) == 1).select(det, F.col(value).cast("double").alias(value))
        else:
            part = df.where((B.read_bit(det, i) == 1) & (B.read_bit(det, a) == 0)).select(B.single(det, i, a).alias(det), (F.col(value) * B.single_parity(det, i, a)).cast("double").alias(value))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(det).agg(F.sum(value).alias(value))


def orbital_occupations(df: DataFrame, n_orb: int, value: str = "v", det: str = "det") -> DataFrame:
    """orb and the sum of v^2 of the keys that occupy it."""
    return df.select(F.explode(B.positions(det, 2 * n_orb)).alias("orb"), (F.col(value) * F.col(value)).alias("w")).groupBy("orb").agg(F.sum("w").alias("occupation"))


def h_dot(trial: DataFrame, vec: DataFrame, mol: Molecule, us: list[str], vs: list[str], det: str = "det") -> DataFrame:
    """<u_i| H |v_j> for all pairs, by applying H to the (small) trial side only: i, j, dot."""
    from .vector import batched_dot

    parts = [multiply(trial.where(F.col(u) != 0).select(det, u), mol, u, det) for u in us]
    hu = parts[0]
    for p in parts[1:]:
        hu = hu.join(p, det, "full")
    return batched_dot(hu.na.fill(0.0), vec, us, vs, det)


def dense_block(spark, keys: DataFrame, mol: Molecule, eps: float) -> DataFrame:
    """(src, dst, -eps * H) between the keys of a deterministic subspace."""
    rows = offdiagonal(keys.select("det"), mol)
    return rows.join(keys.select(F.col("det").alias("det2")), "det2", "left_semi").select(F.col("det").alias("src"), F.col("det2").alias("dst"), (F.col("el") * -eps).alias("val"))


def exact_matrix(mol: Molecule, keys: list[int] | None = None) -> tuple[list[int], np.ndarray]:
    """The whole Hamiltonian of a small molecule, for checks."""
    half = mol.n_elec // 2
    keys = keys or strings.all_strings(mol.n_orb, half, mol.n_elec - half)
    at = {k: i for i, k in enumerate(keys)}
    out = np.zeros((len(keys), len(keys)))
    n = mol.n_orb
    for k, x in at.items():
        occ = strings.positions(k)
        out[x, x] = mol.diagonal(occ)
        virt = [o for o in range(2 * n) if not k >> o & 1]
        for i in occ:
            for a in virt:
                if i // n == a // n:
                    d, s = strings.single(k, i, a)
                    if d in at:
                        out[at[d], x] = s * mol.single_element(i, a, occ)
        for jj, j in enumerate(occ):
            for i in occ[:jj]:
                for bb, b in enumerate(virt):
                    for a in virt[:bb]:
                        if i // n == a // n and j // n == b // n:
                            d, s = strings.double(k, i, j, a, b)
                            if d in at:
                                out[at[d], x] = s * float(mol.double_element(i, j, a, b))
    return keys, out
