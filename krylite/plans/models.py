"""The protocol that a Hamiltonian offers to the methods, for chains and molecules."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from ..operators import heat_bath, hubbard, molecule, near_uniform
from ..operators.samplers import generator


class Model(Protocol):
    reference: int

    def diagonal(self) -> Column: ...

    def offdiagonal(self, df: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class ChainModel:
    chain: hubbard.Chain

    @property
    def reference(self) -> int:
        return self.chain.reference

    def diagonal(self) -> Column:
        return self.chain.diagonal("det")

    def offdiagonal(self, df: DataFrame) -> DataFrame:
        return hubbard.offdiagonal(df, self.chain)

    def sampled(self, df: DataFrame, m: int, seed: int) -> DataFrame:
        """Two stages of systematic compression: electron or phonon, then which move. (det, v, det2, el): el carries v."""
        from ..operators.compress import hierarchical

        c = self.chain
        hops = F.size(hubbard.hop_list("det", c.n_sites))
        rows = df.select("det", F.col("v").cast("double").alias("v"), F.xxhash64("det").alias("row"))
        if c.g and c.ph_bits:
            total = c.t + c.g
            kinds = rows.withColumn("w", F.array(F.lit(c.t / total), F.lit(c.g / total)))
            kinds = hierarchical(kinds, m, "w", r=float(generator(seed, 1).random())).select("det", "sub", F.col("new").alias("v"), F.lit(total).alias("scale"))
        else:
            kinds = rows.select("det", F.lit(0).alias("sub"), "v", F.lit(c.t).alias("scale"))
        electron = kinds.where("sub = 0").drop("sub").withColumn("n_div", hops).where("n_div > 0").withColumn("row", F.xxhash64("det"))
        hit = hierarchical(electron, m, None, n_div="n_div", r=float(generator(seed, 2).random()))
        hop = F.get(hubbard.hop_list("det", c.n_sites), F.col("sub"))
        moved = hit.withColumn("hop", hop)
        out = moved.select("det", B.single("det", F.col("hop.des"), F.col("hop.cre")).alias("det2"), (-F.col("new") * F.col("scale") * F.col("n_div")).alias("el"))
        if c.g and c.ph_bits:
            moves = hubbard.phonon_moves(kinds.where("sub = 1").select("det", "v", "scale"), c)
            out = out.unionByName(moves.select("det", "det2", (F.col("v") * F.col("el") / F.lit(c.g) * F.col("scale")).alias("el")))
        return out


@dataclass(frozen=True)
class MoleculeModel:
    mol: molecule.Molecule
    e_ref: float = 0.0

    @property
    def reference(self) -> int:
        return self.mol.reference

    def diagonal(self) -> Column:
        return molecule.diagonal_of(self.mol)("det") - F.lit(self.e_ref)

    def offdiagonal(self, df: DataFrame) -> DataFrame:
        return molecule.offdiagonal(df, self.mol)

    def element(self) -> object:
        mol = self.mol

        @F.pandas_udf("double")
        def el(det: pd.Series, i: pd.Series, j: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
            d, p, q, r, s = (x.to_numpy(np.int64) for x in (det, i, j, a, b))
            return pd.Series(np.where(p == q, mol.single_elements(d, p, r), mol.double_element(p, q, r, s)))

        return el

    def drawn(self, df: DataFrame, p_doub: float, seed: int, how: str = "near_uniform") -> DataFrame:
        """Multinomial draws for rows (det, v, n_walk): det, v, n_walk, det2, prob, el (signed)."""
        if how == "near_uniform":
            got = near_uniform.spawn(df, self.mol.irreps, p_doub, seed)
        else:
            got = heat_bath_spawn(df, self.mol, p_doub, seed)
        return got.withColumn("el", F.col("sign") * self.element()("det", "i", "j", "a", "b"))


def heat_bath_spawn(df: DataFrame, mol: molecule.Molecule, p_doub: float, seed: int) -> DataFrame:
    import pyarrow as pa

    from ..functions import strings

    t, irreps, n = heat_bath.tensors(mol), mol.irreps, mol.n_orb
    names = [x.split()[0] for x in near_uniform.DRAWN.split(", ")]
    kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32()]

    def run(batches):
        for b in batches:
            rows = []
            for det, v, walks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not walks:
                    continue
                rng = generator(seed, det)
                two = int(rng.binomial(walks, p_doub))
                for i, j, a, c, p in heat_bath.draw_doubles(t, irreps, det, two, rng):
                    if i // n == j // n and a > c:
                        a, c = c, a
                    d, s = strings.double(det, i, j, a, c)
                    rows.append((det, v, walks, d, i, j, a, c, p * p_doub, s))
                for i, a, p in near_uniform.draw_singles(det, irreps, walks - two, rng):
                    d, s = strings.single(det, i, a)
                    rows.append((det, v, walks, d, i, i, a, a, p * (1 - p_doub), s))
            cols = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return df.select("det", F.col("v").cast("double").alias("v"), F.col("n_walk").cast("long").alias("n_walk")).mapInArrow(run, near_uniform.DRAWN)
