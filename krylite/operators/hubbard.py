"""Open-chain Hubbard-Holstein model on LONG keys: 2 * n_sites electron bits, then ph_bits phonon bits a site.

H = -t sum of hops + U n_doubly + omega n_phonons + g sum_i n_i (b_i + b_i^+). Neighbouring orbitals of one spin are
neighbouring bits, so hops carry no sign.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import strings


@dataclass(frozen=True)
class Chain:
    n_sites: int
    n_elec: int
    u: float = 0.0
    t: float = 1.0
    g: float = 0.0
    omega: float = 0.0
    ph_bits: int = 0
    e_ref: float = 0.0

    def __post_init__(self) -> None:
        if self.n_sites * (2 + self.ph_bits) > 63:
            raise ValueError("keys of this chain need more than 63 bits")

    @property
    def reference(self) -> int:
        return strings.neel_string(self.n_sites, self.n_elec)

    @property
    def electrons(self) -> int:
        return (1 << (2 * self.n_sites)) - 1

    def diagonal(self, det: str = "det") -> Column:
        el = B.doubly_occupied(det, self.n_sites)
        out = F.lit(self.u) * el
        return out + F.lit(self.omega) * self.total_phonons(det) if self.ph_bits else out

    def phonons(self, det: str = "det") -> Column:
        mask = (1 << self.ph_bits) - 1
        return F.array(*[B.shr(det, 2 * self.n_sites + s * self.ph_bits).bitwiseAND(F.lit(mask)) for s in range(self.n_sites)])

    def total_phonons(self, det: str = "det") -> Column:
        return F.aggregate(self.phonons(det), F.lit(0).cast("long"), lambda a, b: a + b)


def movable(det: str, n_sites: int) -> tuple[Column, Column]:
    """Keys of orbitals whose electron can hop right, and left, with open ends."""
    half = (1 << n_sites) - 1
    last, first = 1 << (n_sites - 1), 1
    d = F.col(det).bitwiseAND(F.lit((1 << (2 * n_sites)) - 1))
    no_last = half ^ last | (half ^ last) << n_sites
    no_first = half ^ first | (half ^ first) << n_sites
    right = d.bitwiseAND(F.bitwise_not(B.shr(d, 1))).bitwiseAND(F.lit(no_last))
    left = d.bitwiseAND(F.bitwise_not(B.shl(d, 1))).bitwiseAND(F.lit(no_first))
    return right, left


def hop_list(det: str, n_sites: int) -> Column:
    """(des, cre) of every hop, those to the right first."""
    right, left = movable(det, n_sites)
    move = lambda key, by: F.transform(B.positions(key, 2 * n_sites), lambda k: F.struct(k.alias("des"), (k + by).alias("cre")))
    return F.concat(move(right, 1), move(left, -1))


def hops(df: DataFrame, n_sites: int, det: str = "det") -> DataFrame:
    """One row for each row and hop, with des, cre and the new key det2."""
    out = df.withColumn("__hop", F.explode(hop_list(det, n_sites))).select(*df.columns, "__hop.*")
    return out.withColumn("det2", B.single(det, "des", "cre"))


def hop_at(det: str, n_sites: int, index: Column) -> Column:
    """The index-th hop of a key; null out of range."""
    return F.get(hop_list(det, n_sites), index)


def sampled_hops(df: DataFrame, n_sites: int, n: int, seed: int, det: str = "det") -> DataFrame:
    """n uniform hops of each row with their probability, drawn by a hash of key and draw number."""
    all_hops = hop_list(det, n_sites)
    draws = df.withColumn("__n", F.size(all_hops)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pick = F.floor(B.uniform(det, "draw", seed=seed) * F.col("__n")).cast("int")
    return draws.where("__n > 0").withColumn("__hop", F.get(all_hops, pick)).select(*df.columns, "draw", "__hop.*", (1.0 / F.col("__n")).alias("prob"))


def phonon_moves(df: DataFrame, chain: Chain, det: str = "det") -> DataFrame:
    """One row for each row, occupied site and direction: by (+1 or -1), det2 and the element g * n_i * sqrt(n)."""
    n, bits = chain.n_sites, chain.ph_bits
    moves = F.array(*[F.struct(F.lit(s).alias("site"), F.lit(by).alias("by")) for s in range(n) for by in (1, -1)])
    out = df.withColumn("__m", F.explode(moves)).select(*df.columns, "__m.*")
    occ = B.read_bit(det, F.col("site")) + B.read_bit(det, F.col("site") + n)
    have = B.shr(det, F.col("site") * bits + 2 * n).bitwiseAND(F.lit((1 << bits) - 1))
    out = out.withColumn("__occ", occ).withColumn("__ph", have)
    out = out.where((F.col("__occ") > 0) & (F.col("__ph") + F.col("by") >= 0) & (F.col("__ph") + F.col("by") < (1 << bits)))
    moved = F.col(det) + B.shl(F.lit(1), F.col("site") * bits + 2 * n) * F.col("by")
    size = F.sqrt(F.greatest(F.col("__ph"), F.col("__ph") + F.col("by")).cast("double"))
    return out.withColumn("det2", moved).withColumn("el", F.lit(chain.g) * F.col("__occ") * size).drop("__occ", "__ph")


def offdiagonal(df: DataFrame, chain: Chain, det: str = "det") -> DataFrame:
    """Rows of `df` joined with their off-diagonal elements: det2, el."""
    out = hops(df, chain.n_sites, det).withColumn("el", F.lit(-chain.t)).select(*df.columns, "det2", "el")
    if chain.g and chain.ph_bits:
        out = out.unionByName(phonon_moves(df, chain, det).select(*df.columns, "det2", "el"))
    return out


def multiply(df: DataFrame, chain: Chain, value: str = "v", det: str = "det") -> DataFrame:
    """H v: (det, v). Off-diagonal rows are summed map-side before they move; zero results are kept out."""
    off = offdiagonal(df.select(det, value), chain, det).select(F.col("det2").alias(det), (F.col("el") * F.col(value)).alias(value))
    own = df.select(det, (chain.diagonal(det) * F.col(value)).alias(value))
    return own.unionByName(off).groupBy(det).agg(F.sum(value).alias(value)).where(F.col(value) != 0)


def reference_overlap(df: DataFrame, chain: Chain, value: str = "v", det: str = "det") -> DataFrame:
    """One row: the vector's overlap with -H/t applied to the reference: hops count 1, phonons on occupied sites -g/t."""
    spark = df.sparkSession
    ref = spark.createDataFrame([(chain.reference,)], f"{det} long")
    near = offdiagonal(ref, chain, det).select(F.col("det2").alias(det), (F.col("el") / F.lit(-chain.t)).alias("__w"))
    return df.join(F.broadcast(near), det).agg(F.coalesce(F.sum(F.col(value) * F.col("__w")), F.lit(0.0)).alias("overlap"))  # at most 4 n_sites rows


def states(spark, chain: Chain) -> DataFrame:
    """Every key with half of the electrons of each spin and no phonons."""
    half, n = chain.n_elec // 2, chain.n_sites
    ok = (F.bit_count(F.col("id").bitwiseAND(F.lit((1 << n) - 1))) == half) & (F.bit_count(B.shr("id", n)) == half)
    return spark.range(1 << (2 * n)).where(ok).select(F.col("id").alias("det"))
