"""Bit-string functions on LONG keys of up to 63 bits, all inside whole-stage code generation.

A key holds alpha spin orbitals in its low `n_orb` bits and beta ones in the next `n_orb`. `functions.strings` has the
same functions on Python integers of any width.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOr = Column | str | int


def col(x: ColumnOr) -> Column:
    return F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x


def shl(x: ColumnOr, n: ColumnOr) -> Column:
    return F.call_function("shiftleft", col(x).cast("long"), col(n).cast("int"))


def shr(x: ColumnOr, n: ColumnOr) -> Column:
    return F.call_function("shiftrightunsigned", col(x).cast("long"), col(n).cast("int"))


def bit(k: ColumnOr) -> Column:
    return shl(F.lit(1).cast("long"), k)


def low_mask(n: ColumnOr) -> Column:
    """n ones."""
    return bit(n) - 1


def read_bit(det: ColumnOr, k: ColumnOr) -> Column:
    return shr(det, k).bitwiseAND(1).cast("int")


def set_bit(det: ColumnOr, k: ColumnOr) -> Column:
    return col(det).bitwiseOR(bit(k))


def zero_bit(det: ColumnOr, k: ColumnOr) -> Column:
    return col(det).bitwiseAND(F.bitwise_not(bit(k)))


def positions(det: ColumnOr, n_bits: int) -> Column:
    """Positions of set bits, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(n_bits - 1)), lambda k: read_bit(det, k) == 1)


def empty_positions(det: ColumnOr, first: int, last: int) -> Column:
    """Positions of clear bits in [first, last)."""
    return F.filter(F.sequence(F.lit(first), F.lit(last - 1)), lambda k: read_bit(det, k) == 0)


def diff_positions(a: ColumnOr, b: ColumnOr, n_bits: int, most: int = 4) -> Column:
    """Positions where the keys differ; null if there are more than `most`."""
    x = col(a).bitwiseXOR(col(b))
    return F.when(F.bit_count(x) <= most, positions(x, n_bits))


def ones_between(det: ColumnOr, a: ColumnOr, b: ColumnOr) -> Column:
    """Set bits strictly between two positions, in either order."""
    lo, hi = F.least(col(a), col(b)), F.greatest(col(a), col(b))
    return F.when(lo == hi, 0).otherwise(F.bit_count(col(det).bitwiseAND(low_mask(hi)).bitwiseAND(F.bitwise_not(low_mask(lo + 1)))))


def sign_of(count: Column) -> Column:
    return 1 - 2 * (count % 2)


def excite_sign(det: ColumnOr, cre: ColumnOr, des: ColumnOr) -> Column:
    return sign_of(ones_between(det, cre, des))


def single(det: ColumnOr, i: ColumnOr, a: ColumnOr) -> Column:
    return set_bit(zero_bit(det, i), a)


def single_parity(det: ColumnOr, i: ColumnOr, a: ColumnOr) -> Column:
    return excite_sign(det, a, i)


def double(det: ColumnOr, i: ColumnOr, j: ColumnOr, a: ColumnOr, b: ColumnOr) -> Column:
    return set_bit(set_bit(zero_bit(zero_bit(det, i), j), a), b)


def double_parity(det: ColumnOr, i: ColumnOr, j: ColumnOr, a: ColumnOr, b: ColumnOr) -> Column:
    """For i < j and a < b: both occupied bits are cleared, then the ones between i, a and between j, b are counted."""
    core = zero_bit(zero_bit(det, i), j)
    return sign_of(ones_between(core, i, a) + ones_between(core, j, b))


def flip_spins(det: ColumnOr, n_orb: int) -> Column:
    mask = (1 << n_orb) - 1
    return shl(col(det).bitwiseAND(F.lit(mask)), n_orb).bitwiseOR(shr(det, n_orb).bitwiseAND(F.lit(mask)))


def excitation_level(a: ColumnOr, b: ColumnOr) -> Column:
    """0, 1 or 2 orbitals moved; null for more."""
    n = F.bit_count(col(a).bitwiseXOR(col(b)).bitwiseAND(col(a)))
    return F.when(n <= 2, n)


def excitation(a: ColumnOr, b: ColumnOr, n_bits: int) -> Column:
    """Orbitals left, then orbitals entered; null for more than two moved."""
    x = col(a).bitwiseXOR(col(b))
    left, to = positions(x.bitwiseAND(col(a)), n_bits), positions(x.bitwiseAND(col(b)), n_bits)
    return F.when(excitation_level(a, b).isNotNull(), F.concat(left, to))


def replace_sorted(orbs: ColumnOr, old: ColumnOr, new: ColumnOr) -> Column:
    """A sorted list with one entry replaced."""
    return F.array_sort(F.concat(F.filter(col(orbs), lambda x: x != col(old)), F.array(col(new))))


def nth_virtual(det: ColumnOr, spin: ColumnOr, n: ColumnOr, n_orb: int) -> Column:
    """The nth (from 0) empty orbital of a spin; null if there is none."""
    virt = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n_orb - 1)), lambda k: k + col(spin) * n_orb), lambda k: read_bit(det, k) == 0)
    return F.get(virt, col(n))


def flip_connection(det: ColumnOr, n_orb: int) -> Column:
    """Whether a key and its spin flip are joined: 0 identical, 1 by a double excitation, 2 not."""
    mask = F.lit((1 << n_orb) - 1)
    alpha, beta = col(det).bitwiseAND(mask), shr(det, n_orb).bitwiseAND(mask)
    return F.least(F.bit_count(alpha.bitwiseAND(F.bitwise_not(beta))), F.lit(2))


def doubly_occupied(det: ColumnOr, n_sites: int) -> Column:
    mask = F.lit((1 << n_sites) - 1)
    return F.bit_count(col(det).bitwiseAND(shr(det, n_sites)).bitwiseAND(mask))


def sites(det: ColumnOr, n_sites: int, occupied_by: int) -> Column:
    """Sites with exactly one (1) or two (2) electrons. Singly occupied ones come as spin orbitals."""
    if occupied_by == 2:
        return F.filter(F.sequence(F.lit(0), F.lit(n_sites - 1)), lambda k: (read_bit(det, k) + read_bit(det, k + n_sites)) == 2)
    return F.filter(F.sequence(F.lit(0), F.lit(2 * n_sites - 1)), lambda k: (read_bit(det, k) == 1) & (read_bit(det, (k + n_sites) % (2 * n_sites)) == 0))


def hex_key(det: ColumnOr) -> Column:
    return F.lower(F.hex(col(det)))


def triangular(i: ColumnOr, j: ColumnOr, with_diagonal: bool = True) -> Column:
    """Packed index of i <= j (or i < j)."""
    j = col(j)
    return ((j * (j + 1) if with_diagonal else j * (j - 1)) / 2).cast("long") + col(i)


def uniform(*keys: ColumnOr, seed: int = 0) -> Column:
    """A uniform number in [0, 1) that depends on the keys and the seed only, so that tasks may be run again."""
    return shr(F.xxhash64(*[col(k) for k in keys], F.lit(seed)), 11).cast("double") / float(1 << 53)
