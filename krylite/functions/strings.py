"""Bit-string functions on Python integers of any width: references, driver-side constants, bodies of samplers."""

from __future__ import annotations

from itertools import combinations


def from_bytes(*raw: int) -> int:
    """Byte 0 first."""
    return int.from_bytes(bytes(raw), "little")


def to_bytes(det: int, n: int) -> bytes:
    return det.to_bytes(n, "little")


def positions(det: int) -> list[int]:
    out = []
    while det:
        low = det & -det
        out.append(low.bit_length() - 1)
        det ^= low
    return out


def ones_between(det: int, a: int, b: int) -> int:
    lo, hi = min(a, b), max(a, b)
    return 0 if hi <= lo else ((det & ((1 << hi) - 1)) >> (lo + 1)).bit_count()


def hf_string(n_orb: int, n_elec: int) -> int:
    half = (1 << (n_elec // 2)) - 1
    return half | half << n_orb


def neel_string(n_sites: int, n_elec: int) -> int:
    """Electrons from site 0 on, spins alternating: alpha on even sites, beta on odd ones."""
    det = 0
    for site in range(n_elec):
        det |= 1 << (site + (n_sites if site % 2 else 0))
    return det


def flip_spins(det: int, n_orb: int) -> int:
    mask = (1 << n_orb) - 1
    return (det & mask) << n_orb | det >> n_orb & mask


def excitation(a: int, b: int) -> tuple[int, list[int]] | None:
    """How many orbitals moved and which, left ones first; None for more than two."""
    left, to = positions(a & ~b), positions(b & ~a)
    return (len(left), left + to) if len(left) <= 2 else None


def single(det: int, i: int, a: int) -> tuple[int, int]:
    """New key and parity."""
    return det & ~(1 << i) | 1 << a, 1 - 2 * (ones_between(det, i, a) & 1)


def double(det: int, i: int, j: int, a: int, b: int) -> tuple[int, int]:
    """New key and parity, for i < j and a < b."""
    core = det & ~(1 << i) & ~(1 << j)
    return core | 1 << a | 1 << b, 1 - 2 * (ones_between(core, i, a) + ones_between(core, j, b) & 1)


def sign_in_list(i: int, virt: int, occ: list[int]) -> int:
    """Parity of moving the electron in orbital i to virt, from the list of occupied orbitals."""
    lo, hi = min(i, virt), max(i, virt)
    return 1 - 2 * (sum(lo < o < hi for o in occ) & 1)


def nth_virtual(occ: list[int], spin: int, n_orb: int, n: int) -> int | None:
    free = [k for k in range(spin * n_orb, (spin + 1) * n_orb) if k not in set(occ)]
    return free[n] if 0 <= n < len(free) else None


def nth_virtual_of_irrep(det: int, irreps: list[int], irrep: int, spin: int, n: int) -> int | None:
    n_orb = len(irreps)
    free = [k + spin * n_orb for k in range(n_orb) if irreps[k] == irrep and not det >> (k + spin * n_orb) & 1]
    return free[n] if 0 <= n < len(free) else None


def flip_connection(det: int, n_orb: int) -> tuple[int, list[int]]:
    """0 identical to its spin flip, 1 joined by a double excitation (with the alpha and beta orbitals), 2 neither."""
    mask = (1 << n_orb) - 1
    a, b = det & mask, det >> n_orb & mask
    left, right = positions(a & ~b), positions(b & ~a)
    if not left:
        return 0, []
    return (1, [left[0], right[0] + n_orb]) if len(left) == 1 else (2, [])


def sites(det: int, n_sites: int, electrons: int) -> list[int]:
    mask = (1 << n_sites) - 1
    a, b = det & mask, det >> n_sites & mask
    if electrons == 2:
        return positions(a & b)
    return positions(a & ~b) + [s + n_sites for s in positions(b & ~a)]


def movable(det: int, n_sites: int) -> tuple[list[int], list[int]]:
    """Spin orbitals whose electron can hop right, and left, on an open chain."""
    right = [k for k in positions(det) if k % n_sites != n_sites - 1 and not det >> (k + 1) & 1]
    left = [k for k in positions(det) if k % n_sites and not det >> (k - 1) & 1]
    return right, left


def hops(det: int, n_sites: int) -> list[tuple[int, int]]:
    right, left = movable(det, n_sites)
    return [(k, k + 1) for k in right] + [(k, k - 1) for k in left]


def phonons(det: int, n_sites: int, bits: int) -> list[int]:
    """Phonon numbers in the bits above the electrons."""
    return [det >> (2 * n_sites + s * bits) & ((1 << bits) - 1) for s in range(n_sites)]


def change_phonon(det: int, n_sites: int, bits: int, site: int, by: int) -> int | None:
    """The key with one phonon more or less at a site; None out of range."""
    n = phonons(det, n_sites, bits)[site] + by
    return det + (by << (2 * n_sites + site * bits)) if 0 <= n < 1 << bits else None


def all_strings(n_orb: int, n_alpha: int, n_beta: int) -> list[int]:
    half = lambda n: [sum(1 << k for k in c) for c in combinations(range(n_orb), n)]
    return sorted(a | b << n_orb for a in half(n_alpha) for b in half(n_beta))
