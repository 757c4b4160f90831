import random

import pytest
from pyspark.sql import functions as F

from krylite.functions import bits as B
from krylite.functions import strings as S


def test_between():
    d = S.from_bytes(0xC0, 0x38, 0x02)
    assert [S.ones_between(d, a, b) for a, b in ((1, 7), (14, 2), (1, 3), (18, 12))] == [1, 5, 0, 2]


def test_reference_strings():
    assert S.to_bytes(S.hf_string(11, 18), 3) == bytes([255, 249, 15])
    assert S.to_bytes(S.hf_string(18, 20), 5) == bytes([255, 3, 252, 15, 0])
    assert S.to_bytes(S.hf_string(24, 10), 6) == bytes([31, 0, 0, 31, 0, 0])
    assert S.to_bytes(S.hf_string(26, 10), 7) == bytes([31, 0, 0, 124, 0, 0, 0])
    assert S.hf_string(4, 2) == 0b00010001
    assert S.to_bytes(S.neel_string(6, 6), 2) == bytes([0b10010101, 0b1010])
    assert S.neel_string(2, 2) == 0b1001
    assert S.to_bytes(S.neel_string(8, 8), 2) == bytes([0b01010101, 0b10101010])
    assert S.neel_string(4, 4) == 0b10100101
    assert S.to_bytes(S.neel_string(20, 8), 5) == bytes([85, 0, 160, 10, 0])


@pytest.mark.parametrize("n,a,b", [(8, (0xCC, 0x33), (0x33, 0xCC)), (4, (0xC3,), (0x3C,)), (12, (0xF1, 0xE1, 0x07), (0x7E, 0x10, 0x1F)), (6, (0x0B, 0x0E), (0xF8, 0x02))])
def test_flip(spark, n, a, b):
    assert S.flip_spins(S.from_bytes(*a), n) == S.from_bytes(*b)
    assert spark.range(1).select(B.flip_spins(F.lit(S.from_bytes(*a)), n)).first()[0] == S.from_bytes(*b)


def test_excitations():
    hf = S.hf_string(10, 8)
    assert S.excitation(hf, hf) == (0, [])
    one, _ = S.single(hf, 2, 9)
    assert S.excitation(hf, one) == (1, [2, 9])
    two, _ = S.single(one, 0, 7)
    assert S.excitation(hf, two) == (2, [0, 2, 7, 9])
    assert S.excitation(hf, S.single(two, 1, 8)[0]) is None


def test_flip_connection():
    n = 10

    def key(a, b):
        return sum(1 << k for k in a) | sum(1 << (k + n) for k in b)

    assert S.flip_connection(key([1, 2, 3, 4], [1, 2, 3, 4]), n)[0] == 0
    assert S.flip_connection(key([1, 2, 3, 4], [1, 2, 3, 5]), n) == (1, [4, 15])
    assert S.flip_connection(key([1, 2, 3, 4], [1, 2, 5, 6]), n)[0] == 2


def test_sign_in_list():
    occ = [1, 3, 5, 7]
    want = {(1, 4): 1, (1, 6): -1, (1, 8): 1, (3, 8): 1, (1, 2): 1, (0, 0): 1, (3, 6): 1, (3, 4): -1, (3, 0): -1}
    assert {k: S.sign_in_list(occ[k[0]], k[1], occ) for k in want} == want
    assert S.sign_in_list(26, 22, [23, 24, 25, 26]) == -1


def test_virtuals():
    occ = [1, 4, 7, 11, 15, 17]
    assert [S.nth_virtual(occ, s, 10, n) for s, n in ((0, 0), (0, 5), (1, 0), (1, 2))] == [0, 8, 10, 13]
    irreps = [0, 1, 2, 0, 1, 2, 0, 1, 2, 0]
    d = S.from_bytes(0x24, 0x3A, 0x00)
    assert [S.nth_virtual_of_irrep(d, irreps, 2, s, n) for s, n in ((0, 0), (1, 1), (1, 2))] == [8, 18, None]


def test_sites():
    for n, raw, want in ((10, (0xC3, 0x14, 0x0A), 2), (8, (0xC7, 0x8F), 4), (3, (0xEB,), 1), (4, (0x22,), 1), (5, (0x42, 0x00), 1), (5, (0xFF, 0xFF), 5)):
        assert len(S.sites(S.from_bytes(*raw) & ((1 << 2 * n) - 1), n, 2)) == want
    d = S.from_bytes(0x55, 0x06)
    assert S.sites(d, 6, 2) == [0, 4] and S.sites(d, 6, 1) == [2, 9]


def test_moves_and_phonons():
    right, left = S.movable(S.from_bytes(0x95, 0x06), 6)
    assert right == [0, 2, 4, 7, 10] and left == [2, 4, 7, 9]
    hops = S.hops(S.neel_string(10, 10), 10)
    assert len(hops) == 18 and all(b == a + 1 for a, b in hops[:9])
    assert S.phonons(S.from_bytes(0, 0x54, 0x78, 0x00), 5, 3) == [5, 2, 0, 7, 1]
    d = S.from_bytes(0x2E, 0x00)
    assert S.change_phonon(d, 3, 2, 0, 1) == S.from_bytes(0x6E, 0x00)
    assert S.change_phonon(d, 3, 2, 1, 1) == S.from_bytes(0x2E, 0x01)
    assert S.change_phonon(d, 3, 2, 0, -1) is None
    assert S.change_phonon(S.from_bytes(0x2E, 0x03), 3, 2, 1, 1) is None


def test_columns_equal_integers(spark):
    rng = random.Random(1)
    rows = [(rng.getrandbits(40), rng.randrange(40), rng.randrange(40)) for _ in range(300)] + [(2**62 - 1, 0, 61), (1 << 61, 61, 3), (0, 1, 1)]
    df = spark.createDataFrame(rows, "det long, a int, b int")
    got = df.select("*", B.ones_between("det", "a", "b").alias("n"), B.positions("det", 62).alias("occ"), B.set_bit("det", "a").alias("s"), B.zero_bit("det", "a").alias("z"), B.read_bit("det", "b").alias("r"), B.hex_key("det").alias("h")).collect()
    for r in got:
        assert r.n == S.ones_between(r.det, r.a, r.b) and r.occ == S.positions(r.det)
        assert r.s == r.det | 1 << r.a and r.z == r.det & ~(1 << r.a) and r.r == r.det >> r.b & 1 and r.h == f"{r.det:x}"


def test_replaced_lists(spark):
    orbs = F.array(*[F.lit(x) for x in (2, 4, 6, 8, 10)])
    for old, new, want in ((6, 9, [2, 4, 8, 9, 10]), (6, 1, [1, 2, 4, 8, 10]), (10, 12, [2, 4, 6, 8, 12])):
        assert spark.range(1).select(B.replace_sorted(orbs, F.lit(old), F.lit(new))).first()[0] == want


def test_uniform_is_stable(spark):
    df = spark.range(20_000)
    a = df.select(F.avg(B.uniform("id", seed=3)), F.min(B.uniform("id", seed=3)), F.max(B.uniform("id", seed=3))).first()
    b = df.repartition(5).select(F.avg(B.uniform("id", seed=3))).first()
    assert abs(a[0] - 0.5) < 0.01 and 0 <= a[1] and a[2] < 1 and abs(a[0] - b[0]) < 1e-12
