import numpy as np
import pytest

from krylite import catalog
from krylite.functions import strings as S
from krylite.operators import heat_bath, hubbard, linalg, molecule, near_uniform
from krylite.operators.samplers import generator
from krylite.plans import methods as P
from krylite.plans.models import ChainModel, MoleculeModel


def chain_matrix(n, u):
    keys = S.all_strings(n, n // 2, n // 2)
    at = {k: i for i, k in enumerate(keys)}
    h = np.zeros((len(keys), len(keys)))
    for k, i in at.items():
        h[i, i] = u * len(S.sites(k, n, 2))
        for a, b in S.hops(k, n):
            h[at[S.single(k, a, b)[0]], i] -= 1
    return keys, h


@pytest.mark.parametrize("n,u,want", [(2, 2, [-1.23606798, 0, 2]), (4, 2, [-2.87594281, -2.08715446, -1.32340428]), (4, 4, [-1.95314531, -1.4128987, -0.85952339])])
def test_chain_energies(n, u, want):
    keys, h = chain_matrix(n, u)
    assert np.allclose(np.linalg.eigvalsh(h)[:3], want, atol=1e-7)


def test_chain_multiply(spark):
    keys, h = chain_matrix(4, 2)
    v = np.random.default_rng(1).normal(size=len(keys))
    df = spark.createDataFrame(list(zip(keys, v.tolist(), strict=True)), "det long, v double")
    got = {r.det: r.v for r in hubbard.multiply(df, hubbard.Chain(4, 4, u=2.0)).collect()}
    assert np.allclose([got.get(k, 0) for k in keys], h @ v)
    assert {r.det for r in hubbard.states(spark, hubbard.Chain(4, 4)).collect()} == set(keys)


def test_power_iteration_finds_the_ground_state(spark):
    keys, h = chain_matrix(4, 2)
    out = P.chain_exact(spark, ChainModel(hubbard.Chain(4, 4, u=2.0)), P.Config(eps=0.25, iterations=14, target_nonzero=100, shift_interval=100))
    e = out.series("projnum")[-1] / out.series("projden")[-1]
    v = np.zeros(len(keys))
    v[keys.index(S.neel_string(4, 4))] = 100
    for _ in range(14):
        v = v - 0.25 * (h @ v)
    want = (h @ v)[keys.index(S.neel_string(4, 4))] / v[keys.index(S.neel_string(4, 4))]
    assert abs(e - want) < 1e-8


def test_systematic_power_iteration_without_loss(spark):
    """With samples for all elements the sampled product is the exact one, and the run that of the matrix."""
    mol = catalog.small_molecule()
    keys, h = molecule.exact_matrix(mol)
    e_ref = mol.diagonal(S.positions(mol.reference))
    out = P.power_systematic(spark, MoleculeModel(mol, e_ref), P.Config(eps=0.05, iterations=2, matrix_nonzero=5000, target_nonzero=1000, shift_interval=100))
    v = np.zeros(len(keys))
    v[keys.index(mol.reference)] = 100
    for _ in range(2):
        v = v - 0.05 * (h @ v - e_ref * v)
    got = {r.det: r.v for r in out.vector.collect()}
    assert np.allclose([got.get(k, 0.0) for k in keys], v, atol=1e-6)


def test_run_goes_on_from_its_last_save(spark, tmp_path):
    model = ChainModel(hubbard.Chain(4, 4, u=2.0))
    cfg = lambda n, path: P.Config(eps=0.1, iterations=n, target_nonzero=20, shift_interval=1, save_every=2, save_path=path, seed=3)
    whole = P.chain_exact(spark, model, cfg(4, None))
    P.chain_exact(spark, model, cfg(2, str(tmp_path / "run")))
    rest = P.resume(spark, model, cfg(4, str(tmp_path / "run")))
    assert [i for _, i, m, _ in rest.trajectory if m == "norm"] == [2, 3] and abs(rest.shift - whole.shift) < 1e-9
    a, b = ({r.det: r.v for r in x.vector.collect()} for x in (whole, rest))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    with pytest.raises(ValueError):
        P.resume(spark, model, cfg(4, None))


def test_elements_of_many_keys():
    mol = catalog.small_molecule()
    keys = S.all_strings(4, 2, 2)
    assert np.allclose(mol.diagonals(np.array(keys)), [mol.diagonal(S.positions(k)) for k in keys])
    moves = [(k, i, a) for k in keys for i in S.positions(k) for a in range(8) if a // 4 == i // 4 and not k >> a & 1]
    got = mol.single_elements(*(np.array(x) for x in zip(*moves, strict=True)))
    assert np.allclose(got, [mol.single_element(i, a, S.positions(k)) for k, i, a in moves])


def test_holstein_signs(spark):
    c = hubbard.Chain(2, 2, u=1.0, g=0.5, omega=1.0, ph_bits=1)
    df = spark.createDataFrame([(c.reference, 1.0)], "det long, v double")
    got = {r.det2: r.el for r in hubbard.offdiagonal(df, c).collect()}
    ref = c.reference
    assert got == {S.single(ref, 0, 1)[0]: -1.0, S.single(ref, 3, 2)[0]: -1.0, ref | 1 << 4: 0.5, ref | 1 << 5: 0.5}


def test_molecule_multiply_and_flips(spark):
    mol = catalog.small_molecule()
    keys, h = molecule.exact_matrix(mol)
    assert np.allclose(h, h.T)
    v = np.random.default_rng(2).normal(size=len(keys))
    df = spark.createDataFrame(list(zip(keys, v.tolist(), strict=True)), "det long, v double")
    got = {r.det: r.v for r in molecule.multiply(df, mol).collect()}
    assert np.allclose([got.get(k, 0) for k in keys], h @ v)
    # spin-flip pairs: the folded product equals the folded vector's product
    flip = {k: S.flip_spins(k, 4) for k in keys}
    even = np.array([v[i] + v[keys.index(flip[k])] for i, k in enumerate(keys)]) / 2
    folded = [(k, float(even[i] if flip[k] == k else even[i] * np.sqrt(2))) for i, k in enumerate(keys) if k <= flip[k]]
    hv = h @ even
    out = {r.det: r.v for r in molecule.multiply(spark.createDataFrame(folded, "det long, v double"), mol, parity=1).collect()}
    assert np.allclose([out.get(k, 0) for k, _ in folded], [hv[keys.index(k)] * (1 if flip[k] == k else np.sqrt(2)) for k, _ in folded])


def test_frozen_orbitals_fold_in():
    mol = catalog.small_molecule()
    whole = molecule.Molecule(4, 4, mol.h, mol.eri, [0] * 4)
    frozen = molecule.Molecule.with_frozen(2, 4, mol.h, mol.eri, [0] * 4)
    keys = [k for k in S.all_strings(4, 2, 2) if k & 1 and k >> 4 & 1]
    _, big = molecule.exact_matrix(whole, keys)
    small_keys = [(k & 0b1110) >> 1 | ((k >> 5) & 0b111) << 3 for k in keys]
    _, small = molecule.exact_matrix(frozen, small_keys)
    assert np.allclose(big, small)


def test_symmetry_tables(spark):
    irreps = [0, 1, 2, 0, 1, 1]
    det = sum(1 << k for k in (1, 2, 3, 7, 10, 11))
    one = {(r.i, r.a) for r in molecule.singles(spark.createDataFrame([(det,)], "det long"), 6, irreps).collect()}
    assert one >= {(1, 4), (1, 5), (3, 0)} and {x for x in one if x[0] < 6} == {(1, 4), (1, 5), (3, 0)}
    assert molecule.count_doubles_without_symmetry(4, 4) == 2 * 1 * 1 + 2 * 2 * 2 * 2


@pytest.mark.parametrize("how", ["systematic", "pivotal"])
def test_heat_bath_is_complete(spark, how):
    """With enough samples and unit elements every excitation's value is exactly 1."""
    mol = catalog.small_molecule()
    ref = spark.createDataFrame([(mol.reference, 1.0)], "det long, v double")
    got = heat_bath.apply(ref, mol, heat_bath.tensors(mol), 2000, 0.7, how, unit_elements=True).collect()
    assert got and all(abs(abs(r.el) - 1) < 1e-9 for r in got)


def test_heat_bath_weights():
    mol = catalog.small_molecule()
    t = heat_bath.tensors(mol)
    det, occ = mol.reference, S.positions(mol.reference)
    assert abs(heat_bath.o1_weights(t, 4, occ)[0].sum() - 1) < 1e-12
    total, rng, n = {}, generator(1, 2), 20_000
    for i, j, a, b, p in heat_bath.draw_doubles(t, mol.irreps, det, n, rng):
        key = (i, j, *sorted((a, b)))
        total.setdefault(key, [0, p])[0] += 1
    for count, p in total.values():
        assert abs(count / n - p) < 5 * np.sqrt(p / n) + 1e-9


def test_near_uniform_probabilities():
    irreps, det = [0, 1, 0, 1, 0], S.hf_string(5, 4)
    n, rng = 20_000, generator(3)
    total = {}
    for i, j, a, b, p in near_uniform.draw_doubles(det, irreps, n, rng):
        total.setdefault((i, j, a, b), [0, p])[0] += 1
    for count, p in total.values():
        assert abs(count / n - p) < 5 * np.sqrt(p / n)
    ones = {}
    for i, a, p in near_uniform.draw_singles(det, irreps, n, rng):
        ones.setdefault((i, a), [0, p])[0] += 1
    assert abs(sum(p for _, p in ones.values()) - 1) < 1e-9


def test_walkers_move_as_expected(spark):
    """The mean of one walker step is the exact step, within its spread."""
    mol = catalog.small_molecule()
    model = MoleculeModel(mol, mol.diagonal(S.positions(mol.reference)))
    vec = spark.createDataFrame([(mol.reference, 2000.0)], "det long, v double")
    cfg = P.Config(eps=0.1, seed=2)
    for spawn in ("walkers", "float_walkers"):
        got = {r.det: r.v for r in P.SPAWN[spawn](vec, model, cfg, 0).groupBy("det").agg({"v": "sum"}).withColumnRenamed("sum(v)", "v").collect()}
        keys, h = molecule.exact_matrix(mol)
        col = h[:, keys.index(mol.reference)]
        for k, x in zip(keys, col, strict=True):
            if k != mol.reference and abs(x) > 1e-3:
                assert abs(got.get(k, 0) + 0.1 * x * 2000) < 40 + 0.3 * abs(200 * x), spawn


def test_subspace_energies(spark):
    mol = catalog.small_molecule()
    keys, h = molecule.exact_matrix(mol)
    e0 = mol.diagonal(S.positions(mol.reference))
    values, vectors = np.linalg.eigh(h)
    trial = vectors[:, :2] + 0.005 * np.random.default_rng(3).normal(size=(len(keys), 2))
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in zip(keys, trial, strict=True)], "det long, v0 double, v1 double")
    out = P.subspace(spark, MoleculeModel(mol, e0), P.Config(eps=0.1, iterations=3, target_nonzero=200, damping=0.5, restart_interval=2), df, ["v0", "v1"])
    got = P.subspace_energies(out, skip=2) + e0
    assert np.allclose(got, values[:2], atol=0.01)


@pytest.mark.parametrize("parity", [1, -1])
def test_subspace_with_time_reversal(spark, parity):
    mol = catalog.small_molecule()
    keys, h = molecule.exact_matrix(mol)
    flip = lambda k: k >> mol.n_orb | (k & (1 << mol.n_orb) - 1) << mol.n_orb
    pairs = [k for k in keys if k < flip(k) or k == flip(k) and parity > 0]
    basis = np.zeros((len(keys), len(pairs)))
    for i, k in enumerate(pairs):
        basis[keys.index(k), i] += 1 if k == flip(k) else np.sqrt(0.5)
        if k != flip(k):
            basis[keys.index(flip(k)), i] += parity * np.sqrt(0.5)
    values, vectors = np.linalg.eigh(basis.T @ h @ basis)
    trial = vectors[:, :2] + 0.005 * np.random.default_rng(3).normal(size=(len(pairs), 2))
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in zip(pairs, trial, strict=True)], "det long, v0 double, v1 double")
    model = MoleculeModel(mol, mol.diagonal(S.positions(mol.reference)))
    cfg = lambda **more: P.Config(eps=0.1, target_nonzero=200, matrix_nonzero=100_000, damping=0.5, parity=parity, **more)
    got = P.subspace_energies(P.subspace(spark, model, cfg(iterations=3, restart_interval=2), df, ["v0", "v1"]), skip=2) + model.e_ref
    assert np.allclose(got, values[:2], atol=0.01)
    one, two = ({r.det: (r.v0, r.v1) for r in P.subspace(spark, model, cfg(iterations=1), df, ["v0", "v1"], how).vector.collect()} for how in ("exact", "heat_bath"))
    assert set(two) <= set(pairs) and all(np.allclose(two.get(k, (0, 0)), x, atol=1e-6) for k, x in one.items())
    few = df.orderBy("det").limit(2)
    held = P.subspace(spark, model, cfg(iterations=1, initiator=1e9), few, ["v0", "v1"]).vector
    assert {r.det for r in held.collect()} == {r.det for r in few.collect()}


def test_linear_algebra():
    assert np.allclose(linalg.inverse([[1, 3], [2, 4]]), [[-2, 1.5], [1, -0.5]])
    assert np.allclose(linalg.inverse_upper_of_lu([[1, 3], [2, 4]]), [[1, 1.5], [0, -0.5]])
    r = linalg.inverse_r([[0, 3, 6], [1, 4, 7], [2, 5, 9]])
    want = np.array([[-0.4472136, -0.85201287, 1.08866211], [0, 0.30429031, -4.76289672], [0, 0, 2.44948974]])
    assert np.allclose(np.abs(r), np.abs(want), atol=1e-6)
    e, _ = linalg.generalised_eigen(np.diag([3.0, 1.0]), np.eye(2))
    assert np.allclose(e, [1, 3]) and np.allclose(linalg.singular_values([[3, 0], [0, 4]]), [4, 3])
