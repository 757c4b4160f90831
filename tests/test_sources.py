import numpy as np
import pytest
from pyspark.sql import functions as F

from krylite import stats
from krylite.sources import readers as R
from krylite.sources import writers as K


def write(path, text):
    path.write_text(text)
    return str(path)


def test_numbers(spark, tmp_path):
    p = write(tmp_path / "a.csv", "1,2, 3\n4,5,6\n\n")
    assert [r.val for r in R.read_numbers(spark, p).orderBy("row", "col").collect()] == [1, 2, 3, 4, 5, 6]
    assert R.read_last_line(spark, p) == [4, 5, 6] and R.read_matrix(spark, p).shape == (2, 3)
    with pytest.raises(Exception):
        R.read_numbers(spark, str(tmp_path / "none")).count()
    w = write(tmp_path / "w", " 1.5 2\n3e-1\n")
    assert [r.val for r in R.read_whitespace(spark, w).orderBy("line", "pos").collect()] == [1.5, 2.0, 0.3]


def test_hubbard_parameters(spark, tmp_path):
    good = "n_elec\n6\nlat_len\n6\nn_dim\n1\neps\n0.001\nU\n2\nomega\n1\ng\n0.5\ngs_energy\n-3.98\n"
    p = R.read_hubbard(spark, write(tmp_path / "h", good))
    assert (p.n_elec, p.u, p.g, p.gs_energy) == (6, 2.0, 0.5, -3.98)
    with pytest.raises(ValueError, match="omega"):
        R.read_hubbard(spark, write(tmp_path / "i", good.replace("omega", "hf_energy")))


@pytest.mark.parametrize("group,given", [("D2h", [1, 4, 6, 7, 8, 5, 3, 2]), ("C2v", [1, 4, 2, 3]), ("C2h", [1, 4, 2, 3]), ("D2", [1, 4, 3, 2]), ("Cs", [1, 2]), ("C1", [1])])
def test_irreps(spark, group, given):
    assert R.convert_irreps(given, group) == list(range(len(given)))
    df = spark.createDataFrame(list(enumerate(given)), "orb int, irrep int")
    assert [r.irrep for r in R.convert_irrep_column(df, group).orderBy("orb").collect()] == list(range(len(given)))
    with pytest.raises(ValueError):
        R.convert_irreps([9], group)


def test_fcidump(spark, tmp_path):
    text = "&FCI NORB=2,NELEC=2,MS2=0,\nORBSYM=1,4,\nISYM=1,\n&END\n0.5 1 1 1 1\n0.25 2 1 2 1\n0.3 1 1 2 2\n-1.0 1 1 0 0\n-0.4 2 2 0 0\n-0.9 1 0 0 0\n0.7 0 0 0 0\n"
    p = write(tmp_path / "f", text)
    mol = R.read_fcidump(spark, p, "C2v")
    assert mol.core == 0.7 and mol.h[1, 1] == -0.4 and mol.irreps == [0, 1]
    assert mol.eri[0, 1, 0, 1] == mol.eri[1, 0, 0, 1] == 0.25 and mol.eri[1, 1, 0, 0] == 0.3
    kinds = {r.kind: r.n for r in R.fcidump_table(spark, p).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"two": 3, "one": 2, "energy": 1, "core": 1}
    assert abs(mol.diagonal([0, 2]) - (0.7 - 2.0 + 0.5)) < 1e-12


def test_hf_folder(spark, tmp_path):
    write(tmp_path / "sys_params.txt", "n_elec\n2\nn_frozen\n0\nn_orb\n2\neps\n0.01\nhf_energy\n-1.5\n")
    write(tmp_path / "symm.txt", "0\n1\n")
    write(tmp_path / "hcore.txt", "-1,0\n0,-0.4\n")
    phys = np.zeros((2, 2, 2, 2))
    phys[0, 0, 0, 0] = 0.5
    write(tmp_path / "eris.txt", "\n".join(",".join(map(str, row)) for row in phys.reshape(-1, 2)))
    p, mol = R.read_hf_folder(spark, str(tmp_path))
    assert p.hf_energy == -1.5 and abs(mol.diagonal([0, 2]) - p.hf_energy) < 1e-12


def test_text_vectors_and_dice(spark, tmp_path):
    write(tmp_path / "x_dets", "5\n9\n3\n")
    write(tmp_path / "x_vals", "0.5\n-1\n")
    assert {r.det: r.v for r in R.read_vector_text(spark, str(tmp_path / "x_")).collect()} == {5: 0.5, 9: -1.0}
    dice = "header\nState : 0\n0  0.9  2 0\n1  -0.1  a b\n2 1e-9 0 2\nState : 1\n0 0.7  b a\n"
    p = write(tmp_path / "dice", dice)
    assert {r.det: r.v for r in R.read_dice(spark, p, 2, 0).collect()} == {0b0101: 0.9, 0b1001: -0.1}
    assert {r.det: r.v for r in R.read_dice(spark, p, 2, 1).collect()} == {0b0110: 0.7}
    with pytest.raises(ValueError):
        R.read_dice(spark, p, 2, 2)


def test_checkpoints_and_state(spark, tmp_path):
    v = spark.createDataFrame([(1, 2.0, False), (2, 1e-12, False), (3, 0.0, True)], "det long, v double, pinned boolean")
    K.save_checkpoint(v, str(tmp_path / "c"), 10)
    K.save_checkpoint(v.where("det = 1"), str(tmp_path / "c"), 20)
    assert {r.det for r in R.read_checkpoint(spark, str(tmp_path / "c"), 10).collect()} == {1, 3}
    assert {r.det for r in R.read_checkpoint(spark, str(tmp_path / "c")).collect()} == {1}
    K.save_state(spark, str(tmp_path / "s"), "r", 10, -0.5, 3.0, 7)
    K.save_state(spark, str(tmp_path / "s"), "r", 20, -0.6, 4.0, 7)
    assert K.load_state(spark, str(tmp_path / "s"), "r").shift == -0.6


def test_arrays_and_trajectories(spark, tmp_path):
    K.write_npy(str(tmp_path / "a.npy"), np.ones((1, 2, 2)))
    K.write_npy(str(tmp_path / "a.npy"), np.zeros((1, 2, 2)), append=True)
    assert R.read_npy(str(tmp_path / "a.npy")).shape == (2, 2, 2)
    K.write_npz(str(tmp_path / "b.npz"), x=np.arange(3))
    assert R.read_npy(str(tmp_path / "b.npz"), "x").tolist() == [0, 1, 2]
    for it in range(3):
        K.append_trajectory(spark, str(tmp_path / "t"), [("r", it, "S", -0.1 * it)])
        K.append_matrices(spark, str(tmp_path / "m"), "r", it, np.eye(2) * it, np.eye(2))
    from krylite.schemas import MATRIX_TRAJECTORY
    from krylite.streaming.trajectories import drain, read, running_means

    got = drain(running_means(read(spark, str(tmp_path / "t"))), "means").collect()
    assert len(got) == 1 and got[0].n == 3 and abs(got[0]["mean"] + 0.1) < 1e-12
    h, d = K.matrix_arrays(spark.read.schema(MATRIX_TRAJECTORY).parquet(str(tmp_path / "m")), 2)
    assert h.shape == (3, 2, 2) and h[2, 1, 1] == 2


def test_statistics(spark):
    rng = np.random.default_rng(1)
    x = np.zeros(4000)
    for i in range(1, len(x)):
        x[i] = 0.8 * x[i - 1] + rng.normal()
    assert abs(stats.autocorrelation_time(x) - 9) < 3
    num = spark.createDataFrame([(i, float(2 + 0.1 * v)) for i, v in enumerate(x)], "iter long, value double")
    den = spark.createDataFrame([(i, 1.0) for i in range(len(x))], "iter long, value double")
    s = stats.summary(num, den, 100, exact=2.0)
    assert abs(s["error"]) < s["two_sigma"] * 2 and s["efficiency"] > 0
    cov = {r.lag: r.cov for r in stats.autocovariance(num, 2, "value").collect()}
    y = 2 + 0.1 * x - (2 + 0.1 * x).mean()
    assert abs(cov[1] - (y[1:] * y[:-1]).sum() / len(y)) < 1e-9
