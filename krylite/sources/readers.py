"""Readers: number tables, keyword files, FCIDUMP, text vectors, Dice output, checkpoints.

All go through Spark's file readers, so any store that Spark can open will do. A missing file raises.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.molecule import Molecule


def text_lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a small text file (parameters, integrals of one molecule) on the driver."""
    return spark.read.text(path, wholetext=True).first()[0].splitlines()


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, or of a folder's files in the order of their names, with their number from 0.

    Lines are numbered within each block of a file; the blocks before it, one row each, give where it starts.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__id"))
    blocks = lines.groupBy("__file", "__at").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.orderBy("__file", "__at").rowsBetween(W.unboundedPreceding, -1))
    starts = blocks.select("__file", "__at", F.coalesce(before, F.lit(0)).alias("__start"))
    inside = F.row_number().over(W.partitionBy("__file", "__at").orderBy("__id")) - 1
    return lines.withColumn("__inside", inside).join(starts, ["__file", "__at"]).select("value", (F.col("__start") + F.col("__inside")).cast("long").alias("line"))


def read_numbers(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """A CSV of numbers, flattened row by row: (row, col, val)."""
    lines = numbered(spark, path).where(F.trim("value") != "")
    cells = lines.select(F.col("line").alias("row"), F.posexplode(F.split("value", r"\s*,\s*")).alias("col", "x"))
    return cells.where(F.trim("x") != "").select("row", "col", F.trim("x").cast(kind).alias("val"))


def read_matrix(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([[float(x) for x in line.replace(" ", "").split(",") if x] for line in text_lines(spark, path) if line.strip()])


def read_last_line(spark: SparkSession, path: str) -> list[float]:
    """The last line of a CSV, for restarting a shift."""
    row = numbered(spark, path).where(F.trim("value") != "").orderBy(F.col("line").desc()).limit(1).first()
    return [float(x) for x in row["value"].split(",") if x.strip()] if row else []


def read_whitespace(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated numbers: (line, pos, val)."""
    words = numbered(spark, path).select("line", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("pos", "x"))
    return words.where("x <> ''").select("line", "pos", F.col("x").cast("double").alias("val"))


def keyword_pairs(lines: list[str], keys: list[str]) -> dict[str, str]:
    """Keyword and value lines in a fixed order; another keyword raises."""
    found = [x.strip() for x in lines if x.strip()]
    out = {}
    for i, k in enumerate(keys):
        if len(found) < 2 * i + 2 or found[2 * i] != k:
            raise ValueError(f"expected {k!r} as keyword {i + 1}")
        out[k] = found[2 * i + 1]
    return out


@dataclass(frozen=True)
class SystemParameters:
    n_elec: int
    n_frozen: int
    n_orb: int
    eps: float
    hf_energy: float


def read_system(spark: SparkSession, folder: str) -> SystemParameters:
    got = keyword_pairs(text_lines(spark, f"{folder}/sys_params.txt"), ["n_elec", "n_frozen", "n_orb", "eps", "hf_energy"])
    return SystemParameters(int(got["n_elec"]), int(got["n_frozen"]), int(got["n_orb"]), float(got["eps"]), float(got["hf_energy"]))


def read_hf_folder(spark: SparkSession, folder: str) -> tuple[SystemParameters, Molecule]:
    """System parameters, one- and two-electron integrals and irreps of a molecule's folder."""
    p = read_system(spark, folder)
    tot = p.n_orb + p.n_frozen // 2
    irreps = [int(x) for x in text_lines(spark, f"{folder}/symm.txt") if x.strip()]
    h = read_matrix(spark, f"{folder}/hcore.txt")
    flat = np.array([float(x) for line in text_lines(spark, f"{folder}/eris.txt") for x in line.split(",") if x.strip()])
    eri = flat.reshape(tot, tot, tot, tot).transpose(0, 2, 1, 3)  # <pq|rs> to (pr|qs)
    return p, Molecule.with_frozen(p.n_frozen, p.n_elec, h, eri, irreps)


@dataclass(frozen=True)
class HubbardParameters:
    n_elec: int
    lat_len: int
    n_dim: int
    eps: float
    u: float
    omega: float
    g: float
    gs_energy: float


def read_hubbard(spark: SparkSession, path: str) -> HubbardParameters:
    k = keyword_pairs(text_lines(spark, path), ["n_elec", "lat_len", "n_dim", "eps", "U", "omega", "g", "gs_energy"])
    return HubbardParameters(int(k["n_elec"]), int(k["lat_len"]), int(k["n_dim"]), float(k["eps"]), float(k["U"]), float(k["omega"]), float(k["g"]), float(k["gs_energy"]))


#: Irreps of one convention, in the order in which the other numbers them from 0.
IRREP_ORDER = {
    "D2h": (1, 4, 6, 7, 8, 5, 3, 2),
    "C2v": (1, 4, 2, 3),
    "C2h": (1, 4, 2, 3),
    "D2": (1, 4, 3, 2),
    "Cs": (1, 2),
    "C2": (1, 2),
    "Ci": (1, 2),
    "C1": (1,),
}


def convert_irreps(irreps: list[int], group: str) -> list[int]:
    order = IRREP_ORDER[group]
    bad = [x for x in irreps if x not in order]
    if bad:
        raise ValueError(f"irreps {bad} don't exist in {group}")
    return [order.index(x) for x in irreps]


def convert_irrep_column(orbitals: DataFrame, group: str, name: str = "irrep") -> DataFrame:
    order = IRREP_ORDER[group]
    pairs = F.create_map(*[F.lit(x) for i, o in enumerate(order) for x in (o, i)])
    return orbitals.withColumn(name, pairs[F.col(name)])


def read_fcidump(spark: SparkSession, path: str, group: str) -> Molecule:
    """Header of four lines (NORB, NELEC, MS2; ORBSYM; ISYM; &END), then `value i j k l`, counted from 1.

    Index order needn't be canonical; lines with one index are orbital energies and are skipped.
    """
    import re

    lines = text_lines(spark, path)
    head = {k.upper(): int(v) for k, v in re.findall(r"(\w+)\s*=\s*(-?\d+)", lines[0])}
    if head.get("MS2", 0):
        raise ValueError("MS2 must be 0")
    n = head["NORB"]
    irreps = convert_irreps([int(x) for x in re.findall(r"\d+", lines[1].split("=", 1)[1])], group)
    if len(irreps) != n:
        raise ValueError(f"{len(irreps)} orbital symmetries for {n} orbitals")
    h, eri, core = np.zeros((n, n)), np.zeros((n, n, n, n)), 0.0
    for line in lines[4:]:
        if not line.strip():
            continue
        v, *at = line.replace("D", "E").split()
        i, j, k, m = (int(x) - 1 for x in at)
        v = float(v)
        if i < 0:
            core = v
        elif k >= 0:
            for p, q in ((i, j), (j, i)):
                for r, s in ((k, m), (m, k)):
                    eri[p, q, r, s] = eri[r, s, p, q] = v
        elif j >= 0:
            h[i, j] = h[j, i] = v
    return Molecule(n, head["NELEC"], h, eri, irreps, core)


def fcidump_table(spark: SparkSession, path: str) -> DataFrame:
    """The body of an FCIDUMP as a table: kind (core, one, two, energy), p, q, r, s from 0 (null where unused), val."""
    body = numbered(spark, path).where((F.col("line") >= 4) & (F.trim("value") != ""))
    x = F.split(F.trim(F.regexp_replace("value", "D", "E")), r"\s+")
    ix = [F.when(F.get(x, F.lit(i)).cast("int") > 0, F.get(x, F.lit(i)).cast("int") - 1) for i in range(1, 5)]
    kind = F.when(ix[0].isNull(), "core").when(ix[1].isNull(), "energy").when(ix[2].isNull(), "one").otherwise("two")
    return body.select(kind.alias("kind"), *[c.alias(k) for c, k in zip(ix, "pqrs", strict=True)], F.get(x, F.lit(0)).cast("double").alias("val"))


def read_determinants(spark: SparkSession, path: str) -> DataFrame:
    """One key a line: (line, det)."""
    return numbered(spark, path).where(F.trim("value") != "").select("line", F.trim("value").cast("long").alias("det"))


def read_vector_text(spark: SparkSession, prefix: str, kind: str = "double") -> DataFrame:
    """`<prefix>dets` and `<prefix>vals` paired by line; the shorter file's length counts."""
    vals = numbered(spark, f"{prefix}vals").where(F.trim("value") != "").select("line", F.trim("value").cast(kind).alias("v"))
    return read_determinants(spark, f"{prefix}dets").join(vals, "line").select("det", "v")


def read_dice(spark: SparkSession, path: str, n_orb: int, state: int = 0, least: float = 1e-6) -> DataFrame:
    """The vector of one `State :` block of Dice output: (det, v); 2, a, b, 0 stand for an orbital's electrons.

    Coefficients under `least` are left out. The block number is a running count of headers over line numbers: a window
    over the header lines only, which are few, joined back by range of lines.
    """
    lines = numbered(spark, path)
    heads = lines.where(F.col("value").contains("State :")).select("line", (F.row_number().over(W.orderBy("line")) - 1).alias("state"), F.lead("line").over(W.orderBy("line")).alias("until"))
    at = heads.where(F.col("state") == state).first()
    if at is None:
        raise ValueError(f"no state {state}")
    body = lines.where(F.col("line") > at["line"])
    if at["until"] is not None:
        body = body.where(F.col("line") < at["until"])
    x = F.split(F.trim("value"), r"\s+")
    occ = F.slice(x, 3, n_orb)
    has = lambda chars: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(n_orb - 1)), lambda k: F.when(F.get(occ, k).isin(*chars), F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a + b)
    rows = body.where((F.size(x) >= n_orb + 2) & F.get(x, F.lit(0)).rlike(r"^\d+$")).select((has(["2", "a"]) + F.call_function("shiftleft", has(["2", "b"]), F.lit(n_orb))).alias("det"), F.get(x, F.lit(1)).cast("double").alias("v"))
    return rows.where(F.abs("v") >= least)


def read_checkpoint(spark: SparkSession, path: str, iteration: int | None = None, values: tuple[str, ...] = ("v",), least: float = 1e-9) -> DataFrame:
    """A saved vector, of the newest or a given iteration; rows under `least` in all columns go, unless dense or pinned."""
    df = spark.read.parquet(path)
    if "iter" in df.columns:
        iteration = df.agg(F.max("iter")).first()[0] if iteration is None else iteration
        df = df.where(F.col("iter") == iteration).drop("iter")
    keep = F.lit(False)
    for v in values:
        keep = keep | (F.abs(v) > least)
    for flag in ("is_dense", "pinned"):
        if flag in df.columns:
            keep = keep | F.col(flag)
    return df.where(keep)


def read_npy(path: str, key: str | None = None) -> np.ndarray:
    got = np.load(path)
    return got if key is None else got[key]


def with_dense(vec: DataFrame, keys: DataFrame) -> DataFrame:
    """Flag the rows of a dense subspace; keys not stored yet come in with zeros."""
    from ..operators.vector import pin

    return pin(vec, keys, "is_dense")
