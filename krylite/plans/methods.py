"""Iterative methods: stochastic power iteration, walker dynamics, subspace iteration, observables.

Every method is `run(spark, model, config) -> RunResult`. One iteration is one plan, from the stored vector to the next
stored one, plus a few aggregates; the vector is written to the shared folder each time, so lineage stays short and
a lost executor costs one iteration. The driver holds the shift, the seed and the counters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..operators import heat_bath, linalg, molecule
from ..operators import vector as V
from ..operators.compress import adjust_geometric, adjust_shift, column_samples, compress, round_binomial, round_small
from ..operators.samplers import compress_columns, generator
from ..schemas import TRAJECTORY
from ..storage import Saved, scope, scratch
from .models import ChainModel, Model, MoleculeModel


@dataclass(frozen=True)
class Config:
    eps: float = 0.01
    iterations: int = 50
    target_nonzero: int = 1000
    matrix_nonzero: int = 1000
    target_norm: float = 0.0
    initiator: float = 0.0
    #: Whether |v| equal to the threshold is an initiator.
    initiator_inclusive: bool = True
    damping: float = 0.05
    shift_interval: int = 10
    start_amplitude: float = 100.0
    distribution: str = "near_uniform"
    compression: str = "systematic"
    p_doub: float | None = None
    restart_interval: int = 10
    parity: int | None = None
    seed: int = 0
    run: str = "run"
    save_every: int = 100
    save_path: str | None = None
    burn_in: int = 0
    observe_every: int = 1
    weight_power: float = 0.0


@dataclass
class RunResult:
    trajectory: list[tuple[str, int, str, float]]
    vector: DataFrame
    shift: float
    matrices: list[tuple[int, np.ndarray, np.ndarray]] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.trajectory, TRAJECTORY)

    def series(self, metric: str) -> np.ndarray:
        return np.array([v for _, _, m, v in self.trajectory if m == metric])


def start(spark: SparkSession, model: Model, cfg: Config) -> DataFrame:
    return spark.createDataFrame([(model.reference, cfg.start_amplitude)], "det long, v double")


def flagged(vec: DataFrame, cfg: Config, threshold: float | None = None) -> DataFrame:
    t = cfg.initiator if threshold is None else threshold
    size = F.abs("v")
    return vec.withColumn("ini", size >= t if cfg.initiator_inclusive else size > t)


def exact_spawn(vec: DataFrame, model: Model, cfg: Config, it: int) -> DataFrame:
    got = model.offdiagonal(flagged(vec, cfg))
    return got.select(F.col("det").alias("src"), F.col("det2").alias("det"), (-cfg.eps * F.col("el") * F.col("v")).alias("v"), "ini")


def chain_spawn(vec: DataFrame, model: ChainModel, cfg: Config, it: int) -> DataFrame:
    got = model.sampled(vec, cfg.matrix_nonzero, cfg.seed * 1_000_003 + it)
    flags = flagged(vec, cfg).select("det", "ini")
    return got.join(flags, "det").select(F.col("det").alias("src"), F.col("det2").alias("det"), (-cfg.eps * F.col("el")).alias("v"), "ini")


def heat_bath_spawn(vec: DataFrame, model: MoleculeModel, cfg: Config, it: int) -> DataFrame:
    mol = model.mol
    p = cfg.p_doub if cfg.p_doub is not None else heat_bath.double_probability(mol)
    got = heat_bath.apply(vec, mol, heat_bath.tensors(mol), cfg.matrix_nonzero, p, cfg.compression, cfg.seed * 1_000_003 + it)
    flags = flagged(vec, cfg).select("det", "ini")
    return got.join(flags, "det").select(F.col("det").alias("src"), F.col("det2").alias("det"), (-cfg.eps * F.col("el")).alias("v"), "ini")


def multinomial_spawn(vec: DataFrame, model: MoleculeModel, cfg: Config, it: int) -> DataFrame:
    """Samples in proportion to |v|; each carries v / (its row's samples * its probability). Ten first iterations use a
    tenth of the samples."""
    n = cfg.matrix_nonzero if it >= 10 else max(1, cfg.matrix_nonzero // 10)
    p = cfg.p_doub if cfg.p_doub is not None else heat_bath.double_probability(model.mol)
    r = float(generator(cfg.seed, it, 5).random())
    walks = flagged(column_samples(vec, n, r=r).where("n_walk > 0"), cfg)
    got = model.drawn(walks, p, cfg.seed * 1_000_003 + it, cfg.distribution).join(walks.select("det", "ini"), "det")
    share = F.col("v") / F.col("n_walk") / F.col("prob")
    return got.select(F.col("det").alias("src"), F.col("det2").alias("det"), (-cfg.eps * F.col("el") * share).alias("v"), "ini")


def walker_spawn(vec: DataFrame, model: MoleculeModel, cfg: Config, it: int, whole: bool = True) -> DataFrame:
    """One draw a walker. Whole walkers: attempts round to whole numbers; others: attempts under 0.01 round to 0 or 0.01."""
    p = cfg.p_doub if cfg.p_doub is not None else heat_bath.double_probability(model.mol)
    walks = flagged(vec, cfg).withColumn("n_walk", F.ceil(F.abs("v")).cast("long"))
    got = model.drawn(walks, p, cfg.seed * 1_000_003 + it, cfg.distribution).join(walks.select("det", "ini"), "det")
    one = F.col("v") / F.col("n_walk")
    x = got.withColumn("x", -cfg.eps * F.col("el") * one / F.col("prob")).withColumn("k", F.monotonically_increasing_id())
    u = B.uniform("det", "det2", "k", seed=cfg.seed * 7919 + it)
    new = F.signum("x") * round_binomial(F.abs("x"), u) if whole else round_small(F.col("x"), u, 0.01)
    return x.select(F.col("det").alias("src"), F.col("det2").alias("det"), new.cast("double").alias("v"), "ini").where("v <> 0")


SPAWN = {"exact": exact_spawn, "chain": chain_spawn, "heat_bath": heat_bath_spawn, "multinomial": multinomial_spawn, "walkers": walker_spawn, "float_walkers": lambda v, m, c, i: walker_spawn(v, m, c, i, False)}


def ground_state(spark: SparkSession, model: Model, cfg: Config, spawn: str = "exact", trial: DataFrame | None = None, dense: DataFrame | None = None, initial: DataFrame | None = None, shift: float = 0.0, last: float = 0.0, first: int = 0) -> RunResult:
    """v <- v - eps (H - S) v with sampled H, then compression to the target.

    Covers walkers (whole or not; no vector compression, shift control by norm), multinomial, systematic heat-bath and
    exact products, with an optional dense subspace whose block is applied exactly. The estimator is <H T|v> / <T|v>.
    `initial`, `shift`, `last` (the norm that the shift remembers) and `first` (iterations done) continue a run.
    """
    vec = Saved(initial if initial is not None else start(spark, model, cfg), "vec")
    trial = Saved(trial if trial is not None else spark.createDataFrame([(model.reference, 1.0)], "det long, v double"), "trial")
    h_trial = Saved(apply_h(trial.df, model), "h-trial")
    block = None
    if dense is not None:
        dense = Saved(dense.select("det").distinct(), "dense")
        block = Saved(model.offdiagonal(dense.df).join(dense.df.withColumnRenamed("det", "det2"), "det2", "left_semi").select(F.col("det").alias("src"), F.col("det2").alias("dst"), (F.col("el") * -cfg.eps).alias("val")), "block")
    walkers = spawn in ("walkers", "float_walkers")
    out = []
    for it in range(first, cfg.iterations):
        with scope():  # what a step writes on its way goes with it
            diag = model.diagonal()
            adds = SPAWN[spawn](vec.df, model, cfg, it)
            if block is not None:  # the block is exact: sampled moves inside it are left out
                inside = lambda name: dense.df.select(F.col("det").alias(name), F.lit(True).alias(f"in_{name}"))
                adds = adds.join(inside("src"), "src", "left").join(inside("det"), "det", "left").where("in_src is null or in_det is null").select("det", "v", "ini")
                adds = adds.unionByName(V.coo_multiply(block.df, vec.df.join(dense.df, "det", "left_semi")).withColumn("ini", F.lit(True)))
            adds = scratch(adds.select("det", "v", "ini"), "adds")
            kept = V.death_cloning(vec.df, "v", diag, cfg.eps, shift)
            if walkers:
                u = B.uniform("det", seed=cfg.seed * 104_729 + it)
                kept = kept.withColumn("v", F.signum("v") * round_binomial(F.abs("v"), u) if spawn == "walkers" else round_small(F.col("v"), u)).withColumn("v", F.col("v").cast("double"))
            ok = V.accepted(vec.df, adds) if not walkers else adds.where("ini").unionByName(adds.where("not ini").join(vec.df.where("v <> 0").select("det").unionByName(adds.where("ini").select("det")), "det", "left_semi"))
            merged = Saved(V.merge(kept, ok).where("v <> 0"), "merged")
        stats = merged.df.agg(F.sum(F.abs("v")).alias("norm"), F.count("*").alias("n"), F.sum((F.abs("v") >= cfg.initiator).cast("long")).alias("n_ini")).first()
        norm = float(stats["norm"] or 0.0)
        if (it + 1) % cfg.shift_interval == 0 and norm:
            shift, last = adjust_shift(shift, norm, last, cfg.target_norm or norm, cfg.damping / cfg.shift_interval / cfg.eps)
        num, den = (float(V.dot(merged.df, t.df).first()[0]) for t in (h_trial, trial))
        for name, value in (("projnum", num), ("projden", den), ("S", shift), ("norm", norm), ("nkept", stats["n"]), ("nini", stats["n_ini"])):
            out.append((cfg.run, it, name, float(value or 0)))
        if walkers:
            new = merged
        else:
            fixed = merged.df.join(dense.df, "det", "left_semi") if block is not None else None
            loose = merged.df.join(dense.df, "det", "left_anti") if block is not None else merged.df
            with scope():
                small = compress(loose, cfg.target_nonzero, r=float(generator(cfg.seed, it).random()))
                new = Saved(small.select("det", "v") if fixed is None else small.select("det", "v").unionByName(fixed), "vec")
            merged.drop()
        vec.drop()
        vec = new
        if cfg.save_path and (it + 1) % cfg.save_every == 0:
            from ..sources.writers import save_checkpoint, save_state

            save_checkpoint(vec.df, cfg.save_path + "/vector", it + 1)
            save_state(spark, cfg.save_path + "/state", cfg.run, it + 1, shift, last, cfg.seed)
    return RunResult(out, vec.df, shift)


def resume(spark: SparkSession, model: Model, cfg: Config, spawn: str = "exact", **more) -> RunResult:
    """Go on with the run cfg.run from its last saved vector, shift and norm, up to cfg.iterations in all.

    Random numbers depend on the seed and the iteration, so the rest is the one that the run would have had.
    """
    from ..sources.readers import read_checkpoint
    from ..sources.writers import load_state

    if not cfg.save_path:
        raise ValueError("the run names no save_path")
    state = load_state(spark, cfg.save_path + "/state", cfg.run)
    if state is None:
        raise ValueError(f"no state of run {cfg.run!r}")
    vec = read_checkpoint(spark, cfg.save_path + "/vector", state["iter"], least=0.0)
    return ground_state(spark, model, cfg, spawn, initial=vec.select("det", "v"), shift=state["shift"], last=state["last_norm"], first=state["iter"], **more)


def apply_h(vec: DataFrame, model: Model, value: str = "v") -> DataFrame:
    off = model.offdiagonal(vec.select("det", value)).select(F.col("det2").alias("det"), (F.col("el") * F.col(value)).alias(value))
    own = vec.select("det", (model.diagonal() * F.col(value)).alias(value))
    return own.unionByName(off).groupBy("det").agg(F.sum(value).alias(value))


def fciqmc(spark: SparkSession, model: MoleculeModel, cfg: Config, **more) -> RunResult:
    return ground_state(spark, model, cfg, "walkers", **more)


def fciqmc_float(spark: SparkSession, model: MoleculeModel, cfg: Config, **more) -> RunResult:
    return ground_state(spark, model, cfg, "float_walkers", **more)


def power_multinomial(spark: SparkSession, model: MoleculeModel, cfg: Config, **more) -> RunResult:
    return ground_state(spark, model, cfg, "multinomial", **more)


def power_systematic(spark: SparkSession, model: MoleculeModel, cfg: Config, **more) -> RunResult:
    return ground_state(spark, model, cfg, "heat_bath", **more)


def power_exact(spark: SparkSession, model: Model, cfg: Config, **more) -> RunResult:
    return ground_state(spark, model, cfg, "exact", **more)


def chain_exact(spark: SparkSession, model: ChainModel, cfg: Config, **more) -> RunResult:
    return ground_state(spark, model, cfg, "exact", **more)


def chain_systematic(spark: SparkSession, model: ChainModel, cfg: Config, **more) -> RunResult:
    return ground_state(spark, model, cfg, "chain", **more)


def subspace(spark: SparkSession, model: MoleculeModel, cfg: Config, trials: DataFrame, values: list[str], product: str = "exact", low_memory: bool = False) -> RunResult:
    """k states at once. Each iteration: matrices <T|v>, <T|H|v>; every restart interval a rotation by the inverse of R
    of the overlap; compression of all columns; v <- v - eps (H - S) v for each.

    `low_memory` keeps no H T and computes <T|H|v> by applying H to the trial side when matrices are asked for.
    """
    k = len(values)
    mol = model.mol
    pinned = Saved(trials.select("det", *values).withColumn("pinned", F.lit(True)), "trials")
    h_trial = None if low_memory else Saved(h_columns(pinned.df.drop("pinned"), model, values, cfg.parity), "h-trials")
    vec = Saved(pinned.df, "vec")
    norms = vec.df.agg(*[F.sum(F.abs(v)).alias(v) for v in values]).first()
    vec = replaced(vec, vec.df.select("det", *[(F.col(v) * (1000.0 / norms[v])).alias(v) for v in values], "pinned"))
    shifts, last, out, matrices = np.zeros(k), [0.0] * k, [], []
    for it in range(cfg.iterations):
        with scope():
            row = vec.df.agg(*[F.sum(F.abs(v)).alias(v) for v in values]).first()
            norm = [float(row[v]) for v in values]
            for j in range(k):
                shifts[j], last[j] = adjust_geometric(float(shifts[j]), norm[j], last[j], cfg.damping / cfg.eps)
                out += [(cfg.run, it, f"norm{j}", norm[j]), (cfg.run, it, f"S{j}", float(shifts[j]))]
            if it % cfg.observe_every == 0:
                d = matrix(V.batched_dot(pinned.df, vec.df, values, values), k)
                left = h_trial.df if h_trial is not None else h_columns(pinned.df.drop("pinned"), model, values, cfg.parity)
                h = matrix(V.batched_dot(left, vec.df, values, values), k)
                matrices.append((it, h, d))
                if it and it % cfg.restart_interval == 0:
                    turn = linalg.inverse_r(d - cfg.eps * h)
                    turned = Saved(V.rotate(vec.df, values, turn), "vec")
                    after = turned.df.agg(*[F.sum(F.abs(v)).alias(v) for v in values]).first()
                    vec.drop()
                    vec = replaced(turned, turned.df.select("det", *[(F.col(v) * (norm[j] / after[v])).alias(v) for j, v in enumerate(values)], "pinned"))
            small = compress_columns(vec.df, values, cfg.target_nonzero, cfg.compression if cfg.compression != "heat_bath" else "pivotal", cfg.seed + 1000 * it, pinned="pinned")
            vec = replaced(vec, small)
            steps = None
            for j, v in enumerate(values):
                one = vec.df.where(F.col(v) != 0).select("det", F.col(v).alias("v"))
                threshold = cfg.initiator * norm[j] / max(1, cfg.target_nonzero)
                source = one if cfg.parity is None else molecule.unfold(one, "v", mol.n_orb, cfg.parity)
                if product == "exact":
                    adds = model.offdiagonal(source).select("det", "det2", (F.col("el") * F.col("v")).alias("x"))
                else:
                    p = cfg.p_doub if cfg.p_doub is not None else heat_bath.double_probability(mol)
                    adds = heat_bath.apply(source, mol, heat_bath.tensors(mol), cfg.matrix_nonzero, p, "pivotal", cfg.seed + 1000 * it + j).select("det", "det2", F.col("el").alias("x"))
                if cfg.parity is not None:  # elements within a pair become adds to its own key
                    origin, _ = molecule.fold("det", F.col("x"), mol.n_orb, cfg.parity)
                    target, x = molecule.fold("det2", F.col("x"), mol.n_orb, cfg.parity)
                    adds = adds.select(origin.alias("det"), target.alias("det2"), x.alias("x")).where("x <> 0")
                flags = flagged(one, cfg, threshold)
                adds = adds.join(flags.select("det", "ini"), "det").select(F.col("det2").alias("det"), (-cfg.eps * F.col("x")).alias("v"), "ini")
                step = V.death_cloning(one, "v", model.diagonal(), cfg.eps, float(shifts[j])).unionByName(V.accepted(one, adds).select("det", "v"))
                step = step.groupBy("det").agg(F.sum("v").alias(v))
                steps = step if steps is None else steps.join(step, "det", "full")
            merged = steps.join(vec.df.where("pinned").select("det", "pinned"), "det", "full")
            vec = replaced(vec, merged.select("det", *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values], F.coalesce("pinned", F.lit(False)).alias("pinned")))
    return RunResult(out, vec.df, float(shifts[0]), matrices)


def replaced(old: Saved, new: DataFrame) -> Saved:
    saved = Saved(new, "vec")
    old.drop()
    return saved


def matrix(cells: DataFrame, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for r in cells.collect():  # k * k rows
        out[r["i"], r["j"]] = r["dot"]
    return out


def h_columns(df: DataFrame, model: MoleculeModel, values: list[str], parity: int | None) -> DataFrame:
    out = None
    for v in values:
        one = df.where(F.col(v) != 0).select("det", F.col(v).cast("double").alias(v))
        if parity is None:
            part = apply_h(one, model, v)
        else:
            hv = molecule.multiply(one, model.mol, v, parity=parity)
            part = hv.unionByName(one.select("det", (F.col(v) * -model.e_ref).alias(v))).groupBy("det").agg(F.sum(v).alias(v))
        out = part if out is None else out.join(part, "det", "full")
    return out.na.fill(0.0)


def subspace_energies(result: RunResult, skip: int = 0) -> np.ndarray:
    """Generalised eigenvalues of the mean matrices."""
    kept = [(h, d) for it, h, d in result.matrices if it >= skip]
    return linalg.generalised_eigen(np.mean([h for h, _ in kept], 0), np.mean([d for _, d in kept], 0))[0]


def observable(spark: SparkSession, model: MoleculeModel, cfg: Config, des: int, cre: int, replicas: int = 1, initial: DataFrame | None = None) -> RunResult:
    """A one-electron observable: against a copy frozen after burn-in, or, with two replicas, between independent vectors.

    obs_num = <left| O |v>, obs_den = <left|v>; the first is divided by the second off-line.
    """
    vecs = [Saved(initial if initial is not None else start(spark, model, cfg), f"rep{i}") for i in range(replicas)]
    frozen, out = None, []
    for it in range(cfg.iterations):
        with scope():
            for i, v in enumerate(vecs):
                adds = exact_spawn(v.df, model, cfg, it)
                merged = V.merge(V.death_cloning(v.df, "v", model.diagonal(), cfg.eps, 0.0), V.accepted(v.df, adds)).where("v <> 0")
                if cfg.weight_power:
                    merged = merged.withColumn("__w", F.col("v")).drop("v").withColumn("v", F.col("__w") * F.pow(1 + F.abs("__w"), F.lit(cfg.weight_power)))
                    small = compress(merged, cfg.target_nonzero, r=float(generator(cfg.seed, it, i).random())).withColumn("v", F.col("v") / F.pow(1 + F.abs("__w"), F.lit(cfg.weight_power)))
                else:
                    small = compress(merged, cfg.target_nonzero, r=float(generator(cfg.seed, it, i).random()))
                vecs[i] = replaced(v, small.select("det", "v"))
        if it + 1 == cfg.burn_in or (frozen is None and it >= cfg.burn_in):
            frozen = Saved(vecs[0].df, "frozen")
        if it >= cfg.burn_in and it % cfg.observe_every == 0:
            left = vecs[1].df if replicas > 1 else frozen.df
            ov = molecule.one_electron(vecs[0].df, model.mol.n_orb, des, cre)
            out.append((cfg.run, it, "obs_num", float(V.dot(left, ov).first()[0])))
            out.append((cfg.run, it, "obs_den", float(V.dot(left, vecs[0].df).first()[0])))
    return RunResult(out, vecs[0].df, 0.0)


def vector_dots(vectors: dict[str, DataFrame]) -> DataFrame:
    """All pairwise dots of named vectors (det, v): first, second, dot, from one join by key."""
    rows = None
    for name, vec in vectors.items():
        part = vec.select(F.lit(name).alias("name"), "det", "v")
        rows = part if rows is None else rows.unionByName(part)
    both = rows.withColumnRenamed("name", "first").join(rows.select(F.col("name").alias("second"), "det", F.col("v").alias("w")), "det").where("first <= second")
    return both.groupBy("first", "second").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
