"""Registered queries over the test tables, and the SQL that gives the same rows independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stats
from .functions import bits as B
from .functions import strings
from .operators import compress as C
from .operators import heat_bath, hubbard, molecule, samplers
from .operators import vector as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


# Base relations ------------------------------------------------------------------------------------------------------

SIGNED = "CASE WHEN {flag} THEN -l_quantity ELSE l_quantity END"
VEC = "SELECT l_partkey AS det, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS BIGINT) AS v FROM lineitem GROUP BY 1 HAVING sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) <> 0"
VEC2 = "SELECT l_partkey AS det, CAST(sum(CASE WHEN l_linestatus = 'O' THEN -l_quantity ELSE l_quantity END) AS BIGINT) AS v FROM lineitem GROUP BY 1 HAVING sum(CASE WHEN l_linestatus = 'O' THEN -l_quantity ELSE l_quantity END) <> 0"
DETS6 = "SELECT det FROM (SELECT CAST(range AS BIGINT) AS det FROM range(4096)) WHERE bit_count(det & 63) = 3 AND bit_count(det >> 6) = 3"
#: Every row of lineitem counts for one of the 400 half-filled states.
AMP = f"SELECT d.det, CAST(sum(l_quantity) AS BIGINT) AS v FROM (SELECT det, row_number() OVER (ORDER BY det) - 1 AS k FROM ({DETS6})) d JOIN lineitem ON l_orderkey % 400 = d.k GROUP BY 1"
PAIRS = f"SELECT a.det AS det, b.det AS det2 FROM ({DETS6}) a JOIN ({DETS6}) b ON (a.det + 31 * b.det) % 97 = 0"
#: Irreps of six orbitals and the chain's boundary pair of bits.
IRREPS = [0, 1, 2, 0, 1, 2]
IRREP_SQL = "[0, 1, 2, 0, 1, 2]"
N = 6


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def signed_vector(spark: SparkSession, d: str, flag: str, value: str) -> DataFrame:
    items = read(spark, d, "lineitem").select("l_partkey", "l_quantity", flag)
    amount = F.when(F.col(flag) == value, -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return items.groupBy(F.col("l_partkey").alias("det")).agg(F.sum(amount).cast("long").alias("v")).where("v <> 0")


def vec(spark: SparkSession, d: str) -> DataFrame:
    return signed_vector(spark, d, "l_returnflag", "R")


def vec2(spark: SparkSession, d: str) -> DataFrame:
    return signed_vector(spark, d, "l_linestatus", "O")


def dets6(spark: SparkSession) -> DataFrame:
    return spark.range(4096).select(F.col("id").alias("det")).where((F.bit_count(F.col("det").bitwiseAND(63)) == 3) & (F.bit_count(B.shr("det", 6)) == 3))


def amp(spark: SparkSession, d: str) -> DataFrame:
    states = F.array(*[F.lit(k).cast("long") for k in range(4096) if (k & 63).bit_count() == (k >> 6).bit_count() == 3])
    items = read(spark, d, "lineitem").select((F.col("l_orderkey") % 400).cast("int").alias("k"), "l_quantity")
    return items.groupBy("k").agg(F.sum("l_quantity").cast("long").alias("v")).select(F.get(states, F.col("k")).alias("det"), "v")


def pairs(spark: SparkSession) -> DataFrame:
    a = dets6(spark).withColumn("k", F.col("det") % 97)
    b = dets6(spark).select(F.col("det").alias("det2"), F.pmod(-31 * F.col("det"), F.lit(97)).alias("k"))
    return a.join(b, "k").select("det", "det2")


def chain(**more) -> hubbard.Chain:
    return hubbard.Chain(N, N, u=2.0, t=1.0, **more)


# Compression ---------------------------------------------------------------------------------------------------------

M = 500
PRESERVED = """
ranked AS (SELECT *, abs(v) AS a, row_number() OVER (ORDER BY abs(v) DESC, {key}) AS k, CAST(sum(abs(v)) OVER () AS BIGINT) AS total, CAST(sum(abs(v)) OVER (ORDER BY abs(v) DESC, {key} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM src),
greedy AS (SELECT *, CAST(a AS HUGEINT) * ({m} - k + 1) >= total - (upto - a) AND k <= {m} AS ok FROM ranked),
kept AS (SELECT *, min(CASE WHEN ok THEN 1 ELSE 0 END) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) = 1 AS keep FROM greedy)"""
RESAMPLED = """
left_over AS (SELECT {m} - count(*) FILTER (WHERE keep) AS n, CAST(coalesce(sum(a) FILTER (WHERE NOT keep), 0) AS BIGINT) AS g FROM kept),
cumulative AS (SELECT kept.*, n, g, CAST(sum(CASE WHEN keep THEN 0 ELSE a END) OVER (ORDER BY {key} ROWS UNBOUNDED PRECEDING) AS HUGEINT) AS c FROM kept CROSS JOIN left_over),
ticked AS (SELECT *, CASE WHEN keep OR g = 0 THEN 0 ELSE (2 * c * n + g - 1) // (2 * g) - (2 * (c - a) * n + g - 1) // (2 * g) END AS hits FROM cumulative)"""


def new_values(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.round("new", 6).alias("new_val"), "keep")


@query("compress_systematic", f"WITH src AS ({VEC}), {PRESERVED.format(key='det', m=M)}, {RESAMPLED.format(key='det', m=M)} SELECT det, round(CASE WHEN keep THEN CAST(v AS DOUBLE) ELSE sign(v) * (CAST(g AS DOUBLE) / n) END, 6) AS new_val, keep FROM ticked WHERE keep OR hits > 0")
def compress_systematic(spark, d):
    return new_values(C.systematic(C.preserve(vec(spark, d), M)), "det")


CUBED = f"SELECT det, v * v * v AS v FROM ({VEC})"


@query("compress_cubed", f"WITH src AS ({CUBED}), {PRESERVED.format(key='det', m=M)}, {RESAMPLED.format(key='det', m=M)} SELECT det, round(CASE WHEN keep THEN CAST(v AS DOUBLE) ELSE sign(v) * (CAST(g AS DOUBLE) / n) END, 6) AS new_val, keep FROM ticked WHERE keep OR hits > 0")
def compress_cubed(spark, d):
    return new_values(C.systematic(C.preserve(vec(spark, d).withColumn("v", F.expr("v * v * v")), M)), "det")


@query("compress_preserve", f"WITH src AS ({CUBED}), {PRESERVED.format(key='det', m=M)} SELECT det, v, keep FROM kept")
def compress_preserve(spark, d):
    return C.preserve(vec(spark, d).withColumn("v", F.expr("v * v * v")), M).df.select("det", "v", "keep")


@query("systematic_by_segment", """WITH src AS (SELECT l_suppkey AS seg, l_partkey AS det, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, sum(v) OVER (PARTITION BY seg) AS g, sum(v) OVER (PARTITION BY seg ORDER BY det ROWS UNBOUNDED PRECEDING) AS c FROM src)
SELECT seg, det, round(g / 3, 6) AS new_val FROM c WHERE greatest(0, ceil(CAST(c * 3 AS DOUBLE) / g - 0.5)) > greatest(0, ceil(CAST((c - v) * 3 AS DOUBLE) / g - 0.5))""")
def systematic_by_segment(spark, d):
    src = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("seg"), F.col("l_partkey").alias("det")).agg(F.sum("l_quantity").cast("long").alias("v"))
    return C.systematic_segments(src, ["seg"], F.lit(3), "v", ["det"], F.lit(0.5)).select("seg", "det", F.round("new", 6).alias("new_val"))


@query("systematic_budget", """WITH src AS (SELECT l_suppkey AS part, CAST(sum(l_quantity) AS BIGINT) AS norm FROM lineitem GROUP BY 1),
c AS (SELECT *, sum(norm) OVER () AS g, CAST(sum(norm) OVER (ORDER BY part ROWS UNBOUNDED PRECEDING) AS HUGEINT) AS c FROM src)
SELECT part, CAST((2 * c * 1000 + g - 1) // (2 * g) - (2 * (c - norm) * 1000 + g - 1) // (2 * g) AS BIGINT) AS budget FROM c""")
def systematic_budget(spark, d):
    norms = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("part")).agg(F.sum("l_quantity").cast("long").alias("norm"))
    return C.systematic_budget(norms, "part", "norm", 1000).select("part", "budget")


CHILDREN = "SELECT l_orderkey AS id, l_linenumber AS sub, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2"


@query("hierarchical_systematic", f"WITH src AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY sub) - 1 AS INTEGER) AS sub, v FROM ({CHILDREN})), {PRESERVED.format(key='id, sub', m=400)}, {RESAMPLED.format(key='id, sub', m=400)} SELECT id, sub, round(CASE WHEN keep THEN CAST(v AS DOUBLE) ELSE sign(v) * (CAST(g AS DOUBLE) / n) END, 6) AS new_val FROM ticked WHERE keep OR hits > 0")
def hierarchical_systematic(spark, d):
    lines = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("long").alias("q"))
    rows = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "q"))), lambda x: x["q"]).alias("w")).withColumn("v", F.lit(1).cast("long"))
    return C.hierarchical(rows, 400, "w", "v", "id").select("id", "sub", F.round("new", 6).alias("new_val"))


@query("column_sample_counts", f"""WITH src AS ({VEC}), c AS (SELECT det, abs(v) AS a, sum(abs(v)) OVER () AS g, CAST(sum(abs(v)) OVER (ORDER BY det ROWS UNBOUNDED PRECEDING) AS HUGEINT) AS c FROM src)
SELECT det, CAST((2 * c * 5000 + g - 1) // (2 * g) - (2 * (c - a) * 5000 + g - 1) // (2 * g) AS BIGINT) AS n_walk FROM c""")
def column_sample_counts(spark, d):
    return C.column_samples(vec(spark, d), 5000).select("det", "n_walk")


@query("round_binomial_hash", f"SELECT det, CAST(floor(v / 8.0) + CASE WHEN ((det * 7919) % 1000) / 1000.0 < v / 8.0 - floor(v / 8.0) THEN 1 ELSE 0 END AS BIGINT) AS rounded FROM ({VEC})")
def round_binomial_hash(spark, d):
    u = ((F.col("det") * 7919) % 1000) / 1000.0
    return vec(spark, d).select("det", C.round_binomial(F.col("v") / 8.0, u).alias("rounded"))


@query("round_small_elements", f"SELECT det, CASE WHEN abs(v) < 40 THEN sign(v) * CASE WHEN ((det * 7919) % 1000) / 1000.0 * 40.0 < abs(v) THEN 40.0 ELSE 0.0 END ELSE CAST(v AS DOUBLE) END AS rounded FROM ({VEC})")
def round_small_elements(spark, d):
    u = ((F.col("det") * 7919) % 1000) / 1000.0
    return vec(spark, d).select("det", C.round_small(F.col("v").cast("double"), u, 40.0).alias("rounded"))


@query("uniform_children", f"""WITH src AS (SELECT det AS id, sub, CAST(v AS DOUBLE) * (1.0 / k) AS child FROM (SELECT det, v, det % 4 + 1 AS k FROM ({VEC})), LATERAL (SELECT CAST(range AS INTEGER) AS sub FROM range(0, k)))
SELECT id, sub, round(child, 6) AS child FROM src""")
def uniform_children(spark, d):
    rows = vec(spark, d).select(F.col("det").alias("id"), "v", (F.col("det") % 4 + 1).alias("k"))
    return C.children(rows, None, "v", "k", "id").select("id", "sub", F.round("child", 6).alias("child"))


# Vector store --------------------------------------------------------------------------------------------------------

#: Adds by order key, of which some are keys of the vector.
SPAWN = "SELECT l_orderkey AS det, CAST(sum(CASE WHEN l_linestatus = 'O' THEN -l_quantity ELSE l_quantity END) AS BIGINT) AS v, l_orderkey % 3 = 0 AS ini FROM lineitem GROUP BY l_orderkey HAVING sum(CASE WHEN l_linestatus = 'O' THEN -l_quantity ELSE l_quantity END) <> 0"
DISTINCT = "(SELECT det, v FROM a UNION ALL SELECT det, v FROM b)"


def spawned(spark, d):
    amount = F.when(F.col("l_linestatus") == "O", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    sums = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("det")).agg(F.sum(amount).cast("long").alias("v"))
    return sums.where("v <> 0").withColumn("ini", F.col("det") % 3 == 0)


@query("vector_merge", f"SELECT det, CAST(sum(v) AS BIGINT) AS v FROM (SELECT * FROM ({VEC}) UNION ALL SELECT * FROM ({VEC2})) GROUP BY 1")
def vector_merge(spark, d):
    return V.merge(vec(spark, d), vec2(spark, d))


@query("vector_merge_initiator", f"SELECT det, CAST(sum(v) AS BIGINT) AS v FROM (SELECT det, v FROM ({VEC}) UNION ALL SELECT det, v FROM ({SPAWN}) s WHERE ini OR det IN (SELECT det FROM ({VEC}))) GROUP BY 1")
def vector_merge_initiator(spark, d):
    return V.merge(vec(spark, d), V.accepted(vec(spark, d), spawned(spark, d)))


@query("merge_in_place", f"SELECT det, CAST(sum(v) AS BIGINT) AS v FROM (SELECT det, v FROM ({VEC}) UNION ALL SELECT det, v FROM ({SPAWN}) s WHERE ini OR det IN (SELECT det FROM ({VEC})) OR det IN (SELECT det FROM ({SPAWN}) WHERE ini)) GROUP BY 1")
def merge_in_place(spark, d):
    return V.merge_initiator(vec(spark, d), spawned(spark, d))


@query("rejected_spawns", f"SELECT det, v FROM ({SPAWN}) WHERE NOT ini AND det NOT IN (SELECT det FROM ({VEC}))")
def rejected_spawns(spark, d):
    return V.rejected(vec(spark, d), spawned(spark, d)).select("det", "v")


@query("accepted_non_initiators", f"SELECT count(*) AS n_accepted FROM ({SPAWN}) WHERE NOT ini AND det IN (SELECT det FROM ({VEC}))")
def accepted_non_initiators(spark, d):
    return V.accepted_non_initiators(vec(spark, d), spawned(spark, d))


@query("sign_coherent_count", f"SELECT CAST(sum(CASE WHEN a.v * b.v > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_coherent FROM ({VEC}) a JOIN ({VEC2}) b USING (det)")
def sign_coherent_count(spark, d):
    return V.sign_coherent(vec(spark, d), vec2(spark, d))


@query("sparse_dot", f"SELECT CAST(sum(a.v * b.v) AS BIGINT) AS dot FROM ({VEC}) a JOIN ({VEC2}) b USING (det)")
def sparse_dot(spark, d):
    return V.dot(vec(spark, d), vec2(spark, d))


@query("batched_dot", f"""WITH a AS (SELECT det, v AS v0, v * 2 AS v1 FROM ({VEC})), b AS (SELECT det, v AS v0, v + 1 AS v1, v - det AS v2 FROM ({VEC2}))
SELECT i, j, CAST(sum(CASE i WHEN 0 THEN a.v0 ELSE a.v1 END * CASE j WHEN 0 THEN b.v0 WHEN 1 THEN b.v1 ELSE b.v2 END) AS BIGINT) AS dot FROM a JOIN b USING (det), (SELECT CAST(range AS INTEGER) AS i FROM range(2)), (SELECT CAST(range AS INTEGER) AS j FROM range(3)) GROUP BY 1, 2""")
def batched_dot(spark, d):
    a = vec(spark, d).select("det", F.col("v").alias("v0"), (F.col("v") * 2).alias("v1"))
    b = vec2(spark, d).select("det", F.col("v").alias("v0"), (F.col("v") + 1).alias("v1"), (F.col("v") - F.col("det")).alias("v2"))
    return V.batched_dot(a, b, ["v0", "v1"], ["v0", "v1", "v2"])


TWO = f"SELECT coalesce(a.det, b.det) AS det, coalesce(a.v, 0) AS v0, coalesce(b.v, 0) AS v1 FROM ({VEC}) a FULL JOIN ({VEC2}) b ON a.det = b.det"


def two(spark, d):
    return vec(spark, d).withColumnRenamed("v", "v0").join(vec2(spark, d).withColumnRenamed("v", "v1"), "det", "full").na.fill(0)


@query("internal_dot", f"SELECT CAST(sum(v0 * v1) AS BIGINT) AS dot FROM ({TWO})")
def internal_dot(spark, d):
    return V.internal_dot(two(spark, d), "v0", "v1")


@query("one_norm", f"SELECT CAST(sum(abs(v)) AS BIGINT) AS one_norm FROM ({VEC})")
def one_norm(spark, d):
    return V.one_norm(vec(spark, d))


@query("sum_squares", f"SELECT CAST(sum(v * v) AS BIGINT) AS sum_squares FROM ({VEC})")
def sum_squares(spark, d):
    return V.sum_squares(vec(spark, d))


@query("dense_norm", f"SELECT CAST(sum(abs(v)) AS BIGINT) AS dense_norm FROM ({VEC}) WHERE det <= 50")
def dense_norm(spark, d):
    return V.dense_norm(vec(spark, d).withColumn("is_dense", F.col("det") <= 50))


@query("vector_counts", f"SELECT count(*) AS n_keys, CAST(sum(CASE WHEN v0 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_nonzero FROM ({TWO})")
def vector_counts(spark, d):
    return V.counts(two(spark, d), "v0")


@query("axpy", f"SELECT det, v0 + 3 * v1 AS v0, v1 FROM ({TWO})")
def axpy(spark, d):
    return V.axpy(two(spark, d), "v0", "v1", 3)


@query("copy_column", f"SELECT det, v0, v0 AS v1 FROM ({TWO})")
def copy_column(spark, d):
    return V.copy(two(spark, d), "v0", "v1")


@query("weight_vec", f"SELECT det, v0 * (1 + abs(v1)) AS v0, v1 FROM ({TWO})")
def weight_vec(spark, d):
    return V.weight(two(spark, d), "v0", "v1", 1)


@query("zero_prune", f"SELECT det, v0 + v1 AS v0, 0 AS v1, det <= 20 AS pinned FROM ({TWO}) WHERE v0 + v1 <> 0 OR det <= 20")
def zero_prune(spark, d):
    df = V.zero(V.axpy(two(spark, d), "v0", "v1"), "v1").withColumn("pinned", F.col("det") <= 20)
    return V.prune(df, ["v0", "v1"], "pinned").withColumn("v1", F.col("v1").cast("int"))


@query("pin_dense", f"SELECT coalesce(a.det, p.det) AS det, coalesce(v, 0) AS v, p.det IS NOT NULL AS is_dense FROM ({VEC}) a FULL JOIN (SELECT 3 * s_suppkey AS det FROM supplier) p ON a.det = p.det")
def pin_dense(spark, d):
    keys = read(spark, d, "supplier").select((3 * F.col("s_suppkey")).alias("det"))
    return V.pin(vec(spark, d), keys, "is_dense")


@query("diag_multiply", f"SELECT det, v0, v0 * (2 + 3 * (det % 7)) AS v1 FROM ({TWO})")
def diag_multiply(spark, d):
    return V.diag_multiply(two(spark, d), "v0", "v1", F.col("det") % 7, 2, 3).select("det", "v0", F.col("v1").cast("long").alias("v1"))


@query("coo_multiply", f"SELECT l_suppkey AS det, CAST(sum(l_quantity * v) AS BIGINT) AS v FROM lineitem JOIN ({VEC}) ON det = l_partkey GROUP BY 1")
def coo_multiply(spark, d):
    coo = read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("val"))
    return V.coo_multiply(coo, vec(spark, d)).select("det", F.col("v").cast("long").alias("v"))


@query("rotate_columns", f"SELECT det, CAST(2 * v0 + v1 AS DOUBLE) AS v0, CAST(v0 - v1 AS DOUBLE) AS v1 FROM ({TWO})")
def rotate_columns(spark, d):
    return V.rotate(two(spark, d), ["v0", "v1"], [[2, 1], [1, -1]])


@query("orbital_occupations", f"SELECT CAST(orb AS INTEGER) AS orb, CAST(sum(v * v) AS BIGINT) AS occupation FROM ({AMP}), range(12) t(orb) WHERE (det >> orb) & 1 = 1 GROUP BY 1")
def orbital_occupations(spark, d):
    return molecule.orbital_occupations(amp(spark, d), N)


# Bit strings ---------------------------------------------------------------------------------------------------------

LISTED = "array_to_string(list_filter(range(0, 12), lambda k: (({x} >> k) & 1) = 1), ',')"
BETWEEN = "bit_count({d} & ((CAST(1 AS BIGINT) << greatest({a}, {b})) - 1) & ~((CAST(1 AS BIGINT) << (least({a}, {b}) + 1)) - 1))"


@query("bit_positions", f"SELECT det, {LISTED.format(x='det')} AS occ, array_to_string(list_filter(range(0, 6), lambda k: ((det >> k) & 1) = 0), ',') AS virt FROM ({DETS6})")
def bit_positions(spark, d):
    return dets6(spark).select("det", F.array_join(B.positions("det", 12).cast("array<string>"), ",").alias("occ"), F.array_join(B.empty_positions("det", 0, 6).cast("array<string>"), ",").alias("virt"))


@query("bits_changed", f"SELECT det, det | (CAST(1 AS BIGINT) << CAST(det % 12 AS INTEGER)) AS with_bit, det & ~(CAST(1 AS BIGINT) << CAST(det % 12 AS INTEGER)) AS without_bit, CAST((det >> CAST(det % 12 AS INTEGER)) & 1 AS INTEGER) AS was FROM ({DETS6})")
def bits_changed(spark, d):
    k = F.col("det") % 12
    return dets6(spark).select("det", B.set_bit("det", k).alias("with_bit"), B.zero_bit("det", k).alias("without_bit"), B.read_bit("det", k).alias("was"))


@query("bits_between", f"SELECT det, CAST({BETWEEN.format(d='det', a='a', b='b')} AS INTEGER) AS n, CAST(1 - 2 * ({BETWEEN.format(d='det', a='a', b='b')} % 2) AS INTEGER) AS sign, a, b FROM (SELECT det, CAST(det % 12 AS INTEGER) AS a, CAST((det * 5 + 1) % 12 AS INTEGER) AS b FROM ({DETS6})) WHERE a <> b")
def bits_between(spark, d):
    df = dets6(spark).select("det", (F.col("det") % 12).cast("int").alias("a"), ((F.col("det") * 5 + 1) % 12).cast("int").alias("b")).where("a <> b")
    return df.select("det", B.ones_between("det", "a", "b").cast("int").alias("n"), B.excite_sign("det", "a", "b").cast("int").alias("sign"), "a", "b")


@query("find_excitation", f"SELECT det, det2, CAST(bit_count(xor(det, det2) & det) AS INTEGER) AS level, concat_ws(',', nullif({LISTED.format(x='(xor(det, det2) & det)')}, ''), nullif({LISTED.format(x='(xor(det, det2) & det2)')}, '')) AS orbs FROM ({PAIRS}) WHERE bit_count(xor(det, det2) & det) <= 2")
def find_excitation(spark, d):
    df = pairs(spark).withColumn("level", B.excitation_level("det", "det2").cast("int")).where("level is not null")
    return df.select("det", "det2", "level", F.array_join(B.excitation("det", "det2", 12).cast("array<string>"), ",").alias("orbs"))


@query("diff_positions", f"SELECT det, det2, CASE WHEN bit_count(xor(det, det2)) <= 4 THEN {LISTED.format(x='xor(det, det2)')} END AS diff FROM ({PAIRS})")
def diff_positions(spark, d):
    return pairs(spark).select("det", "det2", F.array_join(B.diff_positions("det", "det2", 12).cast("array<string>"), ",").alias("diff"))


@query("flip_spins", f"SELECT det, ((det & 63) << 6) | (det >> 6) AS flipped, least(det, ((det & 63) << 6) | (det >> 6)) AS canonical FROM ({DETS6})")
def flip_spins(spark, d):
    return dets6(spark).select("det", B.flip_spins("det", N).alias("flipped"), molecule.fold("det", F.lit(1.0), N, 1)[0].alias("canonical"))


@query("flip_connection", f"SELECT det, CAST(least(bit_count((det & 63) & ~(det >> 6)), 2) AS INTEGER) AS kind FROM ({DETS6})")
def flip_connection(spark, d):
    return dets6(spark).select("det", B.flip_connection("det", N).cast("int").alias("kind"))


@query("nth_virtual", f"SELECT det, CAST(list_filter(range(0, 6), lambda k: ((det >> k) & 1) = 0)[1 + CAST(det % 4 AS INTEGER)] AS INTEGER) AS alpha, CAST(list_filter(range(6, 12), lambda k: ((det >> k) & 1) = 0)[1 + CAST(det % 4 AS INTEGER)] AS INTEGER) AS beta FROM ({DETS6})")
def nth_virtual(spark, d):
    n = (F.col("det") % 4).cast("int")
    return dets6(spark).select("det", B.nth_virtual("det", F.lit(0), n, N).alias("alpha"), B.nth_virtual("det", F.lit(1), n, N).alias("beta"))


@query("sorted_replace", f"SELECT det, array_to_string(list_sort(list_append(list_filter(occ, lambda k: k <> occ[1]), 20)), ',') AS occ FROM (SELECT det, list_filter(range(0, 12), lambda k: ((det >> k) & 1) = 1) AS occ FROM ({DETS6}))")
def sorted_replace(spark, d):
    df = dets6(spark).withColumn("occ", B.positions("det", 12))
    return df.select("det", F.array_join(B.replace_sorted("occ", F.get("occ", F.lit(0)), F.lit(20)).cast("array<string>"), ",").alias("occ"))


# Excitations by symmetry ---------------------------------------------------------------------------------------------

ORBS = "SELECT CAST(range AS INTEGER) AS {x} FROM range(12)"


def on(x: str) -> str:
    return f"((det >> {x}) & 1) = 1"


def off(x: str) -> str:
    return f"((det >> {x}) & 1) = 0"


def one(x: str) -> str:
    return f"(CAST(1 AS BIGINT) << {x})"


def irrep(x: str) -> str:
    return f"{IRREP_SQL}[1 + {x} % 6]"


@query("irrep_lookup", "SELECT CAST(p_partkey % 8 AS INTEGER) AS irrep, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS orbs FROM part GROUP BY 1")
def irrep_lookup(spark, d):
    orbs = read(spark, d, "part").select(F.col("p_partkey").alias("orb"), (F.col("p_partkey") % 8).cast("int").alias("irrep"))
    return molecule.irrep_lookup(orbs).select("irrep", F.array_join(F.col("orbs").cast("array<string>"), ",").alias("orbs"))


@query("single_excitations", f"SELECT det, i, a, (det & ~{one('i')}) | {one('a')} AS det2, CAST(1 - 2 * ({BETWEEN.format(d='det', a='i', b='a')} % 2) AS INTEGER) AS sign FROM ({DETS6}), ({ORBS.format(x='i')}), ({ORBS.format(x='a')}) WHERE {on('i')} AND {off('a')} AND i // 6 = a // 6 AND {irrep('i')} = {irrep('a')}")
def single_excitations(spark, d):
    df = molecule.singles(dets6(spark), N, IRREPS)
    return df.select("det", F.col("i").cast("int").alias("i"), F.col("a").cast("int").alias("a"), "det2", F.col("sign").cast("int").alias("sign"))


CORE = f"(det & ~{one('i')} & ~{one('j')})"


@query("double_excitations", f"""SELECT det, i, j, a, b, {CORE} | {one('a')} | {one('b')} AS det2,
CAST(1 - 2 * (({BETWEEN.format(d=CORE, a='i', b='a')} + {BETWEEN.format(d=CORE, a='j', b='b')}) % 2) AS INTEGER) AS sign
FROM ({DETS6}), ({ORBS.format(x='i')}), ({ORBS.format(x='j')}), ({ORBS.format(x='a')}), ({ORBS.format(x='b')})
WHERE i < j AND a < b AND {on('i')} AND {on('j')} AND {off('a')} AND {off('b')} AND i // 6 = a // 6 AND j // 6 = b // 6 AND xor(xor({irrep('i')}, {irrep('j')}), xor({irrep('a')}, {irrep('b')})) = 0""")
def double_excitations(spark, d):
    df = molecule.doubles(dets6(spark), N, IRREPS)
    return df.select("det", *[F.col(x).cast("int").alias(x) for x in "ijab"], "det2", F.col("sign").cast("int").alias("sign"))


@query("count_singles", f"SELECT det, CAST(count(a) AS INTEGER) AS n FROM ({DETS6}) LEFT JOIN (SELECT i, a FROM ({ORBS.format(x='i')}), ({ORBS.format(x='a')})) ON {on('i')} AND {off('a')} AND i // 6 = a // 6 AND {irrep('i')} = {irrep('a')} GROUP BY 1")
def count_singles(spark, d):
    return dets6(spark).select("det", molecule.count_singles(N, IRREPS).cast("int").alias("n"))


@query("virtual_counts", f"SELECT det, CAST(x AS INTEGER) AS irrep, CAST(s AS INTEGER) AS spin, CAST(count(k) AS INTEGER) AS n FROM ({DETS6}) CROSS JOIN range(3) t(x) CROSS JOIN range(2) u(s) LEFT JOIN (SELECT CAST(range AS INTEGER) AS k FROM range(6)) ON {IRREP_SQL}[1 + k] = x AND ((det >> CAST(k + 6 * s AS INTEGER)) & 1) = 0 GROUP BY 1, 2, 3")
def virtual_counts(spark, d):
    from .operators.near_uniform import virtual_counts as counts

    df = dets6(spark).select("det", F.posexplode(counts("det", IRREPS)).alias("at", "n")).where("at < 6")
    return df.select("det", (F.col("at") / 2).cast("int").alias("irrep"), (F.col("at") % 2).cast("int").alias("spin"), F.col("n").cast("int").alias("n"))


@query("one_electron_operator", f"""SELECT det2 AS det, CAST(sum(x) AS BIGINT) AS v FROM (SELECT (det & ~{one('i')}) | {one('a')} AS det2, v * (1 - 2 * ({BETWEEN.format(d='det', a='i', b='a')} % 2)) AS x
FROM ({AMP}), (VALUES (1, 4), (7, 10)) t(i, a) WHERE {on('i')} AND {off('a')}) GROUP BY 1""")
def one_electron_operator(spark, d):
    return molecule.one_electron(amp(spark, d), N, 1, 4).select("det", F.col("v").cast("long").alias("v"))


# Hubbard-Holstein chain ----------------------------------------------------------------------------------------------

HOPS = f"SELECT a.det AS det, b.det AS det2 FROM ({DETS6}) a JOIN ({DETS6}) b ON bit_count(xor(a.det, b.det)) = 2 AND bit_count(xor(a.det, b.det) & (2 * xor(a.det, b.det))) = 1 AND xor(a.det, b.det) <> 96"


@query("hubbard_diag", f"SELECT det, CAST(bit_count((det & 63) & (det >> 6)) AS INTEGER) AS n FROM ({DETS6})")
def hubbard_diag(spark, d):
    return dets6(spark).select("det", B.doubly_occupied("det", N).cast("int").alias("n"))


@query("hubbard_hops", HOPS)
def hubbard_hops(spark, d):
    return hubbard.hops(dets6(spark), N).select("det", "det2")


MULTIPLIED = f"SELECT det, CAST(sum(x) AS DOUBLE) AS v FROM (SELECT det, 2 * bit_count((det & 63) & (det >> 6)) * v AS x FROM ({AMP}) UNION ALL SELECT h.det2, -v FROM ({AMP}) a JOIN ({HOPS}) h ON h.det = a.det) GROUP BY 1 HAVING sum(x) <> 0"


@query("hubbard_multiply", MULTIPLIED)
def hubbard_multiply(spark, d):
    return hubbard.multiply(amp(spark, d), chain())


NEEL = strings.neel_string(N, N)


@query("neel_overlap", f"SELECT CAST(coalesce(sum(v), 0) AS DOUBLE) AS overlap FROM ({AMP}) a JOIN ({HOPS}) h ON h.det2 = a.det WHERE h.det = {NEEL}")
def neel_overlap(spark, d):
    return hubbard.reference_overlap(amp(spark, d), chain())


@query("power_step", f"SELECT det, CAST(sum(x) AS DOUBLE) AS v FROM (SELECT det, 64 * v AS x FROM ({AMP}) UNION ALL SELECT det, -v FROM ({MULTIPLIED})) GROUP BY 1")
def power_step(spark, d):
    v = amp(spark, d)
    step = hubbard.multiply(v, chain()).withColumn("v", -F.col("v"))
    return V.merge(v.withColumn("v", (64 * F.col("v")).cast("double")), step)


HOLSTEIN_KEYS = f"SELECT det + ((det % 4) << 12) + (((det // 4) % 4) << 14) AS det, v FROM ({AMP})"


@query("phonon_moves", f"""WITH src AS ({HOLSTEIN_KEYS}), m AS (SELECT det, site, d, ((det >> site) & 1) + ((det >> (site + 6)) & 1) AS occ, (det >> (12 + 2 * site)) & 3 AS ph FROM src, (SELECT CAST(range AS INTEGER) AS site FROM range(6)), (VALUES (1), (-1)) t(d))
SELECT det, site, d AS change, det + d * (CAST(1 AS BIGINT) << (12 + 2 * site)) AS det2, round(0.5 * occ * sqrt(greatest(ph, ph + d)), 9) AS el FROM m WHERE occ > 0 AND ph + d BETWEEN 0 AND 3""")
def phonon_moves(spark, d):
    src = amp(spark, d).select((F.col("det") + B.shl(F.col("det") % 4, 12) + B.shl(F.floor(F.col("det") / 4) % 4, 14)).alias("det"))
    got = hubbard.phonon_moves(src, chain(g=0.5, omega=1.0, ph_bits=2))
    return got.select("det", "site", F.col("by").alias("change"), "det2", F.round("el", 9).alias("el"))


@query("phonon_totals", f"WITH src AS ({HOLSTEIN_KEYS}) SELECT det, CAST((det >> 12) & 3 AS BIGINT) + ((det >> 14) & 3) AS n, array_to_string([(det >> 12) & 3, (det >> 14) & 3, (det >> 16) & 3, (det >> 18) & 3, (det >> 20) & 3, (det >> 22) & 3], ',') AS phonons FROM src")
def phonon_totals(spark, d):
    src = amp(spark, d).select((F.col("det") + B.shl(F.col("det") % 4, 12) + B.shl(F.floor(F.col("det") / 4) % 4, 14)).alias("det"))
    c = chain(ph_bits=2)
    return src.select("det", c.total_phonons().alias("n"), F.array_join(c.phonons().cast("array<string>"), ",").alias("phonons"))


# Heat-bath tensors ---------------------------------------------------------------------------------------------------

RAW = "SELECT p, q, r, s, 1 + (5 * (p + r) + 3 * p * r + 5 * (q + s) + 3 * q * s + (p + r) * (q + s)) % 17 AS val FROM (SELECT CAST(range AS INTEGER) AS p FROM range(6)), (SELECT CAST(range AS INTEGER) AS q FROM range(6)), (SELECT CAST(range AS INTEGER) AS r FROM range(6)), (SELECT CAST(range AS INTEGER) AS s FROM range(6))"
D_DIFF = f"SELECT p, q, CAST(sum(abs(val)) AS BIGINT) AS d FROM ({RAW}) WHERE p <> r AND q <> s GROUP BY 1, 2"
D_SAME = f"SELECT a.p, a.q, CAST(2 * sum(abs(a.val - b.val)) AS BIGINT) AS d FROM ({RAW}) a JOIN ({RAW}) b ON a.p = b.p AND a.q = b.q AND a.r = b.s AND a.s = b.r WHERE a.p < a.q AND a.s < a.r AND a.r <> a.p AND a.r <> a.q AND a.s <> a.p AND a.s <> a.q GROUP BY 1, 2"
S_SUM = f"SELECT p, CAST(sum(d) AS BIGINT) AS s FROM (SELECT p, d FROM ({D_SAME}) UNION ALL SELECT q, d FROM ({D_SAME}) UNION ALL SELECT p, d FROM ({D_DIFF})) GROUP BY 1"


def raw_tensor(spark: SparkSession) -> DataFrame:
    k = F.col("id")
    df = spark.range(6**4).select(*[(F.floor(k / 6**e) % 6).cast("int").alias(x) for x, e in zip("pqrs", (3, 2, 1, 0), strict=True)])
    return df.withColumn("val", F.expr("1 + (5 * (p + r) + 3 * p * r + 5 * (q + s) + 3 * q * s + (p + r) * (q + s)) % 17"))


@query("hb_tensors", f"SELECT 'diff' AS kind, p, q, d FROM ({D_DIFF}) UNION ALL SELECT 'same', p, q, d FROM ({D_SAME}) UNION ALL SELECT 'sum', p, -1, s FROM ({S_SUM})")
def hb_tensors(spark, d):
    diff, same, s = heat_bath.tensor_tables(raw_tensor(spark))
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "p", "q", F.col("d").cast("long").alias("d"))
    return tag(diff, "diff").unionByName(tag(same, "same")).unionByName(tag(s.select("p", F.lit(-1).alias("q"), F.col("s").alias("d")), "sum"))


OCC = f"SELECT det, o1 FROM ({DETS6}), ({ORBS.format(x='o1')}) WHERE ((det >> o1) & 1) = 1"


@query("hb_o1_weights", f"SELECT det, o1, round(CAST(s AS DOUBLE) / sum(s) OVER (PARTITION BY det), 9) AS weight FROM ({OCC}) JOIN ({S_SUM}) ON p = o1 % 6")
def hb_o1_weights(spark, d):
    got = heat_bath.o1_table(dets6(spark), heat_bath.tensor_tables(raw_tensor(spark))[2], N)
    return got.select("det", F.col("o1").cast("int").alias("o1"), F.round("weight", 9).alias("weight"))


PAIR_D = f"SELECT p, q, d, TRUE AS same FROM ({D_SAME}) UNION ALL SELECT p, q, d, FALSE FROM ({D_DIFF})"


@query("hb_o2_weights", f"""SELECT det, o1, o2, round(CAST(d AS DOUBLE) / sum(d) OVER (PARTITION BY det, o1), 9) AS weight FROM ({OCC}) o JOIN ({ORBS.format(x='o2')}) ON ((det >> o2) & 1) = 1 AND o1 <> o2
JOIN ({PAIR_D}) t ON t.same = (o1 // 6 = o2 // 6) AND CASE WHEN o1 // 6 = o2 // 6 THEN p = least(o1 % 6, o2 % 6) AND q = greatest(o1 % 6, o2 % 6) ELSE p = o1 % 6 AND q = o2 % 6 END""")
def hb_o2_weights(spark, d):
    diff, same, _ = heat_bath.tensor_tables(raw_tensor(spark))
    occ = dets6(spark).select("det", F.explode(B.positions("det", 12)).alias("o1"))
    got = heat_bath.o2_table(occ, same, diff, N)
    return got.select("det", F.col("o1").cast("int").alias("o1"), F.col("o2").cast("int").alias("o2"), F.round("weight", 9).alias("weight"))


@query("hb_u1_weights", f"""SELECT det, o1, u1, round(sqrt(val) / sum(sqrt(val)) OVER (PARTITION BY det, o1), 9) AS weight FROM ({OCC}) o JOIN ({ORBS.format(x='u1')}) ON ((det >> u1) & 1) = 0 AND o1 // 6 = u1 // 6
JOIN (SELECT p, q, abs(val) AS val FROM ({RAW}) WHERE r = q AND s = p) e ON e.p = o1 % 6 AND e.q = u1 % 6""")
def hb_u1_weights(spark, d):
    roots = raw_tensor(spark).where("r = q and s = p").select("p", "q", F.sqrt(F.abs("val")).alias("root"))
    occ = dets6(spark).select("det", F.explode(B.positions("det", 12)).alias("o1"))
    got = heat_bath.u1_table(occ, roots, N)
    return got.select("det", F.col("o1").cast("int").alias("o1"), F.col("u1").cast("int").alias("u1"), F.round("weight", 9).alias("weight"))


# Trajectories --------------------------------------------------------------------------------------------------------

TRAJ = "SELECT CAST(user_id % 4 AS VARCHAR) AS run, event_id AS iter, CAST(round(value * 100) AS BIGINT) AS value FROM events"


def traj(spark, d):
    return read(spark, d, "events").select((F.col("user_id") % 4).cast("string").alias("run"), F.col("event_id").alias("iter"), F.round(F.col("value") * 100).cast("long").alias("value"))


@query("shift_series", f"""WITH t AS (SELECT run, iter, 1 + abs(value) AS norm FROM ({TRAJ})),
s AS (SELECT *, lag(norm) OVER w AS last, max(CASE WHEN norm >= 6000 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hit FROM t WINDOW w AS (PARTITION BY run ORDER BY iter))
SELECT run, iter, norm, round(sum(CASE WHEN hit = 1 THEN -0.05 * ln(CAST(norm AS DOUBLE) / last) ELSE 0.0 END) OVER (PARTITION BY run ORDER BY iter ROWS UNBOUNDED PRECEDING), 6) AS shift FROM s""")
def shift_series(spark, d):
    norms = traj(spark, d).select("run", "iter", (1 + F.abs("value")).alias("norm"))
    return C.shift_series(norms, 6000, 0.05).withColumn("shift", F.round("shift", 6))


NUM = f"SELECT iter, value AS num FROM ({TRAJ}) WHERE iter >= 100"
DEN = "SELECT event_id AS iter, user_id % 7 + 1 AS den FROM events WHERE event_id >= 100"


def num_den(spark, d):
    den = read(spark, d, "events").select(F.col("event_id").alias("iter"), (F.col("user_id") % 7 + 1).alias("value"))
    return stats.aligned(traj(spark, d).select("iter", "value"), den, 100)


@query("ratio_estimator", f"WITH p AS (SELECT iter, num, den FROM ({NUM}) JOIN ({DEN}) USING (iter)), m AS (SELECT avg(num) AS n, avg(den) AS d FROM p) SELECT iter, round(num / d - n * den / (d * d), 6) AS residual FROM p, m")
def ratio_estimator(spark, d):
    return stats.residuals(num_den(spark, d)).withColumn("residual", F.round("residual", 6))


@query("autocorr_lag", f"WITH t AS (SELECT iter, CAST(value AS DOUBLE) AS value FROM ({TRAJ})), m AS (SELECT avg(value) AS m, count(*) AS n FROM t), x AS (SELECT iter, value - m AS x, n FROM t, m) SELECT CAST(lag AS INTEGER) AS lag, round(sum(a.x * b.x) / max(a.n), 3) AS cov FROM x a JOIN range(6) l(lag) ON TRUE JOIN x b ON b.iter = a.iter + lag GROUP BY 1")
def autocorr_lag(spark, d):
    got = stats.autocovariance(traj(spark, d).withColumn("value", F.col("value").cast("double")), 5, "value")
    return got.select("lag", F.round("cov", 3).alias("cov"))


@query("running_mean_dev", f"SELECT run, iter, round(abs(avg(value) OVER (PARTITION BY run ORDER BY iter ROWS UNBOUNDED PRECEDING) - 5000), 6) AS deviation FROM ({TRAJ})")
def running_mean_dev(spark, d):
    return stats.running_mean_deviation(traj(spark, d), 5000.0).select("run", "iter", F.round("deviation", 6).alias("deviation"))


@query("blocked_means", f"SELECT CAST(iter // 64 AS BIGINT) AS block, round(avg(value), 6) AS mean, count(*) AS n FROM ({TRAJ}) GROUP BY 1")
def blocked_means(spark, d):
    return stats.blocked(traj(spark, d), 64).select("block", F.round("mean", 6).alias("mean"), "n")


@query("restart_row", f"SELECT iter, value FROM ({TRAJ}) ORDER BY iter DESC LIMIT 1")
def restart_row(spark, d):
    return traj(spark, d).orderBy(F.col("iter").desc()).limit(1).select("iter", "value")


@query("stream_window_totals", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1")
def stream_window_totals(spark, d):
    import uuid

    from .streaming.trajectories import drain, windowed

    schema = read(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    got = drain(windowed(stream, "ts", "cents", "1 hour", "1 day"), f"windows_{uuid.uuid4().hex}")
    return got.select(F.col("window.start").cast(schema["ts"].dataType).alias("start"), "total", "n")


# Sinks and sources ---------------------------------------------------------------------------------------------------


@query("checkpoint_roundtrip", f"SELECT det, v, det <= 50 AS is_dense FROM ({VEC}) WHERE abs(v) > 40 OR det <= 50")
def checkpoint_roundtrip(spark, d):
    import uuid

    from .sources.readers import read_checkpoint
    from .sources.writers import save_checkpoint
    from .storage import shared_dir

    path = f"{shared_dir(spark)}/vector-{uuid.uuid4().hex}"
    save_checkpoint(vec(spark, d).withColumn("is_dense", F.col("det") <= 50).where("1 = 0"), path, 1)
    save_checkpoint(vec(spark, d).withColumn("is_dense", F.col("det") <= 50), path, 2)
    return read_checkpoint(spark, path, least=40).select("det", "v", "is_dense")


@query("text_vector_roundtrip", VEC)
def text_vector_roundtrip(spark, d):
    import uuid

    from .sources.readers import read_vector_text
    from .sources.writers import write_vector_text
    from .storage import shared_dir

    path = f"{shared_dir(spark)}/text-{uuid.uuid4().hex}/"
    rows = vec(spark, d)
    write_vector_text(rows, path)
    return read_vector_text(spark, path, "long")


# Files and molecules against SQL --------------------------------------------------------------------------------------


def new_path(spark, name: str) -> str:
    import uuid

    from .storage import shared_dir

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def lines(rows: DataFrame, order: list[str], line: Column, path: str) -> str:
    """A text file of one line a row, in order."""
    rows.orderBy(*order).select(line.cast("string").alias("value")).write.text(path)
    return path


@query("csv_numbers", """WITH p AS (SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS row, * FROM part)
SELECT row, 0 AS col, CAST(p_partkey AS DOUBLE) AS val FROM p UNION ALL SELECT row, 1 AS col, CAST(p_size AS DOUBLE) AS val FROM p UNION ALL SELECT row, 2 AS col, p_retailprice AS val FROM p""")
def csv_numbers(spark, d):
    from .sources.readers import read_numbers

    return read_numbers(spark, lines(read(spark, d, "part"), ["p_partkey"], F.concat_ws(" , ", "p_partkey", "p_size", "p_retailprice"), new_path(spark, "csv")))


@query("whitespace_numbers", """WITH p AS (SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS line, * FROM supplier)
SELECT line, 0 AS pos, CAST(s_suppkey AS DOUBLE) AS val FROM p UNION ALL SELECT line, 1 AS pos, s_acctbal AS val FROM p""")
def whitespace_numbers(spark, d):
    from .sources.readers import read_whitespace

    return read_whitespace(spark, lines(read(spark, d, "supplier"), ["s_suppkey"], F.concat(F.lit("  "), F.concat_ws(" \t ", "s_suppkey", "s_acctbal")), new_path(spark, "words")))


@query("determinant_list", "SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS line, o_orderkey AS det FROM orders")
def determinant_list(spark, d):
    from .sources.readers import read_determinants

    return read_determinants(spark, lines(read(spark, d, "orders"), ["o_orderkey"], F.col("o_orderkey"), new_path(spark, "dets")))


@query("last_csv_line", "SELECT CAST(event_id AS DOUBLE) AS id, value FROM events ORDER BY event_id DESC LIMIT 1")
def last_csv_line(spark, d):
    from .sources.readers import read_last_line

    path = lines(read(spark, d, "events"), ["event_id"], F.concat_ws(",", "event_id", "value"), new_path(spark, "last"))
    return spark.createDataFrame([tuple(read_last_line(spark, path))], "id double, value double")


@query("dice_vector", f"SELECT det, v / 8.0 AS v FROM ({AMP})")
def dice_vector(spark, d):
    from .sources.readers import read_dice

    has = lambda k, shift: B.read_bit("det", k + shift) == 1
    occ = F.transform(F.sequence(F.lit(0), F.lit(N - 1)), lambda k: F.when(has(k, 0) & has(k, N), "2").when(has(k, 0), "a").when(has(k, N), "b").otherwise("0"))
    body = amp(spark, d).withColumn("occ", F.array_join(occ, "  "))
    blocks = [body.select(F.lit(i).alias("block"), "det", F.concat_ws("  ", "det", value.cast("string"), "occ").alias("text")) for i, value in enumerate((F.col("v") * 1.0, F.col("v") / 8.0))]
    heads = spark.createDataFrame([(i, -1, f"State : {i}") for i in range(2)], "block int, det long, text string")
    path = lines(heads.unionByName(blocks[0]).unionByName(blocks[1]), ["block", "det"], F.col("text"), new_path(spark, "dice"))
    return read_dice(spark, path, N, 1)


@query("fcidump_rows", """SELECT CASE p_partkey % 5 WHEN 0 THEN 'one' WHEN 1 THEN 'energy' ELSE 'two' END AS kind, CAST(p_partkey % 4 AS INTEGER) AS p, CASE WHEN p_partkey % 5 <> 1 THEN CAST(p_partkey // 4 % 4 AS INTEGER) END AS q,
CASE WHEN p_partkey % 5 > 1 THEN CAST(p_partkey // 16 % 4 AS INTEGER) END AS r, CASE WHEN p_partkey % 5 > 1 THEN CAST(p_partkey // 64 % 4 AS INTEGER) END AS s, p_retailprice AS val FROM part""")
def fcidump_rows(spark, d):
    from .sources.readers import fcidump_table

    k = F.col("p_partkey")
    index = lambda shift, used: F.when(used, F.shiftright(k, shift) % 4 + 1).otherwise(0)
    body = read(spark, d, "part").select(k.alias("at"), F.concat_ws(" ", F.col("p_retailprice").cast("string"), index(0, F.lit(True)), index(2, k % 5 != 1), index(4, k % 5 > 1), index(6, k % 5 > 1)).alias("text"))
    head = spark.createDataFrame([(-4, " &FCI NORB=4,NELEC=4,MS2=0,"), (-3, "  ORBSYM=1,1,1,1,"), (-2, "  ISYM=1,"), (-1, " &END")], "at long, text string")
    return fcidump_table(spark, lines(head.unionByName(body), ["at"], F.col("text"), new_path(spark, "dump")))


@query("hubbard_parameters", "SELECT (SELECT count(*) FROM region) AS n_elec, (SELECT count(*) FROM nation) AS lat_len, CAST(1 AS BIGINT) AS n_dim, max(l_discount) AS eps, max(l_quantity) AS u, max(l_tax) AS omega, min(l_quantity) AS g, -max(l_discount) AS gs_energy FROM lineitem")
def hubbard_parameters(spark, d):
    from .sources.readers import read_hubbard

    n, k = read(spark, d, "region").count(), read(spark, d, "nation").count()
    top = read(spark, d, "lineitem").agg(F.max("l_discount").alias("d"), F.max("l_quantity").alias("q"), F.max("l_tax").alias("t"), F.min("l_quantity").alias("g")).first()
    given = {"n_elec": n, "lat_len": k, "n_dim": 1, "eps": top["d"], "U": top["q"], "omega": top["t"], "g": top["g"], "gs_energy": -top["d"]}
    rows = spark.createDataFrame([(i, f"{name}\n{value}") for i, (name, value) in enumerate(given.items())], "at int, text string").coalesce(1)
    p = read_hubbard(spark, lines(rows, ["at"], F.col("text"), new_path(spark, "params")))
    return spark.createDataFrame([(p.n_elec, p.lat_len, p.n_dim, p.eps, p.u, p.omega, p.g, p.gs_energy)], "n_elec long, lat_len long, n_dim long, eps double, u double, omega double, g double, gs_energy double")


def plain_molecule() -> molecule.Molecule:
    """Six orbitals with integrals that SQL can state: (pq|rs) = ((p+1)(q+1) + (r+1)(s+1)) / 1000, h = (p+q+1) / 10."""
    import numpy as np

    k = np.arange(N)
    both = np.outer(k + 1, k + 1) / 1000
    return molecule.Molecule(N, N, (k[:, None] + k + 1) / 10, both[:, :, None, None] + both[None, None], IRREPS)


OCCUPIED = "list_filter(range(0, 12), lambda o: ((det >> o) & 1) = 1{more})"


@query("molecule_diagonal", f"""SELECT det, round(list_sum(list_transform({OCCUPIED.format(more='')}, lambda o: (2 * (o % 6) + 1) / 10.0)) + 0.0005 * list_sum(list_transform({OCCUPIED.format(more='')}, lambda i: list_sum(list_transform({OCCUPIED.format(more='')},
lambda j: (i % 6 + 1) * (i % 6 + 1) + (j % 6 + 1) * (j % 6 + 1) - CASE WHEN i // 6 = j // 6 THEN 2 * (i % 6 + 1) * (j % 6 + 1) ELSE 0 END)))), 6) AS diagonal FROM ({AMP})""")
def molecule_diagonal(spark, d):
    return amp(spark, d).select("det", F.round(molecule.diagonal_of(plain_molecule())("det"), 6).alias("diagonal"))


SINGLE_ROWS = f"SELECT det, v, i, a, (det & ~{one('i')}) | {one('a')} AS det2, 1 - 2 * ({BETWEEN.format(d='det', a='i', b='a')} % 2) AS sign, list_sum(list_transform({OCCUPIED.format(more=' AND o <> i')}, lambda o: (i % 6 + 1) * (a % 6 + 1) + (o % 6 + 1) * (o % 6 + 1) - CASE WHEN o // 6 = i // 6 THEN (o % 6 + 1) * (i % 6 + a % 6 + 2) ELSE 0 END)) / 1000.0 + (i % 6 + a % 6 + 1) / 10.0 AS el FROM ({AMP}), ({ORBS.format(x='i')}), ({ORBS.format(x='a')}) WHERE {on('i')} AND {off('a')} AND i // 6 = a // 6 AND {irrep('i')} = {irrep('a')}"
DOUBLE_ROWS = f"""SELECT det, v, {CORE} | {one('a')} | {one('b')} AS det2, 1 - 2 * (({BETWEEN.format(d=CORE, a='i', b='a')} + {BETWEEN.format(d=CORE, a='j', b='b')}) % 2) AS sign,
((i % 6 + 1) * (a % 6 + 1) + (j % 6 + 1) * (b % 6 + 1) - CASE WHEN i // 6 = j // 6 THEN (i % 6 + 1) * (b % 6 + 1) + (j % 6 + 1) * (a % 6 + 1) ELSE 0 END) / 1000.0 AS el
FROM ({AMP}), ({ORBS.format(x='i')}), ({ORBS.format(x='j')}), ({ORBS.format(x='a')}), ({ORBS.format(x='b')})
WHERE i < j AND a < b AND {on('i')} AND {on('j')} AND {off('a')} AND {off('b')} AND i // 6 = a // 6 AND j // 6 = b // 6 AND xor(xor({irrep('i')}, {irrep('j')}), xor({irrep('a')}, {irrep('b')})) = 0"""


@query("molecule_offdiagonal", f"SELECT det, det2, round(sign * el, 6) AS el FROM (SELECT det, det2, sign, el FROM ({SINGLE_ROWS}) UNION ALL SELECT det, det2, sign, el FROM ({DOUBLE_ROWS})) WHERE abs(el) > 1e-12")
def molecule_offdiagonal(spark, d):
    got = molecule.offdiagonal(amp(spark, d), plain_molecule())
    return got.where(F.abs("el") > 1e-12).select("det", "det2", F.round("el", 6).alias("el"))


@query("molecule_matrix_element", f"SELECT round(sum(x.v * sign * el * y.v) / 1e6, 3) AS dot FROM (SELECT det2, v, sign, el FROM ({SINGLE_ROWS}) UNION ALL SELECT det2, v, sign, el FROM ({DOUBLE_ROWS})) x JOIN ({AMP}) y ON y.det = x.det2")
def molecule_matrix_element(spark, d):
    """<v| off-diagonal H |v>"""
    v = amp(spark, d)
    moved = molecule.offdiagonal(v.withColumn("v", F.col("v").cast("double")), plain_molecule()).groupBy(F.col("det2").alias("det")).agg(F.sum(F.col("el") * F.col("v")).alias("hv"))
    return V.dot(moved, v, "hv", "v").select(F.round(F.col("dot") / 1e6, 3).alias("dot"))


DIAGONAL_ROWS = ORACLE["molecule_diagonal"]


@query("h_dot", f"SELECT 0 AS i, 0 AS j, round(((SELECT sum(x.v * sign * el * y.v) FROM (SELECT det2, v, sign, el FROM ({SINGLE_ROWS}) UNION ALL SELECT det2, v, sign, el FROM ({DOUBLE_ROWS})) x JOIN ({AMP}) y ON y.det = x.det2) + (SELECT sum(v * v * diagonal) FROM ({AMP}) JOIN ({DIAGONAL_ROWS}) USING (det))) / 1e6, 3) AS dot")
def h_dot(spark, d):
    """<u| H |v>, with H applied to u."""
    v = amp(spark, d).withColumn("v", F.col("v").cast("double"))
    got = molecule.h_dot(v, v, plain_molecule(), ["v"], ["v"])
    return got.select("i", "j", F.round(F.col("dot") / 1e6, 3).alias("dot"))


@query("vector_dots", f"""WITH x AS (SELECT 'a' AS name, det, v FROM ({VEC}) UNION ALL SELECT 'b' AS name, det, v FROM ({VEC2}) UNION ALL SELECT 'c' AS name, det, v FROM ({SPAWN}))
SELECT p.name AS first, q.name AS second, CAST(sum(p.v * q.v) AS BIGINT) AS dot FROM x p JOIN x q ON p.det = q.det AND p.name <= q.name GROUP BY 1, 2""")
def vector_dots(spark, d):
    from .plans.methods import vector_dots as dots

    return dots({"a": vec(spark, d), "b": vec2(spark, d), "c": spawned(spark, d)})


@query("collapse_groups", f"SELECT det, v0, v1, v0 + v1 AS new FROM ({TWO}) WHERE v0 + v1 <> 0")
def collapse_groups(spark, d):
    return C.hits_only(two(spark, d).withColumn("new", F.col("v0") + F.col("v1")))


@query("owner_counts", f"SELECT count(*) AS n_keys FROM ({VEC})")
def owner_counts(spark, d):
    """Keys by owner, summed up again: every key has one."""
    return V.bucket_sizes(vec(spark, d), 16).agg(F.sum("n").alias("n_keys"))


# Sequential samplers and methods: no SQL; checked against exact results in the tests ---------------------------------


@query("pivotal_compress")
def pivotal_compress(spark, d):
    return samplers.pivotal_compress(vec(spark, d).withColumn("v", F.col("v").cast("double")), M, seed=3)


@query("multinomial_compress")
def multinomial_compress(spark, d):
    return samplers.multinomial(vec(spark, d).withColumn("v", F.col("v").cast("double")), M, seed=3)


@query("pivotal_by_segment")
def pivotal_by_segment(spark, d):
    src = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("seg"), F.col("l_partkey").alias("det")).agg(F.sum("l_quantity").alias("v"))
    return samplers.pivotal_segments(src.withColumn("n", F.lit(3)), "seg", "n", seed=3)


@query("alias_multinomial")
def alias_multinomial(spark, d):
    src = read(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.sum("l_quantity").alias("p"))
    return samplers.alias_sample(src, "l_suppkey", "l_linenumber", "p", 1000, 5)


@query("compress_columns_pivotal")
def compress_columns_pivotal(spark, d):
    df = two(spark, d).select("det", F.col("v0").cast("double").alias("v0"), F.col("v1").cast("double").alias("v1"))
    return samplers.compress_columns(df, ["v0", "v1"], 300, "pivotal", 1)


@query("gram_schmidt")
def gram_schmidt(spark, d):
    return V.gram_schmidt(two(spark, d).select("det", F.col("v0").cast("double").alias("v0"), F.col("v1").cast("double").alias("v1")), ["v0", "v1"])


def small_molecule() -> molecule.Molecule:
    """Four orbitals, four electrons, integrals with all eight symmetries from a fixed seed, two irreps."""
    import numpy as np

    rng = np.random.default_rng(11)
    n, irreps = 4, [0, 1, 0, 1]
    h = rng.normal(0, 0.2, (n, n))
    h = (h + h.T) / 2 + np.diag([-2.0, -1.2, -0.4, 0.2])
    e = rng.normal(0, 0.12, (n, n, n, n))
    e = sum(e.transpose(p) for p in ((0, 1, 2, 3), (1, 0, 2, 3), (0, 1, 3, 2), (1, 0, 3, 2), (2, 3, 0, 1), (3, 2, 0, 1), (2, 3, 1, 0), (3, 2, 1, 0))) / 8
    for p in range(n):
        for q in range(n):
            if irreps[p] != irreps[q]:
                h[p, q] = 0
            e[p, p, q, q] += 0.5 / (1 + abs(p - q))
            for r in range(n):
                for s in range(n):
                    if irreps[p] ^ irreps[q] ^ irreps[r] ^ irreps[s]:
                        e[p, q, r, s] = 0
    return molecule.Molecule(n, 4, h, e, irreps)


@query("molecule_multiply")
def molecule_multiply(spark, d):
    mol = small_molecule()
    keys = strings.all_strings(4, 2, 2)
    v = read(spark, d, "lineitem").groupBy((F.col("l_orderkey") % len(keys)).cast("int").alias("k")).agg(F.sum("l_quantity").alias("v"))
    det = F.get(F.array(*[F.lit(k).cast("long") for k in keys]), F.col("k"))
    return molecule.multiply(v.select(det.alias("det"), "v"), mol)


@query("heat_bath_apply")
def heat_bath_apply(spark, d):
    mol = small_molecule()
    ref = spark.createDataFrame([(mol.reference, 1.0)], "det long, v double")
    return heat_bath.apply(ref, mol, heat_bath.tensors(mol), 20, heat_bath.double_probability(mol), seed=4)


@query("near_uniform_draws")
def near_uniform_draws(spark, d):
    from .operators.near_uniform import spawn

    return spawn(dets6(spark).select("det", F.lit(1.0).alias("v"), F.lit(3).alias("n_walk")), IRREPS, 0.8, 9)


def method(name: str, run: Callable):
    @query(name)
    def f(spark, d, run=run):
        return run(spark).frame(spark)


def _methods() -> None:
    from .plans import methods as P
    from .plans.models import ChainModel, MoleculeModel

    def cfg(**k):
        return P.Config(**({"eps": 0.02, "iterations": 4, "shift_interval": 2, "target_nonzero": 100, "matrix_nonzero": 60, "seed": 5} | k))

    def mol():
        m = small_molecule()
        return MoleculeModel(m, m.diagonal(strings.positions(m.reference)))

    four = hubbard.Chain(4, 4, u=2.0)
    holstein = hubbard.Chain(4, 4, u=2.0, g=0.3, omega=0.5, ph_bits=2)
    method("run_chain_exact", lambda s: P.chain_exact(s, ChainModel(four), cfg()))
    method("run_chain_systematic", lambda s: P.chain_systematic(s, ChainModel(holstein), cfg()))
    method("run_power_exact", lambda s: P.power_exact(s, mol(), cfg()))
    method("run_power_systematic", lambda s: P.power_systematic(s, mol(), cfg(iterations=2)))
    method("run_power_multinomial", lambda s: P.power_multinomial(s, mol(), cfg()))
    method("run_fciqmc", lambda s: P.fciqmc(s, mol(), cfg()))
    method("run_fciqmc_float", lambda s: P.fciqmc_float(s, mol(), cfg()))

    def trials(s):
        m = small_molecule()
        return s.createDataFrame([(m.reference, 1.0, 0.0), (strings.single(m.reference, 1, 3)[0], 0.0, 1.0)], "det long, v0 double, v1 double")

    method("run_subspace", lambda s: P.subspace(s, mol(), cfg(iterations=2), trials(s), ["v0", "v1"]))
    method("run_subspace_sampled", lambda s: P.subspace(s, mol(), cfg(iterations=1), trials(s), ["v0", "v1"], "heat_bath", True))
    method("run_observable", lambda s: P.observable(s, mol(), cfg(iterations=3, burn_in=1), 0, 2))
    method("run_observable_replicas", lambda s: P.observable(s, mol(), cfg(iterations=2), 0, 2, 2))


_methods()
