"""Size-tiered sharding with versioned manifests.

Arrivals are appended as small immutable shards. A run is a set of shards written together; runs of similar size share
a tier. When a tier holds enough runs, compaction merges them, without a shuffle, into files of the target size and
commits a new manifest. A manifest is a JSON file named by its version, written under a temporary name and then renamed;
the rename fails if another writer has already committed that version, so a reader sees whole versions only. That needs a
file system whose rename is atomic and refuses an existing target, as HDFS and local ones do; on an object store without
such a rename, let one writer commit at a time.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    """A table as immutable Parquet shards under `root`, which all executors must share."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fanout: int = 4, smallest: int = 1 << 20):
        if target_bytes < 1 or fanout < 2 or smallest < 1:
            raise ValueError("target_bytes and smallest must be positive, fanout at least 2")
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fanout, self.smallest = target_bytes, fanout, smallest
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _files(self, folder: str) -> list[dict]:
        found = self.fs.listStatus(self._path(folder))
        return sorted(({"file": f"{folder}/{f.getPath().getName()}", "bytes": f.getLen()} for f in found if f.getPath().getName().endswith(".parquet")), key=lambda x: x["file"])

    def version(self) -> int:
        at = self._path("manifests")
        if not self.fs.exists(at):
            return 0
        return max((int(f.getPath().getName()[1:-5]) for f in self.fs.listStatus(at) if f.getPath().getName().startswith("v")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "runs": []}
        data = self.fs.open(self._path(f"manifests/v{version:08d}.json"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")
        finally:
            data.close()
        return json.loads(text)

    def _commit(self, runs: list[dict], after: int) -> int:
        """Atomically make `runs` version after + 1; Conflict if that version exists."""
        name = self._path(f"manifests/v{after + 1:08d}.json")
        temp = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = self.fs.create(temp, False)
        out.write(bytearray(json.dumps({"version": after + 1, "runs": runs}).encode()))
        out.close()
        if self.fs.exists(name) or not self.fs.rename(temp, name):
            self.fs.delete(temp, False)
            raise Conflict(f"version {after + 1} exists")
        return after + 1

    def tier(self, size: int) -> int:
        return max(0, int(math.log(max(size, 1) / self.smallest, self.fanout)) + 1) if size >= self.smallest else 0

    def append(self, df: DataFrame, arrival: str | None = None) -> int:
        """Write arrivals as small shards: one run, or with a column `arrival` one run for each of its values.

        A null arrival is a run of its own. Appending no rows commits a version without new runs. Rows may repeat and hold
        nulls anywhere; the values of `arrival` go into folder names, and the column itself isn't stored. Returns the
        version.
        """
        at = self.version()
        known = self.manifest(at)["runs"]
        folder = f"data/{uuid.uuid4().hex}"
        if arrival is None:
            df.write.parquet(f"{self.root}/{folder}")
            groups = {"": self._files(folder)}
        else:
            df.write.partitionBy(arrival).parquet(f"{self.root}/{folder}")
            inner = [f.getPath().getName() for f in self.fs.listStatus(self._path(folder)) if f.isDirectory()]
            groups = {name: self._files(f"{folder}/{name}") for name in sorted(inner)}
        runs = [{"run": f"{folder}/{name}".rstrip("/"), "files": files, "bytes": sum(f["bytes"] for f in files), "born": at + 1} for name, files in groups.items() if files]
        return self._commit_or_clear(known + runs, at, [folder])

    def _commit_or_clear(self, runs: list[dict], after: int, folders: list[str]) -> int:
        """Commit; what was written for a version that another writer committed first is deleted."""
        try:
            return self._commit(runs, after)
        except Conflict:
            for f in folders:
                self.fs.delete(self._path(f), True)
            raise

    def plan(self, runs: list[dict]) -> list[list[dict]]:
        """Groups of similarly sized runs to merge: every tier that holds at least `fanout` runs."""
        tiers: dict[int, list[dict]] = {}
        for r in runs:
            if any(f["bytes"] < self.target_bytes / 2 for f in r["files"]) or len(r["files"]) == 0:
                tiers.setdefault(self.tier(r["bytes"]), []).append(r)
        return [sorted(rs, key=lambda r: r["run"]) for _, rs in sorted(tiers.items()) if len(rs) >= self.fanout]

    def compact(self) -> int | None:
        """One round: merge the tiers that are full and commit; None if there was nothing to do."""
        at = self.version()
        runs = self.manifest(at)["runs"]
        groups = self.plan(runs)
        if not groups:
            return None
        merged = []
        for group in groups:
            size = sum(r["bytes"] for r in group)
            folder = f"data/{uuid.uuid4().hex}"
            rows = self.spark.read.parquet(*[f"{self.root}/{f['file']}" for r in group for f in r["files"]])
            rows.coalesce(max(1, round(size / self.target_bytes))).write.parquet(f"{self.root}/{folder}")
            files = self._files(folder)
            merged.append({"run": folder, "files": files, "bytes": sum(f["bytes"] for f in files), "born": at + 1})
        gone = {r["run"] for g in groups for r in g}
        return self._commit_or_clear([r for r in runs if r["run"] not in gone] + merged, at, [r["run"] for r in merged])

    def vacuum(self, unnamed_after: float = 86_400.0) -> int:
        """Delete runs that only older manifests name (those can't be read afterwards), and folders of so many seconds of
        age that no manifest names, left by writers that broke off. Returns how many went."""
        named = {r["run"] for r in self.manifest()["runs"]}
        old = {r["run"] for v in range(1, self.version()) for r in (self.manifest(v)["runs"] if self.fs.exists(self._path(f"manifests/v{v:08d}.json")) else [])} - named
        in_use = {"/".join(r.split("/")[:2]) for r in named | old}
        lost = set()
        if self.fs.exists(self._path("data")):
            now = self.jvm.System.currentTimeMillis()
            lost = {f"data/{f.getPath().getName()}" for f in self.fs.listStatus(self._path("data")) if now - f.getModificationTime() > 1000 * unnamed_after} - in_use
        for run in old | lost:
            self.fs.delete(self._path(run), True)
        return len(old) + len(lost)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, with columns _shard (its file) and _version. Own columns of these names stay; the
        store's get another underscore in front, as many as it takes."""
        found = self.manifest(version)
        files = [f["file"] for r in found["runs"] for f in r["files"]]
        if not files:
            raise ValueError("the store is empty")
        rows = self.spark.read.parquet(*[f"{self.root}/{f}" for f in files])
        shard, number = (free_name(rows.columns, n) for n in ("_shard", "_version"))
        name = F.regexp_extract(F.input_file_name(), r"(data/[^?#]*)$", 1)
        return rows.withColumn(shard, name).withColumn(number, F.lit(found["version"]))


def free_name(columns: list[str], name: str) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def op8_shards(spark, sf_dir: str) -> DataFrame:
    """Documents arrive in 16 batches of unequal size; the store is compacted until no tier is full.

    One row per document: doc_id, shard_id, shard_bytes, version, n_bytes and the text's digest as the shard holds it.
    """
    from .common import new_path, table

    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, new_path(spark, "shards"), target_bytes=32 << 20)
    # four large, six middling and six small batches, so that several tiers fill
    spread = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(64))
    batch = F.when(spread < 32, spread % 4).when(spread < 56, 4 + spread % 6).otherwise(10 + spread % 6)
    arrival = free_name(docs.columns, "arrival")
    store.append(docs.withColumn(arrival, batch.cast("int")), arrival)
    while store.compact() is not None:
        store.vacuum()
    sizes = [(f["file"], f["bytes"], store.tier(r["bytes"])) for r in store.manifest()["runs"] for f in r["files"]]
    shards = spark.createDataFrame(sizes, "_shard string, shard_bytes long, tier int")
    rows = store.read().select("doc_id", "text", *[F.col(free_name(docs.columns, n)).alias(n) for n in ("_shard", "_version")])
    rows = rows.select("doc_id", "_shard", F.col("_version").alias("version"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    return rows.join(F.broadcast(shards), "_shard").select("doc_id", F.col("_shard").alias("shard_id"), "shard_bytes", "tier", "version", "n_bytes", "text_sha256")
