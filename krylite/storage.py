"""Durable intermediates: lineage is cut by Parquet files in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where a session in one process names none (tests), a folder that is cleared at the end."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="krylite-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        at = _own[0]
    return at.rstrip("/")


class Saved:
    """A written table; `df` reads it, `drop` deletes it once its successor is written."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


_scope: ContextVar[list[Saved] | None] = ContextVar("scope", default=None)


@contextmanager
def scope() -> Iterator[None]:
    """Tables that scratch() writes inside are deleted at the end; what was made from them must be written by then."""
    held: list[Saved] = []
    token = _scope.set(held)
    try:
        yield
    finally:
        _scope.reset(token)
        for x in held:
            x.drop()


def scratch(df: DataFrame, name: str) -> DataFrame:
    """A table that is read more than once is written once. Outside of a scope it stays until the folder is cleared."""
    saved = Saved(df, name)
    if (held := _scope.get()) is not None:
        held.append(saved)
    return saved.df
