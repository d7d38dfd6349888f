"""Tables written once to the cluster's shared folder and read back.

Used wherever a result feeds several passes (clip bounds, medians, then the output) or
loops: the passes read narrow columns of a finished table instead of repeating the
shuffle above it, lineage is cut, and the loss of an executor costs a re-read only.
The size of the files is what Spark compares with ``spark.sql.autoBroadcastJoinThreshold``,
so a staged side is broadcast only when its measured size allows it.

``scope`` drops what was staged inside it, but for what is kept; operators use it for their
intermediate tables, and a caller who is done with a result uses it for the result as well:

    with scope(spark):
        find_substitutes(products, tie_break=["code"]).write.parquet(path)
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
_open_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; local sessions may go without."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="shelfgrade-")
    return _local_roots[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if scopes := _open_scopes.get():
        scopes[-1].append(path)
    return path


@dataclass(frozen=True)
class Staged:
    """A written table."""

    frame: DataFrame
    path: str

    @cached_property
    def rows(self) -> int:
        """Number of rows, from the footers of the files."""
        return self.frame.sparkSession.read.parquet(self.path).count()

    def derive(self, frame: DataFrame) -> Staged:
        """A column-wise view of the table: same rows, other values."""
        return replace(self, frame=frame)


def stage(df: DataFrame, name: str = "stage") -> Staged:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return Staged(spark.read.schema(df.schema).parquet(path), path)


def release(spark: SparkSession, path: str) -> None:
    """Drop a staged table that no live DataFrame reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator:
    """Release what is staged inside, also after an error. The value is a function that keeps
    staged tables: they pass to the scope around, if any."""
    own: list[str] = []
    kept: list[str] = []
    token = _open_scopes.set((*_open_scopes.get(), own))

    def keep(staged: Staged) -> DataFrame:
        kept.append(staged.path)
        return staged.frame

    done = False
    try:
        yield keep
        done = True
    finally:
        _open_scopes.reset(token)
        stays = set(kept) if done else set()
        if scopes := _open_scopes.get():
            scopes[-1].extend(stays)
        for path in own:
            if path not in stays:
                release(spark, path)
