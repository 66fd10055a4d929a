"""Cutting lineage with tables written to the cluster's shared folder.

Iterative operators write each round as Parquet below the folder named by `spark.checkpoint.dir` and read it back.
Lost executors then cost at most the running round, column pruning works on what was written, and the file sizes
give the optimizer true statistics for its join choices.

Operators drop what nothing reads any more. What a returned DataFrame still reads lives until its session ends, or,
in long sessions, until the `scratch` block around its use is left.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a folder of our own only where that is unset and the session is local."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="spark-parallaxa-")
    return _own_folders[app]


class Folder:
    """A folder below the shared one; `drop()` removes it once nothing reads it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/parallaxa/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
        _live.add(self)

    def drop(self) -> None:
        if self not in _live:
            return
        _live.discard(self)
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


class Cut(Folder):
    """A DataFrame that was written to the shared folder."""

    def __init__(self, df: DataFrame, name: str):
        super().__init__(df.sparkSession, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)


_live: set[Folder] = set()


def cut(df: DataFrame, name: str = "cut") -> Cut:
    """Runs `df` once, writes it to the shared folder and returns the written table."""
    return Cut(df, name)


@contextmanager
def scratch() -> Iterator[None]:
    """Whatever operators write inside the block is removed when it is left: use up their results before."""
    before = set(_live)
    try:
        yield
    finally:
        for folder in _live - before:
            folder.drop()


@atexit.register
def _drop_all() -> None:
    for folder in list(_live):
        try:
            if folder.spark.sparkContext._jsc is not None:
                folder.drop()
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass
