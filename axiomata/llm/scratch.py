"""Tables written to the folder that the driver and all executors share.

A materialised table cuts the lineage: when an executor is lost, later stages
read the files again instead of recomputing what led to them.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset a new local one, which only a local master may use."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else ""
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="axiomata-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """One query's folder below :func:`shared_root`."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._at: dict[int, str] = {}
        if _scopes:
            _scopes[-1].append(self)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str, instead_of: tuple[DataFrame | None, ...] = ()) -> DataFrame:
        """Write ``df`` as Parquet and read it back; the kept tables ``instead_of`` are deleted then."""
        at = self.path(name)
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        for old in instead_of:
            gone = self._at.pop(id(old), None)
            if gone:
                _delete(self.spark, gone)
        self._at[id(out)] = at
        self._held = getattr(self, "_held", [])
        self._held.append(out)  # so that no other table gets its id
        return out

    def drop(self) -> None:
        """Delete the folder with all its tables; nothing may read them any more."""
        _delete(self.spark, self.root)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_scopes: list[list[Scratch]] = []


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Delete at its end all that operators kept inside; what they return must have been written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for made in _scopes.pop():
            made.drop()

