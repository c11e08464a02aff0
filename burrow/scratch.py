"""Tables between jobs: written to the folder that driver and executors share, read again, and deleted when done.

The folder is the session's ``spark.checkpoint.dir``. A result reads some of them when it is read itself; ``clear`` deletes what is left once no result is needed. Where it is unset, a run on one machine (master local) gets a temporary folder, as
in tests; on a cluster that is an error, for no machine's own folder is seen by the others.
"""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Paths that this process has handed out, by application.
_given: dict[str, list[str]] = {}
_releasing: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    where = spark.conf.get("spark.checkpoint.dir", None) or (given.get() if given.isDefined() else None)
    if where:
        return where
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="burrow-shared-")
    return _own[context.applicationId]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = posixpath.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _given.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _deleted(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> int:
    """Deletes all that was written below the shared folder for this application and is still there, when no result needs it any more; how many paths."""
    paths = _given.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _deleted(spark, path)
    return len(paths)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written to the shared folder as Parquet and read again: lineage ends here and survives executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    if _releasing and not keep:
        _releasing[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released() -> Iterator[None]:
    """Deletes the tables that were written inside, but for those with ``keep``, when the last of them has been read."""
    _releasing.append([])
    try:
        yield
    finally:
        for spark, path in _releasing.pop():
            _deleted(spark, path)
            if path in (given := _given.get(spark.sparkContext.applicationId, [])):
                given.remove(path)
