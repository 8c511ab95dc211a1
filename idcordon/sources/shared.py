"""A folder that every executor can reach, for tables that cut a lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, list[str]] = {}
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)  # what this thread's ``settled`` removes


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new path below the folder the cluster names in ``spark.checkpoint.dir``.

    Where that setting is absent, the folder given to ``setCheckpointDir`` counts; a session with
    neither is an error, as a folder of one machine is of no use to the others. Only a session
    that runs in this process alone, as in tests, gets one of its own.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    base = base or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="idcordon-"))
        base = context.getCheckpointDir()
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(context.applicationId, []).append(path)
    return path


def drop_shared(spark: SparkSession) -> int:
    """Remove what this session has written to the shared folder; call it when results are stored elsewhere."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    _remove(spark, paths)
    return len(paths)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write once, read as often as needed: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    passing = _PASSING.get()
    if passing is not None:
        passing.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def settled(make: Callable[[], DataFrame], purpose: str) -> DataFrame:
    """What ``make`` gives, stored. Tables that ``make`` stores on its way go once it is written; no frame on them may leave."""
    mark = _PASSING.set([])
    try:
        df = make()
        paths = _PASSING.get()
    finally:
        _PASSING.reset(mark)
    out = stored(df, purpose)
    spark = df.sparkSession
    _remove(spark, paths)
    written = _WRITTEN[spark.sparkContext.applicationId]
    written[:] = [p for p in written if p not in set(paths)]
    return out
