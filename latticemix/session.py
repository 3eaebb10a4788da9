"""Where a job may keep intermediate tables."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    that names none (tests, a laptop) gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="latticemix-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class _Made(threading.local):
    """Paths given out in this thread."""

    def __init__(self):
        self.paths: list[str] = []


_made = _Made()


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.paths.append(path)
    return path


def made_so_far() -> int:
    """How many paths this thread has; ``remove_intermediate`` can begin there."""
    return len(_made.paths)


def remove_intermediate(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> int:
    """Delete what this thread wrote below ``new_path`` after the first ``since`` paths, but for ``keep``.

    Call it once what was read from there has been written or collected.
    """
    paths = [p for p in _made.paths[since:] if p not in keep]
    _made.paths[since:] = [p for p in _made.paths[since:] if p in keep]
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it reliably, cutting its lineage."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
