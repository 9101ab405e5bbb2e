"""Session plumbing shared by all operators: shipping code, shared scratch space, table reading."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers.

    Nothing happens when PYTHONPATH already names the repository or when Spark runs in the
    repository folder itself; otherwise a zip of the sources goes out with ``addPyFile`` once. Arrow
    batches get at most 1000 rows, unless the session says otherwise.
    """
    if spark.conf.get(ARROW_ROWS, "10000") == "10000":  # the default is for short rows; texts fill a worker's memory
        spark.conf.set(ARROW_ROWS, "1000")
    root = str(_PACKAGE.parent)
    here = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if root in here or getattr(sc, "_folio_shipped", False):
        return
    path = Path(tempfile.mkdtemp()) / "folio_src.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(path))
    sc._folio_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores, if a plain scan has partitions for less than half of them.

    For work in Python that costs far more than moving the rows: few or small files would keep most
    cores idle. Larger inputs, plans with a shuffle of their own and streams stay as they are.
    """
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution()
    if plan.executedPlan().nodeName().startswith("Adaptive"):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = plan.toRdd().getNumPartitions()
    return df.repartition(cores) if n * 2 < cores or n < cores and _single(df) else df


def _single(df: DataFrame) -> bool:
    """Whether all rows come from one file, which may be one block that can't be split."""
    try:
        return len(df.inputFiles()) == 1
    except Exception:  # rows that don't come from files
        return False


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if sc.master.startswith("local[") or sc.master == "local":
        own = Path(tempfile.mkdtemp(prefix="folio-")).as_uri()
    else:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/folio-checkpoints"
        if own.startswith(("file:", "/")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


class _Scopes(threading.local):
    """The open scopes of a thread, innermost last: each lists the tables written within it alone."""

    def __init__(self):
        self.open: list[list[tuple[SparkSession, str]]] = []


_scopes = _Scopes()
#: Tables that no scope drops; they go with the driver.
_written: list[tuple[SparkSession, str]] = []


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Whether Spark deletes the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Like :func:`cut` it ends the lineage, but the columns stay prunable and compressed; nothing needs the
    shuffle files of the write any more, and they go at once. The tables go when the driver ends, or
    earlier through :func:`scratch` and :func:`drop_stash`.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    (_scopes.open[-1] if _scopes.open else _written).append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._folio_path = path
    return out


def drop_stash(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stash` once nothing reads them any more."""
    path = getattr(df, "_folio_path", None)
    if path:
        delete_path(df.sparkSession, path)
        for scope in [_written, *_scopes.open]:
            scope[:] = [x for x in scope if x[1] != path]


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Drops, at its end, the tables that :func:`stash` wrote within, but for those handed to what it yields.

    Those belong to the scope around it. A scope knows the tables of its own thread only, so operators that run
    side by side leave each other's alone; a failure drops them too.
    """
    kept: set[str | None] = set()
    own: list[tuple[SparkSession, str]] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.add(getattr(df, "_folio_path", None))
        return df

    _scopes.open.append(own)
    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        _scopes.open.remove(own)
        outer = _scopes.open[-1] if _scopes.open else _written
        for spark, path in own:
            if path in kept:
                outer.append((spark, path))
            else:
                delete_path(spark, path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete_path(spark, path)
        except Exception:  # the JVM may be gone already
            return
