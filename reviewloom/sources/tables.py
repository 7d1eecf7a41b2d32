"""Reading tables and keeping intermediate results in storage that every executor can reach."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder; columns and filters are pushed into the scan by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate results: the session's spark.checkpoint.dir, a folder of our own only where none is set."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        own = tempfile.mkdtemp(prefix="reviewloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        context.setCheckpointDir(folder)
    return folder


#: Stages written by this process, and the blocks that will delete theirs, innermost last.
_WRITTEN: set[str] = set()
_BLOCKS: list[set[str]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: a cut of the lineage that survives lost executors.

    Unlike a checkpoint of rows, the copy is columnar, compressed and carries sizes for join planning. It is deleted by the
    `scratch` block around it, by `discard`, or at the end of the process.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_discard_all)
    _WRITTEN.add(path)
    if _BLOCKS:
        _BLOCKS[-1].add(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def temporary_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, which goes the way of a stage."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_discard_all)
    _WRITTEN.add(path)
    return path


def _stages_of(df: DataFrame) -> set[str]:
    files = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    return {p for p in _WRITTEN if any(f.rstrip("/").endswith(p.rsplit("/", 1)[1]) for f in files)}


def _delete(paths: set[str]) -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for path in paths:
        _WRITTEN.discard(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _discard_all() -> None:
    try:
        _delete(set(_WRITTEN))
    except Exception:  # the session may be gone already
        _WRITTEN.clear()


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialised frame that no later plan reads."""
    _delete(_stages_of(df))


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose stages are deleted at its end, but for those of frames that went through the function it gives.

    Frames that are read after the block must be kept, or not depend on a stage of the block.
    """
    own: set[str] = set()
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(_stages_of(df))
        return df

    _BLOCKS.append(own)
    try:
        yield keep
    finally:
        _BLOCKS.remove(own)
        if _BLOCKS:
            _BLOCKS[-1].update(own & kept)
        _delete(own - kept)
