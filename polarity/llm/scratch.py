"""Materialised intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from threading import local

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OPEN = local()
FILES_BYTES = 32 << 20  # names of a table's files that are broadcast; more are joined by a shuffle


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session that names
    none gets a folder of its own; a cluster without one is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if not path and not current:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="polarity-shared-")
    if not current:
        spark.sparkContext.setCheckpointDir(path)
    return path or current


def _scopes() -> list[dict[str, bool]]:
    if not hasattr(_OPEN, "scopes"):
        _OPEN.scopes = []
    return _OPEN.scopes


def _folders(df: DataFrame) -> list[str]:
    """Folders of the checkpoints that ``df`` reads."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    files = [x.rdd().getCheckpointFile() for x in (leaves.apply(i) for i in range(leaves.size())) if x.getClass().getSimpleName() == "LogicalRDD"]
    return [f.get() for f in files if f.isDefined()]


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint. The
    innermost open ``scratch_scope`` deletes it when it ends."""
    shared_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    if _scopes():
        _scopes()[-1].update(dict.fromkeys(_folders(done), False))
    return done


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes what ``materialise`` wrote inside, but what the tables read that
    are given to the function that the scope yields: these pass to the scope around it, if any.

    Shuffle files go when the JVM collects the plans that own them, so the
    scope also asks for a collection, as Spark's own cleaner does from time to time.
    """
    scopes, mine = _scopes(), {}
    scopes.append(mine)

    def keep(df: DataFrame) -> DataFrame:
        mine.update(dict.fromkeys(_folders(df), True))
        return df

    try:
        yield keep
    finally:
        scopes.remove(mine)
        for folder, kept in mine.items():
            if not kept:
                remove(spark, folder)
            elif scopes:
                scopes[-1][folder] = False
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Hand the machine what this worker's allocators hold free: a worker stays for later tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's Arrow batches, which gives memory back when the task ends."""
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def lean_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run`` on a group's table, which gives memory back when the group is done."""
    def group(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    return group


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number of its own for each row, the same in every job. The
    rows of a table as it is read are told by their place in their file, so they
    are not copied; other rows are written first."""
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or "_metadata" in df.columns:
        return materialise(df.withColumn(name, F.monotonically_increasing_id()))
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
    files = sorted(r[0] for r in placed.select("__file").distinct().collect())
    numbers = df.sparkSession.createDataFrame(list(enumerate(files)), "__number long, __file string")
    if sum(map(len, files)) <= FILES_BYTES:  # the driver has them all, so their size is known
        numbers = F.broadcast(numbers)
    own = [f"`{c.replace('`', '``')}`" for c in df.columns]
    return placed.join(numbers, "__file").select(*own, (F.shiftleft("__number", 40) + F.col("__place")).alias(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, column: str) -> int:
    """Exact size of a text column, which fixes how many buckets a job uses."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, in whichever store it is."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
