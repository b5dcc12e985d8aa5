"""What the library needs from the caller's Spark session."""

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def prepare_session(spark: SparkSession) -> SparkSession:
    """Settings the library relies on.

    Timestamps are parsed and converted as UTC; the listener zone is a parameter. And
    generated methods above 8000 bytes of bytecode, which the JVM would only interpret,
    are left to Spark's split projections: wide refinements run twice as fast. Of a key that
    an exported record has twice, the last value counts. Folders are listed by some hundred
    tasks, not by one each: a task takes longer to start than a folder to list.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", "256")
    return spark


def require_utc(spark: SparkSession) -> None:
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone is {zone}; call prepare_session(spark) first")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


_collecting: ContextVar[list[str] | None] = ContextVar("tables of the innermost block", default=None)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and go on from there.

    Cuts the lineage, survives lost executors, and later steps read only the columns
    they need. The innermost ``temporary_tables`` block around the call removes the table
    again; outside such blocks it is removed when the driver's JVM ends.
    """
    return _written(df, _collecting.get())


def _written(df: DataFrame, paths: list[str] | None) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/hearlog-{uuid.uuid4().hex}"
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    if paths is None:
        delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's JVM remove ``path``, which has to exist, when it ends."""
    folder, files = _on_storage(spark, path)
    files.deleteOnExit(folder)


def _on_storage(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete, at the end of the block, the tables that ``durable`` wrote inside it.

    Blocks nest, and threads do not see each other's blocks; ``at_once`` hands the
    caller's block on to its tasks. The block is given a ``durable`` whose tables outlast
    it: they belong to the block around it.
    """
    paths: list[str] = []
    around = _collecting.get()
    outer = _collecting.set(paths)
    try:
        yield lambda df: _written(df, around)
    finally:
        _collecting.reset(outer)
        for path in paths:
            folder, files = _on_storage(spark, path)
            files.delete(folder, True)


def sized(df: DataFrame, rows: int, rows_per_task: int = 10_000) -> DataFrame:
    """``df`` without needless tasks, for data that many small jobs will go over."""
    return df.coalesce(max(1, rows // rows_per_task))


def at_once(spark: SparkSession, tasks: list[Callable], width: int) -> list:
    """Run driver-side tasks that each start Spark jobs, ``width`` at a time, in order."""
    wrap = inheritable_thread_target(spark)
    wrapped = [(copy_context(), wrap(task)) for task in tasks]
    with ThreadPool(max(1, min(width, len(tasks)))) as pool:
        return pool.map(lambda pair: pair[0].run(pair[1]), wrapped)
