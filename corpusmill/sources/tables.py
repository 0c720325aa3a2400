"""Parquet tables of a data folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables whose rows take work: a few small files of them are spread over all tasks.
TEXTS = ("note_record", "documents", "chunk_note", "oc_part")
#: Bytes of a file that one task reads, about: a row group is one task's however small the splits.
ROW_GROUP = 128 << 20
#: Bytes of a table that are worth a task of their own.
SHARE = 256 << 10


def files_of(spark: SparkSession, folder: str, name: str) -> list:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    return [(f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``: one file or a directory of files.

    A table of ``TEXTS`` with fewer row groups than the session has tasks, a
    small one, is dealt out evenly; a large one stays as it lies.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if name in TEXTS:
        tasks = spark.sparkContext.defaultParallelism
        if sum(-(-size // ROW_GROUP) for _, size, _ in files_of(spark, folder, name)) < tasks:
            return df.repartition(tasks)
    return df


def shared_out(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """The table ``name`` with its work for all tasks, and no shuffle of texts.

    Of a table with fewer row groups than the session has tasks, a small one,
    every row group is read by several tasks, each of which keeps the rows of its
    share by the hash of ``key``: reading takes far less than the work on a text.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    sizes = [size for _, size, _ in files_of(spark, folder, name)]
    shares = -(-spark.sparkContext.defaultParallelism // max(1, sum(-(-size // ROW_GROUP) for size in sizes)))
    shares = min(shares, -(-sum(sizes) // SHARE))
    if shares < 2:
        return df
    return reduce(DataFrame.unionAll, (df.where(F.expr(f"pmod(xxhash64({key}), {shares}) = {i}")) for i in range(shares)))


def state_of(spark: SparkSession, folder: str, name: str) -> tuple:
    """What tells this state of a table from another: the names, sizes and times of its files."""
    return (folder, name, *sorted(files_of(spark, folder, name)))


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to ``path`` to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where it is unset, a local master (tests, a laptop) gets a folder of its own
    once per application, and any other master an error: its executors would
    each write where only they can read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        import atexit
        import shutil
        import tempfile

        own = tempfile.mkdtemp(prefix="corpusmill-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder, so that its lineage ends there.

    The files go when the result is no longer referenced, where the session has
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def evenly(rows: DataFrame, *keys: str) -> DataFrame:
    """Few small ``rows`` with much work each, in as many partitions as the session shuffles into: partitions merged by their bytes would leave the work to a few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
