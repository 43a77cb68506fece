"""Session settings that operators rely on."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession


_FOLDERS: set[str] = set()


def shared_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is
    unset and the session is local (tests) is a temporary folder taken.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut there."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _own_folder(spark: SparkSession) -> str:
    """The application's folder of tables under the shared checkpoint folder, deleted when it ends."""
    folder = f"{spark.sparkContext.getCheckpointDir()}/tables"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)

        def clear() -> None:
            with suppress(Exception):  # the JVM may be gone before
                _delete(spark, folder)

        atexit.register(clear)
    return folder


def written(df: DataFrame, folder: str | None = None, name: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in a folder of its own under the shared checkpoint folder, or in ``name`` under ``folder``.

    Like ``checkpointed``, but computed once and read back by column, and without what Spark has
    inferred about ``df``: in long loops rounds on checkpoints
    became slower and slower, probably by such inferred predicates. Without ``folder`` it is
    deleted when the application ends.
    """
    spark = df.sparkSession
    shared_checkpoints(spark)
    path = f"{folder or _own_folder(spark)}/{name or uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for ``written`` under the shared checkpoint folder, deleted at the end."""
    shared_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        _delete(spark, folder)
