"""Reading tables and cutting lineage in storage that every executor shares."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One whole table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting (tests on one machine) gets a folder of its own in the working directory,
    or among temporary files if that cannot be written, which is set once as its checkpoint folder.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        home = os.getcwd() if os.access(os.getcwd(), os.W_OK) else tempfile.gettempdir()
        context.setCheckpointDir(os.path.join(home, "spark-checkpoints", uuid.uuid4().hex))
    return context._jsc.sc().getCheckpointDir().get()


#: Sessions and paths of the tables that :func:`written` made and nothing has dropped yet.
_LEFT: dict[str, SparkSession] = {}


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here, and the loss of an executor costs nothing.

    The table lasts as long as the driver, as results may be computed from it at any time, unless it is dropped before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder for files that an operator writes itself; it goes with the driver, too."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    return path


def mounted(spark: SparkSession, path: str) -> str | None:
    """The whole path as Python opens it, if it names plain files, as a mounted folder does; nothing for other file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(at).toUri().getPath() if system.getUri().getScheme() == "file" else None


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`written`, once nothing reads it any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        _delete(df.sparkSession, folder)
        for path in [p for p in _LEFT if folder.endswith(p.split(":", 1)[-1].lstrip("/"))]:
            del _LEFT[path]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _drop_all() -> None:
    """What is left goes with the driver."""
    for path, spark in list(_LEFT.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session's virtual machine has ended already
            return


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for operators that must fix a partitioning themselves."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
