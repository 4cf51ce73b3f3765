"""Where intermediate results go: the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of local applications that name none, by application.
_OWN: dict[str, str] = {}
#: Folders that this process wrote and has not removed.
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one, for local sessions that name none.

    On a cluster the folder must be named, for executors do not see the driver's own folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _OWN:
            _OWN[application] = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        folder = _OWN[application]
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def clear() -> list[str]:
    """Remove the folders that ``new_path`` gave to this process, once their rows are no longer wanted; the paths removed.

    Works on the file systems that Arrow opens by their URI. Checkpoints go with
    their DataFrames if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    from pyarrow import fs

    gone = []
    for path in list(_WRITTEN):
        place, inside = fs.FileSystem.from_uri(path if urlsplit(path).scheme else f"file://{path}")
        if place.get_file_info(inside).type != fs.FileType.NotFound:
            place.delete_dir(inside)
            gone.append(path)
        _WRITTEN.remove(path)
    return gone


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """A reliable checkpoint: the lineage ends in files that every executor can read."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of ``new_path`` by the file system that Spark has for it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _WRITTEN.remove(path)


class Rounds:
    """The rows that the last round of an iteration left, as ``stored``; those of the round before go once they are written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path = spark, name, None

    def keep(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, self.name)
        df.write.parquet(path)
        self.drop()
        self.path = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        if self.path:
            remove(self.spark, self.path)
        self.path = None


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
