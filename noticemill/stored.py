"""Tables that a call stores in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset a local session, as in tests, gets one of its own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc._jsc.sc().getCheckpointDir().get()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="noticemill-"))
        folder = sc._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """(path, its file system) as Hadoop's objects."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class CommitConflict(RuntimeError):
    """Another writer has taken the version that a commit was for."""


def create_once(spark: SparkSession, path: str, text: str) -> None:
    """A small file that only one of several writers can create; FileExistsError if it is there.

    It is written aside and renamed to where nothing may be, as stream checkpoints do: readers see it whole or not at
    all, and of two writers one succeeds wherever a rename doesn't replace files.
    """
    target, files = hadoop(spark, path)
    aside, _ = hadoop(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = files.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    jvm, sc = spark._jvm, spark.sparkContext
    never_replacing = sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), sc._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(aside), files.makeQualified(target), never_replacing)
    except Py4JJavaError as e:
        files.delete(aside, False)
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        raise FileExistsError(path) from None


_made: ContextVar[list[Scratch] | None] = ContextVar("_made", default=None)


@contextmanager
def clearing() -> Iterator[None]:
    """Deletes at its end what Scratches made inside still keep: for a caller that has stored the result by then."""
    outer, own = _made.get(), []
    _made.set(own)
    try:
        yield
    finally:
        _made.set(outer)
    for scratch in own:
        scratch.clear()


class Scratch:
    """Tables that a call stores in the shared folder, so that lineage ends there and lost executors cost no more than a read.

    What isn't dropped before is deleted when the driver's JVM ends: a result that is still to be computed reads it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/noticemill-{uuid.uuid4().hex}"
        self._kept: dict[int, tuple[DataFrame, str]] = {}
        if (made := _made.get()) is not None:
            made.append(self)
        place, files = hadoop(spark, self.folder)
        files.mkdirs(place)
        files.deleteOnExit(place)

    def keep(self, df: DataFrame) -> DataFrame:
        """df as a stored table."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        # nothing asks for the marker of success; on a local disk it starts two processes beside the driver
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._kept[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            place, files = hadoop(self.spark, self._kept.pop(id(df))[1])
            files.delete(place, True)

    def clear(self) -> None:
        self.drop(*(df for df, _ in list(self._kept.values())))
