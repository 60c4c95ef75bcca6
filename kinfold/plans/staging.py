"""Written tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Rows of a file of a table whose size is known.
ROWS_IN_FILE = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; local mode without the setting makes its own, a cluster must set it."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="kinfold-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir().rstrip("/")


class Staged:
    """A table written once: ``df`` reads it, :meth:`discard` deletes its files; what is left goes when the driver ends.

    ``rows`` is an upper estimate of its rows, if known: a small table then goes into few files.
    """

    def __init__(self, df: DataFrame, name: str, rows: int | None = None) -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        (df if rows is None else df.coalesce(-(-rows // ROWS_IN_FILE) or 1)).write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _LEFT[self.path] = self

    def discard(self) -> None:
        _LEFT.pop(self.path, None)
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(conf).delete(path, True)


_LEFT: dict[str, Staged] = {}


@atexit.register
def _tidy() -> None:
    """Delete the tables that are left, if the session still lives; results read them until the driver ends."""
    for table in list(_LEFT.values()):
        if table.spark.sparkContext._jsc is None:
            return
        try:
            table.discard()
        except (Py4JError, OSError):
            return


def staged(df: DataFrame, name: str) -> DataFrame:
    return Staged(df, name).df
