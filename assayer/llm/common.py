"""What the operators share: the shared folder, materialised tables, small numeric helpers."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Bytes that the contracts call white space: space, tab, line feed, vertical tab, form feed, return.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_CLASS = "[^\\x20\\x09-\\x0D]"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent and the master is local, a temporary folder is made and set, as
    tests need one. On a cluster without the setting this raises, as a machine-local folder would
    be invisible to the other machines.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    root = "file://" + tempfile.mkdtemp(prefix="assayer-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Workspace:
    """A fresh folder below the shared root for one run of one operator. It lasts as long as the
    application, as results read from it, and is deleted when the driver's Python ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.uri = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(_delete, self.uri)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes df as Parquet in the workspace and reads it back: this cuts the lineage, and a
        lost executor costs no recomputation, as the files are in the shared folder. The write's
        shuffle files go when it ends, not when the driver happens to collect its garbage."""
        self._n += 1
        path = f"{self.uri}/{self._n:03d}-{name}"
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes the files behind kept tables that nothing will read again."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            for f in t.inputFiles()[:1]:
                path = jvm.org.apache.hadoop.fs.Path(f).getParent()
                path.getFileSystem(conf).delete(path, True)


def _delete(uri: str) -> None:
    with contextlib.suppress(OSError):
        fs, path = open_fs(uri)
        fs.delete_dir(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI, for workers that write their own formats. A path
    without scheme is local."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def publish(uri: str, name: str, write) -> str:
    """Calls write(stream) on a name that no other task attempt uses, and returns the file's URI.

    A lost or repeated attempt leaves a file that no manifest names; readers go by the manifest.
    """
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)
    final = f"{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(f"{path}/{final}") as out:
        write(out)
    return f"{uri}/{final}"


def read_range(uri: str, offset: int, length: int) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(length, offset)
