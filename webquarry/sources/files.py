"""Small files and folders through Hadoop's FileSystem: a home may lie in any store that Spark reads."""

from __future__ import annotations

import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    """Files below one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str = ""):
        return self.hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not exist yet; false if it does."""
        try:
            out = self.fs.create(self.path(name), False)
        except Py4JJavaError as e:
            if self.exists(name):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def put(self, name: str, text: str) -> None:
        """Write a file as a whole: readers see the old text or the new one."""
        part = f"{name}.{uuid.uuid4().hex}.part"
        self.create(part, text)
        if self.fs.rename(self.path(part), self.path(name)):
            return
        self.delete(name)  # stores whose rename doesn't replace
        self.fs.rename(self.path(part), self.path(name))

    def delete(self, name: str) -> bool:
        return self.fs.delete(self.path(name), True)

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def files(self, name: str = "", suffix: str = "") -> list[tuple[str, int]]:
        """(path below name, bytes) of all files, folders below included."""
        if not self.exists(name):
            return []
        out, base = [], self.fs.makeQualified(self.path(name)).toString().rstrip("/") + "/"
        each = self.fs.listFiles(self.path(name), True)
        while each.hasNext():
            status = each.next()
            at = status.getPath().toString()
            if at.endswith(suffix):
                out.append((at.removeprefix(base), status.getLen()))
        return sorted(out)

    def age(self, name: str) -> float:
        """Seconds since the file was written."""
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may go without, and gets a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="webquarry-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _stored(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def make_folder(path: str) -> None:
    """From a task, in a store that Arrow knows."""
    store, at = _stored(path)
    store.create_dir(at, recursive=True)


def open_output(path: str):
    """A new file, from a task, in a store that Arrow knows."""
    store, at = _stored(path)
    return store.open_output_stream(at)
