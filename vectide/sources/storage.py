"""Small files and folders on any file system that Spark knows."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir, deleted when the interpreter ends.

    Where the setting is missing, a local session gets a temporary folder; a cluster has no folder to fall back to.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="vectide-")
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"

    def leave() -> None:
        try:
            Storage(spark, path).delete("")
        except Exception:  # the session may have ended before the interpreter does
            pass

    atexit.register(leave)
    return path


class Storage:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def full(self, path: str) -> str:
        return f"{self.root}/{path}"

    def exists(self, path: str) -> bool:
        at, fs = self._at(path)
        return fs.exists(at)

    def delete(self, path: str) -> None:
        at, fs = self._at(path)
        fs.delete(at, True)

    def children(self, path: str) -> list[tuple[str, bool]]:
        at, fs = self._at(path)
        return sorted((s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(at)) if fs.exists(at) else []

    def write_json(self, path: str, value: dict) -> None:
        """The file is replaced as a whole."""
        at, fs = self._at(path)
        new, _ = self._at(f"{path}.new")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        # a rename that overwrites: readers see the old file or the new one
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(context.makeQualified(new), context.makeQualified(at), options)

    def read_json(self, path: str) -> dict:
        at, fs = self._at(path)
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def walk(self, path: str, mark: str):
        """Names, relative to ``path``, of the folders that hold a file ``mark``, at any depth."""
        for name, folder in self.children(path):
            if folder:
                below = f"{path}/{name}"
                if self.exists(f"{below}/{mark}"):
                    yield name
                else:
                    yield from (f"{name}/{x}" for x in self.walk(below, mark))
