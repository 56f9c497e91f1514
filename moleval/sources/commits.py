"""Committed batches and tables (S9, S10): staged folders, and manifests that make them count.

A write goes to a folder of its own that nothing reads yet; a small manifest, put
in place by one rename, makes it part of the table.  So a write that is killed in
between leaves a folder that no manifest names, a repeated append of one batch key
is no second copy, and readers see whole batches only.  Paths go through the
Hadoop file system that Spark uses.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

LOG = "_batches"
MANIFEST = "_manifest.json"
CLAIM = "_claim"


class Folder:
    """Files of one folder on the file system that Spark reads it by."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self._p("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._p(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._p(name))) if self.exists(name) else []

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        f = self.fs.open(self._p(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")
        finally:
            f.close()

    def put(self, name: str, text: str) -> None:
        """A whole file under ``name``, by one rename."""
        part = f"_tmp-{uuid.uuid4().hex}"
        f = self.fs.create(self._p(part), True)
        f.write(bytearray(text.encode()))
        f.close()
        self.fs.mkdirs(self._p(name).getParent())
        if not self.fs.rename(self._p(part), self._p(name)):
            self.fs.delete(self._p(name), False)                # a store whose rename does not replace
            self.fs.rename(self._p(part), self._p(name))

    def claim(self, name: str, stale_s: float) -> bool:
        """Make ``name`` unless another writer holds it; a file older than ``stale_s`` is a dead writer's."""
        if self.exists(name) and time.time() - self.fs.getFileStatus(self._p(name)).getModificationTime() / 1000 > stale_s:
            self.fs.delete(self._p(name), False)
        self.fs.mkdirs(self._p(""))
        if self.fs.getUri().getScheme() == "file":              # the local file system's own create is a test and a write
            try:
                os.close(os.open(self._p(name).toUri().getPath(), os.O_CREAT | os.O_EXCL))
                return True
            except FileExistsError:
                return False
        return self.fs.createNewFile(self._p(name))

    def drop(self, name: str) -> None:
        self.fs.delete(self._p(name), True)

    def fingerprint(self) -> str:
        """Digest of the names, sizes and times of all files below."""
        files, out = self.fs.listFiles(self._p(""), True), []
        while files.hasNext():
            s = files.next()
            out.append((s.getPath().toUri().getPath(), s.getLen(), s.getModificationTime()))
        return hashlib.sha256(json.dumps(sorted(out)).encode()).hexdigest()


def _name(key: str) -> str:
    return hashlib.sha256(str(key).encode()).hexdigest()[:32] + ".json"


def committed(spark: SparkSession, path: str, key: str) -> bool:
    return Folder(spark, path).exists(f"{LOG}/{_name(key)}")


def append_batch(df: DataFrame, path: str, key: str, fmt: str = "parquet") -> bool:
    """Append the rows of one batch, once: False if the key is committed already.

    Two writers of one key both write, and the manifest that is put last names
    the one folder that counts."""
    spark = df.sparkSession
    if committed(spark, path, key):
        return False
    data = f"data/{uuid.uuid4().hex}"
    df.write.format(fmt).save(f"{path.rstrip('/')}/{data}")
    Folder(spark, path).put(f"{LOG}/{_name(key)}", json.dumps({"key": str(key), "folder": data}))
    return True


def read_batches(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """All committed batches; an empty table where there is none."""
    folder = Folder(spark, path)
    data = [json.loads(folder.read(f"{LOG}/{n}"))["folder"] for n in folder.names(LOG)]
    if not data:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load([f"{folder.path}/{d}" for d in data])


def source_fingerprint(spark: SparkSession, *paths: str) -> str:
    """Digest of the files of some source folders or files: changes when one is written again."""
    return hashlib.sha256("".join(Folder(spark, p).fingerprint() for p in paths).encode()).hexdigest()


def materialize_once(spark: SparkSession, path: str, build, fmt: str = "parquet", source: str = "", stale_s: float = 86_400.0,
                     poll_s: float = 0.5) -> DataFrame:
    """Build and write the table unless a finished copy of the same ``source`` (a fingerprint) exists;
    then read the stored copy.

    One writer holds the claim and builds; others wait for its manifest.  A claim older than
    ``stale_s`` (of a writer that died) is taken over.  A folder with the writer's ``_SUCCESS``
    mark and no manifest is a finished copy written plainly; one without is built anew.
    """
    folder = Folder(spark, path)

    def finished() -> DataFrame | None:
        found = json.loads(folder.read(MANIFEST) or "null")
        if found and found["source"] == source:
            return spark.read.format(fmt).load(f"{folder.path}/{found['folder']}")
        if not found and not source and folder.exists("_SUCCESS"):
            return spark.read.format(fmt).load(folder.path)
        return None

    while (done := finished()) is None:
        if not folder.claim(CLAIM, stale_s):
            time.sleep(poll_s)
            continue
        try:
            if finished() is None:                              # another may have finished between the look and the claim
                data = f"data/{uuid.uuid4().hex}"
                build().write.format(fmt).save(f"{folder.path}/{data}")
                folder.put(MANIFEST, json.dumps({"source": source, "folder": data}))
        finally:
            folder.drop(CLAIM)
    return done
