"""Small files in any store that Hadoop reads: whole values, replaced at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Store:
    """Files under a root, by relative path; all calls run on the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._jvm, self.root = spark, spark.sparkContext._jvm, root.rstrip("/")
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def size(self, name: str) -> int:
        return self._fs.getFileStatus(self._path(name)).getLen()

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        """Written beside its place and renamed over it in one step, so that a reader sees the old value or the new one."""
        part = self._path(f"{name}.{uuid.uuid4().hex}.part")
        stream = self._fs.create(part, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        overwrite = self._spark.sparkContext._gateway.new_array(options, 1)
        overwrite[0] = options.OVERWRITE
        self._context.rename(part, self._path(name), overwrite)

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(folder)))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def read_json(self, name: str) -> dict | None:
        """A JSON object; None where there is none that can be read."""
        try:
            value = json.loads(self.read(name)) if self.exists(name) else None
        except ValueError:
            return None
        return value if isinstance(value, dict) else None

    def write_json(self, name: str, value: dict) -> None:
        self.write(name, json.dumps(value, sort_keys=True).encode())


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table at a path is there as a whole."""
    return Store(spark, path).exists("_SUCCESS")
