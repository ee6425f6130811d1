"""Folders that are published in versions, on any file system that Spark writes to.

A version is one small file, `versions/<number>.json`, that names the data folders it consists of; the
highest number counts. Data are written first, under names of their own, and the version file is put in its place last by a rename
that fails where another writer came first. So readers see an old or a new version, whole, and a writer
that dies leaves folders that no version names.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import SparkSession

NAME = re.compile(r"(\d{12})\.json")
GRACE_SECONDS = 3600  #: for which a folder that no version names stays, as it may be being written


class Conflict(RuntimeError):
    """Another writer published first."""


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())
        self._no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def _names(self, folder: str) -> dict[str, float]:
        """Entries of a folder with the seconds at which they were last changed."""
        path = self._path(f"{self.root}/{folder}")
        return {f.getPath().getName(): f.getModificationTime() / 1000 for f in self._fs.listStatus(path)} if self._fs.exists(path) else {}

    def numbers(self) -> list[int]:
        return sorted(int(m[1]) for n in self._names("versions") if (m := NAME.fullmatch(n)))

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/versions/{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def current(self) -> tuple[int, dict]:
        """The highest number and its content; 0 and nothing before the first."""
        for number in reversed(self.numbers()):
            return number, self.read(number)
        return 0, {}

    def data(self, folder: str) -> str:
        """Where a data folder lies."""
        return f"{self.root}/data/{folder}"

    def fresh(self) -> str:
        """A name for a data folder that nothing has used."""
        return uuid.uuid4().hex

    def commit(self, after: int, content: dict) -> int:
        """Publishes content as the version that follows `after`; Conflict if there is one already."""
        part = f"{self.root}/versions/.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(part), True)
        stream.write(bytearray(json.dumps(content, ensure_ascii=False).encode()))
        stream.close()
        number = after + 1
        to = self._path(f"{self.root}/versions/{number:012d}.json")
        try:
            self._context.rename(self._path(part), to, self._no_options)
        except Exception as e:
            self._fs.delete(self._path(part), False)
            if self._fs.exists(to):
                raise Conflict(f"version {number} of {self.root} is there already") from e
            raise
        return number

    def folders(self, content: dict) -> set[str]:
        """Data folders that a content names: all strings below its key `folders`."""
        found = content.get("folders", {})
        return set(found.values() if isinstance(found, dict) else found)

    def vacuum(self, keep: int = 2, grace: float = GRACE_SECONDS) -> list[str]:
        """Removes versions but the last `keep`, and data folders that none of those names and that nobody has changed for `grace` seconds. Readers of older versions must be done."""
        numbers = self.numbers()
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/versions/{n:012d}.json"), False)
        named = set().union(*(self.folders(self.read(n)) for n in numbers[-keep:]))
        gone = [f for f, changed in self._names("data").items() if f not in named and time.time() - changed >= grace]
        for f in gone:
            self._fs.delete(self._path(self.data(f)), True)
        return gone
