"""Numbered markers in a shared folder, each of which one writer alone can put."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


class Markers:
    """A list that writers extend by one marker at a time, a JSON value each.

    A marker is written beside the list and then gets the next number: by a
    link on a local disk, by a rename elsewhere, both of which fail where that number
    is taken. (A store without such a rename can't hold the list.)
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._local = self._fs.getUri().getScheme() == "file"
        self._place = unquote(urlparse(self.folder).path) if "://" in self.folder or self.folder.startswith("file:") else self.folder

    def all(self) -> list:
        """The markers in order."""
        top = self._path(self.folder)
        if not self._fs.exists(top):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(top))
        return [self._read(n) for n in names if n.isdigit()]

    def _read(self, name: str):
        if self._local:
            with open(f"{self._place}/{name}") as f:
                return json.load(f)
        stream = self._fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, number: int, value) -> bool:
        """Puts marker `number` (from 0); False where another writer has."""
        name, beside = f"{number:012d}", f".{uuid.uuid4().hex}"
        if self._local:
            os.makedirs(self._place, exist_ok=True)
            with open(f"{self._place}/{beside}", "w") as f:
                json.dump(value, f)
            try:
                os.link(f"{self._place}/{beside}", f"{self._place}/{name}")
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(f"{self._place}/{beside}")
        at = self._path(f"{self.folder}/{beside}")
        out = self._fs.create(at, False)
        out.write(json.dumps(value).encode())
        out.close()
        if self._fs.rename(at, self._path(f"{self.folder}/{name}")):
            return True
        self._fs.delete(at, False)
        return False
