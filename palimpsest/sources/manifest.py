"""Versions of a stored table.

Data files are written first and never changed; a version is one small JSON file that names the
folders it consists of, put in place by a rename.  Readers of an older version are not disturbed, a
job that dies before the rename leaves the table as it was, and two writers of one version cannot both
succeed.  All access goes through Spark's file systems.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifest:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._folder = self._path(f"{root}/_versions")
        self._fs = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _file(self, version: int):
        return self._path(f"{self.root}/_versions/{version:010d}.json")

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        if not self._fs.exists(self._folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int | None = None) -> tuple[int, dict]:
        """A version (the latest if none is named) and what it holds; version 0 of a new table holds nothing."""
        found = self.versions()
        if version is None:
            if not found:
                return 0, {}
            version = found[-1]
        elif version not in found:
            raise ValueError(f"{self.root} has no version {version}; it has {found}")
        stream = self._fs.open(self._file(version))
        try:
            return version, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, version: int, state: dict) -> None:
        """Makes ``state`` the given version, which must not exist yet."""
        draft = self._path(f"{self.root}/_versions/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.exists(self._file(version)) or not self._fs.rename(draft, self._file(version)):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {version} of {self.root} was written by somebody else; read it and try again")

    def delete(self, folder: str) -> None:
        """Removes a folder of the table that no version to be kept names."""
        self._fs.delete(self._path(f"{self.root}/{folder}"), True)

    def forget(self, version: int) -> None:
        self._fs.delete(self._file(version), False)
