"""A folder whose contents change as a whole: data in folders of their own, named by a manifest.

A writer puts each run's data under ``{root}/runs/{run}`` and then commits one manifest, a small JSON
file ``{root}/manifests/{number}.json`` that names all that belongs to the new version. It is written
under a temporary name and renamed, so readers see the version before or the one after, also when
the writer is killed in between; what a killed run has left is never named by any manifest. Goes
through Hadoop's file systems: any store that Spark can write to. Runs are expected one at a time;
of two that commit the same number, the second fails and its data stay unnamed.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def new_run(self) -> str:
        return f"runs/{uuid.uuid4().hex}"

    def folders(self, name: str) -> list[str]:
        """Names of the folders in a folder; none if it doesn't exist."""
        if not self._fs.exists(self._path(name)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)) if s.isDirectory())

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path("manifests")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict[str, Any]:
        stream = self._fs.open(self._path(f"manifests/{number:010d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> dict[str, Any] | None:
        """The newest complete version's manifest; None before the first commit."""
        numbers = self._numbers()
        return self.read(numbers[-1]) if numbers else None

    def commit(self, manifest: dict[str, Any], keep: int = 2) -> int:
        """Make ``manifest`` the newest version; of the older ones, ``keep - 1`` stay readable.
        ``manifest["runs"]`` lists the runs it names."""
        numbers = self._numbers()
        number = numbers[-1] + 1 if numbers else 0
        final, temporary = self._path(f"manifests/{number:010d}.json"), self._path(f"manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, False)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(temporary, final):
            self._fs.delete(temporary, False)
            raise RuntimeError(f"{self.root}: version {number} was committed by another run")
        self._expire(numbers, keep)
        return number

    def _expire(self, older: list[int], keep: int) -> None:
        """Delete versions beyond the newest ``keep`` and the runs that only they name."""
        gone = older[: max(0, len(older) - (keep - 1))]
        staying = {r for n in self._numbers() if n not in gone for r in self.read(n)["runs"]}
        for n in gone:
            for run in self.read(n)["runs"]:
                if run not in staying:
                    self._fs.delete(self._path(run), True)
            self._fs.delete(self._path(f"manifests/{n:010d}.json"), False)
