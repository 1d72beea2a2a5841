"""A data source of the blobs of a git repository's whole history: oid, path, size and SHA-256.

Objects without a path are passed over.  Sizes are read first, so with the option ``sizes``
(comma-separated) only blobs of those sizes are read and hashed.  A partition is a run of
objects; the repository is a folder that all executors see.
"""

from __future__ import annotations

import hashlib
import subprocess

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Objects of a partition.
OBJECTS = 20_000


class Objects(InputPartition):
    def __init__(self, rows: list[tuple[str, str]]):
        self.rows = rows


class BlobReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.repository = options["path"]
        self.sizes = {int(x) for x in options.get("sizes", "").split(",") if x}

    def _git(self, *args: str, stdin: bytes | None = None) -> bytes:
        return subprocess.run(["git", "-c", "safe.directory=*", "-C", self.repository, *args], input=stdin, capture_output=True, check=True).stdout

    def partitions(self):
        listed = self._git("rev-list", "--objects", "--all").decode("utf-8", "replace").splitlines()
        named = [(x[:40], x[41:]) for x in listed if len(x) > 41]
        return [Objects(named[i : i + OBJECTS]) for i in range(0, len(named), OBJECTS)] or [Objects([])]

    def read(self, partition: Objects):
        asked = "".join(f"{oid}\n" for oid, _ in partition.rows).encode()
        about = self._git("cat-file", "--batch-check", stdin=asked).decode().splitlines() if asked else []
        for (oid, path), line in zip(partition.rows, about):
            _, kind, size = line.split()
            if kind == "blob" and (not self.sizes or int(size) in self.sizes):
                yield oid, path, int(size), hashlib.sha256(self._git("cat-file", "blob", oid)).hexdigest()


class GitBlobs(DataSource):
    """``spark.read.format("git_blobs").load(folder)`` once registered with ``spark.dataSource.register``."""

    @classmethod
    def name(cls) -> str:
        return "git_blobs"

    def schema(self) -> str:
        return "oid string, path string, size long, digest string"

    def reader(self, schema) -> BlobReader:
        return BlobReader(dict(self.options))
