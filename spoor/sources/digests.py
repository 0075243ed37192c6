"""Digests of files of any size: a data source whose tasks read files in chunks.

A row of Spark's own binary reader holds a whole file, and fails at 2 GB. Here a file is a stream of ``CHUNK`` bytes at a
time. Files are dealt over tasks by size, the largest first, each to the task with the least so far.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 1 << 20
SCHEMES = ("file", "hdfs", "s3", "gs", "abfs")


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


def dealt(files: Sequence[tuple[str, int]], tasks: int) -> list[list[tuple[str, int]]]:
    """Files over so many tasks at most, by size."""
    heap = [(0, i) for i in range(min(tasks, len(files)))]
    out: list[list[tuple[str, int]]] = [[] for _ in heap]
    for path, size in sorted(files, key=lambda f: (-f[1], f[0])):
        total, i = heapq.heappop(heap)
        out[i].append((path, size))
        heapq.heappush(heap, (total + size + CHUNK, i))
    return out


def digest(system: fs.FileSystem, path: str, chunk: int = CHUNK) -> str:
    """SHA-256 of a file, of which no more than a chunk is held."""
    h, buffer = hashlib.sha256(), bytearray(chunk)
    with system.open_input_stream(path, buffer_size=0) as stream:
        while n := stream.readinto(buffer):
            h.update(memoryview(buffer)[:n])
    return h.hexdigest()


class FileDigests(DataSource):
    """spark.read.format("file_digests").option("path", folder or file).option("tasks", n)."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "path string, size_bytes long, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("tasks", "200")))


class _Reader(DataSourceReader):
    def __init__(self, path: str, tasks: int) -> None:
        self.path, self.tasks = path, tasks

    def partitions(self) -> list[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(root)
        infos = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = [(i.path, i.size) for i in infos if i.type == fs.FileType.File]
        return [Files(some) for some in dealt(files, self.tasks)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        scheme = self.path.split(":", 1)[0]
        for path, size in partition.paths:
            yield pa.RecordBatch.from_pydict({"path": [f"{scheme}:{path}" if path.startswith("/") else f"{scheme}://{path}"], "size_bytes": [size], "sha256": [digest(system, path)]})
