"""A corpus of files as a Spark data source, batch and streaming: names, sizes and checksums, read in pieces.

`binaryFile` brings a file as one value, at most 2 GB of it. This source reads each file
in pieces inside the task that owns it and keeps only what the columns need:

    register_sources(spark)
    spark.read.format("corpus").option("types", ".pdf,.epub").load(folder)
    spark.readStream.format("corpus").load(folder)

Files are dealt into partitions of about equal bytes. Any file system that pyarrow can
open by its URI will do; a path without a scheme is local to every machine.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from heapq import heappop, heappush
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

PIECE_BYTES = 8 << 20
SCHEMA = "path string, name string, stem string, size long, checksum string"
BATCH_ROWS = 1_000


def _open(path: str):
    """(file system, path inside it) of a URI or a local path."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


def _opened(path: str):
    """The same for a path as Spark writes it, with nothing escaped."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return _open(quote(path, safe=":/@"))


def can_open(path: str) -> bool:
    """Whether a path as Spark writes it is in a store that `_opened` knows."""
    try:
        _opened(path)
    except (pa.ArrowException, OSError):
        return False
    return True


def _listed(path: str, types: Sequence[str]) -> list[tuple[int, str, int]]:
    """(time of change in nanoseconds, path, size) of the accepted, non-empty files under `path`."""
    from pyarrow import fs

    system, root = _open(path)
    infos = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    if not infos and system.get_file_info(root).type == fs.FileType.File:
        infos = [system.get_file_info(root)]
    files = [i for i in infos if i.type == fs.FileType.File and i.size and not i.base_name.startswith(("_", "."))]
    if types:
        files = [i for i in files if i.base_name.lower().endswith(tuple(t.lower() for t in types))]
    return sorted((i.mtime_ns or 0, i.path, i.size) for i in files)


class Files(InputPartition):
    """Paths that one task reads."""

    def __init__(self, paths: list[str]) -> None:
        super().__init__(tuple(paths))


def _dealt(files: list[tuple[int, str, int]], parts: int) -> list[Files]:
    """The files in at most `parts` partitions, largest first into the emptiest."""
    heap: list[tuple[int, int, list[str]]] = [(0, i, []) for i in range(max(1, min(parts, len(files))))]
    for _, path, size in sorted(files, key=lambda f: (-f[2], f[1])):
        total, i, paths = heappop(heap)
        paths.append(path)
        heappush(heap, (total + size, i, paths))
    return [Files(paths) for _, _, paths in sorted(heap, key=lambda h: h[1]) if paths]


def _described(system, path: str) -> dict:
    """One file, never more of it in memory than a piece."""
    digest, size = hashlib.sha256(), 0
    with system.open_input_stream(path) as stream:
        while piece := stream.read(PIECE_BYTES):
            digest.update(piece)
            size += len(piece)
    name = path.rsplit("/", 1)[-1]
    stem, dot, _ = name.rpartition(".")
    return {"path": path, "name": name, "stem": stem if dot and stem else name, "size": size, "checksum": digest.hexdigest()[:32]}


def file_checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, length) -> (path, length, checksum), one file after the other in pieces."""
    for batch in batches:
        found = [_described(*_opened(path))["checksum"] for path in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=["path", "length", "checksum"])


def _read(root: str, partition: Files) -> Iterator[pa.RecordBatch]:
    system, _ = _open(root)
    kind = pa.schema([(n, pa.int64() if n == "size" else pa.string()) for n in ("path", "name", "stem", "size", "checksum")])
    paths = list(partition.value)
    for first in range(0, len(paths), BATCH_ROWS):
        rows = [_described(system, p) for p in paths[first : first + BATCH_ROWS]]
        yield pa.RecordBatch.from_pylist(rows, kind)


class _Reader(DataSourceReader):
    def __init__(self, root: str, types: list[str], parts: int) -> None:
        self.root, self.types, self.parts = root, types, parts

    def partitions(self) -> list[Files]:
        return _dealt(_listed(self.root, self.types), self.parts)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.root, partition) if partition else iter(())


class _StreamReader(DataSourceStreamReader):
    """New files by their time of change; an offset is the last file that was read."""

    def __init__(self, root: str, types: list[str], parts: int) -> None:
        self.root, self.types, self.parts = root, types, parts

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": json.dumps([-1, ""])}

    def latestOffset(self) -> dict:  # noqa: N802
        files = _listed(self.root, self.types)
        return {"at": json.dumps(list(files[-1][:2]))} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (tuple(json.loads(offset["at"])) for offset in (start, end))
        return _dealt([f for f in _listed(self.root, self.types) if low < f[:2] <= high], self.parts)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.root, partition)


class Corpus(DataSource):
    """Options: path, types (accepted endings, by commas; all without it), parts (most partitions, 64)."""

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return SCHEMA

    def _arguments(self) -> tuple[str, list[str], int]:
        if not self.options.get("path"):
            raise ValueError("a corpus needs a path")
        types = [t.strip() for t in self.options.get("types", "").split(",") if t.strip()]
        return self.options["path"], types, int(self.options.get("parts", "64"))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(*self._arguments())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(*self._arguments())


def register_sources(spark: SparkSession) -> None:
    """Make the sources above known by their names; another name is Spark's error for an unknown source."""
    spark.dataSource.register(Corpus)
