from __future__ import annotations

import hashlib
import os

import pytest

from quillwork.sources import files
from quillwork.sources.files import _dealt, _described, _open, register_sources
from quillwork.streaming.streams import drain


def _write(folder, name: str, data: bytes, at: int) -> None:
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    os.utime(path, (1_700_000_000 + at,) * 2)


def _want(data: dict[str, bytes]) -> set:
    out = set()
    for path, body in data.items():
        name = path.rsplit("/", 1)[-1]
        stem = name.rpartition(".")[0] or name
        out.add((name, stem, len(body), hashlib.sha256(body).hexdigest()[:32]))
    return out


DATA = {"a.pdf": b"x" * 10, "deep/b.tar.PDF": b"y" * 3_000, "deep/er/c.pdf": b"z", "noending": b"n"}


def test_batch_and_stream(spark, tmp_path):
    register_sources(spark)
    root = tmp_path / "in"
    for i, (name, body) in enumerate(DATA.items()):
        _write(root, name, body, i)
    _write(root, "empty.pdf", b"", 9)
    _write(root, "_SUCCESS", b"s", 9)
    found = spark.read.format("corpus").load(str(root))
    assert {tuple(r)[1:] for r in found.collect()} == _want(DATA)
    pdf = spark.read.format("corpus").option("types", ".pdf").option("parts", "2").load(f"file:{root}")
    assert {tuple(r)[1:] for r in pdf.collect()} == _want({k: v for k, v in DATA.items() if k != "noending"})
    assert pdf.rdd.getNumPartitions() == 2
    home, stream = str(tmp_path / "home"), lambda: spark.readStream.format("corpus").load(str(root))
    assert {tuple(r)[1:] for r in drain(stream(), home=home).collect()} == _want(DATA)
    _write(root, "later.pdf", b"later", 20)
    rows = drain(stream(), home=home).collect()
    assert len(rows) == 5 and {tuple(r)[1:] for r in rows} == _want({**DATA, "later.pdf": b"later"})


def test_no_files_and_unknown_sources(spark, tmp_path):
    register_sources(spark)
    assert spark.read.format("corpus").load(str(tmp_path)).isEmpty()
    assert spark.read.format("corpus").load(str(tmp_path / "nowhere")).isEmpty()
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("corpus").load().collect()
    with pytest.raises(Exception, match="DATA_SOURCE_NOT_FOUND"):
        spark.read.format("corpora").load(str(tmp_path))


def test_a_large_file_in_pieces(tmp_path, monkeypatch):
    """More than a value of Spark can hold, without holding it."""
    monkeypatch.setattr(files, "PIECE_BYTES", 64 << 20)
    path = tmp_path / "large.bin"
    with open(path, "wb") as out:
        out.truncate((2 << 30) + 5)
    row = _described(_open(str(tmp_path))[0], str(path))
    digest = hashlib.sha256()
    for _ in range(32):
        digest.update(bytes(64 << 20))
    digest.update(bytes(5))
    assert row["size"] == (2 << 30) + 5 and row["checksum"] == digest.hexdigest()[:32]


def test_files_are_dealt_by_size():
    listed = [(0, f"f{i}", size) for i, size in enumerate([100, 60, 50, 30, 20, 20])]
    sizes = dict((p, s) for _, p, s in listed)
    loads = sorted(sum(sizes[p] for p in part.value) for part in _dealt(listed, 3))
    assert loads == [80, 100, 100] and _dealt([], 3) == []
