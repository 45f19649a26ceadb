"""Files that tasks write to and read from the shared folder by its address."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame


def filesystem(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address, with or without a scheme, and the path in it."""
    return pafs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (pafs.LocalFileSystem(), address)


@contextmanager
def written(address: str) -> Iterator:
    """A stream whose file appears under its name only when it is complete, so that a repeated task does no harm."""
    fs, path = filesystem(address)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with fs.open_output_stream(draft) as out:
        yield out
    fs.move(draft, path)


@contextmanager
def opened(address: str) -> Iterator:
    """A file for reading at any place."""
    fs, path = filesystem(address)
    with fs.open_input_file(path) as source:
        yield source


def each_alone(rows: DataFrame) -> DataFrame:
    """Rows that stand for files or their parts, dealt evenly to as many tasks."""
    return rows.repartition(max(1, rows.count()))
