"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Resident memory of a Python worker from which on it is trimmed after a task.
TRIM_BYTES = 250 << 20
#: Characters of text that one step inside a task holds at once; a single longer text is a step of its own.
STEP_CHARS = 4_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tasks_of(spark: SparkSession) -> int:
    """Partitions for an exchange; a cluster sets them to fit its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def steps(batches: Iterable[pa.RecordBatch], text: str = "text",
          most: int = STEP_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts (null: empty), each of about ``most`` characters."""
    for batch in batches:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        start = held = 0
        for i, t in enumerate(texts):
            held += len(t) + 64
            if held >= most:
                yield batch.slice(start, i + 1 - start), texts[start:i + 1]
                start, held = i + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def trim() -> None:
    """Give freed memory back: a Python worker outlives its task, and stages to come need the room."""
    import ctypes
    import gc
    try:
        with open("/proc/self/statm") as sizes:
            if int(sizes.read().split()[1]) * 4096 < TRIM_BYTES:
                return
    except OSError:  # another system
        pass
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tidy(task):
    """``task`` over batches, with its memory given back at the end."""
    def batches(given):
        yield from task(given)
        trim()
    return batches


def tidy_group(task):
    def group(given: pa.Table) -> pa.Table:
        out = task(given)
        trim()
        return out
    return group


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder every executor reaches, and the folder's path in it."""
    return pafs.FileSystem.from_uri(uri)


class Committed:
    """A file that appears under its name only when it is whole.

    A task that runs again, or twice at once, writes the same bytes and replaces the file.
    """

    def __init__(self, uri: str, name: str):
        self.fs, folder = store(uri)
        self.fs.create_dir(folder, recursive=True)
        self.name, self.draft = f"{folder}/{name}", f"{folder}/.{name}.{uuid.uuid4().hex}"

    def __enter__(self):
        self.file = self.fs.open_output_stream(self.draft)
        return self.file

    def __exit__(self, kind, error, trace):
        self.file.close()
        if kind is not None:
            self.fs.delete_file(self.draft)
            return
        try:
            self.fs.move(self.draft, self.name)
        except OSError:  # stores that don't replace a file by a move
            self.fs.delete_file(self.name)
            self.fs.move(self.draft, self.name)
