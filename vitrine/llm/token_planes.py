"""Token files of bit or byte planes.

Ids are cut into blocks of a fixed number. A block is transposed into planes: plane k holds bit (or byte) k of
every id, so that the high planes, which hardly change, shrink to almost nothing under zstandard. A file is

    magic, blocks of compressed planes, document index, chunk index, lengths of both indexes, magic

The chunk index says for each block where it begins, how many ids it has and how long each plane is, so any
range of ids is read without the rest. Every id array of a document ends with the end id.

Documents are range-partitioned by id once; each partition becomes one file, committed by a move, so a task that
runs again replaces its own file. Text never passes through the driver, which sees one row per file.

Defined cases: a null or empty text is the end id alone; null identifiers come first; repeated identifiers keep
their own rows, ordered by text; an empty table gives an empty result. A document may span any number of blocks.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vitrine.llm.common import Committed, steps, store, tasks_of, tidy
from vitrine.llm.pieces import LibraryCoder
from vitrine.shared import run_folder, write_out

MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 16
#: Shuffle partitions per file: in a larger range of documents more pieces of text repeat.
TASKS_PER_FILE = 2


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """The planes of a block, lowest first. ``mode``: ``bit`` or ``byte``."""
    rows = ids.view(np.uint8).reshape(len(ids), ids.itemsize)
    if mode == "byte":
        return [rows[:, k].tobytes() for k in range(ids.itemsize)]
    return [np.packbits((rows[:, k // 8] >> (k % 8)) & 1).tobytes() for k in range(8 * ids.itemsize)]


def from_planes(planes: list[bytes], n: int, kind: str, mode: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    rows = np.zeros((n, size), np.uint8)
    for k, plane in enumerate(planes):
        if mode == "byte":
            rows[:, k] = np.frombuffer(plane, np.uint8)
        else:
            rows[:, k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << (k % 8)
    return rows.reshape(-1).view(kind)


class PlaneWriter:
    """Writes one file; holds less than a block and the indexes."""

    def __init__(self, file, kind: str, mode: str = "byte", level: int = 1, block: int = BLOCK_IDS):
        import zstandard
        self.file, self.kind, self.mode, self.block = file, kind, mode, block
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.pending: list[np.ndarray] = []
        self.held = self.n_ids = 0
        self.at = len(MAGIC)
        self.chunks: list[list[int]] = []
        self.docs: list[tuple[int | None, int]] = []
        file.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.pending.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= self.block:
            flat = np.concatenate(self.pending)
            whole = len(flat) - len(flat) % self.block
            for start in range(0, whole, self.block):
                self._write(flat[start:start + self.block])
            self.pending, self.held = [flat[whole:]], len(flat) - whole

    def _write(self, ids: np.ndarray) -> None:
        planes = [self.pack(p) for p in to_planes(np.ascontiguousarray(ids), self.mode)]
        self.chunks.append([self.at, len(ids), *map(len, planes)])
        for plane in planes:
            self.file.write(plane)
            self.at += len(plane)

    def close(self) -> None:
        if self.held:
            self._write(np.concatenate(self.pending))
        docs = self.pack(np.array([(d or 0, d is not None, n) for d, n in self.docs], "<i8").tobytes())
        chunks = self.pack(json.dumps({
            "kind": self.kind, "mode": self.mode, "block": self.block, "n_docs": len(self.docs),
            "chunks": self.chunks}).encode())
        self.file.write(docs + chunks + np.array([len(docs), len(chunks)], "<u8").tobytes() + MAGIC)


class PlaneReader:
    """Reads one open, seekable file of a known size."""

    def __init__(self, file, size: int):
        import zstandard
        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        tail = self._bytes(size - len(MAGIC) - 16, len(MAGIC) + 16)
        if tail[16:] != MAGIC:
            raise ValueError("not a whole file of id planes")
        n_docs, n_chunks = np.frombuffer(tail[:16], "<u8").tolist()
        end = size - len(MAGIC) - 16
        self.head = json.loads(self.unpack(self._bytes(end - n_chunks, n_chunks)))
        rows = np.frombuffer(self.unpack(self._bytes(end - n_chunks - n_docs, n_docs)), "<i8").reshape(-1, 3)
        self.doc_ids = [d if known else None for d, known, _ in rows.tolist()]
        self.sizes = rows[:, 2]

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> np.ndarray:
        at, n, *lengths = self.head["chunks"][k]
        body, planes = self._bytes(at, sum(lengths)), []
        for length in lengths:
            planes.append(self.unpack(body[:length]))
            body = body[length:]
        return from_planes(planes, n, self.head["kind"], self.head["mode"])

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the file, from the blocks that hold them."""
        block, parts = self.head["block"], []
        while n > 0 and start // block < len(self.head["chunks"]):
            part = self.block(start // block)[start % block:][:n]
            if not len(part):
                break
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(parts) if parts else np.zeros(0, self.head["kind"])

    def pieces(self) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(number of the document, some of its ids, whether they are its last), block by block."""
        doc, left = 0, int(self.sizes[0]) if len(self.sizes) else 0
        for k in range(len(self.head["chunks"])):
            ids = self.block(k)
            while len(ids):
                part, ids = ids[:left], ids[left:]
                left -= len(part)
                yield doc, part, left == 0
                if left == 0:
                    doc += 1
                    left = int(self.sizes[doc]) if doc < len(self.sizes) else 0


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, mode: str = "byte",
                block: int = BLOCK_IDS) -> DataFrame:
    """Encode ``doc_id``, ``text`` into files of ascending doc_id; a row per file: file, name, n_docs, n_ids, start."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = LibraryCoder(tokenizer)
        end, number = np.array([end_id], coder.type), TaskContext.get().partitionId()
        name = f"ids-{number:06d}.planes"
        with Committed(folder, name) as file:
            writer = PlaneWriter(file, coder.type, mode, block=block)
            for batch, texts in steps(batches):
                for doc_id, body in zip(batch.column("doc_id").to_pylist(), coder(texts)):
                    writer.add(doc_id, np.append(np.frombuffer(body, coder.type), end))
            writer.close()
        yield pa.RecordBatch.from_pydict(
            {"file": [number], "name": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids]})

    rows = docs.select("doc_id", "text")
    ordered = (
        rows.repartitionByRange(max(8, tasks_of(spark) // TASKS_PER_FILE), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text"))
    written = ordered.mapInArrow(tidy(run), "file long, name string, n_docs long, n_ids long")
    files = write_out(written, folder, "files")
    # one row per file: the running total over them is the only window without a key
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_digests(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Read the files back, each block once: doc_id, start, n_tokens, ids_crc32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, base = store(folder)
                path = f"{base}/{row['name']}"
                with fs.open_input_file(path) as file:
                    reader = PlaneReader(file, file.size())
                    sums = np.zeros(len(reader.sizes), np.int64)
                    crc = 0
                    for doc, ids, last in reader.pieces():
                        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        if last:
                            sums[doc], crc = crc, 0
                    starts = row["start"] + np.cumsum(reader.sizes) - reader.sizes
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.doc_ids, pa.int64()), pa.array(starts, pa.int64()),
                         pa.array(reader.sizes, pa.int64()), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    count = max(1, min(files.count(), tasks_of(spark)))
    return files.repartitionByRange(count, "file").mapInArrow(
        tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, mode: str = "byte") -> DataFrame:
    """Write every document's ids and read the files back."""
    folder = run_folder(docs.sparkSession, "planes")
    files = write_files(docs, folder, tokenizer, mode=mode)
    return read_digests(docs.sparkSession, folder, files)
