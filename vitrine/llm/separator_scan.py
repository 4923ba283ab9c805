"""Token counts of flat, unindexed token files by a separator scan.

A flat file is nothing but ids of a fixed width; a document ends with the end-of-document id. Files are cut into
blocks of a fixed number of bytes, whatever documents lie there. Each block is searched with one vectorised
comparison. Documents that cross a border are stitched by a prefix scan over one small row per block: the ids
before the block, the documents that end before it, and where the last of them ended.

The query first writes such files: each task encodes what it reads, appends the end id, and notes only which
document it wrote at which place, so that counts can be told by doc_id. Text isn't shuffled.

Defined cases: a null or empty text counts one id, its end; ids after the last separator form a document that
``ended`` marks as false; an empty file or table has no documents; repeated identifiers keep their own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vitrine.llm.common import Committed, steps, store, tasks_of, tidy
from vitrine.llm.pieces import LibraryCoder
from vitrine.shared import run_folder, write_out

BLOCK_BYTES = 4 << 20
#: Beyond the vocabulary (0 to 50256, <|endoftext|> the last), so that no text yields it.
END_ID = 50257


def write_flat(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write a flat file per task. A row per document: file, doc_no (its place in the file), doc_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number, n = LibraryCoder(tokenizer), TaskContext.get().partitionId(), 0
        if end_id < coder.n_ids:  # inside a text it would end it early
            raise ValueError(f"the end id {end_id} is an id of the vocabulary")
        end = np.array([end_id], coder.type).tobytes()
        with Committed(folder, f"flat-{number:06d}.ids") as file:
            for batch, texts in steps(batches):
                file.write(end.join([*coder(texts), b""]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(texts), number), pa.int64()),
                     pa.array(np.arange(n, n + len(texts)), pa.int64()), batch.column("doc_id").cast(pa.int64())],
                    names=["file", "doc_no", "doc_id"])
                n += len(texts)

    written = docs.select("doc_id", "text").mapInArrow(tidy(run), "file long, doc_no long, doc_id long")
    return write_out(written, folder, "places")


def blocks_of(spark: SparkSession, folder: str, width: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per block of the folder's flat files: name, file, block, at, n_bytes. Only the listing is local."""
    import pyarrow.fs as pafs
    fs, base = store(folder)
    files = [(f.base_name, f.size) for f in fs.get_file_info(pafs.FileSelector(base)) if f.base_name.endswith(".ids")]
    rows = spark.createDataFrame(
        [(name, int(name.split("-")[1].split(".")[0]), size) for name, size in files],
        "name string, file long, size long")
    step = block_bytes - block_bytes % width
    at = F.explode(F.sequence(F.lit(0), F.expr(f"(size - 1) div {step}")))
    return (rows.where("size > 0").select("name", "file", "size", at.alias("block"))
            .select("name", "file", F.col("block").cast("long").alias("block"), (F.col("block") * F.lit(step).cast("long")).alias("at"),
                    F.least(F.lit(step), F.col("size") - F.col("block") * F.lit(step).cast("long")).cast("long").alias("n_bytes")))


def scan(spark: SparkSession, folder: str, kind: str = "<u2", end_id: int = END_ID,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents of the flat files: file, doc_no, start (ids before it in the file), n_tokens, ended."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{base}/{row['name']}") as file:
                    file.seek(row["at"])
                    ids = np.frombuffer(file.read(row["n_bytes"]), kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]], pa.int64()), pa.array([row["block"]], pa.int64()),
                     pa.array([len(ids)], pa.int64()),
                     pa.array([np.flatnonzero(ids == end_id).astype(np.int32)], pa.list_(pa.int32()))],
                    names=["file", "block", "n_ids", "ends"])

    blocks = blocks_of(spark, folder, np.dtype(kind).itemsize, block_bytes)
    found = blocks.repartition(tasks_of(spark), "file", "block").mapInArrow(
        tidy(run), "file long, block long, n_ids long, ends array<int>")
    found = write_out(found, folder, "found")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    small = found.select("file", "block", "n_ids", F.size("ends").alias("n_ends"),
                         F.element_at("ends", F.when(F.size("ends") > 0, -1)).alias("last"))
    small = small.withColumn("offset", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    prefix = small.select(
        "file", "block", "offset", F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.last(F.col("offset") + F.col("last") + 1, True).over(before), F.lit(0)).alias("open_at"),
        F.lead("block").over(order).isNull().alias("final"))
    at = found.join(prefix, ["file", "block"])
    ends = F.transform("ends", lambda e: e + F.col("offset"))
    starts = F.concat(F.array("open_at"), F.transform(ends, lambda e: e + 1))
    n = F.size("ends")
    whole = F.transform(F.arrays_zip(ends.alias("e"), F.slice(starts, 1, n).alias("s")),
                        lambda x: F.struct(x["s"].alias("s"), (x["e"] + 1).alias("e"), F.lit(True).alias("ended")))
    rest = F.array(F.struct(F.element_at(starts, -1).alias("s"), (F.col("offset") + F.col("n_ids")).alias("e"),
                            F.lit(False).alias("ended")))
    open_end = F.col("final") & (F.element_at(starts, -1) < F.col("offset") + F.col("n_ids"))
    return at.select(
        "file", "docs_before", F.posexplode(F.when(open_end, F.concat(whole, rest)).otherwise(whole)).alias("i", "d")
    ).select("file", (F.col("docs_before") + F.col("i")).alias("doc_no"), F.col("d.s").alias("start"),
             (F.col("d.e") - F.col("d.s")).alias("n_tokens"), F.col("d.ended").alias("ended"))


def count_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the documents as flat files, scan these, and tell the counts by document."""
    spark = docs.sparkSession
    folder = run_folder(spark, "flat")
    places = write_flat(docs, folder, tokenizer, end_id)
    return places.join(scan(spark, folder, LibraryCoder(tokenizer).type, end_id), ["file", "doc_no"])
