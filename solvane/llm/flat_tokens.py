"""Token counts by separator scan over flat, unindexed token files.

A flat file is nothing but ids of one fixed width, each document ended by the
end-of-document id.  ``scan_separators`` reads such files in blocks of a fixed
number of ids, finds the separators of a block with one vector comparison, and
stitches documents across blocks with a prefix scan over the blocks' summaries
(how many separators, where the last one ends).  Blocks of one file, and files,
are scanned by different tasks.

Defined results: a null or empty text is a document of no ids before its
separator (n_tokens 0); a file that does not end with a separator has a last
document with terminated = false; an empty file has no documents; repeated rows
are documents of their own; a null doc_id is kept as null.  Contents of special
tokens in a text are encoded as text, so that a text cannot hold the separator;
with as_text = false they become those tokens' ids, and a text that gives the
separator is refused with an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from solvane.llm.bpe import encoder
from solvane.llm.shared import NewFile, filesystem, only, text_slices, tidy, working_folder, written

#: Ids in one block of a scan.
BLOCK_TOKENS = 1 << 20


def write_flat(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: int = 2, as_text: bool = True) -> DataFrame:
    """Writes one flat file for each partition of docs(doc_id, text); returns (file, ordinal, doc_id), written.

    The files hold ids only.  Which document was the n-th of its file is known
    from the returned table alone.  Ids go to the file as they are made.
    """
    kind = f"<u{width}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"tokens-{TaskContext.get().partitionId():06d}.bin"
        enc, end = encoder(tokenizer, as_text), struct.pack("<I", end_id)
        file, n = None, 0
        for b in text_slices(batches):
            ids = np.frombuffer(end.join(enc.encode(b.column("text").to_pylist())) + end, "<u4")
            if int(np.count_nonzero(ids == end_id)) != b.num_rows:
                raise ValueError(f"a text holds the separator, id {end_id}")
            file = file or NewFile(f"{folder}/{name}")
            file.write(ids.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows, pa.string()), pa.array(np.arange(n, n + b.num_rows)), b.column("doc_id")], ["file", "ordinal", "doc_id"])
            n += b.num_rows
        if file:
            file.finish()

    slim = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(slim.mapInArrow(tidy(write), "file string, ordinal long, doc_id long"), "flat-manifest")


def scan_separators(spark: SparkSession, folder: str, end_id: int, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, start, n_tokens, terminated) of each document in the flat files of folder.

    start counts ids from the file's beginning, separators included; n_tokens
    leaves the separator out.
    """
    from pyarrow import fs as pafs

    fs, path = filesystem(folder)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    files = [(f.base_name, f.size // width) for f in found if f.type == pafs.FileType.File and f.base_name.endswith(".bin")]
    blocks = (
        spark.createDataFrame(files, "file string, size long")
        .where("size > 0")
        .select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block_tokens).cast("long"))).alias("first"))
    )
    blocks = blocks.repartition(max(1, min(10_000, sum(-(-n // max(block_tokens, BLOCK_TOKENS)) for _, n in files))), "file", "first")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = filesystem(folder)
        for b in batches:
            ends, lasts = [], []
            for name, size, first in zip(*(b.column(c).to_pylist() for c in ("file", "size", "first")), strict=True):
                with store.open_input_file(f"{at}/{name}") as f:
                    data = f.read_at(min(block_tokens, size - first) * width, first * width)
                hits = np.flatnonzero(np.frombuffer(data, f"<u{width}") == end_id) + first
                ends.append(hits)
                lasts.append(int(hits[-1]) if len(hits) else None)
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("size"), b.column("first"), pa.array(ends, pa.list_(pa.int64())), pa.array(lasts, pa.int64())], ["file", "size", "first", "ends", "last_end"])

    found = blocks.mapInArrow(tidy(scan), "file string, size long, first long, ends array<long>, last_end long")
    before = Window.partitionBy("file").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("file")
    stitched = found.select(
        "file",
        "size",
        "first",
        "ends",
        F.coalesce(F.max("last_end").over(before) + 1, F.lit(0)).alias("carry"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("base"),
        F.coalesce(F.max("last_end").over(every), F.lit(-1)).alias("final_end"),
    )
    # the block that holds a file's last id also closes an unterminated document
    open_end = (F.col("first") + block_tokens >= F.col("size")) & (F.col("final_end") < F.col("size") - 1)
    ends = F.when(open_end, F.concat("ends", F.array("size"))).otherwise(F.col("ends"))
    rows = stitched.select("file", "size", "carry", "base", ends.alias("ends")).select("file", "size", "carry", "base", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("carry")).otherwise(F.element_at("ends", F.greatest(F.col("k"), F.lit(1))) + 1)
    return rows.select("file", (F.col("base") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), (F.col("end") < F.col("size")).alias("terminated"))


def token_counts(docs: DataFrame, tokenizer: str, end_id: int, width: int = 2, block_tokens: int = BLOCK_TOKENS, as_text: bool = True) -> DataFrame:
    """Writes docs to flat files and counts their tokens by scanning these: (doc_id, file, ordinal, start, n_tokens, terminated)."""
    spark = docs.sparkSession
    folder = working_folder(spark, "flat")
    manifest = write_flat(docs, folder, tokenizer, end_id, width, as_text)
    return scan_separators(spark, folder, end_id, width, block_tokens).join(manifest, ["file", "ordinal"], "left").select("doc_id", "file", "ordinal", "start", "n_tokens", "terminated")
