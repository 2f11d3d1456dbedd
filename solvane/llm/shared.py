"""Working tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvane import core

#: Text handled at once by one Python worker, so that its memory does not follow the row count of a batch.
SLICE_BYTES = 4 << 20
#: Rows of one Arrow batch.
ARROW_ROWS = 1000
_ARROW_LIMIT = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, qualified; a folder of our own where it is unset, as in tests."""
    return core.shared_root(spark)


_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def working_folder(spark: SparkSession, name: str, outer: int = 0) -> str:
    """A new folder's URI under the shared root; nothing is there yet.  The innermost scope, or one ``outer`` it, removes it at its end."""
    path = f"{shared_root(spark)}/solvane/{name}-{uuid.uuid4().hex}"
    scopes = _SCOPES.get()
    if len(scopes) > outer:
        scopes[-1 - outer].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scope(spark: SparkSession):
    """Working folders made inside are removed at the end, but for those of ``written(..., outer=1)``: what is returned must not read the others."""
    own: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in own:
            remove(spark, path)


def written(df: DataFrame, name: str, outer: int = 0, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = working_folder(spark, name, outer)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(filesystem, path) of a URI for raw files, on the driver and on executors."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


class NewFile:
    """A file written bit by bit under another name, and renamed when it is whole: a task that is run again or twice leaves one whole file."""

    def __init__(self, uri: str):
        self._fs, self._path = filesystem(uri)
        self._fs.create_dir(os.path.dirname(self._path), recursive=True)
        self._own = f"{self._path}.{uuid.uuid4().hex}.tmp"
        self._out = self._fs.open_output_stream(self._own)

    def write(self, data: bytes) -> None:
        self._out.write(data)

    def finish(self) -> None:
        from pyarrow import fs as pafs

        self._out.close()
        if not isinstance(self._fs, pafs.LocalFileSystem) and self._fs.get_file_info(self._path).type != pafs.FileType.NotFound:
            self._fs.delete_file(self._path)
        self._fs.move(self._own, self._path)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice holds about limit bytes of text, and one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.fromiter((x or 0 for x in pc.binary_length(b.column(column)).to_pylist()), np.int64, b.num_rows)
        total = np.cumsum(sizes)
        at = 0
        while at < b.num_rows:
            end = int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right"))
            end = max(at + 1, end)
            yield b.slice(at, end - at)
            at = end


def tidy(f):
    """A function for mapInArrow that gives its memory back to the system when a task ends; idle workers stay small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def trim() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; extra ones, whatever they are called, are left out.

    Texts go to Python in batches of ARROW_ROWS rows at most: the session's limit
    is lowered to that if it is higher, since a batch is in memory several times.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ARROW_LIMIT)) <= ARROW_ROWS:
        conf.set(_ARROW_LIMIT, str(ARROW_ROWS))
    return df.select(*[F.col(f"`{n}`") for n in names])


#: Keys of rows to leave out that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
_NO_ID = 2**63 - 1


def text_key(doc_id: str = "doc_id", text_hash: str | None = None, text: str = "text") -> list:
    """Columns (k, mark) that name a document row by its id and text; null ids have a key too."""
    mark = F.col(text_hash) if text_hash else F.xxhash64(F.col(text))
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("k"), mark.alias("mark")]


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs without the rows that keys(k, mark) name; keys must be written, since they are counted first."""
    names = docs.columns
    known = keys.select(F.col("k").alias("w_k"), F.col("mark").alias("w_mark")).distinct()
    if keys.count() <= BROADCAST_KEYS:
        known = F.broadcast(known)
    k, mark = text_key()
    marked = docs.select("*", k.alias("w_own_k"), mark.alias("w_own_mark"))
    return marked.join(known, (F.col("w_own_k") == F.col("w_k")) & (F.col("w_own_mark") == F.col("w_mark")), "left_anti").select(*[F.col(f"`{n}`") for n in names])
