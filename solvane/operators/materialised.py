"""Results kept by content: two tiers under a key, with counts of hits and misses, bounds, checksums and recovery.

The memory tier is Spark's own (``persist``) for the results used last; the disk
tier is Parquet in a folder.  A result's key is a digest of what it is made from.
A folder without its seal is not a result; a result that does not give its seal's
checksum is damaged, and made again.
"""

from __future__ import annotations

import hashlib
import json
import threading
from collections import OrderedDict
from collections.abc import Callable
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def key_of(name: str, *parts: object) -> str:
    """A digest of a name and of what a result is made from."""
    return hashlib.sha256(json.dumps([name, *map(str, parts)]).encode()).hexdigest()


class Materialised:
    """A folder of results; the oldest go when there are more than ``entries``, of which ``held`` are in memory."""

    def __init__(self, spark: SparkSession, folder: str, entries: int = 64, held: int = 4):
        self.spark, self.folder, self.entries, self.held = spark, folder.rstrip("/"), entries, held
        self.hits = self.misses = self.recovered = 0
        self._memory: OrderedDict[str, DataFrame] = OrderedDict()
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @staticmethod
    def _checksum(df: DataFrame) -> str:
        """Rows and the exact sum of their hashes: the same in any order."""
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
        return f"{r['n']}:{r['h']}"

    def _sealed(self, at: str) -> str | None:
        seal = self._path(f"{at}/_seal")
        if not self._fs.exists(self._path(f"{at}/_SUCCESS")) or not self._fs.exists(seal):
            return None
        stream = self._fs.open(seal)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _made(self, at: str, make: Callable[[], DataFrame]) -> DataFrame:
        make().write.mode("overwrite").parquet(at)
        out = self.spark.read.parquet(at)
        stream = self._fs.create(self._path(f"{at}/_seal"), True)
        stream.write(bytearray(self._checksum(out).encode()))
        stream.close()
        self._evict()
        return out

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The result under a key; made and written if it is not there, and again if it is damaged."""
        at = f"{self.folder}/{key}"
        seal = self._sealed(at)
        if key in self._memory:
            if seal is not None:
                self.hits += 1
                self._memory.move_to_end(key)
                return self._memory[key]
            self._memory.pop(key).unpersist()
        if seal is None:
            self.misses += 1
            out = self._made(at, make)
        else:
            self.hits += 1
            try:
                out = self.spark.read.parquet(at)
                whole = self._checksum(out) == seal
            except Exception:  # a file of it cannot be read
                whole = False
            if not whole:
                self.recovered += 1
                out = self._made(at, make)
        self._memory[key] = out.persist(StorageLevel.MEMORY_AND_DISK)
        while len(self._memory) > self.held:
            self._memory.popitem(last=False)[1].unpersist()
        return out

    def _results(self) -> list:
        return sorted(self._fs.listStatus(self._path(self.folder)), key=lambda s: s.getModificationTime())

    def _evict(self) -> None:
        for s in self._results()[: -self.entries]:
            self._fs.delete(s.getPath(), True)
            held = self._memory.pop(s.getPath().getName(), None)
            if held is not None:
                held.unpersist()

    def stats(self) -> dict[str, int]:
        there = self._results() if self._fs.exists(self._path(self.folder)) else []
        return {"hits": self.hits, "misses": self.misses, "entries": len(there)}

    def tiers(self) -> dict[str, int]:
        """How many results are in memory, and how many damaged ones were made again."""
        return {"held": len(self._memory), "recovered": self.recovered}

    def clear(self) -> None:
        while self._memory:
            self._memory.popitem()[1].unpersist()
        self._fs.delete(self._path(self.folder), True)
        self.hits = self.misses = self.recovered = 0


@contextmanager
def cancellable(spark: SparkSession, tag: str):
    """Jobs started inside carry a tag; ``spark.interruptTag(tag)`` from anywhere stops them."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


class Queue:
    """At most ``running`` analyses at once, each in its own scheduler pool, and ``waiting`` more; others are refused at once."""

    def __init__(self, spark: SparkSession, running: int = 2, waiting: int = 8):
        self.spark = spark
        self._run, self._wait = threading.BoundedSemaphore(running), threading.BoundedSemaphore(running + waiting)

    @contextmanager
    def slot(self, pool: str):
        """Jobs started inside run in the pool; raises RuntimeError if too many wait already."""
        if not self._wait.acquire(blocking=False):
            raise RuntimeError("the queue is full")
        try:
            with self._run:
                context = self.spark.sparkContext
                before = context.getLocalProperty("spark.scheduler.pool")
                context.setLocalProperty("spark.scheduler.pool", pool)
                try:
                    yield
                finally:
                    context.setLocalProperty("spark.scheduler.pool", before)
        finally:
            self._wait.release()
